"""Queries over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from qvault.functions.findings import algorithm_family, effective_severity, finding_fingerprint, severity_rank
from qvault.operators import findings as op
from qvault.plans.bindings import findings, over
from qvault.plans.registry import query

ID = ["scan_id", "ordinal"]
W1 = "w1 AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, file, line, rule_id ORDER BY ordinal) AS n FROM findings) WHERE n = 1)"
MERGE = "list_reduce(list(struct_pack(ordinal := ordinal, specificity := specificity, mode := mode) ORDER BY ordinal), lambda a, x: CASE WHEN x.specificity > a.specificity THEN struct_pack(ordinal := x.ordinal, specificity := x.specificity, mode := coalesce(x.mode, a.mode)) ELSE struct_pack(ordinal := a.ordinal, specificity := a.specificity, mode := coalesce(a.mode, x.mode)) END)"
FAMILY = "CASE WHEN upper(regexp_replace(trim(regexp_replace(split_part(algorithm, ' ', 1), '[-_]?\\d{2,4}([-_].*)?$', '')), '[-_/]', '-', 'g')) = '' THEN 'unknown' ELSE upper(regexp_replace(trim(regexp_replace(split_part(algorithm, ' ', 1), '[-_]?\\d{2,4}([-_].*)?$', '')), '[-_/]', '-', 'g')) END"
RANK = "CASE {} WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
W2 = f"""w2 AS (SELECT f.* REPLACE (w.w.mode AS mode) FROM w1 f JOIN (
  SELECT scan_id, file, line, detection_method, algorithm, category, {MERGE} AS w FROM w1 GROUP BY ALL
) w ON f.scan_id = w.scan_id AND f.ordinal = w.w.ordinal AND f.file = w.file AND f.line = w.line AND f.detection_method = w.detection_method AND f.algorithm = w.algorithm AND f.category = w.category)"""
W3 = f"""fam AS (SELECT *, {FAMILY} AS family FROM w2), won AS (
  SELECT scan_id, file, line, family, {MERGE} AS w, count(*) AS members, array_to_string(list_sort(list_distinct(list(upper(detection_method)))), ', ') AS methods FROM fam WHERE NOT generic GROUP BY ALL
), w3 AS (
  SELECT f.* EXCLUDE (family) REPLACE (w.w.mode AS mode, CASE WHEN members >= 2 THEN 'Confirmed' ELSE confidence END AS confidence), CASE WHEN members >= 2 THEN methods ELSE upper(detection_method) END AS detection
  FROM fam f JOIN won w ON f.scan_id = w.scan_id AND f.file = w.file AND f.line = w.line AND f.family = w.family AND f.ordinal = w.w.ordinal WHERE NOT generic
  UNION ALL SELECT * EXCLUDE (family), upper(detection_method) FROM fam WHERE generic
)"""
W4 = """w4 AS (SELECT * EXCLUDE (sp, kms, best) FROM (
  SELECT *, max(CASE WHEN generic THEN 0 ELSE 1 END) OVER (PARTITION BY scan_id, file, line) AS sp,
    max(CASE WHEN category IN ('Cloud KMS / HSM', 'Cloud KMS', 'Hardware Module') THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, file, line) AS kms,
    max(specificity) OVER (PARTITION BY scan_id, file, line, category) AS best FROM w3
) WHERE NOT ((generic AND (sp = 1 OR specificity < best)) OR (kms = 1 AND category IN ('hardcoded-secret', 'secret'))))"""


@query("w1_dedup_exact", over("findings", f"WITH {W1} SELECT scan_id, ordinal, file, line, rule_id FROM w1"))
def w1(spark, d):
    return op.dedup_exact(findings(spark, d)).select(*ID, "file", "line", "rule_id")


@query("w2_collapse_same_layer", over("findings", f"WITH {W1}, {W2} SELECT scan_id, ordinal, mode, specificity FROM w2"))
def w2(spark, d):
    return op.collapse_same_layer(op.dedup_exact(findings(spark, d))).select(*ID, "mode", "specificity")


@query("w3_corroborate", over("findings", f"WITH {W1}, {W2}, {W3} SELECT scan_id, ordinal, mode, confidence, detection FROM w3"))
def w3(spark, d):
    return op.corroborate(op.collapse_same_layer(op.dedup_exact(findings(spark, d)))).select(*ID, "mode", "confidence", "detection")


@query("w4_suppress_generic", over("findings", f"WITH {W1}, {W2}, {W3}, {W4} SELECT scan_id, ordinal, confidence, detection, category FROM w4"))
def w4(spark, d):
    return op.deduplicate(findings(spark, d), dealt=True).select(*ID, "confidence", "detection", "category")


@query(
    "w5_merge_secrets",
    over(
        "findings",
        f"""WITH m AS (SELECT *, CASE WHEN language IN ('python', 'javascript') AND NOT starts_with(rule_id, 'entropy-') THEN 'ast' WHEN starts_with(rule_id, 'entropy-') THEN 'entropy'
  WHEN language = 'infra' OR contains(rule_id, 'infra') THEN 'infra' WHEN language = 'manifest' OR starts_with(rule_id, 'sca-') THEN 'manifest' ELSE 'config' END AS lay,
  category IN ('hardcoded-secret', 'secret') OR rule_id = 'aes-hardcoded-key' AS sec, {RANK.format('severity')} AS r FROM findings),
s AS (SELECT scan_id, file, line, count(DISTINCT lay) AS layers FROM m GROUP BY ALL),
o AS (SELECT scan_id, file, line, sec, count(DISTINCT lay) AS own, count(*) AS members, max(r) AS worst FROM m GROUP BY ALL),
j AS (SELECT m.*, layers, own, members, worst, row_number() OVER (PARTITION BY m.scan_id, m.file, m.line, m.sec ORDER BY CASE rule_id WHEN 'infra-k8s-secret-plaintext' THEN 120 WHEN 'aes-hardcoded-key' THEN 110 WHEN 'entropy-secret-high-confidence' THEN 100 WHEN 'config-plaintext-secret' THEN 40 ELSE 30 END DESC, r DESC, rule_id DESC, ordinal) AS n
  FROM m JOIN s USING (scan_id, file, line) JOIN o USING (scan_id, file, line, sec))
SELECT scan_id, ordinal, CASE WHEN layers >= 2 THEN 'Confirmed' ELSE confidence END AS confidence,
  CASE WHEN sec AND layers >= 2 AND own >= 2 AND members >= 2 THEN CASE worst WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Informational' END ELSE severity END AS severity
FROM j WHERE NOT (sec AND layers >= 2 AND own >= 2 AND members >= 2 AND n > 1)""",
    ),
)
def w5(spark, d):
    return op.merge_secrets(findings(spark, d)).select(*ID, "confidence", "severity")


SUPPRESSIONS = [(1, "md5-hashing", None, None, None, 1), (2, None, "tests/unit/test_hash.py", None, None, None), (3, "rsa-keygen", "server.js", 10, None, None), (4, "SHA-1", "app.yml", None, None, 2), (5, None, None, 11, None, 0)]


@query(
    "x4_apply_suppressions",
    over(
        "findings",
        """WITH r(ro, rr, rp, rl, rk) AS (VALUES (1, 'md5-hashing', NULL, NULL, 1), (2, NULL, 'tests/unit/test_hash.py', NULL, NULL), (3, 'rsa-keygen', 'server.js', 10, NULL), (4, 'sha-1', 'app.yml', NULL, 2), (5, NULL, NULL, 11, 0)),
h AS (SELECT scan_id, ordinal, ro FROM findings JOIN r ON (rk IS NULL OR rk = scan_id % 3) AND (rr IS NULL OR rr = lower(rule_id) OR rr = lower(algorithm)) AND (rl IS NULL OR rl = line)
  AND (rp IS NULL OR lower(file) = rp OR ends_with(lower(file), '/' || rp) OR ends_with(rp, '/' || lower(file)) OR string_split(lower(file), '/')[-1] = string_split(rp, '/')[-1])),
k AS (SELECT scan_id, ordinal, min(ro) AS ro FROM h GROUP BY ALL)
SELECT f.scan_id, f.ordinal, suppressed OR ro IS NOT NULL AS suppressed, CASE ro WHEN 1 THEN 'rule' WHEN 2 THEN 'path' WHEN 3 THEN 'rule, path and line' WHEN 4 THEN 'rule and path' WHEN 5 THEN 'path' END AS suppression_reason
FROM findings f LEFT JOIN k ON f.scan_id = k.scan_id AND f.ordinal = k.ordinal""",
    ),
)
def x4(spark, d):
    rules = spark.createDataFrame(SUPPRESSIONS, "ordinal int, rule_id string, path string, line int, token string, repo_id long")
    return op.apply_suppressions(findings(spark, d).withColumn("repo_id", F.col("scan_id") % 3), rules).select(*ID, "suppressed", "suppression_reason")


@query("p31_active", over("findings", "SELECT scan_id, ordinal FROM findings WHERE NOT suppressed AND status <> 'RESOLVED'"))
def p31(spark, d):
    return op.active(findings(spark, d)).select(*ID)


@query("o1_order_findings", over("findings", f"SELECT scan_id, ordinal, file, line, {RANK.format('severity')} AS severity_rank FROM findings ORDER BY file, line, severity_rank DESC, specificity DESC, ordinal"))
def o1(spark, d):
    return op.order_findings(findings(spark, d)).select(*ID, "file", "line", severity_rank(F.col("severity")).alias("severity_rank"))


@query("o4_capped_rows", over("findings", f"SELECT * FROM (SELECT scan_id, ordinal, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY {RANK.format('severity')} DESC, ordinal) AS INTEGER) AS rank, greatest(count(*) OVER (PARTITION BY scan_id) - 3, 0) AS overflow FROM findings) WHERE rank <= 3"))
def o4(spark, d):
    return op.capped_rows(findings(spark, d), ["scan_id"], [severity_rank(F.col("severity")).desc(), F.col("ordinal")], 3).select(*ID, "rank", "overflow")


@query("o5_page", over("findings", "SELECT scan_id, ordinal FROM findings ORDER BY scan_id DESC, ordinal DESC LIMIT 25 OFFSET 50"))
def o5(spark, d):
    return op.page(findings(spark, d), [F.desc("scan_id"), F.desc("ordinal")], 25, 50).select(*ID)


@query("u1_union_layers", over("findings", "SELECT scan_id, ordinal, rule_id, mode FROM findings WHERE language = 'python' UNION ALL SELECT scan_id, ordinal, rule_id, NULL FROM findings WHERE language = 'go'"))
def u1(spark, d):
    f = findings(spark, d).select(*ID, "rule_id", "mode", "language")
    return op.union_layers(f.where("language = 'python'").drop("language"), f.where("language = 'go'").drop("language", "mode"))


@query("u2_keyed_except", over("findings", "SELECT scan_id, ordinal, file FROM findings f WHERE specificity = 1 AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.specificity = 4 AND g.scan_id = f.scan_id AND g.file = f.file)"))
def u2(spark, d):
    f = findings(spark, d)
    return op.keyed_except(f.where("specificity = 1"), f.where("specificity = 4"), ["scan_id", "file"]).select(*ID, "file")


@query("u2_keyed_intersect", over("findings", "SELECT scan_id, ordinal, file FROM findings f WHERE specificity = 1 AND EXISTS (SELECT 1 FROM findings g WHERE g.specificity = 4 AND g.scan_id = f.scan_id AND g.file = f.file)"))
def u2b(spark, d):
    f = findings(spark, d)
    return op.keyed_intersect(f.where("specificity = 1"), f.where("specificity = 4"), ["scan_id", "file"]).select(*ID, "file")


@query("u3_union_distinct", over("findings", "SELECT file, algorithm FROM findings WHERE generic UNION SELECT file, algorithm FROM findings WHERE suppressed"))
def u3(spark, d):
    f = findings(spark, d)
    return op.union_distinct(f.where("generic").select("file", "algorithm"), f.where("suppressed").select("file", "algorithm"))


@query(
    "s12_stored_findings",
    over(
        "findings",
        """SELECT substr(sha256(concat_ws(':', scan_id, file, line, rule_id, ordinal)), 1, 32) AS id, scan_id, left(file, 512) AS file_path, line AS line_number, algorithm,
  coalesce(key_size, TRY_CAST(nullif(regexp_extract(algorithm, '(\\d{3,4})', 1), '') AS INTEGER)) AS key_size,
  CASE WHEN quantum_risk IN ('Quantum-Broken', 'Quantum-Weakened') THEN 'vulnerable' WHEN quantum_risk = 'Safe' THEN 'safe' ELSE 'unknown' END AS quantum_status, lower(severity) AS severity FROM findings""",
    ),
)
def s12(spark, d):
    return op.stored_findings(findings(spark, d))


@query(
    "a1_summarize",
    over(
        "findings",
        """WITH t AS (SELECT 'total' AS dimension, 'all' AS value, suppressed FROM findings UNION ALL SELECT 'severity', severity, suppressed FROM findings UNION ALL SELECT 'quantum_risk', quantum_risk, suppressed FROM findings UNION ALL SELECT 'language', language, suppressed FROM findings)
SELECT dimension, value, count(*) FILTER (WHERE NOT suppressed) AS active, count(*) FILTER (WHERE suppressed) AS suppressed FROM t GROUP BY dimension, value""",
    ),
)
def a1(spark, d):
    return op.summarize(findings(spark, d))


@query("a1_files_with_findings", over("findings", f"SELECT scan_id, count(DISTINCT file) AS files, count(*) FILTER (WHERE NOT suppressed) AS active, count(*) FILTER (WHERE suppressed) AS suppressed, ['Informational', 'Low', 'Medium', 'High', 'Critical'][max({RANK.format('severity')}) FILTER (WHERE NOT suppressed) + 1] AS worst FROM findings GROUP BY scan_id"))
def a1_files(spark, d):
    return op.files_with_findings(findings(spark, d))


@query("f1_finding_fingerprint", over("findings", "SELECT scan_id, ordinal, substr(sha256(rule_id || ':' || algorithm || ':' || trim(code_snippet)), 1, 16) AS fingerprint FROM findings"))
def f1(spark, d):
    return findings(spark, d).select(*ID, finding_fingerprint(F.col("rule_id"), F.col("algorithm"), F.col("code_snippet")).alias("fingerprint"))


@query("f10_algorithm_family", over("findings", f"SELECT {FAMILY} AS family, CASE WHEN quantum_risk = 'Quantum-Broken' THEN 'Critical' ELSE severity END AS severity, count(*) AS n FROM findings GROUP BY ALL"))
def f10(spark, d):
    f = findings(spark, d).select(algorithm_family(F.col("algorithm")).alias("family"), effective_severity(F.col("severity"), F.col("quantum_risk")).alias("severity"))
    return f.groupBy("family", "severity").agg(F.count("*").alias("n"))
