"""Queries of scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from qvault.functions import scores as sc
from qvault.functions import text as ft
from qvault.operators import findings as fo
from qvault.operators import rollups as op
from qvault.plans.bindings import catalogue, findings, over, pick, plain, scans, sql
from qvault.plans.q_findings import FAMILY as DEDUP_FAMILY
from qvault.plans.q_findings import RANK
from qvault.plans.q_scores import GUIDED, SCORED, guided
from qvault.plans.registry import query
from qvault.storage import load

SEV = RANK.format("severity")
NAME = "CASE {} WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Informational' END"
def scored(spark, d):
    return op.scored_findings(findings(spark, d))


@query("f9_version_compare", "SELECT p_partkey AS id, (p_partkey % 3, p_partkey % 20, p_partkey % 7) < (1, 10, 0) AS older FROM part")
def f9(spark, d):
    v = F.expr("concat('v', p_partkey % 3, '.', p_partkey % 20, '.', p_partkey % 7)")
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), ft.version_lt(v, F.lit("1.10")).alias("older"))


@query("f7_masked_evidence", "SELECT doc_id, '****' || right(text, 4) AS evidence, length(text) AS n FROM documents")
def f7(spark, d):
    return load(spark, d, "documents").select("doc_id", ft.masked_evidence(F.col("text")).alias("evidence"), F.char_length("text").cast("long").alias("n"))


@query("f25_noisy_or", over("catalogue", "SELECT asset_id, round(least(0.9, 1 - (1 - 0.6) * (1 - size / 100.0) * (1 - 0.2)), 6)::DOUBLE AS score FROM catalogue"))
def f25(spark, d):
    return catalogue(spark, d).select("asset_id", F.round(ft.noisy_or(F.array(F.lit(0.6), F.col("size") / 100.0, F.lit(0.2))), 6).alias("score"))


@query("f28_field_id", over("catalogue", "SELECT asset_id, 'field-' || substr(sha256('[\"' || name || '\",\"' || file || '\"]'), 1, 24) AS field_id FROM catalogue"))
def f28(spark, d):
    return catalogue(spark, d).select("asset_id", F.concat(F.lit("field-"), F.substring(F.sha2(F.to_json(F.array("name", "file")), 256), 1, 24)).alias("field_id"))


LIMITS = {"tls record": 16384, "mtu": 1500, "jwt header": 4096, "smart card": 2048}


@query("j21_pqc_size_impact", over("catalogue", f"WITH {GUIDED}, z AS (SELECT asset_id, CASE family WHEN 'RSA' THEN 512 WHEN 'ECC' THEN 128 WHEN 'DH' THEN 512 END AS bytes_now, CASE recommended WHEN 'ML-KEM-768' THEN 2272 WHEN 'ML-DSA-65' THEN 5261 END AS bytes_new FROM g) SELECT asset_id, CAST(bytes_now AS INTEGER) AS bytes_now, CAST(bytes_new AS INTEGER) AS bytes_new, concat_ws(',', CASE WHEN bytes_new > 4096 THEN 'jwt header' END, CASE WHEN bytes_new > 1500 THEN 'mtu' END, CASE WHEN bytes_new > 2048 THEN 'smart card' END, CASE WHEN bytes_new > 16384 THEN 'tls record' END) AS breaks FROM z WHERE bytes_now IS NOT NULL AND bytes_new IS NOT NULL"))
def j21(spark, d):
    return op.pqc_size_impact(guided(spark, d), LIMITS)


@query("a2_systems_rollup", over("findings", f"SELECT split_part(file, '/', 1) AS system, count(*) AS findings, count(*) FILTER (WHERE {SEV} = 4) AS critical, count(DISTINCT algorithm) AS algorithms, CAST(least(100, sum({SEV} * 5)) AS INTEGER) AS risk_score FROM findings GROUP BY ALL"))
def a2(spark, d):
    return op.systems_rollup(findings(spark, d))


@query("a3_rollup_systems", over("findings", f"WITH {SCORED} SELECT {sc.service_of_path('file', True)} AS system, {NAME.format(f'max({SEV})')} AS highest, CAST(floor(avg(score) + 0.5) AS INTEGER) AS mean_score, count(*) AS findings FROM s GROUP BY ALL"))
def a3(spark, d):
    return op.rollup_systems(scored(spark, d))


@query("a10_hndl_analysis", over("findings", f"WITH {SCORED} SELECT scan_id, count(*) FILTER (WHERE purpose <> 'digital_signature') AS confidentiality, count(*) FILTER (WHERE purpose = 'digital_signature') AS authenticity, round(0.5 * max(score) + 0.5 * avg(score), 6)::DOUBLE AS portfolio, count(*) FILTER (WHERE score < 25) AS b0, count(*) FILTER (WHERE score >= 25 AND score < 50) AS b1, count(*) FILTER (WHERE score >= 50 AND score < 75) AS b2, count(*) FILTER (WHERE score >= 75) AS b3, count(DISTINCT (file, line)) AS places FROM s GROUP BY scan_id"))
def a10(spark, d):
    return op.hndl_analysis(scored(spark, d), "scan_id").withColumn("portfolio", F.round("portfolio", 6))


@query("a10_hndl_algorithms", over("findings", f"WITH {SCORED} SELECT scan_id, algorithm, count(*) AS findings, max(score) AS max_score, count(DISTINCT (file, line)) AS places, ['low', 'low', 'medium', 'high', 'critical', 'critical'][CAST(max(score) // 20 AS INTEGER) + 1] AS band FROM s GROUP BY scan_id, algorithm"))
def a10b(spark, d):
    return op.hndl_algorithms(scored(spark, d), "scan_id")


@query("a13_migration_blockers", over("findings", "WITH n AS (SELECT scan_id, algorithm, count(DISTINCT file) AS n FROM findings GROUP BY ALL) SELECT scan_id, count(*) FILTER (WHERE category IN ('hardcoded-secret', 'secret')) AS hardcoded, count(*) FILTER (WHERE library IS NULL) AS unsupported, count(*) FILTER (WHERE n > 5) AS wide, round(avg(greatest(0, 100 - CASE WHEN category IN ('hardcoded-secret', 'secret') THEN 40 ELSE 0 END - CASE WHEN library IS NULL THEN 20 ELSE 0 END - least(40, 5 * n - 5))), 6) AS mean_agility FROM findings JOIN n USING (scan_id, algorithm) GROUP BY scan_id"))
def a13b(spark, d):
    return op.migration_blockers(findings(spark, d), "scan_id")


@query("a11_repo_risk_score", over("findings", f"SELECT scan_id, sum(v) AS points, greatest(8.0, least(99.0, floor(100 * (1 - exp(-sum(v) / 32)) + 0.5)))::DOUBLE AS risk FROM (SELECT scan_id, CASE {SEV} WHEN 4 THEN 6.0 WHEN 3 THEN 3.0 WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS v FROM findings) GROUP BY scan_id"))
def a11(spark, d):
    return op.repo_risk_score(findings(spark, d), "scan_id")


REPOS = f"SELECT c_custkey AS repo_id, {pick('c_custkey', 'Critical', 'HIGH', 'standard', 'low', None, 'odd')} AS criticality FROM {{customer}}"
TIER = "CASE lower(criticality) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'standard' THEN 2 WHEN 'low' THEN 1 END"
TIERED = f"t AS (SELECT f.*, coalesce({TIER}, 2) AS tier FROM findings f LEFT JOIN orders o ON f.scan_id = o.o_orderkey LEFT JOIN ({plain(REPOS)}) r ON o.o_custkey = r.repo_id)"


def tiered(spark, d):
    return op.with_criticality(findings(spark, d), scans(spark, d), sql(spark, d, REPOS))


@query("j17_with_criticality", over("findings", f"WITH {TIERED} SELECT scan_id, ordinal, CAST(tier AS INTEGER) AS tier FROM t"))
def j17(spark, d):
    return tiered(spark, d).select("scan_id", "ordinal", "tier")


@query("a12_o6_migration_candidates", over("findings", f"WITH {TIERED}, a AS (SELECT algorithm, count(DISTINCT file) AS files, CAST(max(tier) AS INTEGER) AS tier, CAST(max({SEV}) AS INTEGER) AS worst, bool_or(exposure <> 'internal') AS exposed FROM t GROUP BY algorithm) SELECT *, CAST(row_number() OVER (ORDER BY worst DESC, tier DESC, files DESC, algorithm) AS INTEGER) AS rank FROM a"))
def a12(spark, d):
    return op.migration_candidates(tiered(spark, d))


@query("a13_migration_plan", over("findings", f"WITH {SCORED} SELECT scan_id, CASE quantum_risk WHEN 'Quantum-Broken' THEN 'migrate' WHEN 'Classical Risk' THEN 'replace' WHEN 'Quantum-Weakened' THEN 'strengthen' ELSE 'monitor' END AS action, count(*) AS findings, count(DISTINCT file) AS files, max(score) AS max_score FROM s GROUP BY ALL"))
def a13(spark, d):
    return op.migration_plan(scored(spark, d), "scan_id")


@query("a23_projected_drop", over("findings", f"WITH {SCORED}, w AS (SELECT scan_id, sum(score) AS t, count(*) AS n FROM s GROUP BY scan_id), o AS (SELECT scan_id, algorithm, sum(score) AS own, sum(least(score, 10)) AS aft FROM s GROUP BY ALL) SELECT scan_id, algorithm, round(t / n, 6)::DOUBLE AS before, round((t - own + aft) / n, 6)::DOUBLE AS after FROM o JOIN w USING (scan_id)"))
def a23(spark, d):
    r = op.projected_drop(scored(spark, d), "scan_id")
    return r.withColumn("before", F.round("before", 6)).withColumn("after", F.round("after", 6))


@query("p35_migration_scope", over("findings", f"SELECT scan_id, file, sha256(code_snippet) AS secret, string_agg(DISTINCT CAST(line AS VARCHAR), ',' ORDER BY CAST(line AS VARCHAR)) AS lines, {NAME.format(f'max({SEV})')} AS severity FROM findings WHERE category IN ('hardcoded-secret', 'secret') GROUP BY ALL"))
def p35(spark, d):
    return op.migration_scope(findings(spark, d))


MOVING = f"SELECT p_partkey AS id, {pick('p_partkey', 'RSA-2048', 'AES-128-CBC', 'Hardcoded Secret Material', 'MD5', 'Ed25519', 'ECDH', 'ChaCha20', 'sha-1', None)} AS algorithm, {pick('p_size', 'key exchange', 'jwt signing', 'secret store', 'file encryption', None)} AS usage, {pick('p_partkey + p_size', 'Critical', 'High', 'Info', 'Medium', 'Safe', None)} AS severity FROM {{part}}"


@query("p35_migration_items", f"""WITH m AS (SELECT *, lower(coalesce(algorithm, 'unknown')) AS a, lower(coalesce(usage, 'general')) AS u, upper(coalesce(severity, 'medium')) AS s FROM ({plain(MOVING)})),
k AS (SELECT *, CASE WHEN regexp_matches(a, 'secret|key material|password|token|hardcoded') OR contains(u, 'secret') THEN 'SECRET_HYGIENE' WHEN regexp_matches(a, 'rsa|dh|dsa|ed25519|ed448|curve25519|x25519|x448|ecc') THEN 'PQC_REPLACEMENT' ELSE 'SYMMETRIC_HASH_UPGRADE' END AS remediation_class FROM m)
SELECT id, s NOT IN ('SAFE', 'INFO') AS in_scope, remediation_class, CASE remediation_class WHEN 'SECRET_HYGIENE' THEN 'Environment variable or approved secret manager; rotate exposed key' WHEN 'PQC_REPLACEMENT' THEN CASE WHEN regexp_matches(u || ' ' || a, 'sign|verify|jwt|certificate|eddsa|ecdsa|ed25519|ed448') THEN 'ML-DSA-65 (FIPS 204) or SLH-DSA (FIPS 205)' ELSE 'ML-KEM-768 (FIPS 203); consider a reviewed hybrid during transition' END
 ELSE CASE WHEN regexp_matches(a, 'md5|sha1|sha-1') THEN 'SHA-256 / SHA3-256' WHEN regexp_matches(a, 'aes-?128') THEN 'AES-256-GCM' ELSE 'AES-256-GCM or ChaCha20-Poly1305, selected for the observed operation' END END AS target, CASE s WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS priority FROM k""")
def p35_items(spark, d):
    return op.migration_items(sql(spark, d, MOVING)).select("id", "in_scope", "remediation_class", "target", "priority")


MOVES_TO = f"SELECT p_partkey AS move_id, {pick('p_partkey', 'RSA 4096', 'ecdsa', 'X25519', 'AES-128', 'prime256 P-256', 'ECDH', 'unknown', 'ed25519 key', 'rsa')} AS current, {pick('p_size', 'ML-DSA-65', 'Kyber768', 'SLH-DSA-SHA2-128f', 'Hybrid X25519', 'Falcon512', 'SHA3', 'ML-KEM-1024')} AS replacement, p_size % 2 = 0 AS hybrid FROM {{part}}"
#: Sizes as rows of their own: family, whether it exchanges keys, key, and what is sent.
MOVED_SQL = f"""WITH m AS ({plain(MOVES_TO)}), a(t, kem, k, s, x, mixed) AS (VALUES ('RSA 4096', false, 512, 512, 512, false), ('ecdsa', false, 64, 64, 32, false), ('X25519', true, 32, 32, 32, false), ('prime256 P-256', false, 64, 64, 32, false), ('ECDH', true, 65, 65, 65, false), ('ed25519 key', false, 32, 64, 32, false), ('rsa', false, 256, 256, 256, false),
 ('ML-DSA-65', false, 1952, 3309, 3309, false), ('Kyber768', true, 1184, 1088, 1088, false), ('SLH-DSA-SHA2-128f', false, 32, 17088, 17088, false), ('Hybrid X25519', true, 1216, 1120, 1120, true), ('Falcon512', false, 897, 666, 666, false), ('ML-KEM-1024', true, 1568, 1568, 1568, false)),
j AS (SELECT move_id, c.k AS k0, c.s AS s0, CASE WHEN hybrid AND NOT r.mixed AND (c.kem OR r.kem) THEN r.k + c.k ELSE r.k END AS k1, CASE WHEN hybrid AND NOT r.mixed AND (c.kem OR r.kem) THEN c.x + r.x ELSE r.s END AS s1, CASE WHEN c.kem THEN c.x ELSE 32 END AS x0, CASE WHEN r.kem THEN r.x WHEN c.kem THEN c.x ELSE 32 END AS x1 FROM m JOIN a c ON c.t = current JOIN a r ON r.t = replacement),
o AS (SELECT move_id, unnest([1, 2, 3, 4, 5]) AS o, * EXCLUDE (move_id) FROM j),
v AS (SELECT move_id, ['cookie', 'header line', 'first flight', 'QR code', 'radio frame'][o] AS scenario, [ceil((s0 + 236) * 4 / 3.0) + 2, ceil((s0 + 236) * 4 / 3.0) + 2, (k0 + s0 + 300) * 3 + x0, s0, ceil(s0 / 20.0)][o] AS before, [ceil((s1 + 236) * 4 / 3.0) + 2, ceil((s1 + 236) * 4 / 3.0) + 2, (k1 + s1 + 300) * 3 + x1, s1, ceil(s1 / 20.0)][o] AS after, [4096, 8192, 14600, 2953, 20][o] AS lim, o, s1 FROM o)
SELECT move_id, scenario, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(lim AS BIGINT) AS "limit", CASE WHEN o = 5 THEN s1 ELSE after END > lim AS breached FROM v"""


@query("j21_size_scenarios", MOVED_SQL)
def j21_scenarios(spark, d):
    return op.size_scenarios(sql(spark, d, MOVES_TO))


@query("j22_affected_findings", over("findings", "WITH f AS (SELECT *, CASE ordinal % 4 WHEN 0 THEN NULL WHEN 1 THEN 'custom' ELSE algorithm END AS a, CASE ordinal % 3 WHEN 0 THEN 'node-rsa' WHEN 1 THEN 'PyOpenSSL' END AS lib, CASE WHEN line = 10 THEN 'new RSA(2048)' ELSE 'x' END AS code FROM findings) SELECT DISTINCT scan_id, file, line, a AS algorithm, detection_method FROM f WHERE CASE WHEN regexp_matches(upper(a), 'RSA|AES|DES|MD5|SHA|P-256|RC4|ECDH|KEM') THEN contains(upper(a), 'RSA') WHEN lib IS NOT NULL THEN true WHEN lib IS NULL AND regexp_matches(upper(category), 'RSA|AES|DES|MD5|SHA') THEN false ELSE contains(code, 'RSA') END"))
def j22_findings(spark, d):
    f = findings(spark, d).withColumns({"algorithm": F.expr("CASE ordinal % 4 WHEN 0 THEN NULL WHEN 1 THEN 'custom' ELSE algorithm END"), "library": F.expr("CASE ordinal % 3 WHEN 0 THEN 'node-rsa' WHEN 1 THEN 'PyOpenSSL' END"), "code_snippet": F.expr("CASE WHEN line = 10 THEN 'new RSA(2048)' ELSE 'x' END")})
    return op.affected_findings(f, "rsa-3072").select("scan_id", "file", "line", "algorithm", "detection_method")


TOLD = f"SELECT o_orderkey AS id, {pick('o_orderkey', 'PAN', 'HEALTH', 'OTHER', None)} AS data_class, CASE WHEN o_orderkey % 5 > 0 THEN 'f' || CAST(o_custkey AS STRING) END AS name, CASE WHEN o_orderkey % 7 > 0 THEN 'src/a.py' END AS file, CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 90 END AS INT) AS line, {pick('o_custkey', 'RSA', None)} AS algorithm, CAST(CASE WHEN o_custkey % 3 > 0 THEN 2048 END AS INT) AS key_size, {pick('o_custkey + o_orderkey', 'key_exchange', None)} AS usage, CAST(o_custkey % 9 AS DOUBLE) / 2 AS years, {pick('o_orderkey', 'stated', None)} AS source, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS p, CAST(o_custkey % 90 AS DOUBLE) / 100 AS confidence FROM {{orders}}"


@query("f25_exposure_sentence", f"SELECT id, CASE data_class WHEN 'PAN' THEN 'PAN' WHEN 'HEALTH' THEN 'Health' ELSE coalesce(data_class, 'Data') END || ' field ''' || coalesce(name, 'unnamed') || ''' (' || CASE WHEN file IS NULL THEN 'unknown location' ELSE file || coalesce(':' || line, '') END || ') is protected by ' || coalesce(algorithm, 'cryptographic') || coalesce('-' || key_size, '') || coalesce(' ' || replace(usage, '_', ' '), '') || ', ' || CASE WHEN years = floor(years) THEN CAST(CAST(years AS INTEGER) AS VARCHAR) ELSE CAST(years AS VARCHAR) END || '-year retention (' || coalesce(source, 'default assumption') || '), P(exposed) = ' || printf('%.2f', p) || ' under median scenario, lineage confidence ' || CASE WHEN confidence = floor(confidence) THEN CAST(CAST(confidence AS INTEGER) AS VARCHAR) ELSE CAST(confidence AS VARCHAR) END || '.' AS sentence FROM ({plain(TOLD)})")
def f25_sentence(spark, d):
    told = ["data_class", "name", "file", "line", "algorithm", "key_size", "usage", "years", "source", "p"]
    return sql(spark, d, TOLD).select("id", op.exposure_sentence(*map(F.col, told), F.lit("median"), F.col("confidence")).alias("sentence"))


@query("j22_affected_by", over("findings", f"SELECT DISTINCT scan_id, file, line, algorithm FROM findings WHERE {DEDUP_FAMILY} = 'RSA'"))
def j22(spark, d):
    from qvault.functions.findings import algorithm_family

    return op.affected_by(findings(spark, d), algorithm_family(F.col("algorithm")), "RSA").select("scan_id", "file", "line", "algorithm")


@query("a25_fleet_kpis", over("scans", "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) AS n FROM scans) WHERE n = 1) SELECT count(*) AS repos, round(sum(score), 2) AS total, count(*) FILTER (WHERE status = 'F') AS finished FROM l"))
def a25(spark, d):
    from qvault.operators.cbom import latest_per_key

    return op.fleet_kpis(latest_per_key(scans(spark, d), ["repo_id"], [F.desc("created_at"), F.desc("scan_id")]))


@query("a25_fleet_trend", over("scans", "SELECT CAST(created_at AS DATE) AS day, count(*) AS scans, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE status = 'F') AS finished FROM scans GROUP BY 1 ORDER BY 1 DESC LIMIT 14"))
def a25_trend(spark, d):
    return op.fleet_trend(scans(spark, d))


GANTT = "SELECT o_orderkey AS task_id, o_custkey % 50 AS plan, CAST(o_orderkey % 24 AS INT) AS start_month, CAST(o_orderkey % 24 + 1 + o_custkey % 6 AS INT) AS end_month, CAST(o_custkey % 30 AS INT) AS deadline, CAST(o_custkey % 5 AS DOUBLE) AS weight FROM {orders}"


@query("a26_schedule_waves", f"SELECT task_id, plan, CAST(dense_rank() OVER (PARTITION BY plan ORDER BY start_month) AS INTEGER) AS wave FROM ({plain(GANTT)})")
def a26(spark, d):
    return op.schedule_waves(sql(spark, d, GANTT), "plan").select("task_id", "plan", "wave")


@query("a26_schedule_totals", f"SELECT plan, max(end_month) AS makespan, sum(weight * end_month) AS exposure, count(*) FILTER (WHERE end_month > deadline) AS missed FROM ({plain(GANTT)}) GROUP BY plan")
def a26b(spark, d):
    return op.schedule_totals(sql(spark, d, GANTT), "plan")


@query("j20_compare_schedules", f"SELECT task_id, start_month AS base_start, CAST(start_month - task_id % 3 AS INTEGER) AS new_start, CAST(task_id % 3 AS INTEGER) AS months_won FROM ({plain(GANTT)}) WHERE task_id % 3 <> 0")
def j20(spark, d):
    g = sql(spark, d, GANTT)
    return op.compare_schedules(g, g.withColumn("start_month", F.expr("CAST(start_month - task_id % 3 AS INT)")))


VARIED = f"SELECT task_id, plan, CAST(start_month - task_id % 3 AS INT) AS start_month, CAST(end_month - task_id % 3 AS INT) AS end_month, deadline, weight FROM ({GANTT}) x"


@query("j20_improvement", f"WITH b AS ({plain(GANTT)}), v AS ({plain(VARIED)}) SELECT plan, sum(b.weight * b.end_month) AS base_exposure, sum(v.weight * v.end_month) AS new_exposure, count(*) FILTER (WHERE b.start_month <> v.start_month) AS moved, coalesce(round(100 * (sum(b.weight * b.end_month) - sum(v.weight * v.end_month)) / nullif(sum(b.weight * b.end_month), 0), 6), 0.0)::DOUBLE AS improvement FROM b JOIN v USING (task_id, plan) GROUP BY plan")
def j20b(spark, d):
    return op.schedule_improvement(sql(spark, d, GANTT), sql(spark, d, VARIED), "plan")


@query("a24_u4_detection_quality", "WITH e AS (SELECT doc_id AS item, CASE WHEN doc_id % 2 = 0 THEN 'regex' ELSE 'ast' END AS layer FROM labels WHERE quality = 0), a AS (SELECT doc_id AS item, CASE WHEN doc_id % 2 = 0 THEN 'regex' ELSE 'ast' END AS layer FROM documents WHERE contains(text, '***') OR contains(text, '!!')), j AS (SELECT coalesce(e.layer, a.layer) AS layer, e.item AS e, a.item AS a FROM e FULL OUTER JOIN a ON e.item = a.item AND e.layer = a.layer), c AS (SELECT coalesce(layer, 'all') AS layer, count(*) FILTER (WHERE e IS NOT NULL AND a IS NOT NULL) AS tp, count(*) FILTER (WHERE e IS NULL) AS fp, count(*) FILTER (WHERE a IS NULL) AS fn FROM j GROUP BY ROLLUP (layer)) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c")
def a24(spark, d):
    layer = F.when(F.col("item") % 2 == 0, "regex").otherwise("ast")
    expected = load(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("item")).withColumn("layer", layer)
    actual = load(spark, d, "documents").where(F.col("text").contains("***") | F.col("text").contains("!!")).select(F.col("doc_id").alias("item")).withColumn("layer", layer)
    return op.detection_quality(expected, actual)


CERTS = f"SELECT o_orderkey AS cert_id, CAST(o_orderdate AS DATE) AS not_after, {pick('o_custkey', 'MD5', 'SHA-1', 'SHA-256', 'SHA-384')} AS sig_hash, {pick('o_orderkey', 'RSA', 'EC', 'RSA')} AS key_type, {pick('o_custkey', 1024, 256, 2048, 4096)} AS key_size FROM {{orders}}"


@query("p18_certificate_posture", f"WITH c AS ({plain(CERTS)}), l AS (SELECT *, datediff('day', DATE '1995-06-17', not_after) AS d FROM c) SELECT cert_id, CAST(d AS INTEGER) AS days_left, CASE WHEN d < 0 THEN 'expired' WHEN d <= 30 THEN 'expiring soon' ELSE 'valid' END AS expiry, {NAME.format('greatest(CASE WHEN d < 0 THEN 4 WHEN d <= 30 THEN 3 ELSE 0 END, CASE WHEN sig_hash IN (' + chr(39) + 'MD5' + chr(39) + ', ' + chr(39) + 'SHA-1' + chr(39) + ') THEN 3 ELSE 0 END, CASE WHEN key_type = ' + chr(39) + 'RSA' + chr(39) + ' AND key_size < 2048 THEN 4 ELSE 0 END)')} AS severity FROM l")
def p18(spark, d):
    return op.certificate_posture(sql(spark, d, CERTS), F.lit("1995-06-17").cast("date"))


DEPS = f"SELECT p_partkey AS dep_id, CAST(p_size % 9 AS BIGINT) AS repo_id, {pick('p_partkey', 'npm', 'pypi', 'maven')} AS ecosystem, {pick('p_size', 'openssl', 'jsonwebtoken', 'bcprov', 'md5', 'left-pad')} AS library, '^' || CAST(p_partkey % 4 AS STRING) || '.' || CAST(p_size % 9 AS STRING) || '.0' AS declared_version FROM {{part}}"
LIBS = "(VALUES ('openssl', '1.1.0', 'RSA'), ('jsonwebtoken', '2.5.0', 'MD5'), ('bcprov', '3.0.0', 'SHA-1'), ('md5', '9.0.0', 'MD5'))"
CAT_ROWS = [("openssl", "1.1.0"), ("jsonwebtoken", "2.5.0"), ("bcprov", "3.0.0"), ("md5", "9.0.0")]


def deps(spark, d):
    return sql(spark, d, DEPS)


def library_table(spark):
    rows = [(e, lib, v) for e in ("npm", "pypi", "maven") for lib, v in CAT_ROWS]
    return spark.createDataFrame(rows, "ecosystem string, library string, min_safe_version string")


@query("s10_j10_sca_findings", f"WITH d AS ({plain(DEPS)}), r AS (SELECT dep_id, library, CASE WHEN ecosystem = 'npm' AND library = 'openssl' THEN '1.0.9' ELSE regexp_replace(declared_version, '^[^0-9]*', '') END AS version FROM d WHERE library <> 'left-pad'), l(library, safe, a) AS {LIBS} SELECT dep_id, version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) < list_transform(string_split(safe, '.'), lambda x: CAST(x AS INTEGER)) AS needs_bump FROM r JOIN l USING (library)".replace("AS (VALUES", "AS (VALUES"))
def j10(spark, d):
    locks = spark.createDataFrame([("npm", "openssl", "1.0.9")], "ecosystem string, library string, resolved_version string")
    return op.sca_findings(deps(spark, d), library_table(spark), locks).select("dep_id", "version", "needs_bump")


@query("j11_advisory_join", f"WITH d AS ({plain(DEPS)}), a AS (SELECT library, string_agg(DISTINCT advisory, ',' ORDER BY advisory) AS advisories FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'openssl' WHEN 1 THEN 'md5' ELSE 'other' END AS library, 'ADV-' || (s_suppkey % 10) AS advisory FROM supplier) GROUP BY library) SELECT dep_id, advisories FROM d LEFT JOIN a USING (library)")
def j11(spark, d):
    adv = load(spark, d, "supplier").selectExpr("CASE s_suppkey % 3 WHEN 0 THEN 'openssl' WHEN 1 THEN 'md5' ELSE 'other' END AS library", "concat('ADV-', s_suppkey % 10) AS advisory")
    return op.advisory_join(deps(spark, d), adv).select("dep_id", "advisories")


SOURCE = "SELECT scan_id * 31 + ordinal AS repo_id, algorithm FROM findings"
USED = f"SELECT p_partkey AS repo_id, {pick('p_size', 'openssl', 'jsonwebtoken', 'bcprov', 'md5', 'left-pad')} AS library FROM {{part}}"


@query("j9_correlate_sca", over("findings", f"WITH d AS (SELECT DISTINCT repo_id, library FROM ({plain(USED)}) WHERE library <> 'left-pad'), l(library, safe, a) AS {LIBS}, u AS (SELECT DISTINCT repo_id, upper(algorithm) AS a FROM ({SOURCE})), r AS (SELECT repo_id, library, a FROM d JOIN l USING (library) UNION ALL SELECT repo_id, library, '3DES' FROM d) SELECT r.repo_id, library, count(u.a) AS matched, count(*) AS declared, CASE WHEN count(u.a) > 0 THEN 'Confirmed' ELSE 'Possible' END AS confidence FROM r LEFT JOIN u ON r.repo_id = u.repo_id AND r.a = u.a GROUP BY ALL"))
def j9(spark, d):
    algos = F.create_map(*[F.lit(x) for pair in {"openssl": "RSA", "jsonwebtoken": "MD5", "bcprov": "SHA-1", "md5": "MD5"}.items() for x in pair])
    manifest = sql(spark, d, USED).where("library <> 'left-pad'").distinct().withColumn("algorithms", F.array(algos[F.col("library")], F.lit("3DES")))
    source = findings(spark, d).selectExpr("scan_id * 31 + ordinal AS repo_id", "algorithm")
    return op.correlate_sca(manifest, source)


OFFERED = f"SELECT p_partkey AS finding_id, p_size % 50 AS repo_id, {pick('p_partkey + p_size', 'RSA', 'aes', 'General Crypto', 'ECB', '3DES', 'SHA', 'ML-KEM-768', 'MD')} AS one, {pick('p_partkey', 'ecdsa', 'DH', 'x')} AS two FROM {{part}}"
IN_SOURCE = "SELECT scan_id * 100 + ordinal AS finding_id, scan_id % 97 AS repo_id, CASE WHEN ordinal % 7 = 0 THEN 'AES-256-ECB mode' WHEN ordinal % 5 = 0 THEN '3DES/DES' ELSE algorithm END AS algorithm FROM findings"


@query("j9_corroborate", over("findings", f"""WITH m AS ({plain(OFFERED)}), o AS (SELECT repo_id, finding_id, upper(unnest([one, two])) AS da FROM m), s AS ({IN_SOURCE}), f AS (SELECT *, upper(trim(algorithm)) AS a FROM s),
u AS (SELECT DISTINCT repo_id, unnest(list_concat([a], list_filter(regexp_split_to_array(a, '[/, -]+'), lambda x: length(x) >= 2 AND x NOT IN ('MODE', 'KEY', 'WEAK', 'STATIC', 'RAW')))) AS sa FROM f),
met AS (SELECT DISTINCT o.repo_id, o.finding_id, da FROM o JOIN u ON u.repo_id = o.repo_id AND (u.sa = da OR list_contains(string_split(u.sa, ' '), da)) WHERE da NOT IN ('GENERAL CRYPTO', 'LEGACY CRYPTO', 'SSH/CRYPTO', 'BOUNCYCASTLE')),
b AS (SELECT DISTINCT repo_id, da AS name FROM met UNION SELECT DISTINCT u.repo_id, u.sa FROM u JOIN met ON u.repo_id = met.repo_id AND contains(u.sa, met.da))
SELECT DISTINCT repo_id, finding_id, 'manifest' AS layer FROM met UNION ALL SELECT DISTINCT f.repo_id, f.finding_id, 'source' FROM f JOIN b ON f.repo_id = b.repo_id AND (f.a = b.name OR list_contains(regexp_split_to_array(f.a, '[/ -]+'), b.name))"""))
def j9_both(spark, d):
    manifest = sql(spark, d, OFFERED).select("repo_id", "finding_id", F.array("one", "two").alias("algorithms"))
    source = findings(spark, d).selectExpr("scan_id % 97 AS repo_id", "scan_id * 100 + ordinal AS finding_id", "CASE WHEN ordinal % 7 = 0 THEN 'AES-256-ECB mode' WHEN ordinal % 5 = 0 THEN '3DES/DES' ELSE algorithm END AS algorithm")
    return op.corroborate(manifest, source)


FIELDS = f"SELECT o_custkey % 60 AS repo_id, o_orderkey AS field_id, {pick('o_orderkey', 'src/auth/user.sql', 'src/pay/card.py', 'lib/db/schema.sql', 'src/auth/form.py')} AS file, CAST(o_orderkey % 97 + 1 AS INT) AS line, {pick('o_orderkey', 'auth', 'pay', 'db')} AS service, o_orderkey % 3 = 0 AS is_column FROM {{orders}}"
LINKED = f"SELECT c_custkey % 60 AS repo_id, c_custkey AS asset_id, {pick('c_custkey', 'src/auth/user.sql', 'src/auth/login.py', 'src/pay/card.py', 'x/y.py')} AS file, CAST(c_custkey % 89 + 1 AS INT) AS line, {pick('c_custkey', 'auth', 'pay', 'db', None)} AS service, c_custkey % 2 = 0 AS encrypts, c_custkey % 7 = 0 AS runtime FROM {{customer}}"
CALLS = f"SELECT repo_id, file, line + 5 AS line, field_id FROM ({FIELDS}) x WHERE field_id % 6 = 0"
EDGES = "SELECT DISTINCT c_custkey % 60 AS repo_id, 'src/auth/form.py' AS file, 'x/y.py' AS imported FROM {customer}"
LINKS = f"""f AS (SELECT *, regexp_replace(file, '/?[^/]*$', '') AS folder FROM ({plain(FIELDS)})), a AS (SELECT *, regexp_replace(file, '/?[^/]*$', '') AS folder FROM ({plain(LINKED)})), c AS ({plain(CALLS)}), e AS ({plain(EDGES)}),
p AS (SELECT f.repo_id, field_id, asset_id, CASE WHEN runtime THEN 0.85 ELSE 1.0 END * CASE WHEN f.file = a.file
  THEN 0.4 * CASE WHEN abs(f.line - a.line) <= 30 THEN 0.75 ELSE 1.0 END * CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.repo_id = f.repo_id AND c.file = f.file AND c.field_id = f.field_id AND abs(c.line - a.line) <= 30) THEN 0.55 ELSE 1.0 END
  ELSE CASE WHEN f.folder = a.folder THEN 0.85 ELSE 1.0 END * CASE WHEN is_column AND encrypts AND f.service = a.service THEN 0.9 ELSE 1.0 END * CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.repo_id = f.repo_id AND e.file = f.file AND e.imported = a.file) THEN 0.7 ELSE 1.0 END END AS q,
  f.file = a.file OR f.folder = a.folder OR (is_column AND encrypts AND f.service = a.service) OR EXISTS (SELECT 1 FROM e WHERE e.repo_id = f.repo_id AND e.file = f.file AND e.imported = a.file) AS met
 FROM f JOIN a USING (repo_id)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, field_id ORDER BY score DESC, asset_id) AS INTEGER) AS rank FROM (SELECT repo_id, field_id, asset_id, round(least(0.9, 1 - q), 9)::DOUBLE AS score FROM p WHERE met)),
l AS (SELECT repo_id, field_id, asset_id, round(score, 6) AS score, rank, count(*) OVER w > 1 AND max(score) OVER w - min(score) OVER w < 1e-9 AS ambiguous FROM k WHERE rank <= 3 WINDOW w AS (PARTITION BY repo_id, field_id))"""


def linked(spark, d):
    return op.link_fields(sql(spark, d, FIELDS), sql(spark, d, LINKED), calls=sql(spark, d, CALLS), imports=sql(spark, d, EDGES))


@query("j12_link_fields", f"WITH {LINKS} SELECT * FROM l")
def j12(spark, d):
    return linked(spark, d)


FAKE_RISK = f"SELECT c_custkey AS asset_id, s AS scenario, CAST(c_custkey % 11 AS DOUBLE) / CAST(11 AS DOUBLE) * CASE s WHEN 'median' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS p_violated FROM {{customer}}, (SELECT 'median' AS s UNION ALL SELECT 'late') x"


def exposures(spark, d):
    return op.data_exposure(linked(spark, d), sql(spark, d, FAKE_RISK))


EXPOSURE = f"{LINKS}, ex AS (SELECT field_id, l.asset_id, scenario, p_violated AS probability, p_violated * score AS weight FROM l JOIN ({plain(FAKE_RISK)}) r ON l.asset_id = r.asset_id WHERE p_violated > 0)"


@query("j15_data_exposure", f"WITH {EXPOSURE} SELECT field_id, asset_id, scenario, round(probability, 6) AS probability, round(weight, 6) AS weight FROM ex")
def j15(spark, d):
    return exposures(spark, d).withColumn("probability", F.round("probability", 6)).withColumn("weight", F.round("weight", 6))


PROTECTORS = f"SELECT c_custkey AS asset_id, {pick('c_custkey', 'PQC', 'RSA', 'AES')} AS family, {pick('c_custkey', 'encryption', 'jwt', 'encryption', 'signature')} AS usage FROM {{customer}}"


@query("j15_exposure_gaps", f"WITH {LINKS}, g AS (SELECT field_id, bool_and(family = 'PQC' OR usage IN ('jwt', 'signature')) AS skipped FROM l JOIN ({plain(PROTECTORS)}) USING (asset_id) GROUP BY field_id) SELECT f.field_id, CASE WHEN skipped IS NULL THEN 'unprotected' ELSE 'skipped' END AS gap FROM f LEFT JOIN g USING (field_id) WHERE skipped IS NULL OR skipped")
def j15b(spark, d):
    return op.exposure_gaps(sql(spark, d, FIELDS), linked(spark, d), sql(spark, d, PROTECTORS))


@query("a19_exposure_summary", f"WITH {EXPOSURE}, w AS (SELECT scenario, field_id, max(weight) AS w FROM ex GROUP BY ALL) SELECT scenario, round(sum(w), 6) AS expected, count(*) FILTER (WHERE w >= 0.2) AS likely FROM w GROUP BY scenario")
def a19(spark, d):
    return op.exposure_summary(exposures(spark, d))


@query("o2_top_fields", f"WITH {EXPOSURE}, w AS (SELECT scenario, field_id, max(weight) AS w FROM ex GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY scenario ORDER BY round(w, 9) DESC, field_id) AS INTEGER) AS rank FROM w) SELECT scenario, field_id, rank FROM r WHERE rank <= 5")
def o2(spark, d):
    worst = exposures(spark, d).groupBy("scenario", "field_id").agg(F.max("weight").alias("w"))
    return fo.top_per_group(worst, ["scenario"], [F.desc(F.round("w", 9)), F.col("field_id")], 5).select("scenario", "field_id", "rank")


@query("o3_file_cap", over("findings", "SELECT scan_id, file, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, file ORDER BY ordinal) AS n FROM findings) WHERE n <= 2"))
def o3(spark, d):
    return fo.top_per_group(findings(spark, d), ["scan_id", "file"], ["ordinal"], 2).select("scan_id", "file", "ordinal")


#: A line item is a value hit or a name hit, by its number; a place is a part of an order.
SIGNALS = "SELECT l_orderkey AS repo_id, l_partkey AS place, CAST(l_quantity AS DOUBLE) / 100 AS confidence, l_linenumber % 2 + 1 AS n FROM (SELECT l_orderkey, l_partkey % 3 AS l_partkey, l_quantity, l_linenumber FROM {lineitem}) x"


@query("j14_combine_signals", f"WITH s AS ({plain(SIGNALS)}), v AS (SELECT *, count(*) OVER (PARTITION BY repo_id, place) AS c FROM s WHERE n = 1), m AS (SELECT *, count(*) OVER (PARTITION BY repo_id, place) AS c FROM s WHERE n = 2), b AS (SELECT coalesce(v.repo_id, m.repo_id) AS repo_id, coalesce(v.place, m.place) AS place, 1 - (1 - coalesce(v.confidence, 0)) * (1 - coalesce(m.confidence, 0)) AS confidence FROM (SELECT * FROM v WHERE c = 1) v FULL OUTER JOIN (SELECT * FROM m WHERE c = 1) m ON v.repo_id = m.repo_id AND v.place = m.place) SELECT repo_id, place, round(confidence, 6) AS confidence FROM (SELECT * FROM b UNION ALL SELECT repo_id, place, confidence FROM v WHERE c > 1 UNION ALL SELECT repo_id, place, confidence FROM m WHERE c > 1)")
def j14(spark, d):
    s = sql(spark, d, SIGNALS)
    return op.combine_signals(s.where("n = 1").drop("n"), s.where("n = 2").drop("n"), ["repo_id", "place"]).withColumn("confidence", F.round("confidence", 6))
