"""Queries over inventories: assets, the gate, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from qvault.functions import assets as fa
from qvault.operators import cbom, gate
from qvault.plans.bindings import assets, catalogue, findings, over, scans
from qvault.plans.registry import query

ALGO = "CASE WHEN coalesce(algorithm, '') = '' THEN 'UNKNOWN' ELSE regexp_replace(upper(trim(algorithm)), '\\s+', '-', 'g') END"
TYPE = "CASE WHEN coalesce({0}, '') = '' THEN 'algorithm' ELSE regexp_replace(lower(trim({0})), '[\\s_]+', '-', 'g') END"
SIZE = "coalesce(regexp_extract(CAST(key_size AS VARCHAR), '(\\d+)', 1), '')"
PURPOSE = "regexp_replace(lower(trim(coalesce(usage, ''))), '[\\s_]+', '-', 'g')"
CAT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(algorithm, '') || ' ' || coalesce(usage, '')), '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in fa.CATEGORY_KEYWORDS.items()) + " ELSE 'encryption' END"
STATUS = "lower(coalesce(quantum_status, ''))"
VULN = "CASE WHEN " + " OR ".join(f"contains({STATUS}, '{w}')" for w in fa.VULNERABLE_STATUS) + f" THEN true WHEN contains({STATUS}, 'safe') THEN false ELSE " + " OR ".join(f"contains(upper(coalesce(algorithm, '')), '{w}')" for w in fa.VULNERABLE_NAMES) + " END"
FP = f"sha256(concat_ws('|', {ALGO}, {TYPE.format('primitive')}, {SIZE}, file, {PURPOSE}))"
MFP = f"sha256(concat_ws('|', {ALGO}, {TYPE.format('primitive')}, {SIZE}, {PURPOSE}))"
GATE = f"g AS (SELECT *, {FP} AS fp, {MFP} AS mfp, {CAT} AS category, {VULN} AS vulnerable FROM assets), b AS (SELECT * FROM g WHERE NOT is_head), h AS (SELECT * FROM g WHERE is_head)"
ADDED = "added AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.repo_id = h.repo_id AND b.fp = h.fp)), removed AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE b.repo_id = h.repo_id AND b.fp = h.fp))"
MOVES = "ka AS (SELECT *, row_number() OVER (PARTITION BY repo_id, mfp ORDER BY ordinal) AS k FROM added), kr AS (SELECT repo_id, mfp, file AS moved_from, row_number() OVER (PARTITION BY repo_id, mfp ORDER BY ordinal) AS k FROM removed), moves AS (SELECT ka.*, kr.moved_from FROM ka LEFT JOIN kr USING (repo_id, mfp, k))"
SPEC = """CASE WHEN regexp_replace(upper(trim(algorithm)), '[^A-Z0-9]', '', 'g') = 'MD5' OR list_contains(string_split(upper(trim(algorithm)), '-'), 'MD5') THEN 'MD5'
 WHEN regexp_replace(upper(trim(algorithm)), '[^A-Z0-9]', '', 'g') = 'SHA1' OR list_contains(string_split(upper(trim(algorithm)), '_'), 'SHA-1') THEN 'SHA-1'
 WHEN regexp_replace(upper(trim(algorithm)), '[^A-Z0-9]', '', 'g') = 'DES' OR list_contains(string_split(upper(trim(algorithm)), '-'), 'DES') THEN 'DES'
 WHEN regexp_replace(upper(trim(algorithm)), '[^A-Z0-9]', '', 'g') = '3DES' OR list_contains(string_split(upper(trim(algorithm)), '-'), '3DES') THEN '3DES'
 WHEN regexp_replace(upper(trim(algorithm)), '[^A-Z0-9]', '', 'g') = 'RC4' OR list_contains(string_split(upper(trim(algorithm)), '-'), 'RC4') THEN 'RC4'
 WHEN contains(upper(algorithm), 'RSA') AND coalesce(key_size, TRY_CAST(nullif(regexp_extract(upper(algorithm), '(\\d+)', 1), '') AS BIGINT)) < 2048 THEN 'RSA<2048'
 WHEN contains(upper(algorithm), 'DH') AND coalesce(key_size, TRY_CAST(nullif(regexp_extract(upper(algorithm), '(\\d+)', 1), '') AS BIGINT)) < 2048 THEN 'DH<2048' END"""
# Waivers of all repositories, and of one each.
WAIVERS = [(1, "W-rsa", None, "RSA", "src/m1/*", None), (2, "W-aes", None, "AES-256", "f3.py", 3), (3, "W-none", None, "ChaCha20", "src/*", None), (4, "W-ecc", None, "EC", "src/*", 7), (5, "W-dh", None, "dh-1024-old", "*/f5.py", 11), (6, "W-rsa-all", None, "rsa", "*", 12)]
WAIVER_SQL = "w(wo, wid, wa, rx, wr) AS (VALUES (1, 'W-rsa', 'RSA', '(.*/)?src/m1/.*', NULL), (2, 'W-aes', 'AES-256', '(.*/)?f3[.]py', 3), (3, 'W-none', 'CHACHA20', '(.*/)?src/.*', NULL), (4, 'W-ecc', 'EC', '(.*/)?src/.*', 7), (5, 'W-dh', 'DH-1024-OLD', '.*/f5[.]py', 11), (6, 'W-rsa-all', 'RSA', '.*', 12))"
COVERS = "(wr IS NULL OR wr = repo_id) AND (contains(upper(algorithm), wa) OR contains(wa, upper(algorithm))) AND regexp_full_match(file, rx)"


def pair(spark, d):
    g = gate.gate_assets(assets(spark, d))
    return g.where("not is_head"), g.where("is_head")


def waivers(spark):
    return spark.createDataFrame(WAIVERS, "waiver_ordinal int, waiver_id string, match_fingerprint string, match_algorithm string, match_path string, repo_id long")


@query("f2_asset_fingerprint", over("assets", f"SELECT repo_id, ordinal, {FP} AS fingerprint, {MFP} AS moved_fingerprint FROM assets"))
def f2(spark, d):
    return gate.gate_assets(assets(spark, d)).select("repo_id", "ordinal", "fingerprint", "moved_fingerprint")


@query("p30_asset_flags", over("catalogue", f"SELECT asset_id, {CAT} AS category, {VULN} AS vulnerable FROM catalogue"))
def p30(spark, d):
    c = F.col
    return catalogue(spark, d).select("asset_id", fa.asset_category(c("algorithm"), c("usage")).alias("category"), fa.is_quantum_vulnerable(c("quantum_status"), c("algorithm")).alias("vulnerable"))


@query(
    "f21_replacement",
    over(
        "catalogue",
        f"""SELECT asset_id, category, CASE WHEN category = 'signature' OR u SIMILAR TO '.*(SIGN|DSA|ED25519).*' THEN 'ML-DSA (Dilithium) / SLH-DSA (SPHINCS+)' WHEN category = 'key_exchange' OR u SIMILAR TO '.*(DH|X25519|KEM).*' THEN 'ML-KEM (Kyber-768 / Kyber-1024)'
 WHEN u SIMILAR TO '.*(DES|RC4).*' THEN 'AES-256-GCM / ChaCha20-Poly1305 (Classical upgrade)' WHEN u SIMILAR TO '.*(MD5|SHA-1|SHA1).*' THEN 'SHA-256 / SHA-384 / SHA3-256 (Classical upgrade)' WHEN contains(u, 'RSA') THEN 'ML-KEM-768 or hybrid X25519+ML-KEM' ELSE 'AES-256-GCM or NIST PQC standardized suite' END AS replacement,
 'crypto-' || regexp_replace(lower(algorithm), '[^a-z0-9]+', '-', 'g') AS bom_ref, 'urn:uuid:' || regexp_replace(md5(CAST(asset_id AS VARCHAR)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS uuid
FROM (SELECT *, upper(algorithm) AS u, {CAT} AS category FROM catalogue)""",
    ),
)
def f21(spark, d):
    c = F.col
    t = catalogue(spark, d).withColumn("category", fa.asset_category(c("algorithm"), c("usage")))
    return t.select("asset_id", "category", fa.suggested_replacement(c("algorithm"), c("category")).alias("replacement"), cbom.bom_ref(c("algorithm")).alias("bom_ref"), cbom.document_uuid(c("asset_id").cast("string")).alias("uuid"))


@query("j1_asset_diff", over("assets", f"WITH {GATE} SELECT repo_id, ordinal, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.repo_id = h.repo_id AND b.fp = h.fp) THEN 'unchanged' ELSE 'added' END AS change FROM h UNION ALL SELECT repo_id, ordinal, 'removed' FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE b.repo_id = h.repo_id AND b.fp = h.fp)"))
def j1(spark, d):
    return gate.asset_diff(*pair(spark, d)).select("repo_id", "ordinal", "change")


@query("j2_pair_moves", over("assets", f"WITH {GATE}, {ADDED}, {MOVES} SELECT repo_id, ordinal, file, moved_from FROM moves"))
def j2(spark, d):
    return gate.pair_moves(gate.asset_diff(*pair(spark, d))).select("repo_id", "ordinal", "file", "moved_from")


@query("j3_apply_waivers", over("assets", f"WITH {GATE}, {WAIVER_SQL} SELECT repo_id, ordinal, arg_min(wid, wo) AS waiver_id FROM h LEFT JOIN w ON {COVERS} WHERE vulnerable GROUP BY repo_id, ordinal"))
def j3(spark, d):
    v = pair(spark, d)[1].where("vulnerable")
    return gate.apply_waivers(v, waivers(spark)).select("repo_id", "ordinal", "waiver_id")


@query("j4_stale_waivers", over("assets", f"WITH {GATE}, {WAIVER_SQL} SELECT wid AS waiver_id FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE {COVERS})"))
def j4(spark, d):
    return gate.stale_waivers(waivers(spark), pair(spark, d)[1]).select("waiver_id")


@query("j5_prohibited", over("catalogue", f"SELECT asset_id, {SPEC} AS spec FROM catalogue"))
def j5(spark, d):
    return catalogue(spark, d).select("asset_id", gate.prohibited_spec(F.col("algorithm"), F.col("key_size"), gate.DEFAULT_POLICY["prohibited_algorithms"]).alias("spec"))


@query("a8_gate_metrics", over("assets", f"WITH {GATE} SELECT repo_id, category, count(*) FILTER (WHERE NOT is_head) AS base, count(*) FILTER (WHERE is_head) AS head, count(*) FILTER (WHERE is_head) - count(*) FILTER (WHERE NOT is_head) AS delta FROM g WHERE vulnerable GROUP BY ALL"))
def a8(spark, d):
    return gate.gate_metrics(*pair(spark, d))


@query("s13_markdown_report", over("assets", f"""WITH {GATE}, v AS (SELECT repo_id, count(*) FILTER (WHERE vulnerable AND NOT is_head) AS b, count(*) FILTER (WHERE vulnerable AND is_head) AS h FROM g GROUP BY repo_id),
k AS (SELECT repo_id, category, count(*) FILTER (WHERE NOT is_head) AS b, count(*) FILTER (WHERE is_head) AS h FROM g WHERE vulnerable GROUP BY ALL),
c AS (SELECT repo_id, string_agg('| ' || CASE category WHEN 'signature' THEN 'Signatures' WHEN 'key_exchange' THEN 'Key exchange' WHEN 'encryption' THEN 'Encryption' WHEN 'hash' THEN 'Hashes' ELSE 'Protocols' END || ' | ' || b || ' | ' || h || ' | ' || CASE WHEN h > b THEN '+' ELSE '' END || (h - b) || ' |', chr(10) ORDER BY list_position(['signature', 'key_exchange', 'encryption', 'hash', 'protocol'], category)) AS t FROM k WHERE category IN ('signature', 'key_exchange', 'encryption', 'hash', 'protocol') GROUP BY repo_id),
o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, ordinal) AS n, count(*) OVER (PARTITION BY repo_id) AS of FROM h WHERE vulnerable),
w AS (SELECT repo_id, string_agg('| ' || algorithm || ' | `' || file || ':' || line || '` | ' || severity || ' |  |', chr(10) ORDER BY n) || CASE WHEN any_value(of) > 5 THEN chr(10) || '| and ' || (any_value(of) - 5) || ' more | | | |' ELSE '' END AS t FROM o WHERE n <= 5 GROUP BY repo_id)
SELECT v.repo_id, '## Gate: ' || CASE WHEN v.h > v.b THEN 'FAIL' ELSE 'PASS' END || CASE WHEN v.h > v.b THEN concat(chr(10), chr(10), '### Reasons', chr(10), chr(10), '- more than before', chr(10), '- see below') ELSE '' END || concat(chr(10), chr(10), '### Vulnerable assets', chr(10), chr(10), '| Category | Base | Head | Change |', chr(10), '|-|-|-|-|', chr(10), '| **All** | ', v.b, ' | ', v.h, ' | ', CASE WHEN v.h > v.b THEN '+' ELSE '' END, v.h - v.b, ' |') || coalesce(chr(10) || c.t, '') || CASE WHEN w.t IS NOT NULL THEN concat(chr(10), chr(10), '### New violations', chr(10), chr(10), '| Algorithm | Place | Severity | Instead |', chr(10), '|-|-|-|-|', chr(10), w.t) ELSE '' END AS markdown
FROM v LEFT JOIN c ON c.repo_id = v.repo_id LEFT JOIN w ON w.repo_id = v.repo_id"""))
def s13_markdown(spark, d):
    from qvault.sources.files import gate_markdown

    base, head = pair(spark, d)
    both = base.select("repo_id", "vulnerable", F.lit(0).alias("h")).unionByName(head.select("repo_id", "vulnerable", F.lit(1).alias("h")))
    counted = both.groupBy("repo_id").agg(F.count_if(F.col("vulnerable") & (F.col("h") == 0)).alias("base_vulnerable"), F.count_if(F.col("vulnerable") & (F.col("h") == 1)).alias("head_vulnerable"))
    worse = F.col("head_vulnerable") > F.col("base_vulnerable")
    verdicts = counted.withColumns({"verdict": F.when(worse, "FAIL").otherwise("PASS"), "reasons": F.when(worse, "more than before; see below").otherwise("")})
    return gate_markdown(verdicts, gate.gate_metrics(base, head), head.where("vulnerable").withColumn("recommendation", F.lit(None).cast("string")), n=5)


@query(
    "a9_gate_verdict",
    over(
        "assets",
        f"""WITH {GATE}, {ADDED}, {MOVES}, {WAIVER_SQL}, n AS (SELECT m.*, {SPEC} AS spec, (SELECT arg_min(wid, wo) FROM w WHERE {COVERS}) AS wid FROM moves m WHERE moved_from IS NULL),
c AS (SELECT repo_id, count(*) FILTER (WHERE vulnerable AND wid IS NULL) AS unwaived, count(*) FILTER (WHERE vulnerable AND wid IS NOT NULL) AS waived, count(spec) AS prohibited, array_to_string(list_sort(list_distinct(list(spec) FILTER (WHERE spec IS NOT NULL))), ', ') AS specs FROM n GROUP BY repo_id),
t AS (SELECT repo_id, count(*) FILTER (WHERE vulnerable AND NOT is_head) AS base_vulnerable, count(*) FILTER (WHERE vulnerable AND is_head) AS head_vulnerable FROM g GROUP BY repo_id),
r AS (SELECT repo_id, base_vulnerable, head_vulnerable, coalesce(unwaived, 0) AS unwaived, coalesce(waived, 0) AS waived, coalesce(prohibited, 0) AS prohibited, specs FROM t LEFT JOIN c USING (repo_id)),
s AS (SELECT *, concat_ws('; ', CASE WHEN unwaived > 0 THEN unwaived || ' new quantum-vulnerable assets' END, CASE WHEN unwaived <= 0 AND head_vulnerable > base_vulnerable AND waived = 0 THEN 'vulnerable assets grew from ' || base_vulnerable || ' to ' || head_vulnerable END, CASE WHEN prohibited > 0 THEN prohibited || ' prohibited (' || specs || ')' END) AS reasons FROM r)
SELECT repo_id, base_vulnerable, head_vulnerable, unwaived, waived, prohibited, CASE WHEN reasons <> '' THEN 'FAIL' ELSE 'PASS' END AS verdict, CAST(CASE WHEN reasons <> '' THEN 1 ELSE 0 END AS INTEGER) AS exit_code, reasons, concat_ws('; ', CASE WHEN waived > 0 THEN waived || ' new quantum-vulnerable assets are waived' END, CASE WHEN waived > 0 AND head_vulnerable > base_vulnerable THEN 'vulnerable assets grew from ' || base_vulnerable || ' to ' || head_vulnerable || ' under waivers' END) AS warnings FROM s""",
    ),
)
def a9(spark, d):
    return gate.gate_verdict(*pair(spark, d), waivers(spark))


FAKE = """SELECT o_orderkey AS waiver_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'owner' || CAST(o_custkey AS STRING) END AS owner, CASE WHEN o_orderkey % 7 = 0 THEN 'short' ELSE 'accepted until the next release' END AS reason,
 CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS expires, CASE WHEN o_orderkey % 3 = 0 THEN 'abc' END AS fp, CASE WHEN o_orderkey % 5 <> 0 THEN 'RSA' END AS algo, CASE WHEN o_orderkey % 4 <> 0 THEN 'src/*' END AS path FROM {orders}"""


@query(
    "f20_waiver_status",
    f"""WITH v AS ({FAKE.replace("{orders}", "orders")}), x AS (SELECT *, TRY_CAST(expires AS DATE) AS day FROM v), y AS (SELECT *, datediff('day', DATE '1995-06-17', day) AS left_days FROM x),
z AS (SELECT *, CASE WHEN owner = '' THEN 'owner' WHEN length(reason) < 15 THEN 'reason' WHEN expires = '' THEN 'expires' WHEN day IS NULL THEN 'date' WHEN fp IS NULL AND algo IS NULL AND path IS NULL THEN 'match' WHEN fp IS NULL AND algo IS NOT NULL AND path IS NULL THEN 'blanket' WHEN fp IS NULL AND (algo IS NULL OR path IS NULL) THEN 'match' WHEN left_days < 0 THEN 'expired' WHEN left_days > 90 THEN 'too long' END AS error FROM y)
SELECT waiver_id, CASE WHEN error IS NULL THEN 'VALID' WHEN error = 'expired' THEN 'EXPIRED' ELSE 'INVALID' END AS status, error, CAST(left_days AS INTEGER) AS days_left, error IS NULL AND left_days <= 14 AS expiring_soon FROM z""",
)
def f20(spark, d):
    from qvault.plans.bindings import sql

    c = F.col
    status = fa.waiver_status(c("owner"), c("reason"), c("expires"), c("fp"), c("algo"), c("path"), F.lit("1995-06-17").cast("date"))
    return sql(spark, d, FAKE).select("waiver_id", status.alias("s")).select("waiver_id", "s.*")


COMPONENTS = "c AS (SELECT scan_id, algorithm, key_size, mode, count(*) AS occurrences, max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) AS max_severity_rank, arg_min_null(library, ordinal) AS library, min(ordinal) AS first_ordinal FROM findings GROUP BY ALL)"


@query("a4_cbom_components", over("findings", f"WITH {COMPONENTS} SELECT * FROM c"))
def a4(spark, d):
    return cbom.cbom_components(findings(spark, d)).drop("places")


@query("a5_severity_counts", over("findings", f"WITH {COMPONENTS} SELECT scan_id, " + ", ".join(f"count(*) FILTER (WHERE max_severity_rank = {i}) AS {n}" for i, n in ((4, "critical"), (3, "high"), (2, "medium"), (1, "low"), (0, "informational"))) + " FROM c GROUP BY scan_id"))
def a5(spark, d):
    return cbom.severity_counts(cbom.cbom_components(findings(spark, d)))


@query("a6_component_inventory", over("findings", "SELECT algorithm, coalesce(string_agg(DISTINCT library, ',' ORDER BY library), '') AS libraries, coalesce(string_agg(DISTINCT mode, ',' ORDER BY mode), '') AS modes, coalesce(string_agg(DISTINCT CAST(key_size AS VARCHAR), ',' ORDER BY CAST(key_size AS VARCHAR)), '') AS key_sizes, count(DISTINCT file) AS files, count(*) AS findings FROM findings GROUP BY algorithm"))
def a6(spark, d):
    return cbom.component_inventory(findings(spark, d))


@query("a7_crypto_dependencies", over("catalogue", "SELECT 'crypto-' || regexp_replace(lower(algorithm), '[^a-z0-9]+', '-', 'g') AS ref, string_agg(DISTINCT x, ',' ORDER BY x) AS depends_on FROM (SELECT algorithm, unnest([brand, kind]) AS x FROM catalogue) GROUP BY ALL"))
def a7(spark, d):
    return cbom.crypto_dependencies(catalogue(spark, d).select(cbom.bom_ref(F.col("algorithm")).alias("ref"), F.array("brand", "kind").alias("depends_on")))


@query("s5_cbom_documents", over("findings", f"WITH {COMPONENTS} SELECT scan_id, CAST(count(*) AS INTEGER) AS components, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM c GROUP BY scan_id"))
def s5(spark, d):
    docs = cbom.build_cbom_documents(cbom.cbom_components(findings(spark, d)))
    parsed = docs.select("scan_id", F.from_json("content", cbom.DOCUMENT).alias("d"))
    return parsed.select("scan_id", F.size("d.components").alias("components"), F.aggregate("d.components", F.lit(0).cast("long"), lambda a, c: a + F.size(c["occurrences"])).alias("occurrences"))


@query("s4_explode_cbom", over("findings", "SELECT scan_id, algorithm, CAST(key_size AS VARCHAR) AS parameter_set, mode, file, CAST(line AS BIGINT) AS line FROM findings"))
def s4(spark, d):
    return cbom.explode_cbom(cbom.build_cbom_documents(cbom.cbom_components(findings(spark, d))))


@query("s6_cbom_to_assets", over("findings", "SELECT scan_id, algorithm, mode, file, CAST(line AS BIGINT) AS line, CAST(key_size AS INTEGER) AS key_size FROM findings"))
def s6(spark, d):
    return cbom.cbom_to_assets(cbom.build_cbom_documents(cbom.cbom_components(findings(spark, d))))


@query("w6_number_versions", over("scans", "SELECT repo_id, scan_id, CAST(n AS INTEGER) AS version_number, 'v' || n AS version_label FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, scan_id) AS n FROM scans)"))
def w6(spark, d):
    return cbom.number_versions(scans(spark, d)).select("repo_id", "scan_id", "version_number", "version_label")


@query("w7_with_previous", over("scans", "SELECT repo_id, scan_id, lag(scan_id) OVER (PARTITION BY repo_id ORDER BY created_at, scan_id) AS previous_scan_id FROM scans"))
def w7(spark, d):
    return cbom.with_previous(scans(spark, d)).select("repo_id", "scan_id", "previous_scan_id")


@query("w8_latest_per_key", over("scans", "SELECT repo_id, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) AS n FROM scans) WHERE n = 1"))
def w8(spark, d):
    return cbom.latest_per_key(scans(spark, d), ["repo_id"], [F.desc("created_at"), F.desc("scan_id")]).select("repo_id", "scan_id")


REPO_COMPONENTS = "SELECT repo_id, algorithm, key_size, usage AS mode, count(*) AS occurrences, max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) AS r, list_distinct(list(file || ':' || line)) AS spots FROM assets WHERE {} GROUP BY ALL"


@query(
    "j6_cbom_diff",
    over(
        "assets",
        f"""WITH a AS ({REPO_COMPONENTS.format('is_head')}), b AS ({REPO_COMPONENTS.format('NOT is_head')}),
j AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.algorithm, b.algorithm) AS algorithm, coalesce(a.key_size, b.key_size) AS key_size, coalesce(a.mode, b.mode) AS mode, a.occurrences AS ao, b.occurrences AS bo, a.r AS ar, b.r AS br,
 len(list_filter(coalesce(a.spots, []), lambda x: NOT list_contains(coalesce(b.spots, []), x))) AS came, len(list_filter(coalesce(b.spots, []), lambda x: NOT list_contains(coalesce(a.spots, []), x))) AS went
 FROM a FULL OUTER JOIN b ON a.repo_id = b.repo_id AND a.algorithm = b.algorithm AND a.key_size IS NOT DISTINCT FROM b.key_size AND a.mode IS NOT DISTINCT FROM b.mode)
SELECT repo_id, algorithm, key_size, mode, CASE WHEN bo IS NULL THEN 'added' WHEN ao IS NULL THEN 'removed' WHEN ar IS DISTINCT FROM br OR ao <> bo OR came > 0 OR went > 0 THEN 'changed' ELSE 'unchanged' END AS change,
 CASE WHEN bo IS NOT NULL AND ao IS NOT NULL THEN nullif(concat_ws(',', CASE WHEN ar IS DISTINCT FROM br THEN 'severity' END, CASE WHEN ao <> bo THEN 'occurrences' END, CASE WHEN came > 0 OR went > 0 THEN 'places' END), '') END AS changed_fields, CAST(came AS INTEGER) AS places_added, CAST(went AS INTEGER) AS places_removed FROM j""",
    ),
)
def j6(spark, d):
    a = assets(spark, d).withColumns({"mode": F.col("usage"), "library": F.lit(None).cast("string")})
    parts = [cbom.cbom_components(x, ["repo_id"]) for x in (a.where("is_head"), a.where("not is_head"))]
    return cbom.cbom_diff(*parts)


@query(
    "j7_version_diff",
    over(
        "catalogue",
        """WITH v AS (SELECT asset_id, algorithm, mode, key_size FROM catalogue WHERE asset_id % 5 <> 0), p AS (SELECT asset_id, algorithm, CASE WHEN asset_id % 3 = 0 THEN 'GCM' ELSE mode END AS mode, CASE WHEN asset_id % 4 = 0 THEN NULL ELSE key_size END AS key_size FROM catalogue WHERE asset_id % 7 <> 0),
j AS (SELECT coalesce(v.asset_id, p.asset_id) AS asset_id, p.asset_id IS NULL AS added, v.asset_id IS NULL AS removed, concat_ws(',', CASE WHEN v.algorithm IS DISTINCT FROM p.algorithm THEN 'algorithm' END, CASE WHEN v.mode IS DISTINCT FROM p.mode THEN 'mode' END, CASE WHEN v.key_size IS DISTINCT FROM p.key_size THEN 'key_size' END) AS f FROM v FULL OUTER JOIN p ON v.asset_id = p.asset_id)
SELECT asset_id, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN f <> '' THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN NOT added AND NOT removed AND f <> '' THEN f END AS changed_fields FROM j""",
    ),
)
def j7(spark, d):
    c = catalogue(spark, d)
    now = c.where("asset_id % 5 <> 0").select("asset_id", "algorithm", "mode", "key_size")
    before = c.where("asset_id % 7 <> 0").select("asset_id", "algorithm", F.expr("CASE WHEN asset_id % 3 = 0 THEN 'GCM' ELSE mode END").alias("mode"), F.expr("CASE WHEN asset_id % 4 = 0 THEN NULL ELSE key_size END").alias("key_size"))
    return cbom.version_diff(now, before, "asset_id", ["algorithm", "mode", "key_size"])
