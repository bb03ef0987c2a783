"""Queries of scores, profiles and inferences over the catalogue; their SQL looks values up in tables of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from qvault.functions import inference as inf
from qvault.functions import profiles as fp
from qvault.functions import scores as sc
from qvault.functions.threat import risk_family
from qvault.plans.bindings import catalogue, findings, over, pick, plain, sql
from qvault.plans.q_threat import FAMILY
from qvault.plans.registry import query


def _scores(name: str, select: str, **columns: str) -> None:
    """A query of expressions over the catalogue, and SQL written apart from them."""

    @query(name, over("catalogue", select))
    def run(spark, d):
        return catalogue(spark, d).select("asset_id", *[F.expr(e).alias(n) for n, e in columns.items()])


# The same tables as rows, for the SQL.
PRIMITIVE = """CASE WHEN regexp_matches(upper({0}), '^RSA') THEN 'RSA' WHEN regexp_matches(upper({0}), '^ECDSA') THEN 'ECDSA' WHEN regexp_matches(upper({0}), '^DH') THEN 'DH' WHEN regexp_matches(upper({0}), '^AES') THEN 'AES'
 WHEN regexp_full_match(upper({0}), 'SHA-?1') THEN 'SHA-1' WHEN regexp_matches(upper({0}), '^SHA-256') OR upper({0}) = 'SHA256' THEN 'SHA-256' WHEN regexp_matches(upper({0}), '^DES') THEN 'DES' ELSE upper({0}) END"""
WEAK_TABLE = "(VALUES ('MD5', 100), ('SHA1', 90), ('SHA-1', 90), ('DES', 100), ('3DES', 80), ('RC4', 100), ('RC2', 90), ('ECB', 70)) w(name, points)"
USE_TABLE = "(VALUES ('key_exchange', 90), ('digital_signature', 90), ('password_hashing', 85), ('data_encryption', 80), ('mac', 60), ('random_generation', 70), ('integrity_hashing', 55), ('cloud_kms_managed', 25), ('hardware_key_custody', 20)) u(name, points)"
BROKEN = "(VALUES ('RSA'), ('ECC'), ('ECDSA'), ('ECDH'), ('DSA'), ('DH'), ('EDDSA'), ('DES'), ('3DES'), ('RC4'), ('MD5'), ('SHA1'), ('SHA-1')) b(name)"
QUANTUM = """CASE WHEN p IS NULL THEN 50 WHEN EXISTS (SELECT 1 FROM {b} WHERE b.name = p) THEN 100 WHEN p = 'AES' THEN CASE WHEN key_size >= 256 THEN 20 WHEN key_size >= 192 THEN 40 ELSE 60 END WHEN p = 'CHACHA20' THEN 20
 WHEN p IN ('SHA-256', 'SHA256', 'SHA-384', 'SHA-512', 'SHA3-256', 'SHA3-512') THEN 15 ELSE 50 END""".replace("{b}", BROKEN)
#: Points by key size: the first row of a kind whose limit is above the size.
STRENGTH_TABLE = """(VALUES ('long', 2048, 90), ('long', 2049, 20), ('long', 3072, 55), ('long', 4096, 35), ('long', 1000000, 20), ('curve', 256, 80), ('curve', 384, 45), ('curve', 1000000, 25),
 ('aes', 128, 100), ('aes', 192, 50), ('aes', 256, 30), ('aes', 1000000, 10), ('old', 1000000, 100), ('other', 1000000, 30)) s(kind, below, points)"""
KIND = "CASE WHEN p IN ('RSA', 'DSA', 'DH') THEN 'long' WHEN p IN ('ECC', 'ECDSA', 'ECDH', 'EDDSA') THEN 'curve' WHEN p = 'AES' THEN 'aes' WHEN p IN ('DES', '3DES', 'RC4', 'RC2') THEN 'old' ELSE 'other' END"
STRENGTH = f"CASE WHEN p IS NULL OR key_size IS NULL THEN 50 ELSE (SELECT arg_min(points, below) FROM {STRENGTH_TABLE} WHERE s.kind = {KIND} AND below > key_size) END"
OUTDATED = f"CASE WHEN p IS NULL THEN 50 ELSE greatest(coalesce((SELECT points FROM {WEAK_TABLE} WHERE w.name = p), 0), coalesce((SELECT points FROM {WEAK_TABLE} WHERE w.name = upper(mode)), 0)) END"
WINDOW = "greatest(0, coalesce(lifetime, 10) + 3 - 7)"
PURPOSE_TABLE = """(VALUES (1, 'password_hashing', ['password', 'passwd', 'login']), (2, 'key_exchange', ['exchange', 'handshake', 'kem']), (3, 'digital_signature', ['sign', 'verify', 'jwt', 'certificate']), (4, 'data_encryption', ['encrypt', 'cipher', 'decrypt']),
 (5, 'mac', ['hmac', 'mac']), (6, 'random_generation', ['random', 'nonce', 'token']), (7, 'integrity_hashing', ['checksum', 'digest', 'hash'])) q(o, k, ws)"""
HITS = "len(list_filter(ws, lambda x: contains(lower({0}), x)))"
PURPOSE = f"coalesce((SELECT arg_max(k, ({HITS}, -o)) FILTER (WHERE {HITS} > 0) FROM {PURPOSE_TABLE}), 'unknown')"


def scored_sql(source: str, size: str, mode: str, lifetime: str, exposed: str, factor: str) -> str:
    """Table expressions r (with quantum, strength, outdated, used) and s (with score) over rows with algorithm and purpose."""
    return f"""p0 AS (SELECT *, {PRIMITIVE.format('algorithm')} AS p, {lifetime} AS lifetime FROM {source}),
r AS (SELECT *, {QUANTUM} AS quantum, {STRENGTH} AS strength, {OUTDATED} AS outdated, coalesce((SELECT points FROM {USE_TABLE} WHERE u.name = purpose), 50) AS used, {WINDOW} AS w FROM p0),
s0 AS (SELECT *, quantum * 0.40 + strength * 0.20 + outdated * 0.15 + used * 0.10 + floor(CASE WHEN w <= 0 THEN 0 WHEN w >= 15 THEN 100 ELSE floor(w * 100.0 / 15 + 0.5) END * quantum / 100.0 + 0.5) * 0.15 AS raw FROM r),
s AS (SELECT *, CAST(floor(least(100, greatest(0, floor(least(100, greatest(0, raw::DOUBLE * CASE WHEN {exposed} THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)) + 0.5) * {factor}::DOUBLE)) + 0.5) AS INTEGER) AS score FROM s0)"""


#: Findings with primitive, purpose and score, as SQL.
SCORED = "f0 AS (SELECT *, CASE WHEN category IN ('key_exchange', 'digital_signature') THEN category ELSE " + PURPOSE.format("code_snippet") + " END AS purpose FROM findings), " + scored_sql("f0", "key_size", "mode", "CAST(NULL AS INTEGER)", "exposure IN ('external-facing', 'external')", "1.0")

PRIM = sc.primitive("algorithm")
_scores(
    "f12_vulnerability_score",
    "WITH c1 AS (SELECT * EXCLUDE (usage), 'data_encryption' AS purpose FROM catalogue), "
    + scored_sql("c1", "key_size", "mode", "size", "true", "1.25")
    + """ SELECT asset_id, score AS service, CAST(floor(least(100, greatest(0, floor(least(100, greatest(0, (quantum * 0.4 + strength * 0.3 + outdated * 0.2 + 60 * 0.1)::DOUBLE)) + 0.5) * 0.8::DOUBLE)) + 0.5) AS INTEGER) AS simple,
 ['info', 'low', 'medium', 'high', 'critical'][CAST(least(size * 2 // 20, 4) AS INTEGER) + 1] AS label FROM s""",
    service=sc.vulnerability_score(f"({PRIM})", "key_size", "mode", "'data_encryption'", "CAST(size AS INT)", "'external'", "'High'"),
    simple=sc.vulnerability_score(f"({PRIM})", "key_size", "mode", "'mac'", "NULL", "'internal'", "'Low'", "simple"),
    label=sc.severity_label("size * 2"),
)
_scores(
    "f13_mosca",
    "SELECT asset_id, CASE WHEN size > 7 THEN 'HIGH' WHEN size > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, greatest(0, size - 4) AS window_years, CASE WHEN size > 8 THEN 'overdue' WHEN size > 6 THEN 'urgent' WHEN size > 3 THEN 'soon' ELSE 'planned' END AS urgency FROM catalogue",
    risk=sc.mosca_risk("size", "3"), window_years=sc.exposure_window("size"), urgency=sc.urgency("size", "2"),
)
_scores(
    "f14_hndl_risk",
    """WITH r AS (SELECT *, size * 2 AS q, greatest(0, size + 2.5 - 10) AS w FROM catalogue) SELECT asset_id, CASE WHEN size % 3 = 0 THEN 15 ELSE 5 END AS x, 1.0 + least(3.0, size % 9 * 0.5) + CASE WHEN size % 2 = 0 THEN 1.5 ELSE 0.5 END AS y,
 CAST(CASE WHEN q >= 80 AND w > 0 THEN least(100, floor(80 + w * 4.0 / 3 + 0.5)) WHEN q >= 80 THEN 60 WHEN q >= 40 THEN least(100, floor(q * (0.4 + w * 0.03) + 0.5)) ELSE floor(q / 2.0 + 0.5) END AS INTEGER) AS risk FROM r""",
    x=sc.data_lifetime("CAST(NULL AS INT)", "CASE WHEN size % 3 = 0 THEN 'PII' END", "'mac'"), y=sc.migration_time("size % 9 + 1", "size % 2 = 0"), risk=sc.hndl_risk("size * 2", "size", "2.5"),
)
_scores("f15_detect_purpose", f"SELECT asset_id, {PURPOSE.format('usage')} AS purpose FROM catalogue", purpose=sc.detect_purpose("CAST(NULL AS STRING)", "usage"))
_scores(
    "f29_suggest_lifetime",
    "SELECT asset_id, CASE WHEN size % 5 = 0 THEN 3 ELSE CASE usage WHEN 'TLS certificate' THEN 2 WHEN 'password hashing' THEN 15 WHEN 'file encryption' THEN 20 WHEN 'jwt signing' THEN 1 ELSE 10 END END AS years FROM catalogue",
    years=sc.suggest_lifetime("CASE WHEN size % 5 = 0 THEN 3 END", "usage"),
)
_scores(
    "f30_criticality",
    "SELECT asset_id, CAST(floor(0.3::DOUBLE * [80, 30][CAST(size % 2 AS INTEGER) + 1] + 0.25::DOUBLE * (CASE WHEN size % 3 = 0 THEN 30 ELSE 100 END) + 0.25::DOUBLE * 40 + 0.2::DOUBLE * (CASE WHEN size % 7 = 0 THEN 100 ELSE 20 END) + 0.5) AS INTEGER) AS criticality FROM catalogue",
    criticality=f"CAST({sc.criticality('CASE WHEN size % 2 = 0 THEN ' + chr(39) + 'PII' + chr(39) + ' END', 'CASE WHEN size % 3 = 0 THEN ' + chr(39) + 'internal' + chr(39) + ' ELSE ' + chr(39) + 'external' + chr(39) + ' END', 'name', 'size % 7 = 0')} AS INT)",
)
_scores(
    "f31_urgency",
    "SELECT asset_id, CASE WHEN size > 36 THEN 'overdue' WHEN size > 28 THEN 'urgent' WHEN size > 16 THEN 'soon' ELSE 'planned' END AS tier, CASE WHEN size > 36 THEN 'HIGH' WHEN size > 16 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM catalogue",
    tier=sc.urgency("size / 4", "1"), risk=sc.mosca_risk("size / 4", "1"),
)
MODE = "nullif(list_filter(['GCM', 'CCM', 'POLY1305', 'CBC', 'CTR', 'CFB', 'OFB', 'ECB'], lambda m: contains(upper({0}), m))[1], '')"
_scores("f32_cipher_mode", f"SELECT asset_id, {MODE.format('algorithm')} AS mode_found FROM catalogue", mode_found=sc.cipher_mode("algorithm"))
TYPES = "coalesce(list_filter(['hardware:hsm', 'hardware:tpm', 'cloud:kms', 'cloud:vault', 'certificate:cert', 'certificate:x509', 'protocol:tls', 'protocol:ssh', 'protocol:ipsec', 'key:key', 'library:openssl', 'library:lib'], lambda x: contains(lower({0}), split_part(x, ':', 2)))[1], 'algorithm:')"
_scores(
    "f33_enrichment",
    f"SELECT asset_id, split_part({TYPES.format('coalesce(usage, chr(32))')}, ':', 1) AS kind, CASE usage WHEN 'TLS certificate' THEN 2 WHEN 'password hashing' THEN 15 WHEN 'file encryption' THEN 20 WHEN 'jwt signing' THEN 1 ELSE 10 END AS years, {MODE.format('coalesce(mode, algorithm)')} AS mode_found, {PRIMITIVE.format('algorithm')} AS primitive FROM catalogue",
    kind=sc.asset_type("usage"), years=sc.suggest_lifetime("NULL", "usage"), mode_found=sc.cipher_mode("coalesce(mode, algorithm)"), primitive=PRIM,
)
_scores("p34_asset_type", f"SELECT asset_id, split_part({TYPES.format('concat_ws(chr(32), usage, algorithm)')}, ':', 1) AS kind FROM catalogue", kind=sc.asset_type("coalesce(usage, '') || ' ' || algorithm"))
_scores(
    "p21_risk_profile",
    f"WITH p0 AS (SELECT *, {PRIMITIVE.format('algorithm')} AS p FROM catalogue) SELECT asset_id, {QUANTUM} AS quantum, {STRENGTH} AS strength, {OUTDATED} AS deprecation FROM p0",
    quantum=sc.quantum_vulnerability(f"({PRIM})", "key_size"), strength=sc.key_strength(f"({PRIM})", "key_size"), deprecation=sc.classical_deprecation(f"({PRIM})", "mode"),
)

PROFILED = f"SELECT p_partkey AS asset_id, {pick('p_partkey', 'aes', '3DES', 'Blowfish', 'camellia')} AS cipher, {pick('p_size', 'gcm', 'CBC', 'ECB', '', None, 'XTS', 'OCB')} AS mode, {pick('p_partkey + p_size', 128, 256, None, 192)} AS bits, {pick('p_size', 'hs256', 'RS384', 'es512', 'none', 'ps256')} AS token, {pick('p_partkey + 2', 'bcrypt', 'scrypt', 'argon2', 'pbkdf2')} AS derivation FROM {{part}}"


@query("p21_call_profiles", f"""WITH p AS (SELECT *, upper(cipher) AS c, upper(coalesce(mode, '')) AS m FROM ({plain(PROFILED)}))
SELECT asset_id, c || CASE WHEN bits > 0 THEN '-' || bits || '-' || m WHEN m <> '' THEN '-' || m ELSE '' END AS symmetric, CASE WHEN c IN ('3DES', 'BLOWFISH') OR m = 'ECB' THEN 'Critical' WHEN m IN ('GCM', 'OCB') THEN CASE WHEN coalesce(bits, 256) < 256 THEN 'Medium' ELSE 'Informational' END WHEN bits >= 256 THEN 'Low' ELSE 'Medium' END AS severity,
 CASE WHEN c IN ('3DES', 'BLOWFISH') OR m = 'ECB' THEN 'Classical Risk' WHEN m IN ('GCM', 'OCB') AND coalesce(bits, 256) >= 256 THEN 'Safe' ELSE 'Quantum-Weakened' END AS quantum_risk, CASE WHEN bits IS NULL THEN 'RSA' ELSE 'RSA-' || bits END AS rsa, CASE token WHEN 'hs256' THEN 'HMAC-SHA256 (JWT)' WHEN 'RS384' THEN 'RSA-3072-SHA384 (JWT)' WHEN 'es512' THEN 'ECDSA-P521-SHA512 (JWT)' WHEN 'none' THEN 'None (JWT)' END AS token, CASE derivation WHEN 'pbkdf2' THEN 'PBKDF2' WHEN 'argon2' THEN NULL ELSE derivation END AS derivation FROM p""")
def p21_calls(spark, d):
    c = sql(spark, d, PROFILED)
    s = fp.symmetric_profile(F.col("cipher"), F.col("mode"), F.col("bits"))
    return c.select("asset_id", s["algorithm"].alias("symmetric"), s["severity"].alias("severity"), s["quantum_risk"].alias("quantum_risk"), fp.rsa_profile(F.col("bits"))["algorithm"].alias("rsa"), fp.listed(fp.TOKENS, F.lower("token"))["algorithm"].alias("token"), fp.listed(fp.DERIVATIONS, F.col("derivation"))["algorithm"].alias("derivation"))


GUIDE_TABLE = """(VALUES ('RSA', 'key_exchange', 'ML-KEM-768'), ('RSA', 'digital_signature', 'ML-DSA-65'), ('RSA', 'unknown', 'ML-KEM-768 or ML-DSA-65'), ('ECC', 'key_exchange', 'ML-KEM-768'), ('ECC', 'digital_signature', 'ML-DSA-65'), ('ECC', 'unknown', 'ML-DSA-65'),
 ('DH', 'unknown', 'ML-KEM-768'), ('AES', 'unknown', 'AES-256-GCM'), ('HASH', 'password_hashing', 'Argon2id'), ('HASH', 'unknown', 'SHA-384')) d(f, p, r)"""
GUIDED = f"g0 AS (SELECT *, {FAMILY} AS family, {PURPOSE.format('usage')} AS purpose FROM catalogue), g AS (SELECT *, coalesce((SELECT r FROM {GUIDE_TABLE} WHERE f = family AND d.p = purpose), (SELECT r FROM {GUIDE_TABLE} WHERE f = family AND d.p = 'unknown'), 'manual review') AS recommended FROM g0)"
EFFORT = "coalesce((SELECT days FROM (VALUES ('ML-KEM-768', 8), ('ML-DSA-65', 10), ('ML-KEM-768 or ML-DSA-65', 12), ('AES-256-GCM', 3), ('Argon2id', 4), ('SHA-384', 2)) e(r, days) WHERE r = recommended), 5) + greatest(0, size - 1) / 2.0"


def guided(spark, d):
    c = catalogue(spark, d).withColumn("family", risk_family(F.col("algorithm"))).withColumn("purpose", F.expr(sc.detect_purpose("NULL", "usage")))
    return c.withColumn("recommended", F.expr(sc.pqc_guidance("family", "purpose")))


@query("f16_pqc_guidance", over("catalogue", f"WITH {GUIDED} SELECT asset_id, family, purpose, recommended FROM g"))
def f16(spark, d):
    return guided(spark, d).select("asset_id", "family", "purpose", "recommended")


@query("f17_migration_effort", over("catalogue", f"WITH {GUIDED} SELECT asset_id, ({EFFORT})::DOUBLE AS effort, CAST(greatest(0, 100 - 40 * (1 - size % 2) - least(40, 5 * greatest(0, size - 1)) - CASE WHEN usage IS NULL THEN 20 ELSE 0 END) AS INTEGER) AS agility FROM g"))
def f17(spark, d):
    effort, agility = f"CAST({sc.migration_effort('recommended', 'size')} AS DOUBLE)", f"CAST({sc.agility('size % 2 = 0', 'size', 'usage')} AS INT)"
    return guided(spark, d).select("asset_id", F.expr(effort).alias("effort"), F.expr(agility).alias("agility"))


@query("a22_support_counts", over("catalogue", f"WITH {GUIDED} SELECT family, recommended, count(*) AS n, CAST(sum({EFFORT}) AS DOUBLE) AS effort FROM g GROUP BY ALL"))
def a22(spark, d):
    from qvault.operators.rollups import support_counts

    return support_counts(guided(spark, d).withColumn("effort", F.expr(f"CAST({sc.migration_effort('recommended', 'size')} AS DOUBLE)")))


#: Names that configuration uses, beside those of the catalogue.
VALUES = f"SELECT p_partkey AS asset_id, {pick('p_partkey', 'RSA', 'aes-256-cbc', 'MD5', ' sha1 ', 'DES-EDE3', 'rc4', 'arc2', 'Blowfish', 'sha256', 'gzip', 'brotli', 'aes-ecb', 'ed25519', 'des/cbc', 'round-robin', 'ripemd160', 'hs256', 'cast5-cbc', 'idea', 'ecb', 'md4_x', 'pbkdf2', None, '')} AS value FROM {{part}}"
WEAK_NAMES = "(VALUES ('md5', 'MD5', 'Critical'), ('md4', 'MD5', 'Critical'), ('md2', 'MD5', 'Critical'), ('sha1', 'SHA-1', 'High'), ('sha-1', 'SHA-1', 'High'), ('ripemd160', 'RIPEMD-160', 'Medium'), ('ripemd', 'RIPEMD-160', 'Medium'), ('des', '3DES/DES', 'Critical'), ('3des', '3DES/DES', 'Critical'), ('des3', '3DES/DES', 'Critical'), ('tripledes', '3DES/DES', 'Critical'), ('tdes', '3DES/DES', 'Critical'), ('rc4', 'RC4', 'Critical'), ('arc4', 'RC4', 'Critical'), ('rc2', 'RC4', 'Critical'), ('arc2', 'RC4', 'Critical'), ('blowfish', 'Blowfish/Legacy', 'High'), ('cast5', 'Blowfish/Legacy', 'High'), ('idea', 'Blowfish/Legacy', 'High')) k(name, weak, severity)"


@query(
    "p4_classify_algorithm",
    f"""WITH v AS (SELECT asset_id, lower(trim(value)) AS n, regexp_split_to_array(lower(trim(value)), '[/_[:space:]-]')[1] AS b FROM ({VALUES.replace('{part}', 'part')})),
c AS (SELECT asset_id, n, n IN ('gzip', 'brotli', 'round-robin', 'sha256', 'ed25519', 'hs256', 'pbkdf2') OR b IN ('gzip', 'brotli', 'sha256', 'ed25519', 'hs256', 'pbkdf2') AS fine, coalesce((SELECT (weak, severity) FROM {WEAK_NAMES} WHERE name = n), (SELECT (weak, severity) FROM {WEAK_NAMES} WHERE name = b)) AS k FROM v)
SELECT asset_id, CASE WHEN fine THEN NULL WHEN k IS NOT NULL THEN k[1] WHEN list_contains(string_split(n, '-'), 'ecb') OR list_contains(string_split(n, '_'), 'ecb') THEN 'ECB Mode' END AS weak,
 CASE WHEN fine THEN NULL WHEN k IS NOT NULL THEN k[2] WHEN list_contains(string_split(n, '-'), 'ecb') OR list_contains(string_split(n, '_'), 'ecb') THEN 'Critical' END AS severity FROM c""",
)
def p4(spark, d):
    return sql(spark, d, VALUES).select("asset_id", inf.classify_algorithm(F.col("value")).alias("k")).select("asset_id", "k.weak", "k.severity")


@query(
    "p25_infer_key_size",
    over(
        "findings",
        """WITH n AS (SELECT *, upper(algorithm) AS a, ['8192', '4096', '3072', '2048', '1024', '512', '256', '192', '128', '56', '112'] AS sizes, regexp_split_to_array(upper(algorithm), '[^A-Z0-9_]+') AS words, regexp_split_to_array(code_snippet, '[^A-Za-z0-9_]+') AS said FROM findings)
SELECT scan_id, ordinal, CAST(coalesce(CAST(list_filter(words, lambda x: list_contains(sizes, x))[1] AS INTEGER), CASE WHEN contains(a, 'RSA') OR contains(rule_id, 'rsa') THEN CAST(list_filter(said, lambda x: list_contains(sizes[1:6], x))[1] AS INTEGER) END,
 CASE WHEN contains(a, '3DES') THEN 112 WHEN contains(a, 'DES') THEN 56 WHEN contains(a, 'BLOWFISH') OR contains(a, 'RC4') THEN 128 END) AS INTEGER) AS inferred FROM n""",
    ),
)
def p25(spark, d):
    c = F.col
    return findings(spark, d).select("scan_id", "ordinal", inf.infer_key_size(c("algorithm"), c("rule_id"), c("code_snippet")).alias("inferred"))


TAGGED = f"SELECT p_partkey AS asset_id, {pick('p_partkey', 'python', 'javascript', 'java', 'typescript')} AS language, {pick('p_size', 'python-pycryptodome-aes', 'cryptography-fernet', 'secrets-token', 'os.urandom', 'hmac-new', 'random-seed', 'md5-hashing', 'cryptojs-des', 'jsrsasign-sign')} AS rule_id, {pick('p_size + p_partkey', 'sca,npm,left-pad', 'nginx', 'dockerfile,aws', 'terraform', 'k8s', 'apache', '', '', 'crypto-js', 'x,pycryptodome')} AS tags, {pick('p_partkey', None, None, 'openssl', None, None)} AS library FROM {{part}}"


@query(
    "p26_infer_library",
    f"""WITH t AS (SELECT *, string_split(tags, ',') AS l FROM ({TAGGED.replace('{part}', 'part')})), by_tag(o, tag, name) AS (VALUES (1, 'dockerfile', 'Dockerfile'), (2, 'nginx', 'nginx'), (3, 'apache', 'apache'), (4, 'terraform', 'terraform'), (5, 'k8s', 'kubernetes'))
SELECT asset_id, coalesce(library, CASE WHEN list_contains(l, 'sca') THEN list_filter(l, lambda x: x NOT IN ('sca', 'npm', 'pip', 'maven'))[1] END, CASE WHEN contains(tags, 'crypto-js') OR contains(rule_id, 'cryptojs') THEN 'crypto-js' WHEN contains(tags, 'jsrsasign') OR contains(rule_id, 'jsrsasign') THEN 'jsrsasign' END,
 (SELECT arg_min(name, o) FROM by_tag WHERE list_contains(l, tag)), CASE WHEN language = 'python' THEN CASE WHEN contains(tags || rule_id, 'pycryptodome') THEN 'pycryptodome' WHEN contains(tags || rule_id, 'cryptography') THEN 'cryptography' WHEN starts_with(rule_id, 'secrets') THEN 'secrets' WHEN starts_with(rule_id, 'os.') THEN 'os' WHEN starts_with(rule_id, 'hmac') THEN 'hmac' WHEN starts_with(rule_id, 'random') THEN 'random' ELSE 'hashlib' END
 WHEN language IN ('javascript', 'typescript') THEN 'Node Builtin crypto' ELSE 'Standard Crypto API' END) AS inferred FROM t""",
)
def p26(spark, d):
    c = F.col
    t = sql(spark, d, TAGGED).withColumn("tags", F.split("tags", ","))
    return t.select("asset_id", inf.infer_library(c("library"), c("tags"), c("rule_id"), c("language")).alias("inferred"))
