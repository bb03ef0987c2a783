"""What the driver's tables stand for: findings, assets, repositories and so on, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qvault.storage import load

TABLES = ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events", "documents", "pages", "labels")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run ``text`` with the names of tables standing for the folder's tables; braces of its own are doubled."""
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used) if used else spark.sql(text)


#: Rows that a part of a dealt table holds.
ROWS_OF_PART = 4096


def dealt(spark: SparkSession, sf_dir: str, text: str, table: str, key: str) -> DataFrame:
    """As ``sql``, with the rows of ``table`` dealt by ``key`` first.

    A table that lies in one small file is read by one task; where ``text``
    makes many lines of each row, they would all be that task's. Parts are
    numbered by rows, so a task holds no more of them in a larger table, and
    few bytes, which become many, are not put together.
    """
    rows = load(spark, sf_dir, table)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_OF_PART))
    return spark.sql(text, **{table: rows.repartition(parts, key)})


def plain(text: str) -> str:
    """The same text for an engine that has the tables as views."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.replace("{{", "{").replace("}}", "}")


def pick(expr: str, *values: str | int | None) -> str:
    """A CASE that takes one of ``values`` by ``expr`` modulo their number."""
    shown = ["NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in values]
    return f"CASE ({expr}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


ALGORITHM = pick("l_partkey", "RSA-2048", "AES-256-CBC", "MD5", "SHA-1", "ECDSA (P-256)", "3DES", "SHA-256", "AES-128-GCM", "DH-1024", "ML-KEM-768")
RISK = pick("l_partkey", "Quantum-Broken", "Quantum-Weakened", "Classical Risk", "Classical Risk", "Quantum-Broken", "Classical Risk", "Safe", "Quantum-Weakened", "Quantum-Broken", "Safe")
SEVERITY = "CASE WHEN l_returnflag = 'R' THEN 'Critical' WHEN l_returnflag = 'A' THEN 'High' WHEN l_linestatus = 'O' THEN 'Low' WHEN l_quantity > 40 THEN 'Informational' ELSE 'Medium' END"
FILE = pick("l_suppkey", "src/auth/login.py", "src/api/tokens.js", "lib/crypto/cipher.py", "config/app.yml", "infra/main.tf", "tests/unit/test_hash.py", "server.js", "services/pay/card.go")

#: The table repeats some (l_orderkey, l_linenumber); findings have their place in a scan.
ORDINAL = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT)"

#: lineitem as findings: an order is a scan, a few files and lines each, so that findings meet at sites.
FINDINGS = f"""
SELECT l_orderkey AS scan_id, {ORDINAL} AS ordinal, {FILE} AS file,
  CAST(l_quantity AS BIGINT) % 2 + 10 AS line,
  {pick("l_suppkey", "python", "javascript", "infra", "config", "manifest", "go")} AS language,
  {pick("l_partkey + l_suppkey", "aes-hardcoded-key", "config-plaintext-secret", "entropy-secret-high-confidence", "md5-hashing", "rsa-keygen", "sca-library", "infra-k8s-secret-plaintext")} AS rule_id,
  {pick("l_suppkey + CAST(l_quantity AS BIGINT)", "hardcoded-secret", "secret", "hash", "symmetric-cipher", "asymmetric", "Cloud KMS")} AS category,
  {ALGORITHM} AS algorithm, {SEVERITY} AS severity, {RISK} AS quantum_risk,
  CAST(l_quantity AS BIGINT) % 4 + 1 AS specificity, CAST(floor(l_extendedprice) AS BIGINT) % 5 = 0 AS generic,
  {pick("l_partkey + l_linenumber", "AST", "REGEX", "ENTROPY", "SCA")} AS detection_method,
  {pick("l_suppkey + l_partkey", "CBC", None, "GCM", None, "ECB")} AS mode,
  {pick("l_suppkey", "Likely", "Possible", "Confirmed")} AS confidence,
  {pick("l_partkey", 2048, 256, None, None, 256, 168, None, 128, 1024, None)} AS key_size,
  'call_' || CAST(l_partkey % 17 AS STRING) || '(x)' AS code_snippet,
  l_discount > 0.09 AS suppressed, CASE WHEN l_tax > 0.07 THEN 'RESOLVED' ELSE 'ACTIVE' END AS status,
  {pick("l_partkey", "openssl", "pycryptodome", "node:crypto", None)} AS library,
  {pick("l_suppkey", "external-facing", "internal", "public-facing")} AS exposure
FROM {{lineitem}}
"""

#: part as an algorithm and library catalogue.
CATALOGUE = f"""
SELECT p_partkey AS asset_id,
  {pick("p_partkey", "RSA", "aes-256-cbc", "MD5", "sha1", "DES-EDE3", "rc4", "Blowfish", "sha256", "gzip", "ECDSA P-384", "AES-ECB", "ed25519", "DH-1024", "tls_aes_256_gcm_sha384", "ripemd160", "ML-KEM-768", "RSA-1024", "x25519", "HMAC-SHA256", "chacha20-poly1305")} AS algorithm,
  {pick("p_partkey", "CBC", "GCM", "ECB", "CTR", None)} AS mode,
  {pick("p_size", 128, 256, 512, 1024, 2048, 4096, None)} AS key_size,
  {pick("p_size + p_partkey", "password hashing", "TLS certificate", "jwt signing", "file encryption", "key exchange", "checksum", None)} AS usage,
  {pick("p_partkey + 3", "vulnerable", "safe", None, "weakened", "broken", "unknown")} AS quantum_status,
  lower(p_name) AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS BIGINT) AS size, p_retailprice AS price,
  'src/' || {pick("p_size", "auth", "payments", "util", "api")} || '/f' || CAST(p_partkey % 30 AS STRING) || '.py' AS file
FROM {{part}}
"""

#: lineitem as inventories: a supplier is a repository, shipped before the date is its base and after it its head.
ASSETS = f"""
SELECT l_suppkey % 40 AS repo_id, l_shipdate >= TIMESTAMP '1995-06-17 00:00:00' AS is_head, l_orderkey * 100 + {ORDINAL} AS ordinal,
  {ALGORITHM} AS algorithm, {pick("l_partkey", "signature", "cipher", "hash", "hash", "signature", "cipher", "hash", "cipher", "key exchange", "kem")} AS primitive,
  {pick("l_partkey", 2048, 256, None, None, 256, 168, None, 128, 1024, None)} AS key_size,
  'src/m' || CAST(l_orderkey % 6 AS STRING) || '/f' || CAST(l_partkey % 9 AS STRING) || '.py' AS file, CAST(l_linenumber AS BIGINT) AS line,
  {pick("l_linenumber", "sign", "encrypt", "verify")} AS usage, {pick("l_partkey", "broken", "weakened", "", "", None, "", "safe", "safe", "vulnerable", "safe")} AS quantum_status,
  {SEVERITY} AS severity
FROM {{lineitem}}
"""

#: orders as scans of the customers' repositories.
SCANS = "SELECT o_orderkey AS scan_id, o_custkey AS repo_id, o_orderdate AS created_at, o_orderstatus AS status, o_totalprice AS score FROM {orders}"

#: documents as source files, split into lines.
LINES = {
    "spark": "SELECT doc_id, source AS repo_id, CAST(pos + 1 AS INT) AS line, text FROM (SELECT doc_id, source, posexplode(split(text, '\n')) AS (pos, text) FROM {documents})",
    "duckdb": "SELECT doc_id, source AS repo_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line, unnest(l) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)",
}


def numbered(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over lineitem whose rows are numbered first, as ORDINAL says.

    So the table's own columns are dealt by order, not the texts made of them,
    and what is grouped inside a scan afterwards needs no other shuffle.
    """
    lineitem = load(spark, sf_dir, "lineitem").withColumn("_ordinal", F.expr(ORDINAL))
    return spark.sql(text.replace(ORDINAL, "_ordinal"), lineitem=lineitem)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir, FINDINGS)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CATALOGUE)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir, ASSETS)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SCANS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LINES["spark"])


def over(name: str, text: str) -> str:
    """SQL text with a binding as its first table expression: findings, catalogue, assets, scans or lines."""
    source = LINES["duckdb"] if name == "lines" else plain({"findings": FINDINGS, "catalogue": CATALOGUE, "assets": ASSETS, "scans": SCANS}[name])
    rest = text.strip()
    return f"WITH {name} AS ({source})" + (", " + rest[5:] if rest.upper().startswith("WITH ") else "\n" + rest)
