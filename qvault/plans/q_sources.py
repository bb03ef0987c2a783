"""Queries of sources and sinks: each writes to the shared folder and reads back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from qvault.operators.gate import load_policy
from qvault.operators.rollups import sca_findings
from qvault.plans.bindings import assets, findings, over, pick, plain, sql
from qvault.plans.registry import query
from qvault.sources import files as src
from qvault.sources.imports import import_edges
from qvault.storage import load, new_path


@query("s3_findings_round_trip", over("findings", "SELECT scan_id, ordinal, file, algorithm, mode, CAST(key_size AS BIGINT) AS key_size, suppressed FROM findings"))
def s3(spark, d):
    path = new_path(spark, "findings")
    src.write_findings(findings(spark, d), path)
    return src.read_findings(spark, path).select("scan_id", "ordinal", "file", "algorithm", "mode", "key_size", "suppressed")


@query("s11_overwrite_partition", over("findings", "SELECT scan_id % 4 AS slot, count(*) AS n, CASE WHEN scan_id % 4 = 2 THEN 'second' ELSE 'first' END AS run FROM findings GROUP BY ALL"))
def s11(spark, d):
    path = new_path(spark, "slots")
    rows = findings(spark, d).select((F.col("scan_id") % 4).alias("slot"), "ordinal")
    src.overwrite_partition(rows.withColumn("run", F.lit("first")), path, ["slot"])
    src.overwrite_partition(rows.where("slot = 2").withColumn("run", F.lit("second")), path, ["slot"])
    return spark.read.parquet(path).groupBy(F.col("slot").cast("long").alias("slot"), "run").agg(F.count("*").alias("n"))


@query("s13_gate_report", over("assets", "SELECT repo_id, ordinal, rank, overflow FROM (SELECT repo_id, ordinal, CAST(row_number() OVER w AS INTEGER) AS rank, greatest(count(*) OVER (PARTITION BY repo_id) - 20, 0) AS overflow FROM assets WHERE is_head WINDOW w AS (PARTITION BY repo_id ORDER BY CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, ordinal)) WHERE rank <= 20"))
def s13(spark, d):
    return src.gate_report_rows(assets(spark, d).where("is_head"), ["repo_id"], 20).select("repo_id", "ordinal", "rank", "overflow")


MANIFESTS = f"""SELECT p_size % 5 AS repo_id, 'r' || CAST(p_partkey AS STRING) || '/' || {pick('p_partkey', 'requirements.txt', 'package.json', 'pom.xml')} AS path, {pick('p_partkey', 'PyCrypto==2.6 # old', '{{"dependencies":{{"left-pad":"^1.0.0"}}}}', '<project><dependencies><dependency><artifactId>bcprov</artifactId><version>1.5</version></dependency></dependencies></project>')} AS content FROM {{part}}"""


@query("s10_read_dependencies", f"SELECT repo_id, path, {pick('n', 'pypi', 'npm', 'maven')} AS ecosystem, {pick('n', 'pycrypto', 'left-pad', 'bcprov')} AS library, {pick('n', '2.6', '^1.0.0', '1.5')} AS declared_version FROM (SELECT *, CASE WHEN ends_with(path, 'txt') THEN 0 WHEN ends_with(path, 'json') THEN 1 ELSE 2 END AS n FROM ({plain(MANIFESTS)}))")
def s10(spark, d):
    return src.read_dependencies(sql(spark, d, MANIFESTS))


# Documents as the files of repositories, four kinds of places; besides its text each imports others by paths of every form.
IMPORTING = "SELECT doc_id, doc_id % 7 AS repo_id, CASE doc_id % 4 WHEN 0 THEN concat('src/a/f', doc_id, '.js') WHEN 1 THEN concat('src/b/f', doc_id, '.ts') WHEN 2 THEN concat('lib/m', doc_id, '/index.js') ELSE concat('lib/p', doc_id, '.py') END AS file, {0} FROM {{documents}}"
ASKS = """array(concat('import x from "./f', doc_id + 28, '";'), concat('const y = require( \\'../b//./f', doc_id + 21, '.js\\' )'), concat('export * from \\'../../lib/m', doc_id + 14, '\\''), concat('from lib.p', doc_id + 28, ' import z'), 'import React from "react"', concat('require("../../../../f', doc_id, '")'))"""
IMPORTED = """SELECT a.repo_id, a.file, b.file AS imported FROM d a JOIN d b ON a.repo_id = b.repo_id AND (
  (a.doc_id % 4 IN (0, 1) AND b.doc_id = a.doc_id + 28) OR (a.doc_id % 4 = 0 AND b.doc_id = a.doc_id + 21) OR (a.doc_id % 4 = 0 AND b.doc_id = a.doc_id + 14) OR b.doc_id = a.doc_id + 28 AND a.doc_id % 4 = 3)"""


@query("j13_import_edges", f"WITH d AS ({plain(IMPORTING.format('1'))}) {IMPORTED}")
def j13(spark, d):
    lines = sql(spark, d, IMPORTING.format(f"posexplode(concat(split(coalesce(text, ''), '\n'), {ASKS})) AS (line, text)"))
    return import_edges(lines.select("repo_id", "file", "line", "text"))


def policy_rows() -> str:
    return ", ".join(f"('{k}', '{json.dumps(v)}')" for k, v in sorted(load_policy({"waiver_max_days": "30"}).items()))


@query("s8_policy_by_repo", f"SELECT c_custkey AS repo_id, key, value FROM customer, (VALUES {policy_rows()}) p(key, value)")
def s8(spark, d):
    rows = src.policy_table(spark, {"waiver_max_days": "30"}).collect()  # one row per key of the policy
    each = F.explode(F.array(*[F.struct(F.lit(r["key"]).alias("key"), F.lit(r["value"]).alias("value")) for r in rows]))
    return sql(spark, d, "SELECT c_custkey AS repo_id FROM {customer}").withColumn("p", each).select("repo_id", "p.*")


@query("s1_source_tree", "SELECT source AS repo_id, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes FROM documents WHERE source IS NOT NULL GROUP BY source")
def s1_tree(spark, d):
    """Documents written as files of a tree, a folder per source, beside a vendor folder that the scan leaves out."""
    path = new_path(spark, "tree")
    docs = load(spark, d, "documents").where("source is not null").select(F.coalesce("text", F.lit("")).alias("value"), "source")
    for folder in ("src", "vendor"):
        docs.write.partitionBy("source").text(f"{path}/{folder}")
    found = src.read_source_files(spark, path, glob="*.txt", max_bytes=1 << 40)
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("repo_id")).agg(F.sum("size").alias("bytes"))


WAIVED = "SELECT o_orderkey AS n, 'W' || CAST(o_orderkey AS STRING) AS id, 'owner' || CAST(o_custkey % 9 AS STRING) AS owner, 'accepted until the next release' AS reason, substr(CAST(o_orderdate AS STRING), 1, 10) AS expires, CASE WHEN o_orderkey % 2 = 0 THEN 'RSA' END AS algorithm, CASE WHEN o_orderkey % 3 = 0 THEN 'src/*' END AS path FROM {orders}"


@query("s8_load_waivers", f"SELECT id AS waiver_id, owner, expires, NULL AS match_fingerprint, algorithm AS match_algorithm, path AS match_path FROM ({plain(WAIVED)})")
def s8_waivers(spark, d):
    path = new_path(spark, "waivers")
    rows = sql(spark, d, WAIVED)
    rows.select("id", "owner", "reason", "expires", F.struct("algorithm", "path").alias("match")).write.json(path)
    return src.load_waivers(spark, path, lines=True).select("waiver_id", "owner", "expires", "match_fingerprint", "match_algorithm", "match_path")


LOCKS = f"""SELECT p_partkey AS repo_id, 'r/' || {pick('p_partkey', 'package-lock.json', 'requirements.txt', 'package-lock.json', 'requirements.lock', 'pom.xml')} AS path, replace({pick('p_partkey', '{{"packages":{{"":{{"version":"9.9.9"}},"node_modules/left-pad":{{"version":"1.@.0"}},"node_modules/a/node_modules/b":{{"version":"2.0.@"}}}}}}', 'PyCrypto==2.@ # pinned', '{{"dependencies":{{"left-pad":{{"version":"1.3.@"}}}}}}', 'requests==2.@.1', 'none')}, '@', CAST(p_size % 7 AS STRING)) AS content FROM {{part}}"""
LOCKED = "SELECT p_partkey AS repo_id, p_partkey % 5 AS k, CAST(p_size % 7 AS VARCHAR) AS n FROM part"


@query("s10_read_locks", f"WITH k AS ({LOCKED}) SELECT repo_id, 'npm' AS ecosystem, 'left-pad' AS library, CASE k WHEN 0 THEN '1.' || n || '.0' ELSE '1.3.' || n END AS resolved_version FROM k WHERE k IN (0, 2) UNION ALL SELECT repo_id, 'npm', 'b', '2.0.' || n FROM k WHERE k = 0 UNION ALL SELECT repo_id, 'pypi', 'pycrypto', '2.' || n FROM k WHERE k = 1 UNION ALL SELECT repo_id, 'pypi', 'requests', '2.' || n || '.1' FROM k WHERE k = 3")
def s10_locks(spark, d):
    return src.read_locks(sql(spark, d, LOCKS)).drop("path")


# Every repository asks for the same libraries, spelled differently; each has locks of its own for some.
ASKED = "SELECT p_partkey AS repo_id, explode(array(named_struct('ecosystem', 'npm', 'library', 'Left-Pad', 'declared_version', '^1.2.9'), named_struct('ecosystem', 'pypi', 'library', 'py-crypto', 'declared_version', '>=2.1'), named_struct('ecosystem', 'pypi', 'library', 'Requests', 'declared_version', 'latest'))) AS d FROM {part}"


@query("j10_locked_versions", f"WITH k AS ({LOCKED}), a(library, declared, safe) AS (VALUES ('Left-Pad', '1.2.9', '1.3.0'), ('py-crypto', '2.1', '2.4'), ('Requests', 'latest', '2.3.1')), v AS (SELECT repo_id, library, safe, CASE WHEN library = 'Left-Pad' AND k = 0 THEN '1.' || n || '.0' WHEN library = 'Left-Pad' AND k = 2 THEN '1.3.' || n WHEN library = 'py-crypto' AND k = 1 THEN '2.' || n WHEN library = 'Requests' AND k = 3 THEN '2.' || n || '.1' ELSE declared END AS version FROM k, a) SELECT repo_id, library, version, version <> 'latest' AND list_transform(string_split(version, '.'), lambda x: TRY_CAST(x AS INTEGER)) < list_transform(string_split(safe, '.'), lambda x: CAST(x AS INTEGER)) AS needs_bump FROM v")
def j10_locks(spark, d):
    safe = spark.createDataFrame([("npm", "left-pad", "1.3.0"), ("pypi", "pycrypto", "2.4"), ("pypi", "requests", "2.3.1")], "ecosystem string, library string, min_safe_version string")
    asked = sql(spark, d, ASKED).select("repo_id", "d.*")
    return sca_findings(asked, safe, src.read_locks(sql(spark, d, LOCKS))).select("repo_id", "library", "version", "needs_bump")


@query("s13_report_csv", over("findings", "SELECT scan_id, ordinal, CASE WHEN ordinal % 5 = 0 THEN chr(39) || '=' || file ELSE file END AS file, severity FROM findings WHERE severity = 'Critical'"))
def s13_csv(spark, d):
    path = new_path(spark, "report")
    rows = findings(spark, d).where("severity = 'Critical'").select("scan_id", "ordinal", F.expr("CASE WHEN ordinal % 5 = 0 THEN '=' || file ELSE file END").alias("file"), "severity")
    src.write_report_csv(rows, path)
    return spark.read.option("header", True).schema("scan_id long, ordinal long, file string, severity string").csv(path)
