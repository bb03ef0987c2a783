"""Sources and sinks: source trees, findings, dependency manifests, policies, partitioned result tables, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qvault.functions.findings import severity_rank
from qvault.operators.gate import load_policy
from qvault.operators.findings import capped_rows

# Folders that hold no source of the repository itself.
PRUNED = r"(^|/)(node_modules|vendor|dist|build|\.git|__pycache__|target)(/|$)"
FINDING = "scan_id long, ordinal long, file string, line long, language string, rule_id string, category string, algorithm string, severity string, quantum_risk string, specificity long, generic boolean, detection_method string, mode string, confidence string, key_size long, code_snippet string, suppressed boolean, status string, library string, exposure string"


def read_source_files(spark: SparkSession, path: str, *, glob: str = "*", max_bytes: int = 10 << 20) -> DataFrame:
    """(path, size, content) of the files of a tree; the glob and the size limit reach the scan, pruned folders go by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.where((F.col("length") <= max_bytes) & ~F.col("path").rlike(PRUNED)).select("path", F.col("length").alias("size"), "content")


def write_findings(findings: DataFrame, path: str, format: str = "json") -> None:
    """Findings as files; those of text are compressed, as names and values repeat in each row."""
    writer = findings.write.mode("overwrite").format(format)
    (writer.option("compression", "gzip") if format in ("json", "csv") else writer).save(path)


def read_findings(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Findings with a fixed schema, so nothing is inferred; unknown fields are dropped."""
    return spark.read.schema(FINDING).format(format).load(path)


def overwrite_partition(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace the partitions of ``keys`` that ``df`` has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def policy_table(spark: SparkSession, given: dict | None = None) -> DataFrame:
    """The policy as (key, value) rows, defaults filled in."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(load_policy(given).items())], "key string, value string")


def load_waivers(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Waivers from JSON, a list of objects with id, owner, reason, expires and match, or with ``lines`` an object a line."""
    schema = "id string, owner string, reason string, expires string, ticket string, match struct<fingerprint:string,algorithm:string,path:string>"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return rows.select(F.col("id").alias("waiver_id"), "owner", "reason", "expires", F.col("match.fingerprint").alias("match_fingerprint"), F.col("match.algorithm").alias("match_algorithm"), F.col("match.path").alias("match_path"))


def read_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies (repo_id, path, ecosystem, library, declared_version) of files (repo_id, path, content): package.json, requirements.txt, pom.xml."""
    name = F.element_at(F.split("path", "/"), -1)
    npm = files.where(name == "package.json").select("repo_id", "path", F.explode_outer(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>")).alias("library", "declared_version"))
    line = F.regexp_replace("line", r"\s*(#.*)?$", "")
    pip = files.where(name == "requirements.txt").select("repo_id", "path", F.explode(F.split("content", "\n")).alias("line"))
    pip = pip.where(line.rlike(r"^[A-Za-z0-9_.-]+")).select("repo_id", "path", F.lower(F.regexp_extract(line, r"^([A-Za-z0-9_.-]+)", 1)).alias("library"), F.nullif(F.regexp_extract(line, r"[=<>~!]=?\s*([\w.]+)", 1), F.lit("")).alias("declared_version"))
    # Each dependency by itself, as one may lack a version; a version that is a property is not known.
    pom = files.where(name == "pom.xml").select("repo_id", "path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    part = lambda tag: F.nullif(F.trim(F.regexp_extract("d", rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)), F.lit(""))
    pom = pom.select("repo_id", "path", F.lower(part("artifactId")).alias("library"), F.when(~part("version").startswith("${"), part("version")).alias("declared_version"))
    tagged = [df.withColumn("ecosystem", F.lit(e)) for df, e in ((npm, "npm"), (pip, "pypi"), (pom, "maven"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).where("library is not null")


def read_locks(files: DataFrame) -> DataFrame:
    """Locked versions (repo_id, path, ecosystem, library, resolved_version) of files (repo_id, path, content): package-lock.json in both its forms, and pins of requirements files."""
    name = F.element_at(F.split("path", "/"), -1)
    versions = "map<string,struct<version:string>>"
    held = lambda at: F.from_json(F.get_json_object("content", at), versions)
    npm = files.where(name == "package-lock.json").select("repo_id", "path", F.explode(F.array(held("$.packages"), held("$.dependencies"))).alias("m")).select("repo_id", "path", F.explode("m").alias("library", "v"))
    npm = npm.where("library <> ''").select("repo_id", "path", F.lit("npm").alias("ecosystem"), F.lower(F.regexp_replace("library", r"^(.*/)?node_modules/", "")).alias("library"), F.col("v.version").alias("resolved_version"))
    pin = r"^([A-Za-z0-9_.-]+)\s*==\s*([\w.]+)"
    pip = files.where(name.rlike(r"^requirements.*\.(txt|lock)$")).select("repo_id", "path", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(pin))
    pip = pip.select("repo_id", "path", F.lit("pypi").alias("ecosystem"), F.regexp_replace(F.lower(F.regexp_extract("line", pin, 1)), "[-_]", "").alias("library"), F.regexp_extract("line", pin, 2).alias("resolved_version"))
    return npm.unionByName(pip).where("resolved_version is not null").distinct()


RULE_FIELDS = ("language", "id", "algorithm", "category", "severity", "quantum_risk", "specificity", "pattern")


def write_rules(spark: SparkSession, table: Sequence[tuple], path: str) -> None:
    """Rules of operators.rules.LANGUAGE_RULES' form as JSON lines, a folder per language."""
    schema = ", ".join(f"{f} {'int' if f == 'specificity' else 'string'}" for f in RULE_FIELDS)
    spark.createDataFrame(list(table), schema).coalesce(1).write.mode("overwrite").partitionBy("language").json(path)


def read_rules(spark: SparkSession, path: str) -> list[tuple]:
    """Rules from JSON, in the form that rule_scan takes; a rule without a pattern is left out, other fields have defaults."""
    schema = ", ".join(f"{f} {'int' if f == 'specificity' else 'string'}" for f in RULE_FIELDS)
    rows = spark.read.schema(schema).json(path).where("pattern is not null").orderBy("language", "id").collect()  # a few hundred rules
    default = {"id": "crypto-finding", "algorithm": "UNKNOWN", "category": "hash", "severity": "Medium", "quantum_risk": "Classical Risk", "specificity": 2}
    return [tuple(default.get(f) if r[f] is None else r[f] for f in RULE_FIELDS) for r in rows]


def gate_report_rows(violations: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The worst ``n`` violations per repository, and how many more there are."""
    return capped_rows(violations, keys, [severity_rank(F.col("severity")).desc(), F.col("ordinal")], n)


CATEGORY_NAMES = {"signature": "Signatures", "key_exchange": "Key exchange", "encryption": "Encryption", "hash": "Hashes", "protocol": "Protocols"}


def gate_markdown(verdicts: DataFrame, metrics: DataFrame, violations: DataFrame, key: str = "repo_id", n: int = 20) -> DataFrame:
    """One Markdown document per repository: the verdict, its reasons, base against head by category, and the worst ``n`` new violations.

    ``verdicts`` and ``metrics`` come from the gate, ``violations`` has ordinal,
    algorithm, file, line, severity and recommendation. Only the rows that are
    shown are gathered, so a document is bounded whatever the repository holds.
    """
    code = lambda *c: F.concat(F.lit("`"), F.concat(*c), F.lit("`"))
    signed = lambda c: F.when(c > 0, F.concat(F.lit("+"), c.cast("string"))).otherwise(c.cast("string"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    name = F.create_map(*[F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair])
    place = F.array_position(F.array(*map(F.lit, CATEGORY_NAMES)), F.col("category"))
    lines = metrics.where(F.col("category").isin(*CATEGORY_NAMES)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), row(name[F.col("category")], F.col("base").cast("string"), F.col("head").cast("string"), signed(F.col("delta"))).alias("text")))).alias("rows"))
    shown = gate_report_rows(violations, [key], n)
    cells = row(F.col("algorithm"), code(F.col("file"), F.lit(":"), F.col("line").cast("string")), F.col("severity"), F.coalesce("recommendation", F.lit("")))
    worst = shown.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("at"), cells.alias("text")))).alias("worst"), F.max("overflow").alias("overflow"))
    texts = lambda c: F.transform(F.col(c), lambda x: x["text"])
    delta = F.col("head_vulnerable") - F.col("base_vulnerable")
    total = row(F.lit("**All**"), F.col("base_vulnerable").cast("string"), F.col("head_vulnerable").cast("string"), signed(delta))
    reasons = F.transform(F.filter(F.split("reasons", "; "), lambda r: r != ""), lambda r: F.concat(F.lit("- "), r))
    section = lambda given, title, body: F.when(given, F.concat(F.array(F.lit(""), title, F.lit("")), body)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    more = F.when(F.col("overflow") > 0, F.array(F.concat(F.lit("| and "), F.col("overflow").cast("string"), F.lit(" more | | | |")))).otherwise(none)
    document = F.concat(
        F.array(F.concat(F.lit("## Gate: "), F.col("verdict"))),
        section(F.size(reasons) > 0, F.lit("### Reasons"), reasons),
        section(F.lit(True), F.lit("### Vulnerable assets"), F.concat(F.array(F.lit("| Category | Base | Head | Change |"), F.lit("|-|-|-|-|"), total), F.coalesce(texts("rows"), none))),
        section(F.col("worst").isNotNull(), F.lit("### New violations"), F.concat(F.array(F.lit("| Algorithm | Place | Severity | Instead |"), F.lit("|-|-|-|-|")), F.coalesce(texts("worst"), none), more)),
    )
    joined = verdicts.join(lines, key, "left").join(worst, key, "left")
    return joined.select(key, F.array_join(document, "\n").alias("markdown"))


def write_report_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; cells that a spreadsheet would take for a formula begin with an apostrophe."""
    safe = lambda c: F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)
    rows = rows.select(*[safe(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes])
    rows.write.mode("overwrite").option("header", True).csv(path)
