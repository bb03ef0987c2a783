"""Component inventories (CBOM): build, write as documents, read back, version, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.functions.findings import severity_rank

IDENTITY = ["algorithm", "key_size", "mode"]
DOCUMENT = "struct<bomFormat:string,specVersion:string,components:array<struct<`bom-ref`:string,name:string,type:string,version:string,cryptoProperties:struct<assetType:string,algorithmProperties:struct<primitive:string,parameterSetIdentifier:string,mode:string>>,occurrences:array<struct<file:string,line:bigint,properties:array<struct<name:string,value:string>>>>,properties:array<struct<name:string,value:string>>>>>"


def bom_ref(algorithm: Column) -> Column:
    """A slug of the name, as the reference of a component."""
    return F.concat(F.lit("crypto-"), F.regexp_replace(F.lower(F.coalesce(algorithm, F.lit("unknown"))), "[^a-z0-9]+", "-"))


def document_uuid(key: Column) -> Column:
    """A UUID shape over an MD5 of ``key``: the same document gets the same number."""
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(key), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def cbom_components(findings: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """One row per algorithm, key size and mode: first-seen attributes, worst severity, places.

    Places are gathered per component of a scan, so a row grows with one scan at most.
    """
    place = F.struct("file", F.col("line").cast("long").alias("line"), "ordinal")
    return findings.groupBy(*keys, *IDENTITY).agg(
        F.count("*").alias("occurrences"),
        F.max(severity_rank(F.col("severity"))).alias("max_severity_rank"),
        F.min_by("library", "ordinal").alias("library"),
        F.min("ordinal").alias("first_ordinal"),
        F.sort_array(F.collect_list(place)).alias("places"),
    )


def build_cbom_documents(components: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """One JSON document per scan, components in first-seen order.

    A component is written before it is gathered: a text moves and sorts at a
    fraction of what nested arrays cost.
    """
    prop = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    component = F.struct(
        bom_ref(F.col("algorithm")).alias("bom-ref"),
        F.col("algorithm").alias("name"),
        F.lit("cryptographic-asset").alias("type"),
        F.lit("1.0.0").alias("version"),
        F.struct(F.lit("algorithm").alias("assetType"), F.struct(F.lit("other").alias("primitive"), F.col("key_size").cast("string").alias("parameterSetIdentifier"), F.col("mode").alias("mode")).alias("algorithmProperties")).alias("cryptoProperties"),
        F.transform("places", lambda p: F.struct(p["file"].alias("file"), p["line"].alias("line"), F.array(prop("ordinal", p["ordinal"])).alias("properties"))).alias("occurrences"),
        F.array(prop("severityRank", F.col("max_severity_rank"))).alias("properties"),
    )
    written = F.struct(F.col("first_ordinal").alias("o"), F.to_json(component).alias("json"))
    listed = components.groupBy(*keys).agg(F.sort_array(F.collect_list(written)).alias("c"))
    return listed.select(*keys, F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.6","components":['), F.array_join(F.col("c.json"), ","), F.lit("]}")).alias("content"))


def explode_cbom(documents: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Asset rows of documents (keys, content): components by occurrences; a component without any takes its ``path:line`` property."""
    parsed = documents.select(*keys, F.from_json("content", DOCUMENT).alias("d"))
    parts = parsed.select(*keys, F.explode_outer("d.components").alias("c")).where("c is not null")
    rows = parts.select(*keys, "c", F.explode_outer("c.occurrences").alias("o"))
    props = F.map_from_entries(F.coalesce("c.properties", F.array().cast("array<struct<name:string,value:string>>")))
    location = props["location"]
    return rows.select(
        *keys,
        F.col("c.name").alias("algorithm"),
        F.col("c.cryptoProperties.algorithmProperties.parameterSetIdentifier").alias("parameter_set"),
        F.col("c.cryptoProperties.algorithmProperties.mode").alias("mode"),
        F.coalesce("o.file", F.nullif(F.regexp_extract(location, r"^(.*):(\d+)$", 1), F.lit(""))).alias("file"),
        F.coalesce("o.line", F.regexp_extract(location, r"^(.*):(\d+)$", 2).try_cast("long")).alias("line"),
    )


def cbom_to_assets(documents: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Finding-shaped rows of documents; the digits of the parameter set are the key size."""
    return explode_cbom(documents, keys).withColumn("key_size", F.regexp_extract("parameter_set", r"\d+", 0).try_cast("int")).drop("parameter_set")


def severity_counts(components: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Components per severity bucket of each scan."""
    r = F.col("max_severity_rank")
    return components.groupBy(*keys).agg(F.count_if(r == 4).alias("critical"), F.count_if(r == 3).alias("high"), F.count_if(r == 2).alias("medium"), F.count_if(r == 1).alias("low"), F.count_if(r == 0).alias("informational"))


def component_inventory(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per algorithm: sets of libraries, modes and key sizes as sorted text, distinct files, findings."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return findings.groupBy(*keys, "algorithm").agg(joined("library").alias("libraries"), joined("mode").alias("modes"), joined("key_size").alias("key_sizes"), F.count_distinct("file").alias("files"), F.count("*").alias("findings"))


def crypto_dependencies(edges: DataFrame) -> DataFrame:
    """The sorted set of what each reference depends on, from (ref, depends_on) rows with arrays."""
    return edges.select("ref", F.explode("depends_on").alias("on")).groupBy("ref").agg(F.array_join(F.array_sort(F.collect_set("on")), ",").alias("depends_on"))


def number_versions(scans: DataFrame) -> DataFrame:
    """Scans with version number and label per repository, in order of creation."""
    n = F.row_number().over(Window.partitionBy("repo_id").orderBy("created_at", "scan_id"))
    return scans.withColumn("version_number", n).withColumn("version_label", F.concat(F.lit("v"), F.col("version_number").cast("string")))


def with_previous(scans: DataFrame) -> DataFrame:
    """Scans with the one before of the same repository."""
    return scans.withColumn("previous_scan_id", F.lag("scan_id").over(Window.partitionBy("repo_id").orderBy("created_at", "scan_id")))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row per key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def cbom_diff(current: DataFrame, previous: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Components of two inventories side by side: added, removed, changed or unchanged, with the fields that changed, and places that came and went.

    Nulls in the identity are equal to each other.
    """
    on = [*keys, *IDENTITY]
    a, b = current.alias("a"), previous.alias("b")
    same = F.lit(True)
    for k in on:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, same, "full_outer")
    pick = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in on]
    spots = lambda side: F.coalesce(F.transform(F.col(f"{side}.places"), lambda p: F.concat_ws(":", p["file"], p["line"].cast("string"))), F.array().cast("array<string>"))
    came, went = F.array_except(spots("a"), spots("b")), F.array_except(spots("b"), spots("a"))
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    fields = F.array_compact(F.array(*[F.when(differs(c), name) for c, name in (("max_severity_rank", "severity"), ("library", "library"), ("occurrences", "occurrences"))], F.when((F.size(came) > 0) | (F.size(went) > 0), "places")))
    change = F.when(F.col("b.occurrences").isNull(), "added").when(F.col("a.occurrences").isNull(), "removed").when(F.size(fields) > 0, "changed").otherwise("unchanged")
    return joined.select(*pick, change.alias("change"), F.when(change == "changed", F.array_join(fields, ",")).alias("changed_fields"), F.size(came).alias("places_added"), F.size(went).alias("places_removed"))


def version_diff(current: DataFrame, previous: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows by ``key`` with the list of ``fields`` that changed."""
    a, b = current.alias("a"), previous.alias("b")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]))
    kind = F.when(F.col(f"b.{key}").isNull(), "added").when(F.col(f"a.{key}").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), kind.alias("change"), F.when(kind == "changed", F.array_join(changed, ",")).alias("changed_fields"))
