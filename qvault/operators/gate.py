"""The gate: compare two inventories of a repository, pair moved assets, apply policy and waivers, give a verdict."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.functions.assets import asset_category, asset_fingerprint, is_quantum_vulnerable, norm_path
from qvault.operators.scopes import scope, scopes, shared_keys

# The policy where none is given.
DEFAULT_POLICY = {
    "max_new_quantum_vulnerable": 0,
    "max_total_quantum_vulnerable": "baseline",
    "prohibited_algorithms": ["MD5", "SHA-1", "DES", "3DES", "RC4", "RSA<2048", "DH<2048"],
    "fail_on_prohibited_in_new_code": True,
    "waiver_max_days": 90,
    "waiver_warn_days": 14,
    "allow_decrease": True,
}
CATEGORIES = ["signature", "key_exchange", "encryption", "hash", "protocol"]


def load_policy(given: dict | None = None) -> dict:
    """The defaults, overlaid by known keys; numbers that can't be read fall back."""
    policy = DEFAULT_POLICY | {k: v for k, v in (given or {}).items() if k in DEFAULT_POLICY}
    for k in ("max_new_quantum_vulnerable", "waiver_max_days", "waiver_warn_days"):
        try:
            policy[k] = int(policy[k])
        except (TypeError, ValueError):
            policy[k] = DEFAULT_POLICY[k]
    if not isinstance(policy["prohibited_algorithms"], list):
        policy["prohibited_algorithms"] = DEFAULT_POLICY["prohibited_algorithms"]
    return policy


def gate_assets(assets: DataFrame) -> DataFrame:
    """Assets with fingerprint, path-free fingerprint, category and vulnerability."""
    c = F.col
    return assets.withColumns(
        {
            "fingerprint": asset_fingerprint(c("algorithm"), c("primitive"), c("key_size"), c("file"), c("usage")),
            "moved_fingerprint": asset_fingerprint(c("algorithm"), c("primitive"), c("key_size"), None, c("usage")),
            "category": asset_category(c("algorithm"), c("usage")),
            "vulnerable": is_quantum_vulnerable(c("quantum_status"), c("algorithm")),
        }
    )


def asset_diff(base: DataFrame, head: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Head and base assets marked added, unchanged or removed by fingerprint; duplicates stay."""
    both = base.withColumn("_head", F.lit(False)).unionByName(head.withColumn("_head", F.lit(True)))
    lone = F.col("_lone")
    for c in (*keys, "fingerprint"):
        lone = lone | F.col(c).isNull()  # what has no key equals nothing
    change = F.when(~lone, F.when(F.col("_head"), "unchanged")).when(F.col("_head"), "added").otherwise("removed")
    return _with_lone(both, keys).withColumn("change", change).where("change is not null").drop("_head", "_lone")


def _with_lone(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Assets of two inventories, marked by _head, with _lone: whether the other has none of their fingerprint.

    Fingerprints repeat, so they are counted before they move; assets meet the
    result and are not dealt by fingerprint themselves where it is small.
    """
    on = [*keys, "fingerprint"]
    seen = both.groupBy(*on).agg((F.min("_head") == F.max("_head")).alias("_lone")).alias("s")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}"))
    return both.alias("b").join(seen, same).select("b.*", "s._lone")


def pair_moves(diff: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Added assets, each with the file it moved from, if any: the k-th added pairs with the k-th removed of equal path-free fingerprint."""
    on = [*keys, "moved_fingerprint"]
    w = Window.partitionBy(*on).orderBy("ordinal")
    added = diff.where("change = 'added'").withColumn("_k", F.row_number().over(w))
    removed = diff.where("change = 'removed'").select(*on, F.col("file").alias("moved_from"), F.row_number().over(w).alias("_k"))
    return added.join(removed, [*on, "_k"], "left").drop("_k")


def _glob(pattern: Column) -> Column:
    """A shell glob as a regular expression; ``*`` also crosses slashes."""
    escaped = F.regexp_replace(pattern, r"([.+^$()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def _held_names(name: Column) -> Column:
    """Every part of a name, the empty one included; names of algorithms are short."""
    parts = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.transform(F.sequence(i, F.length(name)), lambda j: F.substring(name, i, j - i + 1)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.length(name) > 0, F.flatten(parts)).otherwise(F.array().cast("array<string>"))))


def match_waivers(assets: DataFrame, waivers: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(keys, algorithm, file, fingerprint, waiver_ordinal, waiver_id): the distinct assets that each waiver covers.

    A waiver covers by fingerprint, or by algorithm (either name in the other)
    and path glob. It holds for the repository that its ``keys`` name; where
    they are null, or it has none, for all. Which names hold each other is an
    equi-join of the distinct names of one side with the parts of the other's;
    then assets meet waivers by equi-joins on scope and fingerprint, and on
    scope and name with the glob as a condition.
    """
    on = shared_keys(waivers, keys)
    a = assets.select(*keys, "algorithm", "file", "fingerprint").distinct().withColumn("name", F.upper(F.coalesce("algorithm", F.lit("")))).withColumn("scope", F.explode(scopes(on)))
    w = waivers.select("waiver_ordinal", "waiver_id", F.upper(F.trim("match_algorithm")).alias("target"), "match_path", F.lower(F.trim("match_fingerprint")).alias("print"), scope(on).alias("scope"))
    # One join finds both directions: a name asks for itself among the parts of targets, and offers its parts to them.
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("part"))
    keys_of = lambda c, own, other: F.concat(F.array(key(own, F.col(c))), F.transform(_held_names(F.col(c)), lambda p: key(other, p)))
    names = a.select("name").distinct().withColumn("key", F.explode(keys_of("name", "within", "around")))
    targets = w.select("target").where("target is not null").distinct().withColumn("key", F.explode(keys_of("target", "around", "within")))
    pairs = names.join(targets, "key").select("name", "target").distinct()
    path, glob = norm_path(F.col("file")), norm_path(F.col("match_path"))
    by_path = F.rlike(path, _glob(glob)) | F.rlike(path, _glob(F.concat(F.lit("*/"), glob)))
    # Then one join, on fingerprints and on names, so that assets are read once more only.
    asked = a.withColumn("key", F.explode(F.array(key("print", F.lower("fingerprint")), key("name", F.col("name"))))).drop("name")
    held = ["scope", "key", "waiver_ordinal", "waiver_id", "match_path"]
    given = w.where("print is not null").withColumn("key", key("print", F.col("print"))).select(held)
    given = given.unionByName(w.where("match_path is not null").join(pairs, "target").withColumn("key", key("name", F.col("name"))).select(held))
    met = asked.join(given, ["scope", "key"]).where((F.col("key.kind") == "print") | by_path)
    return met.select(*keys, "algorithm", "file", "fingerprint", "waiver_ordinal", "waiver_id")


def apply_waivers(violations: DataFrame, waivers: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Violations with the first waiver (by ordinal) that covers each, null if none."""
    of = [*keys, "algorithm", "file", "fingerprint"]
    first = match_waivers(violations, waivers, keys).groupBy(*of).agg(F.min_by("waiver_id", "waiver_ordinal").alias("waiver_id")).alias("m")
    same = F.lit(True)
    for c in of:
        same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"m.{c}"))
    return violations.alias("v").join(first, same, "left").select("v.*", "m.waiver_id")


def stale_waivers(waivers: DataFrame, assets: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Waivers that cover no asset of the repositories that they hold for; waivers are told apart by ordinal and id."""
    on = ["waiver_ordinal", "waiver_id"]
    return waivers.join(match_waivers(assets, waivers, keys).select(on).distinct(), on, "left_anti")


def prohibited_spec(algorithm: Column, key_size: Column, specs: Sequence[str]) -> Column:
    """The first spec that the algorithm falls under, null if none; ``RSA<2048`` compares sizes."""
    name = F.upper(F.trim(F.coalesce(algorithm, F.lit(""))))
    bare = F.regexp_replace(name, "[^A-Z0-9]", "")
    out = F.lit(None).cast("string")
    for spec in reversed(list(specs)):
        upper = spec.strip().upper()
        if m := re.match(r"^([A-Z0-9_-]+)\s*<\s*(\d+)$", upper):
            size = F.coalesce(key_size.cast("long"), F.regexp_extract(name, r"(\d+)", 1).try_cast("long"))
            hit = name.contains(m[1]) & F.coalesce(size < int(m[2]), F.lit(False))
        else:
            hit = (bare == re.sub("[^A-Z0-9]", "", upper)) | F.array_contains(F.split(name, "-"), upper) | F.array_contains(F.split(name, "_"), upper) | F.array_contains(F.split(name, r"\s+"), upper)
        out = F.when(hit, spec).otherwise(out)
    return out


def gate_metrics(base: DataFrame, head: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Per repository and category: vulnerable assets in base and head, and their difference."""
    both = base.withColumn("_h", F.lit(0)).unionByName(head.withColumn("_h", F.lit(1))).where("vulnerable")
    counted = both.groupBy(*keys, "category").agg(F.count_if(F.col("_h") == 0).alias("base"), F.count_if(F.col("_h") == 1).alias("head"))
    return counted.withColumn("delta", F.col("head") - F.col("base"))


def gate_verdict(base: DataFrame, head: DataFrame, waivers: DataFrame | None = None, policy: dict | None = None, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """One row per repository: counts, verdict, exit code, reasons and warnings, for all repositories in one job.

    Warnings tell of new assets that a waiver lets pass, and of vulnerable
    assets that grew in spite of one.
    """
    policy = load_policy(policy)
    # Both inventories in one table; only what one of them lacks can be added, removed or moved, and is ranked.
    both = _with_lone(base.withColumn("_head", F.lit(False)).unionByName(head.withColumn("_head", F.lit(True))), keys)
    place = Window.partitionBy(*keys, "moved_fingerprint")
    lone = both.where("_lone").withColumns({"_removed": F.count_if(~F.col("_head")).over(place), "_k": F.row_number().over(Window.partitionBy(*keys, "moved_fingerprint", "_head").orderBy("ordinal"))})
    new = lone.where(F.col("_head") & (F.col("_k") > F.col("_removed")))  # the k-th added pairs with the k-th removed
    if waivers is not None:
        new = apply_waivers(new, waivers, keys)
    else:
        new = new.withColumn("waiver_id", F.lit(None).cast("string"))
    new = new.withColumn("_spec", prohibited_spec(F.col("algorithm"), F.col("key_size"), policy["prohibited_algorithms"]))
    fresh = new.groupBy(*keys).agg(
        F.count_if(F.col("vulnerable") & F.col("waiver_id").isNull()).alias("unwaived"),
        F.count_if(F.col("vulnerable") & F.col("waiver_id").isNotNull()).alias("waived"),
        F.count("_spec").alias("prohibited"),
        F.array_join(F.array_sort(F.collect_set("_spec")), ", ").alias("specs"),
    )
    total = base.withColumn("_head", F.lit(False)).unionByName(head.withColumn("_head", F.lit(True))).groupBy(*keys).agg(F.count_if(F.col("vulnerable") & ~F.col("_head")).alias("base_vulnerable"), F.count_if(F.col("vulnerable") & F.col("_head")).alias("head_vulnerable"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}"))
    rows = total.alias("t").join(fresh.alias("n"), same, "left").select("t.*", *[F.coalesce(f"n.{c}", F.lit(0)).alias(c) for c in ("unwaived", "waived", "prohibited")], F.coalesce("n.specs", F.lit("")).alias("specs"))
    ratchet = F.col("unwaived") > policy["max_new_quantum_vulnerable"]
    grown = F.lit(policy["max_total_quantum_vulnerable"] == "baseline") & (F.col("head_vulnerable") > F.col("base_vulnerable")) & (F.col("waived") == 0)
    banned = F.lit(bool(policy["fail_on_prohibited_in_new_code"])) & (F.col("prohibited") > 0)
    reasons = F.array_compact(
        F.array(
            F.when(ratchet, F.format_string("%d new quantum-vulnerable assets", "unwaived")),
            F.when(grown & ~ratchet, F.format_string("vulnerable assets grew from %d to %d", "base_vulnerable", "head_vulnerable")),
            F.when(banned, F.format_string("%d prohibited (%s)", "prohibited", "specs")),
        )
    )
    failed = F.size("reasons") > 0
    warnings = F.array_compact(
        F.array(
            F.when(F.col("waived") > 0, F.format_string("%d new quantum-vulnerable assets are waived", "waived")),
            F.when((F.col("waived") > 0) & (F.col("head_vulnerable") > F.col("base_vulnerable")), F.format_string("vulnerable assets grew from %d to %d under waivers", "base_vulnerable", "head_vulnerable")),
        )
    )
    return rows.withColumn("reasons", reasons).select(
        *keys, "base_vulnerable", "head_vulnerable", "unwaived", "waived", "prohibited", F.when(failed, "FAIL").otherwise("PASS").alias("verdict"), failed.cast("int").alias("exit_code"), F.array_join("reasons", "; ").alias("reasons"), F.array_join(warnings, "; ").alias("warnings")
    )
