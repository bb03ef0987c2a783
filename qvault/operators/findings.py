"""Findings: duplicates, corroboration between layers, suppression, order, summaries.

All functions take and return findings keyed by ``keys`` (a scan, or a scan of
a repository); everything is decided inside a site (file, line) of a scan, so
the largest group is one site.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.functions.findings import algorithm_family, finding_fingerprint, layer, rule_quality, severity_of_rank, severity_rank
from qvault.operators.scopes import scope, scopes, shared_keys

KMS = ("Cloud KMS / HSM", "Cloud KMS", "Hardware Module")
SECRETS = ("hardcoded-secret", "secret")


def dedup_exact(findings: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """The first finding of each (file, line, rule)."""
    w = Window.partitionBy(*keys, "file", "line", "rule_id").orderBy("ordinal")
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: What a winner takes over from the others of its group where it has none itself.
INHERITED = ("mode", "exposure_signals", "exposure_rationale")


def _held(findings: DataFrame) -> list[str]:
    return [c for c in INHERITED if c in findings.columns]


def _stated(findings: DataFrame, name: str) -> Column:
    """A column's value, null where it is empty."""
    kind = dict(findings.dtypes)[name]
    return F.when(F.size(name) > 0, F.col(name)) if kind.startswith("array") else F.when(F.col(name) != "", F.col(name)) if kind == "string" else F.col(name)


def _merge(held: Sequence[str]):
    """A fold's step: the more specific of two findings, the earlier on a tie; it takes over what it lacks."""

    def step(acc: Column, x: Column) -> Column:
        wins = x["specificity"] > acc["specificity"]
        pick = lambda c: F.when(wins, x[c]).otherwise(acc[c]).alias(c)
        inherit = lambda c: F.when(wins, F.coalesce(x[c], acc[c])).otherwise(F.coalesce(acc[c], x[c])).alias(c)
        return F.struct(pick("ordinal"), pick("specificity"), *map(inherit, held), pick("row"))

    return step


def _winners(findings: DataFrame, group: Sequence[Column | str]) -> DataFrame:
    """The winning finding of each group, whole, with what it inherits, the number of members and their detection methods.

    A group lies inside one site, so its members fit a list, and the winner
    needs no join back to the findings. Columns that a group is named by stay
    columns, so Spark knows that what they deal stays together.
    """
    held = _held(findings)
    named = [c for c in group if isinstance(c, str)]
    member = F.struct("ordinal", "specificity", *[_stated(findings, c).alias(c) for c in held], F.struct(*[c for c in findings.columns if c not in named]).alias("row"))
    listed = findings.groupBy(*group).agg(F.sort_array(F.collect_list(member)).alias("l"), F.array_sort(F.collect_set(F.upper("detection_method"))).alias("methods"))
    won = F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), F.get("l", F.lit(0)), _merge(held))
    rows = listed.select(*named, won.alias("w"), F.size("l").alias("_members"), F.col("methods").alias("_methods"))
    own = lambda c: F.col(c) if c in named else F.coalesce(F.col(f"w.{c}"), F.col(f"w.row.{c}")) if c in held else F.col(f"w.row.{c}")
    return rows.select(*[own(c).alias(c) for c in findings.columns], "_members", "_methods")


def collapse_same_layer(findings: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """One finding per site, detection method, algorithm and category: the most specific, with a mode and signs of exposure inherited."""
    return _winners(findings, [*keys, "file", "line", "detection_method", "algorithm", "category"]).select(findings.columns)


def corroborate(findings: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """One specific finding per site and algorithm family; two or more members make it confirmed and name their methods.

    Members count, not distinct layers, as two findings of one layer also
    confirm. Generic findings pass: each is a group of its own.
    """
    family = F.when(F.col("generic"), F.lit("")).otherwise(algorithm_family(F.col("algorithm"))).alias("_family")
    alone = F.when(F.col("generic"), F.col("ordinal")).alias("_alone")
    kept = _winners(findings, [*keys, "file", "line", family, alone])
    several = ~F.col("generic") & (F.col("_members") >= 2)
    return kept.withColumns(
        {
            "confidence": F.when(several, "Confirmed").otherwise(F.col("confidence")),
            "detection": F.when(several, F.array_join("_methods", ", ")).otherwise(F.upper("detection_method")),
        }
    ).select([*findings.columns, "detection"])


def suppress_generic(findings: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Without generic findings beside a specific one or below their category's best, and without secrets beside a key service."""
    site = Window.partitionBy(*keys, "file", "line")
    kind = Window.partitionBy(*keys, "file", "line", "category")
    marked = findings.withColumns(
        {
            "_specific": F.max((~F.col("generic")).cast("int")).over(site),
            "_kms": F.max(F.col("category").isin(*KMS).cast("int")).over(site),
            "_best": F.max("specificity").over(kind),
        }
    )
    gone = (F.col("generic") & ((F.col("_specific") == 1) | (F.col("specificity") < F.col("_best")))) | ((F.col("_kms") == 1) & F.col("category").isin(*SECRETS))
    return marked.where(~gone).select(findings.columns)


def deduplicate(findings: DataFrame, keys: Sequence[str] = ("scan_id",), *, dealt: bool = False) -> DataFrame:
    """The whole chain: exact, within a layer, between layers, generic.

    Findings are dealt by site once; every step groups inside sites and needs
    no other shuffle. With ``dealt`` they stay where they are, as those of a
    site, or of all its scan, lie together already.
    """
    sites = findings if dealt else findings.repartition(*keys, "file", "line")
    return suppress_generic(corroborate(collapse_same_layer(dedup_exact(sites, keys), keys), keys), keys)


def merge_secrets(findings: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Where layers agree at a site, one secret stays, with the worst severity, and what stays there is confirmed."""
    site = Window.partitionBy(*keys, "file", "line")
    secret = F.col("category").isin(*SECRETS) | (F.col("rule_id") == "aes-hardcoded-key")
    secrets = Window.partitionBy(*keys, "file", "line", "_secret")
    marked = findings.withColumns({"_layer": layer(F.col("language"), F.col("rule_id")), "_secret": secret, "_rank": severity_rank(F.col("severity"))})
    marked = marked.withColumns({"_layers": F.size(F.collect_set("_layer").over(site)), "_own": F.size(F.collect_set("_layer").over(secrets))})
    marked = marked.withColumns(
        {
            "_n": F.row_number().over(secrets.orderBy(rule_quality(F.col("rule_id")).desc(), F.col("_rank").desc(), F.col("rule_id").desc(), "ordinal")),
            "_worst": F.max("_rank").over(secrets),
            "_members": F.count("*").over(secrets),
        }
    )
    merges = F.col("_secret") & (F.col("_layers") >= 2) & (F.col("_own") >= 2) & (F.col("_members") >= 2)
    return (
        marked.where(~(merges & (F.col("_n") > 1)))
        .withColumn("severity", F.when(merges, severity_of_rank(F.col("_worst"))).otherwise(F.col("severity")))
        .withColumn("confidence", F.when(F.col("_layers") >= 2, "Confirmed").otherwise(F.col("confidence")))
        .select(findings.columns)
    )


def apply_suppressions(findings: DataFrame, rules: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``suppressed`` and ``suppression_reason`` by rules (ordinal, rule_id, path, line, token); nulls match anything.

    A rule holds for the repository that its ``keys`` name; where they are
    null, or the rules have none of them, for all.

    A path matches by its last part, which every longer match has, too. Rules
    see few attributes of a finding, so each distinct combination is tested
    once: it meets the rules by an equi-join on what a rule asks for first, a
    token, a path, a rule or algorithm, or a line, and the rest is a condition.
    The first rule by its ordinal counts. Suppressed findings stay in the table
    for audit.
    """
    on = shared_keys(rules, keys)
    attributes = [*on, "rule_id", "algorithm", "file", "line", "code_snippet"]
    last = lambda c: F.element_at(F.split(F.lower(c), "/"), -1)
    named = F.nullif(F.lower("rule_id"), F.lit("*"))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("value"))
    asked = F.when(F.col("token").isNotNull(), key("token", F.col("token"))).when(F.col("path").isNotNull(), key("path", last("path"))).when(named.isNotNull(), key("rule", named)).when(F.col("line").isNotNull(), key("line", F.col("line"))).otherwise(key("any", F.lit("")))
    r = rules.withColumn("key", asked).select("key", scope(on).alias("scope"), *[F.col(c).alias(f"r_{c}") for c in ("ordinal", "rule_id", "path", "line", "token")])
    f = findings.select(attributes).distinct().withColumn("fp", finding_fingerprint(F.col("rule_id"), F.col("algorithm"), F.col("code_snippet")))
    own = F.array_distinct(F.array(key("token", F.col("fp")), key("path", last("file")), key("rule", F.lower("rule_id")), key("rule", F.lower("algorithm")), key("line", F.col("line")), key("any", F.lit(""))))
    wanted = F.lower("r_rule_id")
    match = (F.col("r_rule_id").isNull() | (wanted == "*") | (wanted == F.lower("rule_id")) | (wanted == F.lower("algorithm"))) & (F.col("r_path").isNull() | (last("r_path") == last("file"))) & (F.col("r_line").isNull() | (F.col("r_line") == F.col("line"))) & (F.col("r_token").isNull() | (F.col("r_token") == F.col("fp")))
    reason = F.when(F.col("r_token").isNotNull(), "fingerprint").when(F.col("r_rule_id").isNull(), "path").when(F.col("r_path").isNull(), "rule").when(F.col("r_line").isNull(), "rule and path").otherwise("rule, path and line")
    hits = f.withColumn("key", F.explode(own)).withColumn("scope", F.explode(scopes(on))).join(r, ["scope", "key"]).where(match).groupBy(*attributes).agg(F.min_by(reason, F.col("r_ordinal")).alias("suppression_reason")).alias("h")
    same = F.lit(True)
    for c in attributes:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}"))
    joined = findings.alias("g").join(hits, same, "left")
    found = F.col("h.suppression_reason")
    return joined.select(*[(F.col("g.suppressed") | found.isNotNull()).alias(c) if c == "suppressed" else F.col(f"g.{c}") for c in findings.columns if c != "suppression_reason"], found.alias("suppression_reason"))


def active(findings: DataFrame) -> DataFrame:
    return findings.where("not suppressed and status <> 'RESOLVED'")


def order_findings(findings: DataFrame, by: str = "specificity") -> DataFrame:
    """By file, line, falling severity, then falling specificity or rising rule id."""
    last = F.desc("specificity") if by == "specificity" else F.asc("rule_id")
    return findings.orderBy("file", "line", severity_rank(F.col("severity")).desc(), last, "ordinal")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def capped_rows(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first ``n`` rows per group, each with the number of rows left out."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("overflow", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return ranked.where(F.col("rank") <= n)


def page(df: DataFrame, order: Sequence, limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def union_layers(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for one in layers[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def keyed_except(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), list(key), "left_anti")


def keyed_intersect(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), list(key), "left_semi")


def union_distinct(*tables: DataFrame) -> DataFrame:
    return union_layers(*tables).distinct()


def stored_findings(findings: DataFrame) -> DataFrame:
    """The rows to store: a deterministic id, a status of three, capped texts, a key size from the algorithm where there is none."""
    status = F.when(F.col("quantum_risk").isin("Quantum-Broken", "Quantum-Weakened"), "vulnerable").when(F.col("quantum_risk") == "Safe", "safe").otherwise("unknown")
    size = F.coalesce(F.col("key_size"), F.expr("try_cast(nullif(regexp_extract(algorithm, '(\\\\d{3,4})', 1), '') AS INT)"))
    return findings.select(
        F.substring(F.sha2(F.concat_ws(":", F.col("scan_id").cast("string"), "file", F.col("line").cast("string"), "rule_id", F.col("ordinal").cast("string")), 256), 1, 32).alias("id"),
        "scan_id",
        F.left("file", F.lit(512)).alias("file_path"),
        F.col("line").alias("line_number"),
        "algorithm",
        size.alias("key_size"),
        status.alias("quantum_status"),
        F.lower("severity").alias("severity"),
    )


def summarize(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of active findings by severity, risk and language, and totals, in one pass of grouping sets."""
    dims = ["severity", "quantum_risk", "language"]
    tall = findings.select(*keys, "suppressed", F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])).alias("x"))
    return tall.groupBy(*keys, "x.dimension", "x.value").agg(F.count_if(~F.col("suppressed")).alias("active"), F.count_if("suppressed").alias("suppressed"))


def files_with_findings(findings: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Per scan: the files that have findings, the active and the suppressed findings, and the worst active severity."""
    kept = ~F.col("suppressed")
    worst = severity_of_rank(F.max(F.when(kept, severity_rank(F.col("severity")))))
    return findings.groupBy(*keys).agg(F.count_distinct("file").alias("files"), F.count_if(kept).alias("active"), F.count_if(~kept).alias("suppressed"), worst.alias("worst"))
