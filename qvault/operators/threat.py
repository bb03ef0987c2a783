"""Monte Carlo threat model: when a quantum computer breaks a family, against how long data lives and migration takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qvault.functions import threat as ft

FAMILIES = ["AES", "DH", "ECC", "HASH", "OTHER", "RSA"]


def crypto_assets(findings: DataFrame) -> DataFrame:
    """Findings with family, lifetime X, migration time Y and key-size multiplier."""
    c = F.col
    with_family = findings.withColumn("family", ft.risk_family(c("algorithm")))
    return with_family.withColumns({"x": ft.lifetime_years(c("usage")), "y": ft.migration_years(c("usage"), c("family")), "multiplier": ft.key_size_multiplier(c("family"), c("key_size"))})


def with_overrides(assets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Assets whose lifetime x and migration time y give way to those of ``overrides`` (asset_id, data_lifetime_years, migration_time_years) that are stated and not negative."""
    stated = lambda c: F.when(F.col(c) >= 0, F.col(c).cast("double"))
    given = overrides.groupBy("asset_id").agg(F.max(stated("data_lifetime_years")).alias("_x"), F.max(stated("migration_time_years")).alias("_y"))
    return assets.join(given, "asset_id", "left").withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).drop("_x", "_y")


def patch_scenarios(patch: dict[str, dict[str, tuple]], scenarios: dict | None = None) -> dict:
    """Scenarios with some timelines replaced: only those whose three years ascend from zero or more; others stay as they were."""
    valid = lambda t: len(t) == 3 and 0 <= t[0] <= t[1] <= t[2]
    known = scenarios or ft.SCENARIOS
    return {name: known.get(name, {}) | {f: t for f, t in patch.get(name, {}).items() if valid(t)} for name in {**known, **patch}}


def scenario_table(spark: SparkSession, scenarios: dict | None = None, shifts: Sequence[float] = (0.0,)) -> DataFrame:
    """One row per scenario, shift and family, with the timeline's parameters: a few dozen rows."""
    rows = [
        (name if len(shifts) == 1 else f"{name}:arrival-shift:{s:+g}", f, *(float(p + s) for p in lines.get(f, ft.OTHER_TIMELINE)), f in lines)
        for name, lines in (scenarios or ft.SCENARIOS).items() for s in shifts for f in FAMILIES
    ]
    return spark.createDataFrame(rows, "scenario string, family string, low double, mode double, high double, stated boolean")


#: How many uniform draws a break time of each distribution takes.
DRAWS = {"triangular": 1, "normal": 2, "lognormal": 2}


def timeline_table(spark: SparkSession, scenarios: dict[str, dict[str, tuple]]) -> DataFrame:
    """Scenarios by name, each with timelines by family as (distribution, parameters), as rows in the form of ``scenario_table``.

    Triangular ones have low, mode and high, the others mean and sd. A family
    that a scenario does not state takes its OTHER, or the default one.
    """
    rows = []
    for name, lines in scenarios.items():
        for f in FAMILIES:
            kind, params = lines.get(f) or lines.get("OTHER") or ("triangular", ft.OTHER_TIMELINE)
            a, b, c = (*map(float, params), None)[:3] if len(params) >= 2 else (None, None, None)
            rows.append((name, f, kind, *((a, b, c, None, None) if kind == "triangular" else (None, None, None, a, b)), f in lines))
    return spark.createDataFrame(rows, "scenario string, family string, distribution string, low double, mode double, high double, mean double, sd double, stated boolean")


def check_timelines(timelines: DataFrame) -> DataFrame:
    """Timelines with ``reject_reason``, null where their distribution and parameters can be drawn from."""
    c = F.col
    finite = lambda *cs: F.forall(F.array(*[c(x) for x in cs]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    reason = (
        F.when(~F.coalesce(c("distribution").isin(*DRAWS), F.lit(False)), "distribution unknown")
        .when((c("distribution") == "triangular") & ~finite("low", "mode", "high"), "parameters not finite")
        .when((c("distribution") == "triangular") & ~((c("low") >= 0) & (c("low") <= c("mode")) & (c("mode") <= c("high"))), "years do not ascend")
        .when((c("distribution") != "triangular") & ~finite("mean", "sd"), "parameters not finite")
        .when((c("distribution") != "triangular") & (c("sd") <= 0), "sd not positive")
        .when((c("distribution") == "lognormal") & (c("mean") <= 0), "mean not positive")
    )
    return timelines.withColumn("reject_reason", reason)


def draws(spark: SparkSession, timelines: DataFrame, families: Sequence[str], n: int, seed: int) -> DataFrame:
    """(scenario, family, stated, z): ``n`` break times per scenario and family, shared by all assets.

    Families that assets have, sorted, take the draws of a scenario in turn, one
    for a triangular time and two for a normal or lognormal one, so a family
    begins after the sum of what those before it take. A draw depends on its
    number alone, so the table is made in parallel and in no order. Timelines
    without a distribution are triangular; those that ``check_timelines``
    rejects give no times.
    """
    used = sorted(set(families) - {"PQC"})
    mixed = "distribution" in timelines.columns
    kept = check_timelines(timelines).where("reject_reason is null") if mixed else timelines.withColumns({"distribution": F.lit("triangular"), "mean": F.lit(None).cast("double"), "sd": F.lit(None).cast("double")})
    each = F.create_map(*[F.lit(x) for pair in DRAWS.items() for x in pair])[F.col("distribution")]
    before = Window.partitionBy("scenario").orderBy("family").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.where(F.col("family").isin(*used)).withColumn("k", each).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)) * n)
    rows = placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).withColumn("at", F.col("first") + (F.col("i") - 1) * F.col("k") + 1)
    u = rows.withColumns({"u": ft.uniform_draw(seed, F.col("at")), "v": F.when(F.col("k") == 2, ft.uniform_draw(seed, F.col("at") + 1))} if mixed else {"u": ft.uniform_draw(seed, F.col("at")), "v": F.lit(None).cast("double")})
    normal = F.col("mean") + F.col("sd") * ft.standard_normal(F.col("u"), F.col("v"))
    time = F.when(F.col("distribution") == "normal", normal).when(F.col("distribution") == "lognormal", ft.lognormal(F.col("u"), F.col("v"), F.col("mean"), F.col("sd"))).otherwise(ft.triangular(F.col("u"), F.col("low"), F.col("mode"), F.col("high")))
    return u.select("scenario", "family", "stated", F.greatest(F.lit(0.0), time).alias("z"))


def threat_assessment(assets: DataFrame, scenarios: DataFrame, *, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Per asset and scenario: P(break before migration), P(X + Y > Z), 95% intervals, quantiles, band.

    Assets collapse to their distinct (family, multiplier, X, Y) first, so the
    work is draws times distinct parameters, whatever the number of assets.
    ``assets`` has asset_id, family, multiplier, x and y.
    """
    spark = assets.sparkSession
    families = [r["family"] for r in assets.select("family").distinct().collect()]  # at most seven
    z = draws(spark, scenarios, families, n, seed)
    params = assets.where("family <> 'PQC'").select("family", "multiplier", "x", "y").distinct()
    scaled = F.col("z") * F.col("multiplier")
    counts = z.join(params, "family").groupBy("scenario", "family", "stated", "multiplier", "x", "y").agg(F.count_if(scaled < F.col("y")).alias("broken"), F.count_if(scaled < F.col("x") + F.col("y")).alias("violated"))
    spread = z.groupBy("scenario", "family").agg(F.percentile("z", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    rows = counts.join(spread, ["scenario", "family"])
    p, b = F.col("violated") / n, F.col("broken") / n
    error = lambda v: 1.96 * F.sqrt(v * (1 - v) / n)
    cols = {
        "p_break": b, "p_violated": p,
        "p_violated_low": F.greatest(F.lit(0.0), p - error(p)), "p_violated_high": F.least(F.lit(1.0), p + error(p)),
        "p10": F.col("q")[0] * F.col("multiplier"), "p50": F.col("q")[1] * F.col("multiplier"), "p90": F.col("q")[2] * F.col("multiplier"),
        "low_confidence": (F.col("family") == "OTHER") | ~F.col("stated"),
    }
    rows = rows.withColumns(cols).withColumn("risk_band", ft.risk_band(F.col("p_violated"))).drop("q", "broken", "violated", "stated")
    broken = assets.where("family <> 'PQC'").join(rows, ["family", "multiplier", "x", "y"])
    names = [r["scenario"] for r in scenarios.select("scenario").distinct().collect()]  # a handful
    safe = assets.where("family = 'PQC'").withColumn("scenario", F.explode(F.array(*map(F.lit, names))))
    zero = {k: F.lit(0.0) for k in cols if k != "low_confidence"} | {"low_confidence": F.lit(False), "risk_band": F.lit("MINIMAL")}
    return broken.unionByName(safe.withColumns(zero))


def family_quantiles(assets: DataFrame, timelines: DataFrame, *, n: int = 10_000, seed: int = 42) -> DataFrame:
    """p10, p50 and p90 of the break time per scenario, of the families and multipliers that ``assets`` have, with their number of assets."""
    z = draws(assets.sparkSession, timelines, FAMILIES, n, seed)
    spread = z.groupBy("scenario", "family").agg(F.percentile("z", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    held = assets.where("family <> 'PQC'").groupBy("family", "multiplier").agg(F.count("*").alias("assets"))
    return held.join(spread, "family").select("scenario", "family", "multiplier", "assets", *[(F.col("q")[i] * F.col("multiplier")).alias(c) for i, c in enumerate(("p10", "p50", "p90"))])


def threat_summary(assessed: DataFrame, n: int) -> DataFrame:
    """Per scenario: how many assets are expected to be violated, the highest and the mean probability, how many are likely.

    Probabilities are shares of ``n`` draws; whole draws are added up, so sums
    do not depend on the order of rows.
    """
    p = F.col("p_violated")
    hits = F.round(p * n).cast("long")
    return assessed.groupBy("scenario").agg((F.sum(hits) / n).alias("expected_violated"), F.max(p).alias("max_p"), (F.avg(hits) / n).alias("mean_p"), F.count_if(F.col("risk_band").isin("HIGH", "CRITICAL")).alias("high_or_critical"))


def heatmap(assessed: DataFrame, row: str, metric: str = "p_violated", scenarios: Sequence[str] = tuple(ft.SCENARIOS)) -> DataFrame:
    return assessed.groupBy(F.coalesce(F.col(row), F.lit("Unknown service")).alias("row")).pivot("scenario", list(scenarios)).agg(F.avg(metric))


def hydrate(assessed: DataFrame, assets: DataFrame) -> DataFrame:
    """Assessments with their asset's attributes; an unknown asset leaves nulls."""
    return assessed.join(assets, "asset_id", "left")
