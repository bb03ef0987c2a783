"""Queries of the threat model, over customers as assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from qvault.functions import threat as ft
from qvault.operators import threat as op
from qvault.plans.bindings import catalogue, over, pick, plain, sql
from qvault.plans.registry import query

N, SEED = 10_000, 42
HITS = f"CAST(round(p_violated * {N}) AS BIGINT)"
ASSETS = f"SELECT c_custkey AS asset_id, {pick('c_custkey', 'RSA', 'ECDSA P-256', 'DH-2048', 'AES-256', 'SHA-256', 'ML-KEM-768', 'XYZ')} AS algorithm, {pick('c_nationkey', 1024, 128, 4096, 256, None, 3072)} AS key_size, {pick('c_custkey + c_nationkey', 'keyExchange', 'signature', 'data encryption', 'TLS certificate', None, 'mac')} AS usage, lower(c_mktsegment) AS service FROM {{customer}}"


def _sql_draw(i: str) -> str:
    mod = "& 4294967295"
    times = lambda a, b: f"(((({a}) & 65535) * ({b}) + (((({a}) >> 16) * (({b}) & 65535)) & 65535) * 65536) {mod})"
    return f"""SELECT *, xor(v3, v3 >> 14) / 4294967296.0::DOUBLE AS u FROM (SELECT *, xor(v2, (v2 + {times('xor(v2, v2 >> 7)', 'v2 | 61')}) {mod}) AS v3 FROM (
  SELECT *, {times('xor(v1, v1 >> 15)', 'v1 | 1')} AS v2 FROM (SELECT *, ({SEED} + ({i}) * {ft.INCREMENT}) {mod} AS v1 FROM """


FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(upper(coalesce(algorithm, '')), '[ _]', '-', 'g'), '{p}') THEN '{f}'" for f, p in ft.FAMILY_PATTERNS) + " ELSE 'OTHER' END"
NAMED = "regexp_replace(trim(lower(regexp_replace(coalesce(usage, 'unknown'), '([a-z])([A-Z])', '\\1_\\2', 'g'))), '[ -]+', '_', 'g')"
USAGE = f"CASE WHEN {NAMED} IN ({', '.join(repr(k) for k in ft.LIFETIME_YEARS)}) THEN {NAMED} WHEN contains({NAMED}, 'signature') THEN 'digital_signature' WHEN contains({NAMED}, 'certificate') THEN 'certificate' WHEN contains({NAMED}, 'jwt') THEN 'jwt' WHEN contains({NAMED}, 'auth') THEN 'auth' ELSE 'unknown' END"
X = "CASE WHEN regexp_matches(lower(coalesce(usage, '')), 'signature|auth|jwt|certificate') THEN 0.0::DOUBLE ELSE CASE cu " + " ".join(f"WHEN '{k}' THEN {v}.0::DOUBLE" for k, v in ft.LIFETIME_YEARS.items()) + " END END"
Y = "CASE " + " ".join(f"WHEN cu = '{u}' AND family = '{f}' THEN {v}::DOUBLE" for u, row in ft.MIGRATION_YEARS.items() for f, v in row.items()) + " END"
MULT = "CASE " + " ".join(f"WHEN family = '{f}' AND key_size {'IS NOT NULL' if lo is None else f'>= {lo}'} {'' if hi is None else f'AND key_size <= {hi}'} THEN {v}::DOUBLE" for f, rows in ft.KEY_SIZE_MULTIPLIERS.items() for lo, hi, v in rows) + " WHEN family = 'AES' THEN 0.55::DOUBLE WHEN family = 'HASH' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"


def _tables(shifts=(0.0,)) -> str:
    rows = ", ".join(f"('{n if len(shifts) == 1 else f'{n}:arrival-shift:{s:+g}'}', '{f}', {', '.join(f'{p + s}::DOUBLE' for p in lines.get(f, ft.OTHER_TIMELINE))}, {str(f in lines).lower()}, {op.FAMILIES.index(f) * N})" for n, lines in ft.SCENARIOS.items() for s in shifts for f in op.FAMILIES)
    return f"""WITH raw AS ({plain(ASSETS)}), fam AS (SELECT *, {FAMILY} AS family, {USAGE} AS cu FROM raw), assets AS (SELECT *, {X} AS x, {Y} AS y, {MULT} AS multiplier FROM fam),
t(scenario, family, lo, mo, hi, stated, first) AS (VALUES {rows}),
dr AS ({_sql_draw('first + i')} (SELECT t.*, unnest(range(1, {N + 1})) AS i FROM t)))) ),
z AS (SELECT scenario, family, stated, greatest(0.0, CASE WHEN u < (mo - lo) / (hi - lo) THEN lo + sqrt(u * (hi - lo) * (mo - lo)) ELSE hi - sqrt((1 - u) * (hi - lo) * (hi - mo)) END) AS z FROM dr),
par AS (SELECT DISTINCT family, multiplier, x, y FROM assets WHERE family <> 'PQC'),
cnt AS (SELECT scenario, z.family, stated, multiplier, x, y, count(*) FILTER (WHERE z * multiplier < y) / {N} AS p_break, count(*) FILTER (WHERE z * multiplier < x + y) / {N} AS p_violated FROM z JOIN par USING (family) GROUP BY ALL),
res AS (SELECT asset_id, service, scenario, family, x, y, p_break, p_violated, (family = 'OTHER' OR NOT stated) AS low_confidence FROM assets JOIN cnt USING (family, multiplier, x, y)
 UNION ALL SELECT asset_id, service, scenario, family, x, y, 0.0, 0.0, false FROM assets, (SELECT DISTINCT scenario FROM t) WHERE family = 'PQC'),
band AS (SELECT *, CASE WHEN p_violated < 0.01 THEN 'MINIMAL' WHEN p_violated < 0.05 THEN 'LOW' WHEN p_violated < 0.2 THEN 'MODERATE' WHEN p_violated < 0.5 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_band FROM res)
"""


def assessed(spark, d, shifts=(0.0,)):
    return op.threat_assessment(op.crypto_assets(sql(spark, d, ASSETS)), op.scenario_table(spark, shifts=shifts), n=N, seed=SEED)


def counted(a):
    """Assessments with whole numbers of draws for probabilities: their sums do not depend on order."""
    return a.withColumn("p_violated", F.round(F.col("p_violated") * N).cast("long"))


@query("a14_threat_assessment", _tables() + "SELECT asset_id, scenario, family, x, y, p_break, p_violated, low_confidence, risk_band FROM band")
def a14(spark, d):
    return assessed(spark, d).select("asset_id", "scenario", "family", "x", "y", "p_break", "p_violated", "low_confidence", "risk_band")


#: Scenarios whose families have unlike distributions: each takes one or two draws a time, so what follows begins elsewhere.
MIXED = {
    "mixed": {"AES": ("lognormal", (40, 12)), "DH": ("triangular", (8, 12, 18)), "ECC": ("normal", (15, 4)), "HASH": ("triangular", (25, 40, 70)), "RSA": ("lognormal", (12, 3)), "OTHER": ("normal", (6, 5))},
    "plain": {"RSA": ("triangular", (3, 6, 10)), "ECC": ("normal", (7, 2)), "OTHER": ("lognormal", (5, 4))},
}


def _mixed_tables() -> str:
    rows = []
    for name, lines in MIXED.items():
        first = 0
        for f in op.FAMILIES:
            kind, params = lines.get(f) or lines["OTHER"]
            a, b, c = (*params, 0)[:3]
            rows.append(f"('{name}', '{f}', '{kind}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {str(f in lines).lower()}, {first}, {op.DRAWS[kind]})")
            first += N * op.DRAWS[kind]
    return f"""WITH raw AS ({plain(ASSETS)}), fam AS (SELECT *, {FAMILY} AS family, {USAGE} AS cu FROM raw), assets AS (SELECT *, {X} AS x, {Y} AS y, {MULT} AS multiplier FROM fam),
t(scenario, family, kind, a, b, c, stated, first, k) AS (VALUES {", ".join(rows)}),
dr AS ({_sql_draw('first + i')} (SELECT t.*, unnest(range(1, {N} * k + 1)) AS i FROM t)))) ),
two AS (SELECT scenario, family, kind, a, b, c, stated, (i - 1) // k AS j, arg_min(u, i) AS u, arg_max(u, i) AS v FROM dr GROUP BY ALL),
g AS (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS gauss, ln(1 + (b / a) * (b / a)) AS s2 FROM two),
z AS (SELECT scenario, family, stated, greatest(0.0, CASE kind WHEN 'normal' THEN a + b * gauss WHEN 'lognormal' THEN exp(ln(a) - s2 / 2 + sqrt(s2) * gauss) ELSE CASE WHEN u < (b - a) / (c - a) THEN a + sqrt(u * (c - a) * (b - a)) ELSE c - sqrt((1 - u) * (c - a) * (c - b)) END END) AS z FROM g),
par AS (SELECT DISTINCT family, multiplier, x, y FROM assets WHERE family <> 'PQC'),
cnt AS (SELECT scenario, z.family, stated, multiplier, x, y, count(*) FILTER (WHERE z * multiplier < y) / {N} AS p_break, count(*) FILTER (WHERE z * multiplier < x + y) / {N} AS p_violated FROM z JOIN par USING (family) GROUP BY ALL)
SELECT asset_id, scenario, family, p_break, p_violated, (family = 'OTHER' OR NOT stated) AS low_confidence FROM assets JOIN cnt USING (family, multiplier, x, y) UNION ALL SELECT asset_id, scenario, family, 0.0, 0.0, false FROM assets, (SELECT DISTINCT scenario FROM t) WHERE family = 'PQC'"""


@query("a14_mixed_distributions", _mixed_tables())
def a14_mixed(spark, d):
    found = op.threat_assessment(op.crypto_assets(sql(spark, d, ASSETS)), op.timeline_table(spark, MIXED), n=N, seed=SEED)
    return found.select("asset_id", "scenario", "family", "p_break", "p_violated", "low_confidence")


@query("a15_z_quantiles", _tables() + ", held AS (SELECT family, multiplier, count(*) AS assets FROM assets WHERE family <> 'PQC' GROUP BY ALL), qs AS (SELECT scenario, family, " + ", ".join(f"quantile_cont(z, {q}) AS q{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM z GROUP BY ALL) SELECT scenario, family, multiplier, assets, round(q10 * multiplier, 6) AS p10, round(q50 * multiplier, 6) AS p50, round(q90 * multiplier, 6) AS p90 FROM held JOIN qs USING (family)")
def a15(spark, d):
    q = op.family_quantiles(op.crypto_assets(sql(spark, d, ASSETS)), op.scenario_table(spark), n=N, seed=SEED)
    return q.select("scenario", "family", "multiplier", "assets", *[F.round(n, 6).alias(n) for n in ("p10", "p50", "p90")])


@query("a16_threat_summary", _tables() + f"SELECT scenario, CAST(sum({HITS}) AS BIGINT) / {N}.0::DOUBLE AS expected_violated, max(p_violated) AS max_p, avg({HITS}) / {N} AS mean_p, count(*) FILTER (WHERE risk_band IN ('HIGH', 'CRITICAL')) AS high_or_critical FROM band GROUP BY scenario")
def a16(spark, d):
    return op.threat_summary(assessed(spark, d), N)


@query("a17_heatmap", _tables() + "SELECT service AS row, " + ", ".join(f"avg({HITS}) FILTER (WHERE scenario = '{s}') / {N} AS {s}" for s in ft.SCENARIOS) + " FROM band GROUP BY service")
def a17(spark, d):
    h = op.heatmap(counted(assessed(spark, d)), "service")
    return h.select("row", *[(F.col(s) / N).alias(s) for s in ft.SCENARIOS])


@query("a18_sweep_arrival_shift", _tables((-2.0, 0.0, 3.0)) + f"SELECT scenario, CAST(sum({HITS}) AS BIGINT) / {N}.0::DOUBLE AS expected_violated, count(*) FILTER (WHERE risk_band IN ('HIGH', 'CRITICAL')) AS high_or_critical FROM band GROUP BY scenario")
def a18(spark, d):
    return op.threat_summary(assessed(spark, d, (-2.0, 0.0, 3.0)), N).select("scenario", "expected_violated", "high_or_critical")


@query("j18_hydrate", _tables() + "SELECT r.asset_id, scenario, risk_band, algorithm, key_size FROM band r LEFT JOIN (SELECT * FROM raw WHERE asset_id % 3 <> 0) a ON r.asset_id = a.asset_id")
def j18(spark, d):
    kept = sql(spark, d, ASSETS).where("asset_id % 3 <> 0").select("asset_id", "algorithm", "key_size")
    return op.hydrate(assessed(spark, d).select("asset_id", "scenario", "risk_band"), kept)


@query("a27_schedule_tasks", _tables() + "SELECT asset_id, max(p_violated) AS max_risk, CAST(greatest(1, round(any_value(y) * 12)) AS INTEGER) AS duration_months FROM band GROUP BY asset_id")
def a27(spark, d):
    a = assessed(spark, d)
    return a.groupBy("asset_id").agg(F.max("p_violated").alias("max_risk"), F.first("y").alias("y")).select("asset_id", "max_risk", F.greatest(F.lit(1), F.round(F.col("y") * 12)).cast("int").alias("duration_months"))


DRAWN = "SELECT o_orderkey AS i, CAST(o_custkey % 9 + 1 AS DOUBLE) AS mean, CAST(o_custkey % 4 + 1 AS DOUBLE) / 2 AS sd FROM {orders}"
#: The draws numbered 2 i - 1 and 2 i of each row.
TWO_DRAWS = f"a AS ({_sql_draw('2 * i - 1')} ({plain(DRAWN)}))))), b AS ({_sql_draw('2 * i')} ({plain(DRAWN)})))))"


@query("f18_uniform_draw", f"WITH {TWO_DRAWS}, n AS (SELECT a.i, a.mean, a.sd, a.u AS u, sqrt(-2 * ln(greatest(a.u, 5e-324))) * cos(2 * pi() * b.u) AS z FROM a JOIN b ON a.i = b.i) SELECT i, u, round(z, 6) AS z, round(exp(ln(mean) - ln(1 + (sd / mean) ** 2) / 2 + sqrt(ln(1 + (sd / mean) ** 2)) * z), 6) AS lognormal FROM n")
def f18(spark, d):
    rows = sql(spark, d, DRAWN)
    u = rows.withColumns({"u": ft.uniform_draw(SEED, 2 * F.col("i") - 1), "u2": ft.uniform_draw(SEED, 2 * F.col("i"))})
    return u.select("i", "u", F.round(ft.standard_normal(F.col("u"), F.col("u2")), 6).alias("z"), F.round(ft.lognormal(F.col("u"), F.col("u2"), F.col("mean"), F.col("sd")), 6).alias("lognormal"))


@query("f19_bands", over("catalogue", f"SELECT asset_id, family, {MULT} AS multiplier, {X} AS x, {Y} AS y FROM (SELECT *, {FAMILY} AS family, {USAGE} AS cu FROM catalogue)"))
def f19(spark, d):
    return op.crypto_assets(catalogue(spark, d)).select("asset_id", "family", "multiplier", "x", "y")


@query("f11_confidence_value", over("catalogue", "SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 0.75 WHEN asset_id % 4 = 1 THEN least(1.0, size / 100.0) WHEN asset_id % 4 = 2 THEN least(1.0, CAST(size AS DOUBLE)) ELSE 0.5 END::DOUBLE AS confidence FROM catalogue"))
def f11(spark, d):
    text = F.expr("CASE WHEN asset_id % 4 = 0 THEN 'Likely' WHEN asset_id % 4 = 1 THEN CAST(size AS STRING) || '%' WHEN asset_id % 4 = 2 THEN CAST(size AS STRING) ELSE 'odd' END")
    return catalogue(spark, d).select("asset_id", ft.confidence_value(text).alias("confidence"))


OVERRIDES = "SELECT c_custkey AS asset_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 30 AS DOUBLE) END AS data_lifetime_years, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 7 AS DOUBLE) - 2 END AS migration_time_years FROM {customer} WHERE c_custkey % 2 = 0"


@query("x3_overrides", _tables() + f", o AS ({plain(OVERRIDES)}) SELECT a.asset_id, coalesce(data_lifetime_years, x) AS x, coalesce(CASE WHEN migration_time_years >= 0 THEN migration_time_years END, y) AS y FROM assets a LEFT JOIN o ON a.asset_id = o.asset_id")
def x3(spark, d):
    return op.with_overrides(op.crypto_assets(sql(spark, d, ASSETS)), sql(spark, d, OVERRIDES)).select("asset_id", "x", "y")
