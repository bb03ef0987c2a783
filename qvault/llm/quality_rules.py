"""Quality rules: statistics of each text, and a learned decision list over them, on DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qvault.llm.text import let, strip_blanks, words
from qvault.storage import materialize

#: What rules may test; each is a number that one row gives.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "try_divide(word_chars, n_words)",
    "symbols_per_word": "try_divide(n_symbols, n_words)",
    "dup_line_share": "try_divide(n_dup_lines, n_lines)",
    "repeat_word_share": "try_divide(n_repeat_words, n_words)",
    "upper_share": "try_divide(n_upper, word_chars)",
    "marks_per_word": "try_divide(n_marks, n_words)",
}


def repeated_words(array: Column, size: int = 5) -> Column:
    """Words that lie in a window of ``size`` words found twice or more; the windows are compared by hash."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            again = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"))
        count = let(placed, lambda s: F.aggregate(positions(s), start, step, lambda a: a["n"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(count)

    def hashed(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ids) - size), lambda i: F.xxhash64(*[F.get(ids, i + j) for j in range(size)]))

    windows = let(F.transform(array, lambda w: F.xxhash64(w)), lambda ids: let(hashed(ids), covered))
    return F.when(F.size(array) < size, F.lit(0)).otherwise(windows).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and the counts that the rules use.

    Null texts have no words; they have one empty line.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = text.select("doc_id", "text", words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    full = F.filter("lines", lambda x: strip_blanks(x) != "")
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
    )


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self, prefix: str = "") -> Column:
        value = F.col(prefix + self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class Rule:
    """A conjunction of threshold tests; a row that passes all is rejected."""

    tests: list[Test] = field(default_factory=list)

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column(prefix)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def features(stats: DataFrame, *keep: str) -> DataFrame:
    return stats.select(*keep, *[F.expr(f"coalesce({c}, 0.0D)").alias(n) for n, c in FEATURES.items()])


def _by_bin(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(bad, good) rows of each bin of each feature: at most features x cuts rows reach the driver."""
    bins = F.array(*[F.struct(F.lit(n).alias("feature"), sum((F.col(n) > c).cast("int") for c in cs).alias("bin")) for n, cs in cuts.items() if cs])
    rows = rows.select("bad", F.explode(bins).alias("x")).groupBy("x.feature", "x.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    out = {n: [(0, 0)] * (len(cs) + 1) for n, cs in cuts.items()}
    for r in rows.collect():
        out[r["feature"]][r["bin"]] = (r["p"], r["n"])
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the test of the largest information gain until no good row is left or nothing is gained."""
    rule = Rule()
    while True:
        tables = _by_bin(rows.where(rule.column()), cuts)
        p0, n0 = next(((sum(x[0] for x in t), sum(x[1] for x in t)) for n, t in tables.items() if cuts[n]), (0, 0))
        if p0 == 0 or n0 == 0:
            break
        best, gain = None, 0.0
        for name, table in tables.items():
            for j, cut in enumerate(cuts[name]):
                for above in (True, False):
                    side = table[j + 1 :] if above else table[: j + 1]
                    p, n = sum(x[0] for x in side), sum(x[1] for x in side)
                    got = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                    if got > gain + 1e-9:
                        best, gain = Test(name, above, cut), got
        if best is None:
            break
        rule.tests.append(best)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule with the largest (p - n) / (p + n) on rows that did not grow it, with its p and n."""
    prefixes = [Rule(rule.tests[: i + 1]) for i in range(len(rule.tests))]
    counts = rows.agg(*[c for i, r in enumerate(prefixes) for c in (F.count_if(r.column() & F.col("bad")).alias(f"p{i}"), F.count_if(r.column() & ~F.col("bad")).alias(f"n{i}"))]).first()
    worth = lambda i: (counts[f"p{i}"] - counts[f"n{i}"]) / max(1, counts[f"p{i}"] + counts[f"n{i}"])
    best = max(range(len(prefixes)), key=lambda i: (round(worth(i), 9), -i))
    return prefixes[best], counts[f"p{best}"], counts[f"n{best}"]


def learn_decision_list(labelled: DataFrame, *, n_cuts: int = 24, min_precision: float = 0.8) -> list[Rule]:
    """An ordered list of rejecting rules by sequential covering.

    ``labelled`` has doc_id, the statistics and a boolean ``bad``; rows where it
    is null are left out. Each round grows a conjunction on two thirds of the
    rows not yet covered and prunes it on the rest. The list ends when a pruned
    rule's precision there, with one row of each kind added to what it rejects,
    is below ``min_precision``; it is as long as the rows bear out. All counts are Spark aggregates over all labelled rows; only
    per-bin counts come to the driver. Tables without labels give no rules.
    """
    rows = features(labelled.where("bad is not null"), "doc_id", "bad").withColumn("grows", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    at = F.array(*[F.lit((i + 1) / (n_cuts + 1)) for i in range(n_cuts)])
    found = rows.groupBy("bad").agg(*[F.percentile_approx(n, at, F.lit(1000)).alias(n) for n in FEATURES]).collect()
    cuts = {n: sorted({c for r in found for c in r[n] or []}) for n in FEATURES}
    rules: list[Rule] = []
    left = rows
    while any(cuts.values()):
        rule = _grow(left.where("grows"), cuts)
        if not rule.tests:
            break
        rule, p, n = _prune(left.where("not grows"), rule)
        if (p + 1) / (p + n + 2) < min_precision:
            break
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list as one conditional expression over the features: false where a rule rejects."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(prefix), F.lit(False)).otherwise(out)
    return out


def apply_quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics, base verdict and learned verdict of every row of ``docs``.

    ``docs`` has doc_id and text; ``labels`` has doc_id and quality (0 bad, 1
    good; null: not labelled). Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept and the statistics that only
    the rules use. base_failed holds for fewer than 10 words, or more than a
    fifth of the words inside repeated 5-word windows; kept is then false, and
    otherwise the decision list's verdict.

    Null and empty texts have no words and fail. Rows that repeat a doc_id are
    judged one by one; of labels that repeat a doc_id the smallest counts. The
    statistics are written once to the shared folder, for learning and verdict.
    """
    stats, _ = materialize(text_statistics(docs), "quality")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled, _ = materialize(stats.where(~failed).join(marked, "doc_id").withColumn("bad", F.col("quality") == 0), "labelled")
    rules = learn_decision_list(labelled, **options)
    base = stats.withColumn("base_failed", failed)
    judged = base.select("*", *[F.expr(f"coalesce({c}, 0.0D)").alias(f"feature_{n}") for n, c in FEATURES.items()])
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules, "feature_")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_marks"
    )
