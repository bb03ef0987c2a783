"""Clashing names, few labels, long words, hot keys, and plain versions of what the operators learn."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from qvault.llm import decontamination, language_id, mixing, quality_rules, queries, skew, toxicity
from qvault.llm.features import split_words
from qvault.storage import load

from llm_helpers import lower, words
from oracle_helpers import DATA

SMALL = "/root/testdata/sf0.01"


def test_every_stage_keeps_columns_with_its_own_names(spark):
    docs = load(spark, DATA, "documents")
    for name in ("score", "Predicted", "_hash", "_doc", "own_hash", "of_doc", "of_text", "copies", "each", "text_hash", "part", "digest", "node", "component_id"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in docs.columns[5:]), name


def test_few_toxic_labels_still_learn(spark):
    rnd = random.Random(1)
    clean = [" ".join(rnd.choices([f"word{i}" for i in range(200)], k=40)) for _ in range(400)]
    texts = [(i, t + (" awfulslur nastyterm" if i < 12 else "")) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in [*range(6), *range(100, 160)]], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, labels, learn=F.lit(True)).collect()}
    assert all(got[i] == 1 for i in range(12)) and sum(got[i] for i in range(12, 400)) == 0


def test_evidence_is_the_likelihood_ratio(spark):
    rows = [(3, 0), (5, 40), (0, 7), (10, 100), (4, 4)]
    table = spark.createDataFrame(rows, "n_pos long, n_unl long").select("*", toxicity._evidence(10, 100).alias("g"))

    def log_likelihood(k, n, p):
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)

    for r in table.collect():
        a, b = r["n_pos"], r["n_unl"]
        want = 2 * (log_likelihood(a, 10, a / 10) + log_likelihood(b, 100, b / 100) - log_likelihood(a, 10, (a + b) / 110) - log_likelihood(b, 100, (a + b) / 110))
        assert math.isclose(r["g"], want, abs_tol=1e-9)


def test_scores_are_those_of_the_features_in_each_text():
    model = toxicity.Classifier({"=bad": 0, "bad": 1, "wor": 2}, np.array([1.0, 0.5, -2.0]), -0.25)
    texts = ["Bad bad words", "badly", "", None, "a b c", "wor-bad"]
    got = model.score(pa.array(texts))
    for t, s in zip(texts, got):
        found = {f for w in split_words(pa.array([t], pa.string()), letters_only=True).words for f in toxicity.word_features(w)}
        z = sum(model.weights[i] for f, i in model.features.items() if f in found) + model.bias
        assert math.isclose(s, 1 / (1 + math.exp(-z)))


def test_non_negative_risk_against_plain_gradients():
    """One step of the fit equals a plain step along the numeric gradient's sign, on either side of zero negative risk."""
    rng = np.random.default_rng(3)
    x = rng.random((40, 5)) < 0.4
    positive = np.arange(40) < 15
    for prior in (0.2, 0.9):

        def risk(w):
            z = x @ w[:5] + w[5]
            plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
            negative = minus[~positive].mean() - prior * minus[positive].mean()
            return prior * plus[positive].mean() + negative if negative >= 0 else -negative

        start = np.append(np.zeros(5), math.log(prior / (1 - prior)))
        numeric = np.array([(risk(start + e) - risk(start - e)) / 2e-6 for e in np.eye(6) * 1e-6])
        rows, columns = np.nonzero(x)
        weights, bias = toxicity.nn_pu(rows, columns, positive, 5, prior, steps=1, rate=0.01, l2=0.0)
        assert np.allclose(weights, -0.01 * np.sign(numeric[:5]), atol=1e-4)  # the bias begins where its gradient is zero


def test_words_differ_beyond_their_fortieth_character():
    a, b = "x" * 60 + "abc", "x" * 60 + "qrs"
    assert set(language_id.word_features(a)) != set(language_id.word_features(b))
    marked = f"^{a}$"
    import zlib

    assert {zlib.crc32(marked[i : i + 3].encode()) % language_id.BUCKETS for i in range(len(marked) - 2)} <= set(language_id.word_features(a))
    assert mixing.word_buckets("x" * 80 + "7") != mixing.word_buckets("x" * 80 + "x")[:2] + (mixing.word_buckets("x" * 80)[2],)


def test_texts_without_blanks_are_read_whole(spark):
    one, two = "日本語の文章" * 50, "中文的文字内容" * 50
    rows = [(i, one[i:] if i % 2 else two[i:], "ja" if i % 2 else "zh") for i in range(40)]
    docs = spark.createDataFrame([*rows, (100, "x" * 41 + "日本語の文章", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs, learn=F.lit(True)).collect()}
    assert all(got[i] == lang for i, _, lang in rows) and got[100] == "ja"


def test_rare_languages_keep_windows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_WINDOWS", 40)
    rows = [(i, "lorem ipsum dolor sit amet " * 400, "la") for i in range(30)] + [(100 + i, "kurze deutsche worte", "de") for i in range(3)]
    windows = language_id.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert Counter(lang for _, lang in windows)["de"] == 3


def test_split_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 10)
    rows = spark.createDataFrame([(i, i % 50 if i % 3 else 7, i) for i in range(3000)], "id long, k long, part long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k < 40").persist()
    got = skew.join_split(rows, table, "k", n="n", by=["id"])
    want = rows.join(table.drop("n"), "k")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def plain_containment(docs, items, k=5, threshold=0.8):
    out = set()
    for item, text in items.items():
        w = words(lower(text or ""))
        size = min(k, len(w))
        shingles = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for doc, body in docs.items():
            v = words(lower(body or ""))
            held = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if shingles else set()
            if shingles and len(shingles & held) >= threshold * len(shingles) - 1e-9:
                out.add((doc, item))
    return out


def test_items_are_found_by_shuffle_as_by_broadcast(spark, monkeypatch):
    docs, items = load(spark, DATA, "documents"), load(spark, DATA, "benchmark")
    pairs = lambda: {(r["doc_id"], r["item_id"]) for r in decontamination.find_contained(docs, items).collect()}
    want = plain_containment({r["doc_id"]: r["text"] for r in docs.collect()}, {r["item_id"]: r["text"] for r in items.collect()})
    assert pairs() == want and want
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert pairs() == want
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, DATA).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_rates_are_the_nearest_that_meet_the_targets(spark):
    """The rates of op8 against a plain solver: of all non-negative rates that give the target sums, those nearest to 1."""
    rows = queries.op8_mixing(spark, SMALL).collect()
    n = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in sorted(queries.TARGETS)] for r in rows])
    targets = np.array([queries.TARGETS[d] for d in sorted(queries.TARGETS)]) * n.sum()
    dual = np.zeros(2)
    for _ in range(200):  # Newton's method on the dual
        r = np.maximum(0, 1 - p @ dual)
        off = (r * n) @ p - targets
        active = r > 0
        dual += np.linalg.lstsq((p[active] * n[active, None]).T @ p[active], off, rcond=None)[0]
    assert np.allclose([r["rate"] for r in rows], np.maximum(0, 1 - p @ dual), atol=1e-3)


def plain_decision_list(rows, cuts, min_precision=0.8):
    """Sequential covering with loops over rows: (features, bad, grows) triples."""
    rules, left = [], list(rows)
    while True:
        rule, covered = [], [r for r in left if r[2]]
        while True:
            p0, n0 = sum(r[1] for r in covered), sum(not r[1] for r in covered)
            if not p0 or not n0:
                break
            best, gain = None, 0.0
            for f, cs in cuts.items():
                for cut in cs:
                    for above in (True, False):
                        side = [r for r in covered if (r[0][f] > cut) == above]
                        p, n = sum(r[1] for r in side), sum(not r[1] for r in side)
                        got = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if got > gain + 1e-9:
                            best, gain = (f, above, cut), got
            if best is None:
                break
            rule.append(best)
            covered = [r for r in covered if (r[0][best[0]] > best[2]) == best[1]]
        passes = lambda r, tests: all((r[0][f] > c) == a for f, a, c in tests)
        if not rule:
            return rules
        held, found = [r for r in left if not r[2]], []
        for i in range(len(rule)):
            some = [r for r in held if passes(r, rule[: i + 1])]
            p, n = sum(r[1] for r in some), sum(not r[1] for r in some)
            found.append((round((p - n) / max(1, p + n), 9), -i, p, n))
        _, i, p, n = max(found)
        if (p + 1) / (p + n + 2) < min_precision:
            return rules
        rule = rule[: 1 - i]
        rules.append(rule)
        left = [r for r in left if not passes(r, rule)]


def test_verdicts_against_plain_covering(spark):
    names = list(quality_rules.FEATURES)
    stats = quality_rules.text_statistics(load(spark, SMALL, "documents")).persist()
    got = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, SMALL).collect()}
    quality = {r["doc_id"]: r["quality"] for r in load(spark, SMALL, "labels").collect()}
    table = quality_rules.features(stats, "doc_id").withColumn("grows", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).collect()
    marked = [r for r in table if not got[r["doc_id"]]["base_failed"] and quality.get(r["doc_id"]) is not None]
    n_cuts, cuts = 24, {f: set() for f in names}
    for bad in (True, False):
        for f in names:
            values = sorted(r[f] for r in marked if (quality[r["doc_id"]] == 0) == bad)
            cuts[f] |= {values[max(0, math.ceil((i + 1) / (n_cuts + 1) * len(values)) - 1)] for i in range(n_cuts)} if values else set()
    rules = plain_decision_list([({f: r[f] for f in names}, quality[r["doc_id"]] == 0, r["grows"]) for r in marked], {f: sorted(c) for f, c in cuts.items()})
    assert rules
    for r in table:
        rejected = any(all((r[f] > c) == a for f, a, c in rule) for rule in rules)
        assert got[r["doc_id"]]["kept"] == (not got[r["doc_id"]]["base_failed"] and not rejected)


def test_texts_beyond_the_slice_size(spark):
    """A text of more than all slice sizes goes through the operators that work on slices."""
    long = "the quick brown fox jumps over a lazy dog again. " * 110_000
    docs = spark.createDataFrame([(1, long), (2, "short text of a few words here"), (3, None)], "doc_id long, text string")
    assert len(long) > 5 << 20
    from qvault.llm import near_copies, simhash, token_planes

    got = {r["doc_id"]: r["n_tokens"] for r in token_planes.tokenize_to_files(docs, tokenizer=queries.tokenizer_path()).collect()}
    coder = token_planes.WordEncoder(queries.tokenizer_path()).tokenizer
    assert got[1] == 110_000 * len(coder.encode("the quick brown fox jumps over a lazy dog again. ", add_special_tokens=False).ids) + 1 and got[3] == 1
    assert {r["doc_id"] for r in near_copies.keep_one_of_each(docs).collect()} == {1, 2, 3}
    assert simhash.near_duplicates(docs).count() == 3
    assert language_id.identify_languages(docs.withColumn("lang", F.lit("en")), learn=F.col("doc_id") == 2).where("lang_pred = 'en'").count() == 2
    n = {r["doc_id"]: r["n_tokens"] for r in mixing.mix(docs, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string"), {"a": 0.5, "b": 0.5}).collect()}
    assert n == {1: 1_100_000, 2: 7, 3: 0}


def test_token_ids_of_extreme_documents(spark):
    from qvault.llm import token_planes

    least = -(1 << 63)
    docs = spark.createDataFrame([(None, "a"), (least, "b c"), (None, "d"), (5, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["start"]) for r in token_planes.tokenize_to_files(docs, tokenizer=queries.tokenizer_path()).orderBy("start").collect()]
    assert [i for i, _ in got] == [None, None, least, 5]
