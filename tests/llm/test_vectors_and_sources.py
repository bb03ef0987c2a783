"""Source divergence, hard negatives and near-duplicate vectors against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qvault.llm import divergence, embedding_dedup, hard_negatives
from qvault.llm.divergence import audit_sources
from qvault.llm.embedding_dedup import near_duplicate_vectors
from qvault.llm.hard_negatives import mine_hard_negatives

from llm_helpers import CASES

VECTORS = "vec_id long, label int, embedding array<float>, score string, rank int, block int, node int, at int, space string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, 4, "x") for r in rows], VECTORS)


def plain_audit(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for (lang, source), own in counts.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        everyone = sum((c for (x, _), c in counts.items() if x == lang), Counter())

        def share(c, t, kept=kept):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        pairs = sorted((-sum(abs(share(own, t) - share(c, t)) for t in kept), s) for (x, s), c in counts.items() if x == lang and s != source)
        terms = sorted((share(everyone, t) - share(own, t), t.encode()) for t in kept if own[t] and share(own, t) > share(everyone, t))
        out |= {(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(pairs)}
        out |= {(lang, source, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:top])}
    return out


ROWS = [(t, lang, s) for i, (_, t) in enumerate(CASES * 3) for lang, s in ((("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4]),)] + [("only Ünï words ÄÄ ää\x00nul", "fr", "a"), (None, "fr", "b"), ("!!", "xx", "z")]


def test_audit_equals_plain(spark):
    table = spark.createDataFrame([(*r, 1, 2, "q") for r in ROWS], "text string, lang string, source string, term int, n int, shard string")
    for min_docs, top in ((1, 3), (2, 50), (99, 50)):
        got = audit_sources(table.repartition(3), min_docs=min_docs, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert {tuple(r) for r in got.collect()} == plain_audit(ROWS, min_docs, top)
    assert audit_sources(table.where("false")).count() == 0


def test_audit_of_tiles_equals_plain(spark, monkeypatch):
    """Several blocks of sources and several shards of terms give the same sums."""
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "SHARD_TERMS", 3)
    table = spark.createDataFrame(ROWS, "text string, lang string, source string")
    assert {tuple(r) for r in audit_sources(table, min_docs=1, top=5).collect()} == plain_audit(ROWS, 1, 5)


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    text = "The ünï-cödé words, " * 50 + "x" * 5000 + " end"
    whole = {r["term"]: r["n"] for r in divergence._row_counts(pa.array([text])).to_pylist()}
    monkeypatch.setattr(divergence, "SLICE_BYTES", 64)
    assert {r["term"]: r["n"] for r in divergence._long_counts(pa.scalar(text)).to_pylist()} == whole
    assert b"".join(p[0].as_py().encode() for p in divergence._pieces(pa.scalar(text), 7)).decode() == text


@pytest.mark.parametrize("m, k, n", [(1, 1, 1), (33, 65, 40), (100, 64, 129), (200, 200, 200), (70, 0, 70), (0, 5, 5)])
def test_strassen_is_exact(m, k, n):
    rnd = np.random.default_rng(m * 1000 + k)
    a, b = rnd.integers(-(2**27), 2**27, (m, k)), rnd.integers(-(2**27), 2**27, (k, n))
    want = (a.astype(object) @ b.astype(object)).astype(np.int64) if k else np.zeros((m, n), np.int64)
    assert np.array_equal(hard_negatives.strassen(a, b), want)


def test_heaps_merge_in_any_order():
    rnd = np.random.default_rng(3)
    owner, score, ids = rnd.integers(0, 9, 500), rnd.integers(-5, 5, 500), rnd.permutation(500)
    heaps = hard_negatives.Heaps(9, 4)
    for part in np.array_split(np.arange(500), 7):
        heaps.merge(owner[part], score[part], ids[part])
    want = [(o, s, i) for o in range(9) for s, i in [(-s, i) for s, i in sorted((-s, i) for s, i, x in zip(score, ids, owner, strict=True) if x == o)][:4]]
    assert list(zip(heaps.owner, heaps.score, heaps.id, strict=True)) == want
    assert all(heaps.least[o] == min(s for x, s, _ in want if x == o) for o in range(9))


def plain_negatives(rows, every, positives, negatives):
    used = [(i, lab, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for i, lab, v in used:
        if i % every:
            continue
        near = sorted((-dot(v, w), j) for j, other, w in used if other == lab and j != i)[:positives]
        far = sorted((-dot(v, w), j) for j, other, w in used if other != lab)
        for p, j in near:
            fits = [(s, k) for s, k in far if 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out.update((i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fits))
    return out


def test_hard_negatives_equal_plain(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, int(rnd.integers(0, 3)), [float(x) for x in np.round(rnd.normal(0.2, 0.3, 9), 2)]) for i in range(400)]
    rows += [(50, 1, rows[50][2]), (60, None, rows[1][2]), (None, 1, rows[1][2]), (70, 1, None), (80, 1, [1.0, None]), (90, 1, [float("nan")] * 9), (100, 1, [float("inf")] * 9), (110, 2, []), (120, 2, [0.5, 0.5]), (7, 0, [0.0] * 9)]
    rows += [(1000 + i, 0, [0.5] * 9) for i in range(30)]  # ties
    for parts in (1, 5):
        got = mine_hard_negatives(vectors(spark, rows).repartition(parts), anchors=F.col("vec_id") % 10 == 0)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert Counter(tuple(r) for r in got.collect()) == plain_negatives(rows, 10, 5, 10)
    assert mine_hard_negatives(vectors(spark, rows).where("false"), anchors=F.lit(True)).count() == 0
    assert mine_hard_negatives(vectors(spark, rows), anchors=F.lit(False)).count() == 0


def plain_links(rows, threshold):
    known = {}
    for at, (_, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            known[at] = (label, np.array(v, np.float32).astype(np.float64))
    links = defaultdict(set)
    for a, (la, x) in known.items():
        for b, (lb, y) in known.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a].add(b)
    out = Counter()
    for at, (i, _, _) in enumerate(rows):
        seen, todo = {at}, [at]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out[i, len(links[at]), least, i is not None and i == least] += 1
    return out


def near_vectors(dims=64):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(6, dims))
    rows = []
    for i in range(500):
        c = centres[i % 6] if i % 3 else rnd.normal(size=dims)
        rows.append((i, int(i % 12 < 9), [float(x) for x in (c + rnd.normal(size=dims) * rnd.choice([0.0, 0.05, 0.12, 0.2])).astype(np.float32)]))
    return rows


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_vector_links_equal_plain(spark, dims):
    rows = near_vectors(dims)
    odd = [(3, 1, rows[3][2]), (None, 1, rows[5][2]), (None, 7, [1.0] * dims), (600, None, rows[0][2]), (601, 1, None), (602, 1, [0.0] * dims), (603, 1, [1.0, None] + [0.0] * (dims - 2)), (604, 1, [float("nan")] * dims), (605, 1, [float("-inf")] * dims), (606, 1, []), (607, 1, [1.0, 2.0]), (608, 1, [2.0, 4.0]), (609, 1, [x * 3 for x in rows[6][2]])]
    got = near_duplicate_vectors(vectors(spark, rows + odd).repartition(3), threshold=0.98)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = plain_links(rows + odd, 0.98)
    assert Counter(tuple(r) for r in got.collect()) == want and max(k[1] for k in want) > 10
    assert near_duplicate_vectors(vectors(spark, rows).where("false")).count() == 0


def test_vectors_in_small_blocks(spark, monkeypatch):
    """Links across the blocks of one label: each two meet in one tile."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    rows = near_vectors()
    assert Counter(tuple(r) for r in near_duplicate_vectors(vectors(spark, rows), threshold=0.98).collect()) == plain_links(rows, 0.98)


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(11)
    for width in (64, 128):
        x = rnd.normal(size=(400, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = x + rnd.normal(size=x.shape) * 0.2 / np.sqrt(width)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        truth = x @ y.T
        estimate, bound = embedding_dedup.upper_bounds(embedding_dedup.encode(x)[0], *embedding_dedup.encode(y)[1:], 0.98)
        assert abs((estimate - truth).mean()) < 1e-3 and np.abs(estimate - truth).std() < 0.2
        close = truth >= 0.98
        assert close.sum() > 100 and (estimate + bound >= truth)[close].all()
        # Errors of close pairs stay within a third of what 6 standard errors allow, for nearly all.
        assert (np.abs(estimate - truth) <= bound / 2)[close].mean() > 0.99
        assert (estimate + bound >= 0.98).mean() < 0.01
