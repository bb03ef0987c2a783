"""The operators that run Python in tasks, against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from qvault.llm import language_model, mixing, near_copies, queries, simhash, token_planes, toxicity, warc
from qvault.llm.features import split_words
from qvault.llm.language_id import Crf, fit_crf, forward_backward, identify_languages, label_words, training_windows
from qvault.storage import load, new_path

from llm_helpers import CASES, lower, words
from oracle_helpers import DATA

SMALL = "/root/testdata/sf0.01"


def brute_fingerprint(text, k=3):
    w = words(lower(text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """{node: smallest node reachable} over {node: fingerprint}, by comparing all pairs."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


def test_simhash_query(spark):
    texts = {r["doc_id"]: r["text"] for r in load(spark, DATA, "documents").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, DATA).collect()}
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}


def test_links_lose_nothing(spark):
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    near = [s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for s in seeds for _ in range(15)]
    fps = dict(enumerate(dict.fromkeys([*seeds, *near, 0, (1 << 64) - 1])))
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    table = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    links = simhash.ball_links(simhash.with_neighbours(table)).persist()
    assert all(((r["node"] ^ r["hub"]) & (1 << 64) - 1).bit_count() <= 3 for r in links.collect())
    roots = {r["node"]: r["root"] for r in simhash.connected(links).collect()}
    groups = {}
    for i, f in signed.items():
        groups.setdefault(roots.get(f, f), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == components(fps)


def test_repeated_ids_of_unlike_texts_stay(spark):
    texts = [(5, "one two three four five six seven eight nine"), (5, "an altogether different text with other words in it"), (5, "one two three four five six seven eight nine"), (7, "one two three four five six seven eight nine")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for module in (simhash, near_copies):
        kept = sorted((r["doc_id"], r["text"]) for r in module.keep_one_of_each(docs).collect())
        assert kept == sorted(set(texts[:2]))


def test_simhash_cases(cases, empty):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(cases).collect())
    ids = {i: brute_fingerprint(t) for i, t in CASES if i is not None}
    assert {i: c for i, c in got if i is not None} == components(ids)
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one_of_each(cases).collect()]
    assert sorted(i for i in kept if i) == sorted(set(components(ids).values())) and kept.count(None) == 1


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 1000)
    rows = [(1, "http://a/", "x" * 2500), (2, None, "é" * 700), (3, "u\r\nInjected: 1", None), (4, "u", ""), (5, "u", "x" * 2500), (6, "u", "x" * 1000), (None, "u", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("chunk_no", F.lit(7)).withColumn("payload", F.lit(0))
    folder = new_path(spark, "warc-test")
    warc.write_warc(warc.record_table(pages), folder)
    chunks = warc.read_warc(spark, folder)
    payloads = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["data"]) <= 1 << 16
        payloads[r["page_id"]] = payloads.get(r["page_id"], b"") + r["data"]
        assert r["bytes_so_far"] == len(payloads[r["page_id"]]) and r["sha1_so_far"] == base64.b32encode(hashlib.sha1(payloads[r["page_id"]]).digest()).decode()
    assert payloads[5] == b"x" * 2500 and payloads[2] == "é".encode() * 700 and payloads[4] == b"" and payloads[1] == b""
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.records(chunks).collect()}
    assert got == {1: (2500, "revisit", 5), 2: (1400, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (2500, "response", None), 6: (1000, "response", None), None: (1, "response", None)}


def test_warc_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    twice = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "u", "other")], "page_id long, url string, html string")
    for pages, want in ((empty, []), (twice, [(1, 1, "response", None), (1, 5, "response", None)])):
        folder = new_path(spark, "warc-test")
        warc.write_warc(warc.record_table(pages), folder)
        assert sorted(tuple(r[c] for c in ("page_id", "payload_bytes", "record_type", "refers_to")) for r in warc.records(warc.read_warc(spark, folder)).collect()) == want


def test_chunk_rows_carry_digests_so_far(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 1000)
    page = spark.createDataFrame([(1, "u", "é" * 1700)], "page_id long, url string, html string")
    chunks = sorted(warc.record_table(page).collect(), key=lambda r: r["chunk_no"])
    whole = b"".join(r["data"] for r in chunks)
    assert whole == ("é" * 1700).encode()
    for r in chunks:
        assert r["sha1_so_far"] == base64.b32encode(hashlib.sha1(whole[: r["bytes_so_far"]]).digest()).decode()
        assert r["payload_digest"] == chunks[-1]["sha1_so_far"] and r["payload_bytes"] == len(whole)


def test_warc_query(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in load(spark, DATA, "pages").collect()}
    last = {h: max(i for i in pages if pages[i] == h) for h in pages.values()}
    want = {i: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages.items()}
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op5_warc(spark, DATA).collect()} == want


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 65536, 150_001])
def test_planes_round_trip(tmp_path, kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    w = token_planes.PlaneWriter(str(tmp_path / "f"), kind)
    cut = n // 3
    w.add(np.array([5]), np.array([cut]), ids[:cut])
    w.add(np.array([6, 7]), np.array([0, n - cut]), ids[cut:])
    assert w.close() == (3, n)
    r = token_planes.PlaneReader(str(tmp_path / "f"))
    assert np.array_equal(r.ids(0, n), ids) and np.array_equal(r.ids(n // 2, n - n // 2), ids[n // 2 :])
    assert list(r.documents()) == [(5, cut, zlib.crc32(ids[:cut].tobytes())), (6, 0, 0), (7, n - cut, zlib.crc32(ids[cut:].tobytes()))]


def test_words_encode_as_whole_texts():
    coder = token_planes.WordEncoder(queries.tokenizer_path())
    rnd = random.Random(1)
    letters = "abcZÉéß .,'\"\n\t\x0b\x0c\r!#<|endoftext|>0123 İΣςσ́  中文😀\x00\x1c\x85 's't're;:?Kİ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + ["A<|endoftext|>B <|ENDOFTEXT|> x.", "", "  "]
    for source in (texts, texts[::-1]):
        ids, n = coder.encode(pa.array(source))
        starts = np.cumsum(n) - n
        assert all(coder.tokenizer.encode(t, add_special_tokens=False).ids == ids[a : a + b].tolist() for t, a, b in zip(source, starts, n))


def test_token_query(spark):
    coder, start, want = token_planes.WordEncoder(queries.tokenizer_path()).tokenizer, 0, {}
    for r in sorted(load(spark, DATA, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = coder.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op7_token_planes(spark, DATA).collect()} == want


def test_token_cases(cases, empty):
    got = token_planes.tokenize_to_files(cases, tokenizer=queries.tokenizer_path(), kind="bit", by_word=False).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in CASES), key=lambda i: -1 if i is None else i)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert token_planes.tokenize_to_files(empty, tokenizer=queries.tokenizer_path()).count() == 0


def test_language_model(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in load(spark, DATA, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, t in docs.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    rows = queries.op2_language_model(spark, DATA).collect()
    for r in rows:
        t = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    assert len(rows) == len(docs)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_language_model_cases(cases, empty):
    got = language_model.score_documents(cases, held_out=F.col("doc_id") == 9).collect()
    assert len(got) == len(CASES) and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert language_model.score_documents(empty, held_out=F.lit(False)).count() == 0
    assert language_model.score_documents(cases, held_out=F.lit(True)).where("n_known > 0").count() == 0


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in load(spark, SMALL, "labels").collect()}
    rows = [r for r in queries.op3_toxicity(spark, SMALL).collect() if r["held_out"] and r["doc_id"] in labels]
    clean = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    toxic = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.6 * len(toxic)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_cases(spark, cases, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(cases, labels, learn=F.lit(True))
    assert got.count() == len(CASES) and got.where("score is null").count() == 0
    assert toxicity.score_toxicity(empty, labels, learn=F.lit(True)).count() == 0
    assert toxicity.score_toxicity(cases, labels.where("false"), learn=F.lit(True)).where("predicted = 1").count() == 0


def test_mixing_meets_targets(spark):
    x = queries.op8_mixing(spark, SMALL).agg(F.sum("n_tokens"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in queries.TARGETS], F.min("rate")).first()
    assert all(math.isclose(x[i + 1] / x[0], w, abs_tol=1e-4) for i, w in enumerate(queries.TARGETS.values())) and x[3] >= 0


def test_rates_against_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 500, 200)
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    targets = np.array([0.7, 0.2, 0.1]) * n.sum()
    r = mixing.rates_after(p, mixing.fit_rates(table, targets, 1.0, max_steps=60), 1.0)
    assert (r >= 0).all() and np.allclose((r * n) @ p, targets, rtol=1e-3)


def test_mixing_cases(spark, cases, empty):
    labels = mixing.label_domains(spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (9, None)], "doc_id long, quality int"))
    got = mixing.take_mixture(cases, labels, {"good": 0.5, "low": 0.5})
    assert got.columns == cases.columns and got.where("doc_id is null").count() == 1
    assert mixing.mix(empty, labels, {"good": 1.0}).count() == 0
    assert mixing.mix(cases, labels.where("false"), {"good": 1.0, "low": 1.0}).count() == len(CASES)


def test_forward_backward_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    e, move, first = rng.random((5, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    total, want = 0.0, np.zeros((5, 3))
    for path in product(range(3), repeat=5):
        weight = first[path[0]] * np.prod([e[t, y] for t, y in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
        total += weight
        for t, y in enumerate(path):
            want[t, y] += weight
    both = forward_backward(np.concatenate([e, e[:2]]), np.array([0, 5]), np.array([5, 2]), first, move)
    assert np.allclose(both[:5], want / total) and np.allclose(both.sum(1), 1)


def test_languages_held_out(spark):
    docs = {r["doc_id"]: r["lang"] for r in load(spark, SMALL, "documents").collect()}
    rows = [r for r in queries.op10_language_id(spark, SMALL).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in rows) >= 0.98 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_switched_words(spark):
    model = fit_crf(training_windows(load(spark, SMALL, "documents"), F.lit(True)), steps=30)
    texts = {r["lang"]: r["text"] for r in load(spark, SMALL, "documents").where("n_chars between 600 and 900").dropDuplicates(["lang"]).collect()}
    mixed = " ".join(texts["en"].split()[:40] + texts["de"].split()[:40])
    got = [r["label"] for r in label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).orderBy("pos").collect()]
    assert got[:35].count("en") >= 30 and got[-35:].count("de") >= 30


def test_language_cases(cases, empty):
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(cases, learn=F.lit(True)).collect()}
    assert {got[i] for i in (3, 4, 5)} == {"und"} and got[1] == "en"
    assert identify_languages(empty, learn=F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(cases, learn=F.lit(False)).collect()} == {"und"}
    assert Crf(["a"], np.zeros((1 << 16, 1)), np.ones((1, 1)), np.ones(1)).predict(split_words(pa.array(["x", None, "12"]), letters_only=True))[0] == ["a", "und", "und"]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = load(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).persist()
        if name != "token_output":
            assert docs.columns == columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert 0 < docs.count() < before
            before = docs.count()
    assert docs.where("n_tokens < 1").count() == 0
