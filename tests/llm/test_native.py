"""Line dedup, decontamination and quality rules against SQL and brute force."""

import hashlib
from collections import Counter

import pytest

from qvault.llm import queries
from qvault.llm.decontamination import decontaminate, find_contained
from qvault.llm.line_dedup import dedup_lines
from qvault.llm.quality_rules import apply_quality_rules, learn_decision_list, text_statistics
from qvault.storage import load

from llm_helpers import CASES, lower, words
from oracle_helpers import DATA, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == rows_of_sql(duck, queries.ORACLES[name])


def brute_lines(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 10 and i is not None:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        keys = [lower(x.strip(" \t\n\x0b\x0c\r")) for x in split]
        gone = [i is not None and len(holders.get(k, ())) > 1 and i != min(holders[k]) for k in keys]
        out.append((i, len(split), sum(gone), "\n".join(x for x, g in zip(split, gone) if not g)))
    return Counter(out)


def test_line_dedup_cases(cases, empty):
    got = dedup_lines(cases)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == brute_lines(CASES)
    assert dedup_lines(empty).count() == 0
    three = dedup_lines(cases, min_docs=3).where("n_dropped > 0").count()
    assert three == 2  # the first line of documents 1, 2 and 6


def test_line_dedup_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "same line of text"), (1, "same line of text"), (2, "same line of text")], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in dedup_lines(rows).collect()) == [0, 0, 1]


def test_containment(spark, cases, empty):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, "a b"), (3, None), (4, ""), (None, "a b")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in find_contained(cases, items).collect()}
    assert got == {(1, 1): 1.0, (6, 1): 1.0, (7, 2): 1.0, (8, 2): 1.0}
    assert find_contained(empty, items).count() == 0 and find_contained(cases, items.where("false")).count() == 0
    assert {r["doc_id"] for r in decontaminate(cases, items).collect()} == {2, 3, 4, 5, 9, 10, None}


def test_containment_threshold(spark):
    item = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "pre fix " + " ".join(item) + " tail"), (2, " ".join(item[:25])), (3, " ".join(item[:20])), (4, " ".join(["X", *item[:12], "y", *item[12:]]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_shared"] for r in find_contained(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: 26, 2: 21, 4: 22}


def brute_statistics(t):
    w = words(t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, cases):
    docs = load(spark, DATA, "documents").select("doc_id", "text")
    for table in (docs, cases.select("doc_id", "text")):
        texts = Counter((r["doc_id"], *brute_statistics(r["text"])) for r in table.collect())
        got = text_statistics(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(tuple(r) for r in got) == texts


def test_rules_keep_clean_documents(spark, empty):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    got = {r["doc_id"]: r for r in apply_quality_rules(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [got[i]["kept"] for i, q in truth.items() if q == 1 and got[i]["n_words"] >= 10]
    bad = [got[i]["kept"] for i, q in truth.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert all(not r["kept"] for r in got.values() if r["base_failed"])
    assert apply_quality_rules(empty, labels).count() == 0


def test_no_labels_no_rules(spark, cases):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert apply_quality_rules(cases, labels).where("not base_failed and not kept").count() == 0
    stats = text_statistics(cases).selectExpr("*", "cast(null as boolean) as bad")
    assert learn_decision_list(stats) == []


def test_digest_is_of_the_kept_text(spark):
    kept = {r["doc_id"]: r["kept_text"] for r in dedup_lines(load(spark, DATA, "documents")).collect()}
    for r in queries.op1_line_dedup(spark, DATA).collect():
        assert r["kept_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest()
