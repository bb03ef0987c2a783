"""Benchmark decontamination: short test items found inside long documents, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.llm.text import ascii_lower, words
from qvault.storage import materialize

#: Items whose shingles take up to so many bytes are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Parts that each key is dealt to in a join by shuffle: documents go to one, items to all.
PARTS = 32


def window(k: int) -> list[Column]:
    """The ``k`` words from position ``i`` on."""
    return [F.get("words", F.col("i") + j) for j in range(k)]


def windows(rows: DataFrame, key: str, k: int) -> DataFrame:
    """One row (key, words, i) per position at which ``k`` words begin."""
    full = rows.where(F.size("words") >= k)
    return full.select(key, "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("i"))


def item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """Distinct (item_id, k, shingle, h, q): ``k`` words each, fewer than ``shingle`` only in items that are shorter."""
    rows = items.where("item_id is not null").select("item_id", words(ascii_lower(F.coalesce("text", F.lit("")))).alias("words"))
    rows = rows.withColumn("k", F.least(F.lit(shingle), F.size("words"))).where("k > 0")
    placed = rows.select("item_id", "k", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("i"))
    text = placed.select("item_id", "k", F.array_join(F.slice("words", F.col("i") + 1, F.col("k")), " ").alias("shingle")).distinct()
    sized = text.join(text.groupBy("item_id").agg(F.count("*").alias("q")), "item_id")
    return sized.withColumn("h", F.xxhash64("shingle"))


def signatures(shingles: DataFrame, threshold: float) -> DataFrame:
    """The smallest hashes of each item: its MinHash signature, of a length fixed by its size class.

    A document that holds a share ``threshold`` of an item's q shingles misses
    at most q - ceil(threshold q) of them, so it holds one of any
    q - ceil(threshold q) + 1. Items are partitioned by size into classes
    [2^c, 2^(c+1)); a class takes the length that its largest size needs.
    Candidates from these signatures lose no match.
    """
    top = F.pow(F.lit(2.0), F.floor(F.log2("q")) + 1) - 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle"))
    length = top - F.ceil(top * threshold - 1e-9) + 1
    return shingles.withColumn("rank", rank).where(F.col("rank") <= length).select("item_id", "k", "h")


def met(held: DataFrame, items: DataFrame, key: str, n_bytes: int) -> DataFrame:
    """The inner join of documents' shingles with those of items."""
    if n_bytes <= BROADCAST_BYTES:
        return held.join(F.broadcast(items), key)
    dealt = held.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    return dealt.join(items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [key, "part"]).drop("part")


def find_contained(docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of documents and items of which the document holds at least ``threshold`` of the distinct word shingles.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    left out. Returns doc_id, item_id, n_item_shingles, n_shared and containment.

    Words are lower-cased in A-Z. An item of fewer than ``shingle`` words is one
    shingle of all its words; an item without words, or without an id, matches
    nothing. Null and blank documents hold nothing. Rows that repeat a doc_id or
    item_id count as one text with the shingles of all. Empty tables give an
    empty result.

    The documents are read once to probe the items' signatures and once more,
    for candidates alone, to count their shingles exactly. Items go to the
    documents by broadcast up to BROADCAST_BYTES, however long their words are.
    Beyond, both are shuffled, and a shingle that many documents hold is dealt
    to PARTS tasks.
    """
    all_shingles, _ = materialize(item_shingles(items, shingle), "items")
    sizes = {r["k"]: r["bytes"] for r in all_shingles.groupBy("k").agg(F.sum(F.octet_length("shingle") + 40).alias("bytes")).collect()}  # one row per k, at most `shingle`
    n_bytes = sum(sizes.values())
    signed = signatures(all_shingles, threshold)
    texts = docs.where("doc_id is not null").select("doc_id", words(ascii_lower(F.coalesce("text", F.lit("")))).alias("words"))

    def probe(k: int) -> DataFrame:
        hashed = windows(texts, "doc_id", k).select("doc_id", F.xxhash64(F.concat_ws(" ", *window(k))).alias("h"))
        return met(hashed, signed.where(F.col("k") == k).select("item_id", "h"), "h", n_bytes).select("doc_id", "item_id")

    ks = sorted(sizes) or [shingle]
    candidates = probe(ks[0])
    for k in ks[1:]:
        candidates = candidates.union(probe(k))
    candidates, _ = materialize(candidates.distinct(), "candidates")
    suspects = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")

    def exact(k: int) -> DataFrame:
        held = windows(suspects, "doc_id", k).select("doc_id", F.concat_ws(" ", *window(k)).alias("shingle"))
        return met(held, all_shingles.where(F.col("k") == k).select("item_id", "shingle", "q"), "shingle", n_bytes)

    found = exact(ks[0])
    for k in ks[1:]:
        found = found.unionByName(exact(k))
    counted = found.groupBy("doc_id", "item_id", "q").agg(F.count_distinct("shingle").alias("n_shared"))
    passed = counted.where(F.col("n_shared") >= F.col("q") * threshold - 1e-9).join(candidates, ["doc_id", "item_id"], "left_semi")
    return passed.select("doc_id", "item_id", F.col("q").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null doc_id stay."""
    held = find_contained(docs, items, **options).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(docs.columns)
