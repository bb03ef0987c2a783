"""How far the words of each source lie from those of its language: term counts by Arrow kernels, divergences over columnar shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.llm.features import SLICE_BYTES, release_memory, slices
from qvault.storage import Scratch

#: What parts terms: ASCII characters that are no letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Counts that a task holds before it merges them, and gives them out if they are still as many.
HELD_ROWS = 250_000
#: A shard has about so many terms of a language, and a tile so many sources on each side: 8 bytes for each two of them is what a group holds.
SHARD_TERMS = 1024
TILE_SOURCES = 256

_PARTIAL = "lang string, source string, term string, n long, docs long"
_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def _pieces(text: pa.Scalar, size: int) -> Iterator[pa.Array]:
    """A text in pieces of about ``size`` bytes that end where a term does."""
    data = np.frombuffer(text.as_buffer(), np.uint8)
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data):
            gaps = np.flatnonzero(~_LETTER[data[end : end + 4096]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += 4096
        end = min(end, len(data))
        yield pa.array([data[at:end].tobytes()], pa.binary()).cast(pa.string())
        at = end


def _row_counts(texts: pa.Array) -> pa.Table:
    """(row, term, n): how often each text has each of its terms."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=GAP)
    coded = lists.flatten().dictionary_encode()
    each = pa.table({"row": pc.list_parent_indices(lists), "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    found = pa.table({"row": each["row"], "term": pc.take(coded.dictionary, each["code"]), "n": each["count_all"]})
    return found.filter(pc.not_equal(found["term"], ""))


def _long_counts(text: pa.Scalar) -> pa.Table:
    """The same for one long text, a piece at a time."""
    parts = pa.concat_tables([_row_counts(p) for p in _pieces(text, SLICE_BYTES)])
    return parts.group_by(["row", "term"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _slice_counts(b: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a slice; the empty term stands for the group itself."""
    texts = b.column("text")
    each = _long_counts(texts[0]) if len(texts) == 1 and len(texts[0].as_buffer()) > SLICE_BYTES else _row_counts(texts)
    langs, sources = b.column("lang").dictionary_encode(), b.column("source").dictionary_encode()
    width = max(1, len(sources.dictionary))
    group = pa.array(langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy())
    terms = each["term"].combine_chunks().dictionary_encode()
    counted = pa.table({"group": pc.take(group, each["row"]), "code": terms.indices, "n": each["n"]}).group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    there = pc.unique(group)
    zeros = pa.array(np.zeros(len(there), np.int64))
    number = pa.concat_arrays([counted["group"].combine_chunks(), there]).to_numpy()
    return pa.table({
        "lang": pc.take(langs.dictionary, pa.array(number // width)), "source": pc.take(sources.dictionary, pa.array(number % width)),
        "term": pa.concat_arrays([pc.take(terms.dictionary, counted["code"].combine_chunks()), pa.array([""] * len(there), pa.string())]),
        "n": pa.concat_arrays([counted["n_sum"].combine_chunks(), zeros]), "docs": pa.concat_arrays([counted["count_all"].combine_chunks(), zeros]),
    })


def _merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns({"n_sum": "n", "docs_sum": "docs"})


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of parts of ``docs`` (text, lang, source, none of them null): rows of several parts add up.

    Each group has a row with an empty term, which is no term of a text, so
    that groups without terms are there, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for first, n in slices(b.column("text")):
                held.append(_slice_counts(b.slice(first, n)))
                rows += held[-1].num_rows
                if rows > HELD_ROWS:
                    held = [_merged(held)]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from _merged(held).to_batches()
        held.clear()
        release_memory()

    return docs.select("text", "lang", "source").mapInArrow(run, _PARTIAL)


def _share(count: Column, total: Column, v: Column) -> Column:
    """The smoothed share of a count in billionths, at least 1, in whole numbers of any size."""
    billions = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return F.call_function("div", billions, F.nullif(total + v * 5, F.lit(0)).cast("decimal(20,0)")) + 1


def _tile_distances(rows: pa.Table) -> pa.Table:
    """(lang, source, item, value): distances of the sources of two blocks over a shard's terms.

    Rows without a term name the tile's sources, what they give a term that
    they don't have, and in shard 0 how many terms the language keeps: a term
    that is in neither block makes the difference of those two shares.
    """
    named = rows.filter(pc.is_null(rows["term"]))
    names, block, zero, v = named["source"].combine_chunks(), named["block"].to_numpy(), named["p"].to_numpy(), named["v"][0].as_py()
    sources = pc.index_in(rows["source"], value_set=names).to_numpy()
    terms = rows["term"].combine_chunks().dictionary_encode()
    has = pc.is_valid(rows["term"]).to_numpy()
    dense = np.repeat(zero[:, None], len(terms.dictionary), axis=1)
    dense[sources[has], terms.indices.drop_null().to_numpy()] = rows["p"].to_numpy()[has]
    lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
    a, b, value = [], [], []
    for i in range(len(names)):
        # A tile of two blocks compares across them only.
        others = np.flatnonzero(block == (hi if block[i] == lo else lo))
        others = others[others != i]
        a.append(np.full(len(others), i))
        b.append(others)
        value.append(np.abs(dense[others] - dense[i]).sum(axis=1) + (v - dense.shape[1]) * np.abs(zero[others] - zero[i]))
    a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, value))
    return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(a), pa.string()), "source": pc.take(names, pa.array(a)), "item": pc.take(names, pa.array(b)), "value": pa.array(value.astype(np.int64))})


def _pair_distances(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, from vectors (lang, source, term, p, shards, blocks) and groups."""
    block = F.pmod(F.xxhash64("source", F.lit("block")), F.col("blocks")).cast("int")
    listed = vectors.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "blocks", F.lit(None).cast("long").alias("v"))
    markers = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("zero", F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))).alias("shard"), "blocks", "v")
    markers = markers.withColumn("v", F.when(F.col("shard") == 0, F.col("v")).otherwise(0))
    placed = listed.unionByName(markers).withColumn("block", block)
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    tiles = other.select("lang", "source", "term", "p", "v", "shard", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return tiles.groupBy("lang", "lo", "hi", "shard").applyInArrow(_tile_distances, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, *, min_docs: int = 30, top: int = 50) -> DataFrame:
    """The divergences of the sources of each language of ``docs`` (text, lang, source; other columns are left out).

    Terms are runs of letters A-Z, in lower case, and of other characters
    beyond ASCII. A language keeps those in ``min_docs`` of its rows. Each
    group, a language's source, and each language gives each kept term a share
    in billionths. Returns lang, source, part, item, value and rank: in part
    ``pair`` the sum of differences to each other source of the language, in
    part ``term`` the ``top`` terms that the group has more of than the
    language, with the difference. Larger values come first, ties by item.

    Null texts, languages and sources count as empty ones. Rows that repeat
    are rows of their own. A group without kept terms is compared like any
    other; if a language keeps none, all its values are 0. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    filled = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = scratch.table(partial_counts(filled).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = scratch.table(counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept")
    found = scratch.table(counts.drop("docs").join(kept, ["lang", "term"]), "found")
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    width = counts.where("term = ''").groupBy("lang").agg(F.count("*").alias("sources"))
    sized = counts.where("term = ''").select("lang", "source").join(width, "lang").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "total_lang", "total"])
    split = {"zero": _share(F.lit(0), F.col("total"), F.col("v")), "shards": F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD_TERMS)), "blocks": F.ceil(F.col("sources") / TILE_SOURCES)}
    groups = scratch.table(sized.withColumns(split), "groups")
    both = found.join(groups, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total"), F.col("v")), "q": _share(F.col("n_lang"), F.col("total_lang"), F.col("v"))})
    vectors = scratch.table(both.select("lang", "source", "term", "p", "q", "shards", "blocks"), "vectors")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pair_distances(vectors, groups).withColumn("rank", F.row_number().over(first))
    above = vectors.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    scratch.drop("counts", "kept", "found")
    return part(pairs, "pair").unionByName(part(terms, "term"))
