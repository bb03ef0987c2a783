"""Hard negatives of anchors: exact integer inner products of blocks by Strassen's recursion, kept in heaps that merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.storage import Scratch

#: A tile side of so many rows or fewer, or of so many bytes of numbers, is a block.
BLOCK_ROWS = 512
BLOCK_BYTES = 1 << 20
#: Blocks of anchors and of candidates that one group multiplies: what it holds is bounded by them.
ANCHOR_BLOCKS = 8
CANDIDATE_BLOCKS = 16
#: Strassen's recursion ends where a side is no longer than this.
LEAF = 32

_BLOCK = "ids binary, labels binary, width int, numbers binary"


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices of any shape, by seven products of halves; odd sides are padded with zeros.

    Sums wrap around at 64 bits, so the product is exact wherever its own
    entries fit them.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))[:m, :n]
    i, j, l = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11)
    p3, p4 = strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5, p6, p7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])


class Heaps:
    """The best ``k`` (score, id) of each of ``n`` owners: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.iinfo(np.int64).min)
        self.owner, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def merge(self, owner: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        owner, score, id = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, id)))
        order = np.lexsort((id, ~score, owner))  # ~ turns the order around and can't overflow
        sorted_owner = owner[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner)
        order, place = order[place < self.k], place[place < self.k]
        self.owner, self.score, self.id = owner[order], score[order], id[order]
        full = place == self.k - 1
        self.least[self.owner[full]] = self.score[full]


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantized_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, numbers) of the rows that take part, with each component x as floor(scale * x)."""
    held = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding")))
    # A cast of what is beyond 64 bits is not defined; it saturates here.
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-(2.0**62))), F.lit(2.0**62)))
    return held.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", whole).alias("numbers"))


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (vec_id, label, numbers): arrays as bytes, rows by label and id so that most blocks have one label.

    Shorter vectors are padded with zeros to the block's width; numbers take
    as many bytes as the largest needs.
    """

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        ids, labels = (t[c].to_numpy() for c in ("vec_id", "label"))
        lists = t["numbers"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat, width = lists.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
        numbers = np.zeros((len(ids), width), np.int64)
        numbers[np.arange(width) < sizes[:, None]] = flat
        kind = next(x for x in ("i2", "i4", "i8") if x == "i8" or not len(flat) or np.iinfo(x).min <= flat.min() and flat.max() <= np.iinfo(x).max)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, labels)] + [pa.array([width], pa.int32()), pa.array([numbers.astype(kind).tobytes()], pa.binary())], ["ids", "labels", "width", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, widest = [], 0, 1
        for b in batches:
            at = 0
            while at < len(b):
                widest = max(widest, int(np.diff(b.column("numbers").offsets.to_numpy()).max(initial=1)))
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * widest)))
                taken = b.slice(at, max(1, most - n))
                held.append(taken)
                at, n = at + len(taken), n + len(taken)
                if n >= most:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id").mapInArrow(run, _BLOCK)


class _Block:
    """A packed block as arrays."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        size = len(row["numbers"]) // max(1, len(self.ids) * row["width"])
        self.numbers = np.frombuffer(row["numbers"], f"i{size or 8}").reshape(len(self.ids), row["width"]).astype(np.int64)
        self.number, self.windows = row["block"], row.get("windows") or []
        self.only = self.labels[0] if (self.labels == self.labels[0]).all() else None


def _scores(anchors: _Block, others: _Block) -> np.ndarray:
    width = max(anchors.numbers.shape[1], others.numbers.shape[1])
    a, b = (np.pad(x.numbers, ((0, 0), (0, width - x.numbers.shape[1]))) for x in (anchors, others))
    return strassen(a, np.ascontiguousarray(b.T))


def _cells(anchors: DataFrame, others: DataFrame, n_anchors: int, n_others: int) -> DataFrame:
    """Each block of anchors beside each of the others in one cell of a grid, as rows of both kinds."""
    down, across = -(-n_anchors // ANCHOR_BLOCKS), -(-n_others // CANDIDATE_BLOCKS)
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(max(1, n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    left = anchors.withColumn("is_anchor", F.lit(True)).withColumn("row", own(down)).withColumn("col", every(across))
    right = others.withColumn("is_anchor", F.lit(False)).withColumn("col", own(across)).withColumn("row", every(down))
    return left.unionByName(right, allowMissingColumns=True)


def _sides(cell: pa.Table) -> tuple[list[_Block], list[_Block]]:
    rows = cell.to_pylist()
    return [_Block(r) for r in rows if r["is_anchor"]], [_Block(r) for r in rows if not r["is_anchor"]]


def _positives(k: int):
    """A function of a cell: (block, place, anchor_id, id, score) of the best ``k`` rows with the label of each anchor."""

    def run(cell: pa.Table) -> pa.Table:
        anchors, others = _sides(cell)
        out = []
        for a in anchors:
            heaps = Heaps(len(a.ids), k)
            for c in others:
                same = a.labels[:, None] == c.labels
                if same.any():
                    score = _scores(a, c)
                    owner, at = np.nonzero(same & (a.ids[:, None] != c.ids) & (score >= heaps.least[:, None]))
                    heaps.merge(owner, score[owner, at], c.ids[at])
            out.append((np.full(len(heaps.owner), a.number), heaps.owner, a.ids[heaps.owner], heaps.id, heaps.score))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("block", "place", "anchor_id", "id", "score"), columns, strict=True)))

    return run


def _negatives(k: int, slots: int):
    """A function of a cell: (block, place, slot, id, score) of the best ``k`` rows of other labels in the window of each anchor's positive."""

    def run(cell: pa.Table) -> pa.Table:
        anchors, others = _sides(cell)
        out = []
        for a in anchors:
            low, high = np.full((len(a.ids), slots), 1), np.zeros((len(a.ids), slots), np.int64)
            for w in a.windows:
                low[w["place"], w["slot"] - 1], high[w["place"], w["slot"] - 1] = w["low"], w["high"]
            heaps = Heaps(len(a.ids) * slots, k)
            for c in others:
                if a.only is not None and a.only == c.only:
                    continue
                score, other = _scores(a, c), a.labels[:, None] != c.labels
                for slot in range(slots):
                    least = np.maximum(heaps.least.reshape(-1, slots)[:, slot], low[:, slot])
                    owner, at = np.nonzero(other & (score >= least[:, None]) & (score <= high[:, slot, None]))
                    heaps.merge(owner * slots + slot, score[owner, at], c.ids[at])
            out.append((np.full(len(heaps.owner), a.number), heaps.owner // slots, heaps.owner % slots + 1, heaps.id, heaps.score))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("block", "place", "slot", "id", "score"), columns, strict=True)))

    return run


def mine_hard_negatives(vectors: DataFrame, *, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, label, embedding; other columns are left out) for which ``anchors`` (of vec_id and label) holds.

    Components become floor(scale * x), scores are exact inner products, larger
    ones first, ties by smaller vec_id. An anchor's positives are its first
    rows with its label and another vec_id; the negatives of each are the first
    rows of other labels whose score is from ``low`` to ``high`` hundredths of
    the positive's. Returns anchor_id, positive_id, rank, negative_id,
    positive_score and negative_score.

    Anchors meet all rows in blocks on a grid: once with blocks that share a
    label, for the positives, and once with those that don't, for the windows;
    of each cell only heaps come back, which merge. Rows with a null vec_id or
    label, a null vector, or any null or non-finite component take no part.
    Shorter vectors count as padded with zeros. Rows that repeat a vec_id are
    rows of their own: each is an anchor, a positive and a negative by itself.
    Scores are exact while they fit 60 bits. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = quantized_rows(vectors, scale)
    numbered = lambda df, label: scratch.table(packed(df).withColumn("block", F.monotonically_increasing_id()), label)
    asked, others = numbered(rows.where(anchors), "anchors"), numbered(rows, "candidates")
    n = asked.count(), others.count()
    found = _cells(asked, others, *n).groupBy("row", "col").applyInArrow(_positives(positives), "block long, place long, anchor_id long, id long, score long")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    first = scratch.table(found.withColumn("slot", F.row_number().over(best).cast("long")).where(F.col("slot") <= positives), "positives")
    # Whole bounds of negative scores, low * p <= 100 * n <= high * p, by decimals, which don't overflow.
    hundredths = lambda x: F.col("score").cast("decimal(20,0)") * F.lit(x).cast("decimal(6,0)") * F.lit("0.01").cast("decimal(3,2)")
    window = F.struct("place", "slot", F.ceil(hundredths(low)).cast("long").alias("low"), F.floor(hundredths(high)).cast("long").alias("high"))
    windows = first.groupBy("block").agg(F.collect_list(window).alias("windows"))  # a block bounds it
    near = _cells(asked.join(windows, "block"), others, *n).groupBy("row", "col").applyInArrow(_negatives(negatives, positives), "block long, place long, slot long, id long, score long")
    best = Window.partitionBy("block", "place", "slot").orderBy(F.desc("score"), "id")
    taken = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    return taken.join(first.withColumnRenamed("id", "positive_id").withColumnRenamed("score", "positive_score"), ["block", "place", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
