"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qvault.llm.text import free_names
from qvault.storage import drop_path, materialize

#: Shingles whose bits are counted at once, so that a long text takes bounded memory.
CHUNK = 1 << 16
SEED = 42
#: Fingerprints that differ in so many bits or fewer are linked.
RADIUS = 3


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text: a bit is set if more than half of the shingles' XXH64 have it set."""
    words = text.lower().split()  # on bytes: A-Z only, and blanks are space and 0x09 to 0x0D
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        a, b = starts[at : min(n, at + CHUNK)].tolist(), (ends[at + k - 1 : min(n, at + CHUNK) + k - 1] - 1).tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp holds the 64 bits as a signed number. Null and blank texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def with_neighbours(fps: DataFrame) -> DataFrame:
    """The rows of ``fps`` (fp) that may have another fingerprint within 3 bits; loses none that has.

    Three differing bits touch at most 3 of 8 bytes, so two such fingerprints
    agree in 5 bytes: one row goes out for each choice of 5 of 8. A row with a
    neighbour in the order of its key is not alone there. The rows stream
    through the window, and no more than 2^24 distinct fingerprints share 5
    bytes.
    """
    masks = [sum(0xFF << (8 * i) for i in chosen) for chosen in combinations(range(8), 5)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)])
    sent = fps.select("fp", F.explode(keys).alias("key"))
    near = Window.partitionBy("key").orderBy("fp")
    met = sent.withColumn("beside", F.coalesce(F.lag("fp").over(near), F.lead("fp").over(near))).where("beside is not null")
    return fps.join(met.select("fp").distinct(), "fp", "left_semi")


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (node, hub) of ``fps`` (fp) that connect exactly the fingerprints within 3 bits of each other, directly or by way of a hub.

    Every fingerprint emits its variants within half the radius. Half of 3 is
    rounded by parity: fingerprints with an even number of set bits emit all
    variants within 2 bits, the others within 1. Two fingerprints at distance 3
    or 1 differ in parity, and two at distance 2 both emit the variants within
    1, so each pair meets at a variant. There, the smallest fingerprint within
    1 bit is the hub; all others at that variant are within 2 + 1 bits of it,
    which each link is verified to be. Each row gives at most one link, never
    one per pair, and at most 2081 distinct fingerprints can meet at a variant.
    """
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    one = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), bit))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: bit(i).bitwiseOR(bit(j)))))
    even = F.bit_count("fp") % 2 == 0
    sent = fps.select("fp", F.explode(F.when(even, F.concat(one, two)).otherwise(one)).alias("mask"))
    sent = sent.select(F.col("fp").alias("node"), F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), (F.bit_count("mask") <= 1).alias("near"))
    hub = F.min(F.when(F.col("near"), F.col("node"))).over(Window.partitionBy("variant"))
    met = sent.withColumn("hub", hub).where("hub <> node").select("node", "hub").distinct()
    return met.where(F.bit_count(F.col("node").bitwiseXOR(F.col("hub"))) <= RADIUS)


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (node, hub) reaches; roots themselves are left out.

    Large-star and small-star steps by turns: each links nodes to the smallest
    of their neighbours, until nothing changes, in a logarithmic number of
    rounds. Each round is a table in the shared folder.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    edges, path = materialize(oriented(links.toDF("u", "v")), "links")
    before = None
    while True:
        n = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(n) == before or n[0] == 0:
            break
        before = tuple(n)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = oriented(large.join(smallest, "u").select("v", "m").toDF("u", "v").union(smallest.toDF("u", "v")))
        old = path
        edges, path = materialize(small, "links")
        drop_path(edges.sparkSession, old)
    return edges.toDF("node", "root")


def _grouped(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, root, component_id) of the distinct ones."""
    rows, _ = materialize(fingerprints(docs, shingle), "fingerprints")
    fps, _ = materialize(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    active, _ = materialize(with_neighbours(fps.select("fp")), "active")
    rooted = fps.join(connected(ball_links(active)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows, rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """The fingerprint and the component of every row of ``docs`` (doc_id, text; other columns are left out).

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest
    doc_id reachable over fingerprints that differ in 3 bits or fewer. Equal
    fingerprints collapse first, so copies cost nothing further. Null and blank
    texts have fingerprint zero and link like any other. Rows that repeat a
    doc_id are texts of their own, each with the component of its fingerprint.
    Rows with a null doc_id take the component of their fingerprint; it is null
    if no row with an id has it. An empty table gives an empty result.
    """
    rows, found = _grouped(docs, shingle)
    return rows.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """``docs`` with one row per component: that of the smallest doc_id.

    Where that doc_id has several rows in the component, one with the smallest
    fingerprint stays. Rows with a null doc_id can't be told apart and all stay.
    """
    (at,) = free_names(docs.columns, "at")
    numbered, _ = materialize(docs.where("doc_id is not null").withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows, found = _grouped(numbered.select(F.col(at).alias("doc_id"), "text"), shingle)
    ids = rows.withColumnRenamed("doc_id", at).join(numbered.select(at, "doc_id"), at)
    kept = ids.join(found, "fp").groupBy("root").agg(F.min(F.struct("doc_id", "fp", F.col(at).alias("at"))).alias("kept")).select(F.col("kept.at").alias(at))
    return numbered.join(kept, at, "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
