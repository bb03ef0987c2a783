"""Near-duplicate vectors: randomly rotated binary codes give unbiased inner products with bounds, which choose what is computed exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qvault.llm.simhash import connected
from qvault.llm.skew import join_split
from qvault.storage import Scratch

SEED = 42
#: Bits of each rotated component of a vector that asks; the codes that it is held against have one.
QUERY_BITS = 6
#: Standard errors that an estimate may be off: a pair is lost with a probability below 1e-8.
SIGMAS = 6.0
#: A block has at most so many vectors, or so many bytes of them; a tile holds two blocks.
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
#: Pairs whose exact cosine is computed at once, and the numbers that they read.
EXACT_NUMBERS = 1 << 22
ASKED_AT_ONCE = 256


@lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _padded(width: int) -> int:
    return -(-width // 64) * 64


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rotated unit vectors, their sign codes as 64-bit words, and each one's correction: its inner product with its own code."""
    width = _padded(unit.shape[1])
    turned = np.pad(unit, ((0, 0), (0, width - unit.shape[1]))) @ rotation(width)
    code = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return turned, code, np.abs(turned).sum(axis=1) / np.sqrt(width)


def upper_bounds(turned: np.ndarray, codes: np.ndarray, correction: np.ndarray, threshold: float, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, bound): unbiased estimates of the inner products of unit vectors with encoded ones, and by how much one may be too low where the truth reaches ``threshold``.

    A component of an asking vector is rounded at random to QUERY_BITS bits, so
    that its mean stays; its product with a code is a sum of bit counts. Divided
    by the code's correction it estimates the product with the encoded vector.
    The error has two parts: what of the code is orthogonal to its vector meets
    what of the asking vector is, sqrt(1 - threshold^2) at most; and the rounding.
    """
    width = turned.shape[1]
    low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
    step = np.maximum((high - low) / (2**QUERY_BITS - 1), 1e-12)
    level = np.floor((turned - low) / step + np.random.default_rng(SEED).random(turned.shape)).astype(np.uint8)
    held = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    met = np.zeros((len(turned), len(codes)), np.int64)
    for bit in range(QUERY_BITS + 1):  # rounding up may reach one bit more
        plane = np.packbits(level >> bit & 1, axis=1, bitorder="little").view(np.uint64)
        if plane.any():
            for word in range(plane.shape[1]):
                met += np.bitwise_count(plane[:, word, None] & codes[:, word]).astype(np.int64) << bit
    # The code is +1 or -1 over sqrt(width): twice what meets its set bits, less all.
    product = 2 * (low * held + step * met) - (low * width + step * level.sum(axis=1, dtype=np.int64, keepdims=True))
    estimate = product / np.sqrt(width) / correction
    apart = np.sqrt(np.maximum(1 - correction**2, 0) / max(1, width - 1)) * np.sqrt(max(0.0, 1 - threshold**2))
    return estimate, sigmas * np.sqrt(apart**2 + (step / 2) ** 2) / correction + 1e-9


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` reaches over links a - b."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``left``, in ``right``) of vectors with a cosine of ``threshold`` or more, a bounded number at once."""
    norms = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (left, right)]
    asking, (_, codes, correction) = encode(left / norms[0][:, None])[0], encode(right / norms[1][:, None])
    for first in range(0, len(left), ASKED_AT_ONCE):
        estimate, bound = upper_bounds(asking[first : first + ASKED_AT_ONCE], codes, correction, threshold)
        i, j = np.nonzero(estimate + bound >= threshold)
        i += first
        most = max(1, EXACT_NUMBERS // left.shape[1])
        for at in range(0, len(i), most):
            a, b = i[at : at + most], j[at : at + most]
            exact = np.einsum("ij,ij->i", left[a], right[b]) / (norms[0][a] * norms[1][b])
            yield a[exact >= threshold], b[exact >= threshold]


def _tile(threshold: float):
    """A function of a tile, one or two blocks of a label: (node, n, root), the rows that each node links to there, and the smallest node that it reaches."""

    def side(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, copies = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["copies"], np.int64)
        return nodes, copies, np.frombuffer(row["vectors"], np.float64).reshape(len(nodes), -1)

    def run(rows: pa.Table) -> pa.Table:
        blocks = [side(r) for r in sorted(rows.to_pylist(), key=lambda r: r["block"])]
        one = len(blocks) == 1
        (nodes, copies, left), (others, other_copies, right) = blocks[0], blocks[-1]
        shift = 0 if one else len(nodes)
        every = nodes if one else np.concatenate((nodes, others))
        n, root = np.zeros(len(every), np.int64), np.arange(len(every))
        for a, b in similar_pairs(left, right, threshold):
            if one:
                a, b = a[a < b], b[a < b]
            np.add.at(n, a, other_copies[b])
            np.add.at(n, b + shift, copies[a])
            root = _roots(len(every), np.concatenate((a, np.arange(len(every)))), np.concatenate((b + shift, root)))
        linked = n > 0
        # Places are in no order of node numbers: the smallest node of each root's group is what goes out.
        least = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(least, root, every)
        return pa.table({"node": every[linked], "n": n[linked], "root": least[root][linked]})

    return run


def hashed(vectors: DataFrame) -> DataFrame:
    """(at, vec_id, label, digest, vector) of rows (at, vec_id, label, embedding): vector as bytes of doubles; it and digest are null where the row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, vectors = [], []
            for label, x in zip(b.column("label"), b.column("embedding"), strict=True):
                usable = label.is_valid and x.is_valid and not x.values.null_count
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if usable else np.zeros(0)  # -0.0 becomes 0.0
                norm = float(v @ v) if np.isfinite(v).all() else 0.0
                if not (0 < norm < np.inf) and v.any() and np.isfinite(v).all():
                    v = v / np.abs(v).max()  # squares out of range: the direction is what counts
                    norm = float(v @ v)
                used = norm > 0
                vectors.append(v.tobytes() if used else None)
                digests.append(xxhash.xxh3_128_digest(repr(label.as_py()).encode() + b"\0" + v.tobytes()) if used else None)
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("vec_id"), b.column("label"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["at", "vec_id", "label", "digest", "vector"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("at", "vec_id", "label", "embedding").mapInArrow(run, f"at long, vec_id long, label {kind}, digest binary, vector binary")


def _pack(rows: pa.Table) -> pa.Table:
    """A block's rows as one."""
    joined = lambda c: b"".join(rows[c].to_pylist())
    numbers = lambda c: rows[c].to_numpy().astype(np.int64).tobytes()
    return pa.table({"space": rows["space"][:1], "block": rows["block"][:1], "blocks": rows["blocks"][:1], "nodes": pa.array([numbers("node")], pa.binary()), "copies": pa.array([numbers("copies")], pa.binary()), "vectors": pa.array([joined("vector")], pa.large_binary()).cast(pa.binary())})


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.98) -> DataFrame:
    """The links of every row of ``vectors`` (vec_id, label, embedding; other columns are left out) to rows of its label with a cosine of ``threshold`` or more.

    Returns vec_id, n_links (other rows linked directly), component_id (the
    smallest vec_id reachable, its own included) and kept (vec_id is
    component_id). Equal vectors of a label collapse first and count as often
    as they are there. The vectors of a label are dealt to blocks by a hash,
    and each two blocks of a label meet in a tile, whatever the label's share
    of the rows; a tile gives a row per vector, never one per pair. In a tile
    codes choose the pairs whose cosine is computed in double precision; a pair
    below the threshold is never linked, one above it is missed with a
    probability below 1e-8.

    Vectors that are null, zero or hold null or non-finite components, and rows
    with a null label, link with nothing. Vectors of different lengths are not
    compared. Rows that repeat a vec_id are rows of their own. Those with a
    null vec_id link like others, but name no component; kept is false if no
    row of their component has an id. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession)
    numbered = vectors.select(F.monotonically_increasing_id().alias("at"), F.col("vec_id").cast("long"), "label", "embedding")
    rows = scratch.table(hashed(numbered), "rows")
    usable = rows.where("digest is not null")
    nodes = scratch.table(usable.groupBy("digest").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.min("at").alias("node")), "nodes")
    # One row of each group of copies has the vector; labels and lengths part the rest.
    space = F.to_json(F.struct("label", F.length("vector").alias("bytes")))
    single = scratch.table(usable.join(nodes.select(F.col("node").alias("at"), "copies"), "at").select(F.col("at").alias("node"), "copies", "vector", space.alias("space")), "single")
    per_block = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / F.max(F.length("vector")))))
    sizes = scratch.table(single.groupBy("space").agg(F.count("*").alias("members"), per_block.alias("per_block")).withColumn("blocks", F.ceil(F.col("members") / F.col("per_block"))), "sizes")
    dealt = join_split(single, sizes, "space", n="members", by=["node"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    packed = "space string, block long, blocks long, nodes binary, copies binary, vectors binary"
    blocks = scratch.table(dealt.groupBy("space", "block").applyInArrow(_pack, packed), "blocks")
    other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = other.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).groupBy("space", "lo", "hi")
    met = scratch.table(tiles.applyInArrow(_tile(threshold), "node long, n long, root long"), "met")
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected(met.where("node <> root").select("node", "root").distinct())
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = rooted.join(least, "root").join(counts, "node", "left").select("digest", "copies", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = scratch.table(linked, "found")
    scratch.drop("nodes", "single", "sizes", "blocks", "met")
    inside = join_split(usable.select("vec_id", "digest", "at"), found, "digest", n="copies", by=["at"]).select("vec_id", "n_links", "component_id")
    outside = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
