"""Integrity: Merkle commitments, inclusion proofs, anchors, hash chains, drift against a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.operators.running import running_totals
from qvault.storage import materialize


def canonical_json(*columns: str) -> Column:
    """A row as JSON with sorted keys, no blanks and nulls written out."""
    return F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def hash_pair(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.least(a, b), F.greatest(a, b)), 256)


#: Leaves of a tree that one task numbers; larger trees are numbered by ranges.
LARGE_TREE = 1 << 16


def number_leaves(rows: DataFrame, tree: str, order: Sequence[str], digest: Column) -> DataFrame:
    """(tree, idx, hash, n): a leaf per row, numbered per tree by ``order``, which must tell the rows of a tree apart.

    Trees of up to ``LARGE_TREE`` leaves are numbered where their rows meet,
    which also deals them for the grouping of their levels. The others, of
    which there are few, get their numbers from sums of ranges, so that one
    tree may hold the whole table.
    """
    at = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select(F.col(tree).alias("tree"), *[F.col(c).alias(o) for c, o in zip(order, at, strict=True)], digest.alias("hash"))
    large, _ = materialize(keyed.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_TREE), "large-trees")
    some = not large.isEmpty()
    few = keyed.join(F.broadcast(large), "tree", "left_anti") if some else keyed
    whole = Window.partitionBy("tree")
    numbered = few.select("tree", (F.row_number().over(whole.orderBy(*at)) - 1).cast("long").alias("idx"), "hash", F.count("*").over(whole).alias("n"))
    if not some:
        return numbered
    ranged = running_totals(keyed.join(F.broadcast(large), "tree"), ["tree"], at, {"idx": F.lit(1).cast("long")})
    return numbered.unionByName(ranged.select("tree", F.col("idx").cast("long").alias("idx"), "hash", "n"))


def merkle_leaves(components: DataFrame, tree: str, order: Sequence[str], *columns: str) -> DataFrame:
    """(tree, idx, hash, n): the leaf of each component, the hash of its columns as canonical JSON."""
    return number_leaves(components, tree, order, F.sha2(canonical_json(*columns), 256))


def batch_leaves(roots: DataFrame, batch: Column) -> DataFrame:
    """The leaves of trees over trees: roots (tree, root) numbered by tree in each batch."""
    return number_leaves(roots.withColumn("_batch", batch), "_batch", ["tree"], F.col("root"))


#: Leaves of a block, as a power of two: what one row of a round holds.
BLOCK_LEVELS = 8


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _blocks(leaves: DataFrame) -> DataFrame:
    """(tree, block, n, hashes, depth): the nodes of each block in order, and how many levels they go up in it."""
    size = 1 << BLOCK_LEVELS
    nodes = F.array_sort(F.collect_list(F.struct("idx", "hash")))  # a block bounds it
    rows = leaves.groupBy("tree", F.floor(F.col("idx") / size).alias("block")).agg(F.max("n").alias("n"), nodes.alias("nodes"))
    depth = F.when(F.col("n") > size, BLOCK_LEVELS).otherwise(F.ceil(F.log2("n"))).cast("int")
    return rows.select("tree", "block", "n", F.col("nodes.hash").alias("hashes"), depth.alias("depth"))


def _above(level: Column) -> Column:
    """The nodes above those of a block's level; a lone node is paired with itself."""
    at = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(at, lambda i: hash_pair(F.get(level, 2 * i), F.get(level, F.least(2 * i + 1, F.size(level) - 1))))


def _steps(depth: Column) -> Column:
    return F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))


def _next_round(blocks: DataFrame, root: Column) -> DataFrame:
    """The blocks' roots as the leaves of trees 2 ** BLOCK_LEVELS times smaller."""
    return blocks.select("tree", F.col("block").alias("idx"), root.alias("hash"), F.ceil(F.col("n") / (1 << BLOCK_LEVELS)).alias("n"))


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """(tree, root): blocks of 256 leaves are folded at once, then blocks of their roots, until every tree is one node.

    Trees of any size may stand side by side: a round takes one grouping, and
    divides the rows of large trees by 256. A tree of one node is its root.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 1
    while True:
        leaves = _next_round(blocks := _blocks(leaves), F.get(F.aggregate(_steps(F.col("depth")), F.col("hashes"), lambda level, _: _above(level)), F.lit(0)))
        largest = -(-largest // (1 << BLOCK_LEVELS))
        if largest <= 1:
            return leaves.select("tree", F.col("hash").alias("root"))


def merkle_proofs(leaves: DataFrame) -> DataFrame:
    """Per leaf (tree, idx) its hash, root, and the siblings on the way up, from the bottom.

    A block's row gives the lower part of its leaves' proofs; the rest is the
    proof of the block's root among those of its tree, which blocks get by one
    join before their leaves are listed.
    """
    if (leaves.agg(F.max("n")).first()[0] or 1) > 1 << BLOCK_LEVELS:
        levels = _levels(_blocks(leaves))
        levels, _ = materialize(levels, "merkle")
        upper = merkle_proofs(_next_round(levels, F.get(F.element_at("levels", -1), F.lit(0))))
        placed = levels.join(upper.select("tree", F.col("idx").alias("block"), F.col("proof").alias("upper"), "root"), ["tree", "block"])
    else:
        placed = _levels(_blocks(leaves)).withColumns({"upper": F.array().cast("array<string>"), "root": F.get(F.element_at("levels", -1), F.lit(0))})

    def sibling(level: Column, at: Column) -> Column:
        return F.get(level, F.least(at.bitwiseXOR(F.lit(1)), F.size(level) - 1))

    def listed(levels: Column) -> Column:
        place = F.sequence(F.lit(0), F.size(F.get(levels, F.lit(0))) - 1)
        below = lambda i: F.transform(F.slice(levels, 1, F.size(levels) - 1), lambda level, j: sibling(level, F.floor(i / F.pow(F.lit(2), j)).cast("int")))
        return F.transform(place, lambda i: F.struct(i.alias("i"), F.get(F.get(levels, F.lit(0)), i).alias("leaf"), below(i).alias("lower")))

    each = placed.select("tree", "block", "upper", "root", F.explode(listed(F.col("levels"))).alias("x"))
    return each.select("tree", (F.col("block") * (1 << BLOCK_LEVELS) + F.col("x.i")).alias("idx"), F.col("x.leaf").alias("leaf"), F.concat("x.lower", "upper").alias("proof"), "root")


def _levels(blocks: DataFrame) -> DataFrame:
    """Blocks with all their levels, the leaves first."""
    up = lambda levels, _: F.concat(levels, F.array(_let(F.element_at(levels, -1), _above)))
    return blocks.select("tree", "block", "n", F.aggregate(_steps(F.col("depth")), F.array("hashes"), up).alias("levels"))


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    return F.aggregate(proof, leaf, hash_pair) == root


def verify_batch(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """Claims (tree, root) against anchored roots: valid, mismatch or not anchored."""
    joined = claims.join(anchors.select("tree", F.col("root").alias("_anchored")), "tree", "left")
    reason = F.when(F.col("_anchored").isNull(), "not anchored").when(F.col("_anchored") != F.col("root"), "root mismatch")
    return joined.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_anchored")


def verify_batch_proofs(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """Claims (batch, leaf, proof) of members of a batch against the batch's anchored root (batch, root): the proof must lead there."""
    joined = claims.join(anchors.select("batch", F.col("root").alias("_anchored")), "batch", "left")
    reason = F.when(F.col("_anchored").isNull(), "not anchored").when(~verify_proof(F.col("leaf"), F.col("proof"), F.col("_anchored")), "proof invalid")
    return joined.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_anchored")


def first_anchor(anchors: DataFrame, key: str, order: Sequence) -> DataFrame:
    """The first anchor per key counts; later ones are marked rejected."""
    return anchors.withColumn("accepted", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def verify_audit_chain(entries: DataFrame, recomputed: Column) -> DataFrame:
    """Entries (entry_hash, previous_hash) with what is wrong: tampered content, a missing predecessor, a fork.

    Links are checked by joining hashes, so no order over the whole log is needed.
    """
    known = entries.select(F.col("entry_hash").alias("previous_hash")).distinct().withColumn("_known", F.lit(True))
    forks = entries.where("previous_hash is not null").groupBy("previous_hash").agg(F.count("*").alias("_followers"))
    joined = entries.join(known, "previous_hash", "left").join(forks, "previous_hash", "left")
    problem = F.when(recomputed != F.col("entry_hash"), "tampered").when(F.col("previous_hash").isNotNull() & F.col("_known").isNull(), "orphan").when(F.col("_followers") > 1, "fork")
    return joined.withColumn("problem", problem).drop("_known", "_followers")


def manifest_drift(original: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Files side by side: ADDED, DELETED, MODIFIED or UNCHANGED; an unknown hash counts as unchanged."""
    a, b = original.alias("a"), current.alias("b")
    status = F.when(F.col(f"a.{key}").isNull(), "ADDED").when(F.col(f"b.{key}").isNull(), "DELETED").when(F.col("a.sha256") != F.col("b.sha256"), "MODIFIED").otherwise("UNCHANGED")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"))


def verify_packages(packages: DataFrame, roots: DataFrame) -> DataFrame:
    """Packages (package_id, content, content_sha256, root) with the checks that fail."""
    joined = packages.join(roots.select(F.col("tree").alias("package_id"), F.col("root").alias("_root")), "package_id", "left")
    errors = F.array_compact(F.array(F.when(F.sha2("content", 256) != F.col("content_sha256"), "content hash"), F.when(F.col("_root").isNull(), "no components").when(F.col("_root") != F.col("root"), "merkle root")))
    return joined.withColumn("errors", F.array_join(errors, ",")).withColumn("valid", F.col("errors") == "").drop("_root")


def verify_signed_packages(packages: DataFrame, proofs: DataFrame, statements: DataFrame, statement_type: str, predicate_type: str) -> DataFrame:
    """Each package with every check at once, apart from signatures: what it says of itself, its components' proofs, and the statement about it.

    ``packages`` has package_id, components (an array of JSON), content_hash
    and merkle_root; ``proofs`` package_id, leaf and proof, a row per component,
    which are nested into packages and folded there; ``statements`` package_id,
    type, predicate_type, subject_name, subject_sha256, has_summary and
    n_fingerprints (null if it lists none). Returns package_id, valid, n_proofs,
    bad_proofs and errors, in the order of the checks. A package without
    components is a tree of its content alone.
    """
    rows = packages.select("package_id", F.posexplode("components").alias("at", "component"))
    leaves = number_leaves(rows, "package_id", ["at"], F.sha2("component", 256))
    roots = merkle_roots(leaves).select(F.col("tree").alias("package_id"), F.col("root").alias("_root"))
    folded = proofs.join(packages.select("package_id", "merkle_root"), "package_id").withColumn("_ok", F.coalesce(verify_proof(F.col("leaf"), F.col("proof"), F.col("merkle_root")), F.lit(False)))
    checked = folded.groupBy("package_id").agg(F.count("*").alias("n_proofs"), F.count_if(~F.col("_ok")).alias("bad_proofs"))
    content = F.sha2(F.concat(F.lit("["), F.array_join("components", ","), F.lit("]")), 256)
    joined = packages.withColumn("_content", content).join(roots, "package_id", "left").join(checked, "package_id", "left").join(statements.withColumn("_stated", F.lit(True)), "package_id", "left")
    stated = F.col("_stated").isNotNull()
    odd = lambda c: ~F.coalesce(c, F.lit(False))
    errors = F.array_compact(
        F.array(
            F.when(odd(F.col("_content") == F.col("content_hash")), "content hash"),
            F.when(odd(F.coalesce("_root", "_content") == F.col("merkle_root")), "merkle root"),
            F.when(F.coalesce("bad_proofs", F.lit(0)) > 0, "component proof"),
            F.when(F.coalesce("n_proofs", F.lit(0)) != F.size("components"), "proofs missing"),
            F.when(~stated, "no statement"),
            F.when(stated & odd(F.lower("subject_sha256") == F.lower("content_hash")), "subject digest"),
            F.when(stated & odd(F.length("subject_name") > 0), "subject name"),
            F.when(stated & odd((F.col("type") == statement_type) & (F.col("predicate_type") == predicate_type) & F.col("has_summary") & F.col("n_fingerprints").isNotNull()), "predicate"),
        )
    )
    return joined.select("package_id", (F.size(errors) == 0).alias("valid"), F.coalesce("n_proofs", F.lit(0)).cast("long").alias("n_proofs"), F.coalesce("bad_proofs", F.lit(0)).cast("long").alias("bad_proofs"), F.array_join(errors, ",").alias("errors"))


def attestation_summary(assets: DataFrame, key: str) -> DataFrame:
    """Per subject: components, vulnerable and compliant ones, and one fingerprint over theirs."""
    return assets.groupBy(key).agg(F.count_distinct("fingerprint").alias("components"), F.count_if("vulnerable").alias("vulnerable"), F.count_if(~F.col("vulnerable")).alias("compliant"), F.sha2(F.array_join(F.array_sort(F.collect_set("fingerprint")), ","), 256).alias("digest"))
