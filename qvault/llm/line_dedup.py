"""Line deduplication across documents, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qvault.llm.skew import join_split
from qvault.llm.text import ascii_lower, strip_blanks, wide_hash
from qvault.storage import materialize


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row (doc_id, text_hash, pos, line_hash) per line whose key has ``min_chars`` code points."""
    lines = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
    )
    keyed = lines.select("doc_id", "text_hash", "pos", ascii_lower(strip_blanks(F.col("line"))).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("doc_id", "text_hash", "pos", wide_hash(F.col("key")).alias("line_hash"))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(line_hash, keep_doc, n) of the lines that at least ``min_docs`` documents hold, in ``n`` places.

    For two documents the smallest and the largest id tell; any other number
    counts distinct pairs first. Both aggregate before they shuffle, so a line
    that a third of all documents hold costs one row per task.
    """
    if min_docs == 2:
        ends = lines.groupBy("line_hash").agg(F.min("doc_id").alias("keep_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
        return ends.where("keep_doc < last_doc").drop("last_doc")
    per_doc = lines.where("doc_id is not null").groupBy("line_hash", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("line_hash").agg(F.min("doc_id").alias("keep_doc"), F.count("*").alias("docs"), F.sum("c").alias("n")).where(F.col("docs") >= min_docs).drop("docs")


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines that many documents repeat; keep them in the document with the smallest doc_id.

    ``docs`` has doc_id and text, and may have other columns, which are left
    out. Returns doc_id, n_lines (before dropping), n_dropped and kept_text.

    Lines are split at ``\\n``. Line keys are stripped of blanks and lower-cased
    in A-Z. Only hashes of lines and positions are shuffled by line; the texts
    move once, to meet their positions. The lines that are repeated are a
    table, whose counts tell which of them to join in parts.

    Null texts count as empty: one empty line. Rows with a null doc_id keep all
    lines and count as no document. Rows that repeat a doc_id are treated alike:
    rows of one document count once. An empty table gives an empty table.
    """
    lines = document_lines(docs, min_chars)
    repeated, _ = materialize(repeated_lines(lines, min_docs), "repeated")
    dropped = (
        join_split(lines, repeated, "line_hash", n="n", by=["doc_id", "pos"])
        .where(F.col("doc_id") != F.col("keep_doc"))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    )
    text = F.coalesce("text", F.lit(""))
    joined = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).join(dropped, ["doc_id", "text_hash"], "left")
    split = joined.select("doc_id", "text", F.split("text", "\n").alias("lines"), "dropped")
    # The kept lines are the runs between dropped positions; each run is one slice, so long documents take linear time.
    ends = split.withColumn("ends", F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.size("lines"))))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.slice("lines", F.get("ends", i - 1) + 2, F.get("ends", i) - F.get("ends", i - 1) - 1)))
    return ends.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(runs, "\n")).alias("kept_text"),
    )
