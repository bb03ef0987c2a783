"""Binary files as a source: bytes in chunks, and the printable strings in them, joined where a chunk's end cuts one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qvault.functions.text import shannon_entropy
from qvault.operators import rules

#: Bytes of a chunk, and of the largest file that is searched: larger ones are reported as such.
CHUNK, LIMIT = 1 << 20, 50 << 20


def read_binaries(spark: SparkSession, path: str, *, glob: str = "*", limit: int | None = LIMIT) -> DataFrame:
    """(file, size, content) of the files of a tree; content is null, and not read, where a file is larger than ``limit`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    named = files.select(F.col("path").alias("file"), F.col("length").alias("size"), "content")
    if limit is None:
        return named
    # The bound reaches the scan, which then doesn't open larger files.
    return named.where(F.col("size") <= limit).unionByName(named.where(F.col("size") > limit).select("file", "size", F.lit(None).cast("binary").alias("content")))


def byte_chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """(file, at, bytes): the content of each file in chunks of ``size`` bytes, numbered from 0."""
    n = F.ceil(F.length("content") / size).cast("int")
    places = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    # The content is bound once, as the element of a list: read as a column, it would be copied whole for each chunk.
    cut = F.transform(F.array("content"), lambda c: F.transform(places, lambda i: F.substring(c, i * size + 1, F.lit(size))))[0]
    return files.where(F.length("content") > 0).select("file", F.posexplode(cut).alias("at", "bytes"))


def printable_strings(files: DataFrame, *, chunk: int = CHUNK, shortest: int = 6) -> DataFrame:
    """(file, at, place, text): runs of printable characters of ``shortest`` or more, in their order by chunk and place in it.

    A run that a chunk's end cuts goes on in the next chunk. Only runs at the
    ends of chunks are joined, two a chunk, so what a file's window holds is
    short; a run over many chunks is put together once.
    """
    character = rules.PRINTABLE.replace("{6,}", "")
    text = F.decode("bytes", "ISO-8859-1")
    runs = byte_chunks(files, chunk).select("file", "at", text.alias("text")).select("file", "at", F.regexp_extract_all("text", F.lit(character + "+"), F.lit(0)).alias("runs"), F.col("text").rlike("^" + character).alias("begins"), F.col("text").rlike(character + r"\z").alias("ends"))
    of = runs.withColumn("of", F.size("runs"))
    told = F.transform("runs", lambda t, i: F.struct(i.alias("place"), t.alias("text"), (F.col("begins") & (i == 0)).alias("first"), (F.col("ends") & (i == F.col("of") - 1)).alias("last")))
    # Short runs inside a chunk are no strings, and go before they become rows.
    some = F.filter(told, lambda r: r["first"] | r["last"] | (F.length(r["text"]) >= shortest))
    placed = of.select("file", "at", F.explode(some).alias("r")).select("file", "at", "r.*")
    whole = placed.where(~(F.col("first") | F.col("last"))).select("file", "at", "place", "text")
    order = Window.partitionBy("file").orderBy("at", "place")
    goes_on = F.col("first") & F.coalesce(F.lag("last").over(order) & (F.lag("at").over(order) == F.col("at") - 1), F.lit(False))
    edges = placed.where("first or last").withColumn("goes_on", goes_on)
    numbered = edges.withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct("at", "text")))
    joined = numbered.groupBy("file", "run").agg(listed.alias("p"), F.min(F.struct("at", "place")).alias("f")).select("file", "f.at", "f.place", F.array_join(F.col("p.text"), "").alias("text"))
    return whole.unionByName(joined).where(F.length("text") >= shortest)


def binary_signatures(files: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Findings of binary files: file, rule_id, severity, evidence and line, the number of the string.

    Names of libraries and of weak symbols count once a file and rule, strings
    of high entropy once for each beginning of eight characters, each where it
    comes first. Files whose content is null are reported by their size.
    """
    numbered = printable_strings(files, chunk=chunk).withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at", "place")).cast("long"))
    hit = lambda r: F.when(F.col("text").rlike(r[2]), F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("severity"), F.lit(None).cast("string").alias("evidence")))
    dense = (F.length("text") >= rules.BINARY_LENGTH) & ~F.col("text").rlike(r"^(http|/|\\)")
    secret = F.when(dense & (shannon_entropy(F.when(dense, F.col("text"))) >= rules.BINARY_ENTROPY), F.struct(F.lit("binary-high-entropy-secret").alias("rule_id"), F.lit("High").alias("severity"), F.substring("text", 1, 8).alias("evidence")))
    hits = numbered.select("file", "line", F.explode(F.array_compact(F.array(secret, *map(hit, rules.BINARY_NAMES)))).alias("hit"))
    found = hits.groupBy("file", "hit.rule_id", "hit.severity", "hit.evidence").agg(F.min("line").alias("line"))
    large = files.where("content is null").select("file", F.lit("binary-size-exceeded").alias("rule_id"), F.lit("Informational").alias("severity"), F.concat(F.lit("File size: "), F.col("size").cast("string"), F.lit(" bytes")).alias("evidence"), F.lit(1).cast("long").alias("line"))
    return found.unionByName(large)
