"""Streaming twins of the runtime operators: the same functions over readStream tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from qvault.operators.runtime import match_events, session_gate, validate_events


def read_event_stream(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 100) -> DataFrame:
    """New JSON lines files under ``path`` as a stream; lines that can't be parsed have null fields and are rejected later."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", max_files).json(path)


def accepted(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Valid events of recording sessions: a stream joined with a static table."""
    return session_gate(validate_events(events).where("reject_reason is null"), sessions).where("accepted")


def running_counts(events: DataFrame, identity: Sequence[str], late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts per identity and window of event time; state goes once the watermark has passed a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), *identity).agg(F.sum("count").alias("count"))


def sessions_by_gap(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Progress of each run in sessions of event time that end after a gap."""
    return events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap)).agg(F.sum("count").alias("total"))


def once_each(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of ``key`` inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_counts(events: DataFrame, identity: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Aggregates by identity kept as a table of per-batch sums, which readers add up; a batch that runs again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy(*identity).agg(F.sum("count").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        sums.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str, identity: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*identity).agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def match_stream(events: DataFrame, findings: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()) -> StreamingQuery:
    """Each batch matched to the findings (of the same ``keys``), by the batch function."""

    def write(batch: DataFrame, epoch: int) -> None:
        match_events(batch, findings, keys=keys).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
