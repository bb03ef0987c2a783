"""Recording sessions as state of a stream: each run accepts requests of events while it records and its limits hold.

State is kept per run, in one row: its status, totals, and the distinct calls it
has seen, which its limit bounds. A trigger reads that row once and writes it
once for all requests of the run: each access is a message to Spark.
Every request comes out once with the decision on it, so what was refused is a
table of its own. The state and the decisions survive restarts by the query's
checkpoint, and a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that such state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Events of one request, distinct calls of one run, and times that a run's calls were seen.
MAX_BATCH, MAX_DISTINCT, MAX_TOTAL = 100, 10_000, 1_000_000_000
REQUEST = "run_id long, request_id long, kind string, ts timestamp, calls array<string>, counts array<long>"
DECISION = "run_id long, request_id long, kind string, accepted boolean, reason string, total long, distinct_events long, last_event timestamp, calls array<string>, counts array<long>"


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _micros(at: datetime) -> int:
    """Microseconds since 1970; a time without a zone is local."""
    return (at.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


def _moment(micros: int | None) -> datetime | None:
    return None if micros is None else EPOCH + timedelta(microseconds=micros)


class Session(StatefulProcessor):
    """Decides on the requests of a run in their order: ``start``, ``events`` and ``stop``.

    With ``idle`` seconds, a run that the watermark has left behind by so much
    since its last request is stopped by a timer.
    """

    def __init__(self, max_batch: int = MAX_BATCH, max_distinct: int = MAX_DISTINCT, max_total: int = MAX_TOTAL, idle: int | None = None):
        self.max_batch, self.max_distinct, self.max_total, self.idle = max_batch, max_distinct, max_total, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, total long, last_event long, calls array<string>")

    def _refusal(self, status: str, kind: str, calls: list, total: int, distinct: int, increment: int) -> str | None:
        if kind not in ("start", "events", "stop"):
            return "kind unknown"
        if kind != "events":
            return "not ready" if kind == "start" and status != "ready" else None
        if len(calls) > self.max_batch:
            return "batch too large"
        if status != "recording":
            return "not recording"
        if total + increment > self.max_total:
            return "event limit"
        return "aggregate limit" if distinct + len(set(calls)) > self.max_distinct else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        requests = sorted(rows, key=lambda r: (r.request_id is None, r.request_id or 0))  # what one trigger holds of one run
        status, total, last, held = self.run.get() or ("ready", 0, None, [])
        seen = dict.fromkeys(held)  # in the order of their first requests
        out = []
        for r in requests:
            calls, counts = r.calls or [], r.counts or []
            reason = self._refusal(status, r.kind, calls, total, len(seen), sum(counts))
            if reason is None and r.kind == "events":
                seen.update(dict.fromkeys(calls))
                total += sum(counts)
                last = last if r.ts is None else _micros(r.ts)
            elif reason is None:
                status = {"start": "recording", "stop": "stopped"}[r.kind]
            out.append(Row(run_id=key[0], request_id=r.request_id, kind=r.kind, accepted=reason is None, reason=reason, total=total, distinct_events=len(seen), last_event=_moment(last), calls=calls, counts=counts))
        self.run.update((status, total, last, list(seen)))
        times = [_micros(r.ts) for r in requests if r.ts is not None]
        if self.idle is not None and status == "recording" and times:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(max(times) // 1000 + self.idle * 1000)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, total, last, held = self.run.get()
        if status == "recording":
            self.run.update(("stopped", total, last, held))
            yield Row(run_id=key[0], request_id=None, kind="idle", accepted=True, reason=None, total=total, distinct_events=len(held), last_event=_moment(last), calls=[], counts=[])

    def close(self) -> None:
        pass


def decisions(requests: DataFrame, *, max_batch: int = MAX_BATCH, max_distinct: int = MAX_DISTINCT, max_total: int = MAX_TOTAL, idle: int | None = None, late: str = "10 minutes") -> DataFrame:
    """The decision on each request (see REQUEST) of a stream: accepted or the reason why not, with the run's totals so far."""
    held = requests.withWatermark("ts", late) if idle is not None else requests
    return held.groupBy("run_id").transformWithState(Session(max_batch, max_distinct, max_total, idle), outputStructType=DECISION, outputMode="Append", timeMode="EventTime" if idle is not None else "None")


def record_sessions(requests: DataFrame, path: str, checkpoint: str, **limits) -> StreamingQuery:
    """Decides on a stream of requests and keeps three tables under ``path``: accepted and rejected decisions, and counts of the calls accepted, by batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        columns = [c for c in batch.columns if c not in ("calls", "counts")]
        batch.where("accepted").select(columns).write.mode("overwrite").parquet(f"{path}/accepted/epoch={epoch}")
        batch.where("not accepted").select(columns).write.mode("overwrite").parquet(f"{path}/rejected/epoch={epoch}")
        calls = batch.where("accepted and kind = 'events'").select("run_id", F.explode(F.arrays_zip("calls", "counts")).alias("c"))
        sums = calls.groupBy("run_id", F.col("c.calls").alias("call")).agg(F.sum("c.counts").alias("count"))
        sums.write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")
        batch.unpersist()

    return decisions(requests, **limits).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def use_state_store(spark: SparkSession) -> None:
    """Sets the session's state store to the one that such state needs; queries started before keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def session_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the tables of ``record_sessions``: accepted, rejected, or the counts of all batches added up."""
    table = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").drop("epoch")
    return table.groupBy("run_id", "call").agg(F.sum("count").alias("count")) if name == "counts" else table
