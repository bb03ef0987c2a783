"""Streams give what the batch operators give."""

import json

from pyspark.sql import functions as F

from qvault.operators import runtime
from qvault.streaming import events as st

SCHEMA = "event_id long, run_id long, ts timestamp, operation string, algorithm string, count long, host string, file string, line int"
IDENTITY = ["run_id", "operation", "algorithm"]


def write(folder, n=40):
    folder.mkdir()
    for part in range(2):
        with open(folder / f"{part}.json", "w") as f:
            for i in range(part * n, part * n + n):
                f.write(json.dumps({"event_id": i, "run_id": i % 3, "ts": f"2024-01-01T00:{i % 60:02d}:00", "operation": ["hash", "sign", "click"][i % 3], "algorithm": "sha256", "count": i % 4, "host": "h", "file": "a.py", "line": i}) + "\n")
            f.write("not json\n")


def test_upsert_equals_batch(spark, tmp_path):
    write(tmp_path / "in")
    stream = st.read_event_stream(spark, str(tmp_path / "in"), SCHEMA, max_files=1)
    sessions = spark.createDataFrame([(0, "recording", None), (1, "recording", None)], "run_id long, status string, stopped_at timestamp")
    ok = st.accepted(stream, sessions)
    st.upsert_counts(ok, IDENTITY, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {tuple(r) for r in st.read_counts(spark, str(tmp_path / "out"), IDENTITY).select(*IDENTITY, "count").collect()}
    batch = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    good = runtime.session_gate(runtime.validate_events(batch).where("reject_reason is null"), sessions).where("accepted")
    assert got == {tuple(r) for r in good.groupBy(*IDENTITY).agg(F.sum("count")).collect()} and got


def test_matches_of_a_stream(spark, tmp_path):
    write(tmp_path / "in")
    known = spark.createDataFrame([("f1", "src/a.py", "SHA-256", 10, 1)], "finding_id string, file string, algorithm string, line int, ordinal int")
    st.match_stream(st.read_event_stream(spark, str(tmp_path / "in"), SCHEMA).where("event_id is not null"), known, str(tmp_path / "m"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "m")).where("match_reason = 'exact_line'").count() == 1


def test_windows_and_sessions(spark, tmp_path):
    write(tmp_path / "in")
    events = st.read_event_stream(spark, str(tmp_path / "in"), SCHEMA).where("event_id is not null")
    for name, df in {"w": st.running_counts(events, ["run_id"]), "s": st.sessions_by_gap(events), "d": st.once_each(events, "event_id")}.items():
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.table("d").count() == 80
