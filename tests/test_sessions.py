"""Sessions over a stream against a plain fold, under replays and restarts."""

import json
import os
import random

import pytest

from qvault.streaming import sessions as se


def requests(n=120, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = "start" if i < 3 else rnd.choices(["events", "stop", "start", "odd"], [30, 1, 1, 1])[0]
        calls = [f"c{rnd.randrange(25)}" for _ in range(rnd.randrange(1, 9))] if kind == "events" else None
        rows.append({"run_id": i % 4, "request_id": i, "kind": kind, "ts": f"2024-01-01T00:{i % 60:02d}:{i // 60:02d}", "calls": calls, "counts": [rnd.randrange(1, 9) for _ in calls] if calls else None})
    return rows


def plain(rows, max_batch, max_distinct, max_total):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: r["request_id"]):
        s = state.setdefault(r["run_id"], {"status": "ready", "seen": {}, "total": 0})
        calls, counts = r["calls"] or [], r["counts"] or []
        if r["kind"] == "start":
            reason = None if s["status"] == "ready" else "not ready"
        elif r["kind"] == "stop":
            reason = None
        elif r["kind"] != "events":
            reason = "kind unknown"
        elif len(calls) > max_batch:
            reason = "batch too large"
        elif s["status"] != "recording":
            reason = "not recording"
        elif s["total"] + sum(counts) > max_total:
            reason = "event limit"
        else:
            reason = "aggregate limit" if len(s["seen"]) + len(set(calls)) > max_distinct else None
        if reason is None:
            s["status"] = {"start": "recording", "stop": "stopped"}.get(r["kind"], s["status"])
            for c, n in zip(calls, counts, strict=True):
                s["seen"][c] = s["seen"].get(c, 0) + n
            s["total"] += sum(counts)
        out[r["request_id"]] = (reason, s["total"], len(s["seen"]))
    return out, {(k, c): n for k, s in state.items() for c, n in s["seen"].items()}


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    se.use_state_store(spark)
    yield spark
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


LIMITS = {"max_batch": 7, "max_distinct": 20, "max_total": 150}


def record(spark, folder, out, **limits):
    stream = spark.readStream.schema(se.REQUEST).option("maxFilesPerTrigger", 1).json(str(folder))
    q = se.record_sessions(stream, str(out), str(out) + "-state", **limits)
    q.awaitTermination(180)
    assert q.exception() is None
    found = {r["request_id"]: (r["reason"], r["total"], r["distinct_events"]) for name in ("accepted", "rejected") for r in se.session_table(spark, str(out), name).collect()}
    return found, {(r["run_id"], r["call"]): r["count"] for r in se.session_table(spark, str(out), "counts").collect()}


def test_sessions_equal_a_fold_after_restarts(store, tmp_path):
    rows = requests()
    want, counts = plain(rows, **LIMITS)
    assert {r for r, _, _ in want.values()} == {None, "not ready", "kind unknown", "batch too large", "not recording", "event limit", "aggregate limit"}
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):  # each part is another start of the query, over state that the last one left
        (folder / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part * 40 : part * 40 + 40]))
        got = record(store, folder, tmp_path / "out", **LIMITS)
    assert got == (want, counts)
    assert record(store, folder, tmp_path / "again", **LIMITS) == (want, counts)  # a replay of all


def test_idle_sessions_stop(store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda i, run, kind, minute: {"run_id": run, "request_id": i, "kind": kind, "ts": f"2024-01-01T0{minute // 60}:{minute % 60:02d}:00", "calls": ["a"] if kind == "events" else None, "counts": [1] if kind == "events" else None}
    for i, r in enumerate([[at(0, 1, "start", 0), at(1, 1, "events", 1)], [at(2, 2, "start", 100)], [at(3, 2, "events", 101)], [at(4, 1, "events", 102)]]):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, r)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read by their time
    stream = store.readStream.schema(se.REQUEST).option("maxFilesPerTrigger", 1).json(str(folder))
    q = se.record_sessions(stream, str(tmp_path / "out"), str(tmp_path / "state"), idle=600)
    q.awaitTermination(180)
    assert q.exception() is None
    assert [(r["run_id"], r["total"]) for r in se.session_table(store, str(tmp_path / "out"), "accepted").where("kind = 'idle'").collect()] == [(1, 1)]
    assert [(r["request_id"], r["reason"]) for r in se.session_table(store, str(tmp_path / "out"), "rejected").collect()] == [(4, "not recording")]


def test_state_is_read_and_written_once_a_trigger():
    """However many calls a run has; and a call seen no times counts once."""
    from pyspark.sql import Row

    class State:
        def __init__(self):
            self.value, self.messages = None, 0

        def get(self):
            self.messages += 1
            return self.value

        def update(self, value):
            self.messages += 1
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return state

    state, session = State(), se.Session(max_distinct=30)
    session.init(Handle())
    row = lambda i, kind, calls=(): Row(run_id=1, request_id=i, kind=kind, ts=None, calls=list(calls), counts=[0] * len(calls))
    first = [row(0, "start"), *(row(i, "events", [f"c{i % 20}"]) for i in range(1, 60))]
    second = [row(i, "events", [f"c{i % 25}", "last"]) for i in range(60, 120)]
    out = [r for part in (first, second) for r in session.handleInputRows((1,), iter(part[::-1]), None)]
    assert state.messages == 4
    assert all(r.accepted for r in out) and [r.request_id for r in out] == list(range(120))
    assert out[59].distinct_events == 20 and out[-1].distinct_events == 26 and out[-1].total == 0
