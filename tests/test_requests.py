"""Idempotent requests: the table and the stream tell the same story, also after a restart and with late rows."""

import datetime

import pytest

from orebed.streaming import requests

SCHEMA = "id long, caller string, k string, kind string, request string, response string, ts timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


ROWS = [
    (1, "a", "k1", "begin", "ask", None, at(0)),
    (2, "a", "k1", "begin", "ask", None, at(1)),
    (3, "a", "k1", "begin", "other", None, at(2)),
    (4, "a", "k1", "complete", "other", "no", at(3)),
    (5, "a", "k1", "complete", "ask", "done", at(4)),
    (6, "a", "k1", "begin", "ask", None, at(5)),
    (7, "a", "k1", "release", "ask", None, at(6)),
    (8, "b", "k1", "begin", "ask", None, at(6)),
    (9, "b", "k1", "release", "ask", None, at(7)),
    (10, "b", "k1", "begin", "new", None, at(8)),
    (11, "a", "k1", "begin", "other", None, at(64)),
    (12, "a", "k1", "begin", "other", None, at(65)),
    (13, "b", "k1", "complete", "new", "x", at(90)),
]
WANT = {1: "started", 2: "in_progress", 3: "conflict", 4: "lost", 5: "stored", 6: "completed", 7: "lost", 8: "started", 9: "released", 10: "started", 11: "conflict", 12: "started", 13: "lost"}


def test_outcomes_of_a_table(spark):
    odd = [(20, None, "k1", "begin", "ask", None, at(1)), (21, "a", "k2", "other", "ask", None, at(1)), (22, "a", "k2", "begin", None, None, None), (23, "c", "k", "begin", None, None, at(1)), (24, "c", "k", "begin", None, None, at(1))]
    df = spark.createDataFrame(ROWS + odd, SCHEMA).repartition(3)
    got = {r.id: (r.outcome, r.replayed) for r in requests.request_outcomes(df, ["caller", "k"], "kind", "request", "response", "ts", "id", 3600).collect()}
    assert got == {**{i: (o, "done" if i == 6 else None) for i, o in WANT.items()}, 20: ("invalid", None), 21: ("invalid", None), 22: ("invalid", None), 23: ("started", None), 24: ("in_progress", None)}
    assert requests.request_outcomes(df.limit(0), ["caller", "k"], "kind", "request", "response", "ts", "id", 3600).count() == 0


@pytest.fixture
def rocks(spark):
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_stream_with_restart_and_late_rows(spark, rocks, tmp_path):
    def land(number, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = requests.request_stream(s, ["caller", "k"], "kind", "request", "response", "ts", "30 minutes", 3600)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start(f"{tmp_path}/out")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        return {(r.caller, r.at // 60_000_000 - int(at(0).timestamp()) // 60): (r.outcome, r.replayed) for r in rows}

    want = {(r[1], (r[6] - at(0)).seconds // 60): (WANT[r[0]], "done" if r[0] == 6 else None) for r in ROWS}
    land(0, ROWS[:5])
    first = run()
    assert first == {k: want[k] for k in first} and len(first) == 5
    land(1, ROWS[5:12])
    assert run() == {k: v for k, v in want.items() if k != ("b", 90)}  # a new run goes on from the stored claims
    land(2, [(30, "a", "k1", "begin", "ask", None, at(-40)), *ROWS[12:]])
    assert run() == want  # the late row has no outcome
