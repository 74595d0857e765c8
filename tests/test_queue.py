"""The job queue, replayed as a stream with repeated, unordered and late events."""

import datetime as dt
from collections import Counter

import pytest

from lodestar.streaming.queue import Settings, queue_actions

SCHEMA = "tenant_id long, event_id string, ts timestamp, kind string, job_id string, doc_id string, worker string"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def replayed(spark, tmp_path, batches, settings):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = []
        for k, batch in enumerate(batches):  # one file after the other, the stream stopping in between
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            q = queue_actions(s, settings, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        for r in spark.read.parquet(str(tmp_path / "out")).collect():
            rows.append((r["tenant_id"], r["job_id"], r["worker"], r["action"], int((r["at"] - at(0)).total_seconds())))
        return sorted(rows, key=lambda r: (r[0], r[4], r[3], r[1]))
    finally:
        spark.conf.set(key, old)


def test_each_job_once_through_duplicates_leases_and_retries(spark, tmp_path):
    ev = lambda i, t, kind, job=None, worker=None, doc=None, tenant=1: (tenant, f"e{i}", at(t), kind, job, doc, worker)
    first = [ev(1, 1, "enqueue", "a", doc="d1"), ev(2, 2, "enqueue", "b", doc="d1"), ev(3, 3, "enqueue", "c", doc="d2"), ev(3, 3, "enqueue", "c", doc="d2"), ev(4, 4, "enqueue", "a", doc="d1")]
    second = [ev(6, 10, "ask", worker="w2"), ev(5, 10, "ask", worker="w1"), ev(7, 11, "ask", worker="w3"), ev(5, 10, "ask", worker="w1"), ev(20, 10, "enqueue", "z", tenant=2), ev(21, 12, "ask", worker="w9", tenant=2)]
    third = [ev(8, 20, "done", "a", "w1"), ev(9, 21, "done", "c", "w1"), ev(10, 22, "ask", worker="w1"), ev(11, 23, "failed", "b", "w1")]
    fourth = [ev(12, 24, "ask", worker="w1"), ev(13, 300, "beat", "b", "w1")]  # w2's lease on c is over at 110, w1's on b at 124
    fifth = [ev(14, 400, "ask", worker="w4"), ev(15, 401, "done", "b", "w1")]
    got = replayed(spark, tmp_path, [first, second, third, fourth, fifth], Settings(slots=2, lease=100))
    one = [(j, w, a, t) for n, j, w, a, t in got if n == 1]
    assert ("a", "w1", "claimed", 10) in one and ("c", "w2", "claimed", 10) in one  # b's document is busy
    assert ("", "w3", "idle", 11) in one and ("c", "w1", "refused", 21) in one
    assert ("a", "w1", "completed", 20) in one and ("b", "w1", "claimed", 22) in one and ("b", "w1", "retry", 23) in one
    assert ("b", "w1", "claimed", 24) in one and ("c", "w2", "requeued", 110) in one and ("b", "w1", "requeued", 124) in one
    assert ("b", "w1", "refused", 300) in one  # a beat after the lease
    assert ("b", "w4", "claimed", 400) in one and ("b", "w1", "refused", 401) in one
    assert Counter(j for j, _, a, _ in one if a == "enqueued") == {"a": 1, "b": 1, "c": 1}
    assert ("z", "w9", "claimed", 12) in [(j, w, a, t) for n, j, w, a, t in got if n == 2]
    # never two holders of a job at once
    held = {}
    for j, w, a, t in sorted(one, key=lambda r: (r[3], r[2] == "claimed")):
        if a == "claimed":
            assert j not in held
            held[j] = w
        elif a in ("completed", "retry", "requeued", "dead_letter"):
            held.pop(j, None)


def test_dead_letters_and_intervals(spark, tmp_path):
    ev = lambda i, t, kind, job=None, worker=None: (1, f"e{i:03}", at(t), kind, job, None, worker)
    batch = [ev(0, 1, "enqueue", "a")]
    for k in range(4):
        batch += [ev(2 * k + 1, 10 + 2 * k, "ask", worker="w"), ev(2 * k + 2, 11 + 2 * k, "failed", "a", "w")]
    got = replayed(spark, tmp_path, [batch, [ev(50, 100, "enqueue", "n")], [ev(51, 500, "ask", worker="w")]], Settings(interval=60))
    assert [a for _, j, _, a, _ in got if j == "a"] == ["enqueued", "claimed", "retry", "claimed", "retry", "claimed", "dead_letter", "refused"]
    made = [t for _, j, _, a, t in got if j.startswith("scheduled:") and a == "enqueued"]
    assert made == [60]  # the next one waits until it is done
    assert [j for _, j, _, a, t in got if a == "claimed" and t == 500][0].startswith("scheduled:")
