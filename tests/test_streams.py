"""Streams whose batches come late, in pieces, and again after a restart."""

import datetime

import pytest

from lakeloom.streaming import counters

EVENTS = "event_id long, ts timestamp, user_id long, event_type string"
FIRST = datetime.datetime(2024, 1, 1, 12)


def rows(days):
    return [(100 * d + k, FIRST + datetime.timedelta(days=d, minutes=k), k % 2, "error" if k == 3 else "view") for d in days for k in range(5)]


def put(spark, folder, days):
    spark.createDataFrame(rows(days), EVENTS).coalesce(1).write.mode("append").parquet(folder)


def totals(frame):
    return {(r.user_id, r.day): (r.tasks, r.rejected) for r in frame.collect()}


def expected(days):
    out = {}
    for _, ts, user, kind in rows(days):
        key = (user, str((ts + datetime.timedelta(hours=8)).date()))
        n, bad = out.get(key, (0, 0))
        out[key] = (n + 1, bad + (kind == "error"))
    return out


def test_counters_lose_nothing_over_restarts_and_folding(spark, tmp_path):
    feed, path = f"{tmp_path}/feed", f"{tmp_path}/counters"
    done = []
    for days in ([40], [3], [41, 0], [3]):  # later batches are weeks late; a day comes in two batches
        put(spark, feed, days)
        done += days
        counters.drained(counters.stream_of(spark, feed), path, counters.increments)  # goes on where it stopped
        assert totals(counters.summed(counters.added(spark, path))) == expected(done)
        if len(done) == 4:
            counters.compacted(spark, path, counters.summed)
            assert totals(counters.summed(counters.added(spark, path))) == expected(done)
    counters.compacted(spark, path, counters.summed)
    counters.compacted(spark, path, counters.summed)  # nothing new: nothing changes
    assert totals(counters.added(spark, path)) == expected(done)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    path = f"{tmp_path}/counters"
    batch = spark.createDataFrame(rows([1]), EVENTS)
    for _ in range(2):
        counters.increments(batch).write.mode("overwrite").parquet(f"{path}/rows/batch=0")
    assert totals(counters.summed(counters.added(spark, path))) == expected([1])


def test_log_is_in_event_time(spark, tmp_path):
    feed, path = f"{tmp_path}/feed", f"{tmp_path}/log"
    for days in ([5], [2], [9], [2]):  # the last repeats events
        put(spark, feed, days)
    counters.drained(counters.stream_of(spark, feed).select("user_id", "event_id", "ts"), path)
    got = [(r.user_id, r.sequence, r.event_id) for r in counters.log_of(counters.added(spark, path)).orderBy("user_id", "sequence").collect()]
    want = []
    for user in (0, 1):
        mine = sorted((ts, i) for i, ts, u, _ in rows([2, 5, 9]) if u == user)
        want += [(user, n + 1, i) for n, (_, i) in enumerate(mine)]
    assert got == want


@pytest.mark.parametrize(("at", "clock", "status"), [(None, 5, "queued"), (None, 7, "canceled"), (5, 7, "running"), (6, 7, "canceled"), (8, 9, "canceled")])
def test_expiry_is_guarded(spark, at, clock, status):
    hour = lambda h: FIRST + datetime.timedelta(hours=h)
    tasks = spark.createDataFrame([(1, hour(6))], "task long, deadline timestamp")
    starts = spark.createDataFrame([(1, hour(at))] if at is not None else [], "task long, at timestamp")
    from pyspark.sql import functions as F

    assert [r.status for r in counters.expired(tasks, starts, F.lit(hour(clock))).collect()] == [status]
