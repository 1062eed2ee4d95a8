"""Admission in rounds against a plain fold over all requests in order."""

import os
import random
from collections import defaultdict

import duckdb
import pytest

from lakeloom.operators.admission import DAY, HOUR, REASONS, Limits, ST4_all_rules, admit, usual


def plain(requests, limits):
    admitted, out = [], {}
    by_subject = defaultdict(list)
    for s, i, t, w in sorted(requests, key=lambda r: (r[2], r[1])):
        own, day = by_subject[s], (t + limits.offset_us) // DAY
        same_day = lambda rows: sum((x + limits.offset_us) // DAY == day for x, _ in rows)  # noqa: B023, E731
        broken = (
            sum(x + y > t for x, y in own) >= limits.queued,
            sum(x + y > t for x, y in admitted) >= limits.all_queued,
            sum(x > t - limits.window_us for x, _ in own) >= limits.window,
            same_day(own) >= limits.daily,
            same_day(admitted) >= limits.all_daily,
        )
        reason = next((r for r, b in zip(REASONS, broken, strict=True) if b), None)
        out[i] = (reason is None or limits.observe, reason)
        if out[i][0]:
            own.append((t, w))
            admitted.append((t, w))
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_equals_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    requests = [(rng.randint(1, 12), i, rng.randint(0, 2 * 24 * 6) * HOUR // 6, rng.randint(0, 40) * HOUR // 10) for i in range(160)]  # many at one time
    limits = Limits(queued=rng.choice([1, 2]), all_queued=rng.choice([4, 6]), window=4, window_us=8 * HOUR, daily=6, all_daily=rng.choice([18, 25]), observe=seed == 3)
    got = {r.event_id: (r.admitted, r.reason) for r in admit(spark.createDataFrame(requests, "s long, event_id long, t long, w long"), limits).collect()}
    want = plain(requests, limits)
    assert got == want and len({r for _, r in want.values()}) >= 4


def test_empty_and_unfinished(spark):
    none = spark.createDataFrame([], "s long, event_id long, t long, w long")
    assert admit(none, Limits()).collect() == []
    some = spark.createDataFrame([(1, 1, 0, 10), (2, 2, 5, 10)], "s long, event_id long, t long, w long")
    with pytest.raises(ValueError):
        admit(some, Limits(all_daily=1), most=1)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    rows = duckdb.sql("SELECT user_id, event_id, epoch_us(ts), round_even(value * 60000000, 0)::BIGINT FROM '/root/testdata/sf0.001/events.parquet'").fetchall()
    want = plain(rows, usual(len(rows)))
    assert {r.event_id: r.reason for r in ST4_all_rules(spark, "/root/testdata/sf0.001").collect()} == {i: r or "ADMITTED" for i, (_, r) in want.items()}
    assert {"GLOBAL_QUEUE_FULL", "AGENT_DAILY_TASK_BUDGET_EXHAUSTED"} <= {r for _, r in want.values()}
