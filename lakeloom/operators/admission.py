"""Admission of requests under rules of a subject and of all together, in parallel.

In the order of time each request is admitted or gets the reason of the first rule that it breaks, and only admitted ones
count for later requests.  A subject's rules are a fold along its requests.  The rules for all would make one long fold of
everything; instead a day starts from the decisions of a round before:

The first decisions are those of each subject's own rules alone, a fold for each subject.

1. Requests are cut at local days.  From decisions follow, for each day, the admitted ones of earlier days that are still
   felt in it: queued, or within the window of their subject.
2. Each day is one fold of these and of its own requests under all rules, days beside each other.
3. Rounds end when no decision changes; a round folds only days that feel a changed decision.  Decisions that reproduce
   themselves are the sequential ones: the first day depends on none, and each other only on those before it.  A round settles
   at least the first day that was wrong, so there are no more rounds than days and one, however often the common limits are
   reached.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.store import kept
from lakeloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Reasons in the order of the rules.
REASONS = ("SUBJECT_QUEUE_FULL", "GLOBAL_QUEUE_FULL", "SUBJECT_RATE_LIMITED", "SUBJECT_DAILY_LIMITED", "AGENT_DAILY_TASK_BUDGET_EXHAUSTED")


@dataclass(frozen=True)
class Limits:
    """Most queued of a subject and of all, most admitted of a subject in a window and in a local day, and of all in a day.

    In `observe` reasons are noted, but all are admitted.
    """

    queued: int = 1
    all_queued: int = 100
    window: int = 3
    window_us: int = DAY
    daily: int = 5
    all_daily: int = 200
    offset_us: int = 8 * HOUR
    observe: bool = False


def own_rules(rows: DataFrame, limits: Limits) -> DataFrame:
    """rows (s, event_id, t, w, cell) as each subject's own rules decide: a fold of the day below, of one subject each."""
    return _folded(rows.withColumns({"own": F.lit(True), "earlier": F.lit(True)}).repartition("s").sortWithinPartitions("s", "t", "event_id"), limits, "s")


def felt(rows: DataFrame, limits: Limits, last: int) -> DataFrame:
    """What is admitted, once for each later day (`cell`, up to `last`) in which it is queued or within its subject's window."""
    until = F.least(F.floor((F.col("t") + F.greatest(F.col("w"), F.lit(limits.window_us)) + limits.offset_us) / DAY), F.lit(last))
    days = F.when(until > F.col("cell"), F.sequence(F.col("cell") + 1, until))
    return rows.where("admitted").select("s", "event_id", "t", "w", F.explode(days).alias("cell"))


def day_rules(rows: DataFrame, carried: DataFrame, limits: Limits, days: int) -> DataFrame:
    """rows (s, event_id, t, w, cell, admitted) as all rules decide, each day after what is carried into it."""
    own = rows.select("s", "event_id", "t", "w", "cell", F.lit(True).alias("own"), F.col("admitted").alias("earlier"))
    both = own.unionByName(carried.withColumns({"own": F.lit(False), "earlier": F.lit(True)}))
    return _folded(both.repartition(days, "cell").sortWithinPartitions("cell", "own", "t", "event_id"), limits, "cell")


def _folded(rows: DataFrame, limits: Limits, by: str) -> DataFrame:
    """Decisions on the rows that are a group's own, in the order they come; the others are only counted.  By "s" the rules for
    all are left out.  State are subjects' queues, last admissions and counts of the day, and the ends of all that are queued."""
    common = by == "cell"

    def run(batches):
        last, subjects, queued, day, all_today = object(), {}, [], None, 0
        for batch in batches:
            reasons, admitted = [], []
            for group, s, t, w, own in zip(*(batch.column(c).to_pylist() for c in (by, "s", "t", "w", "own")), strict=True):
                if group != last:
                    last, subjects, queued, day, all_today = group, {}, [], None, 0
                if day != (t + limits.offset_us) // DAY:
                    day, all_today = (t + limits.offset_us) // DAY, 0
                queue, times, today, of = subjects.get(s, ((), (), 0, day))
                today = today if of == day else 0
                reason = None
                if own:
                    while queued and queued[0] <= t:
                        heapq.heappop(queued)
                    queue = tuple(end for end in queue if end > t)
                    recent = len(times) == limits.window and times[0] > t - limits.window_us
                    broken = (len(queue) >= limits.queued, common and len(queued) >= limits.all_queued, recent, today >= limits.daily, common and all_today >= limits.all_daily)
                    reason = next((r for r, b in zip(REASONS, broken, strict=True) if b), None)
                yes = reason is None or limits.observe
                if yes:
                    subjects[s] = ((*queue, t + w), (*times, t)[-limits.window :], today + 1, day)
                    all_today += 1
                    if common and w > 0:
                        heapq.heappush(queued, t + w)
                reasons.append(reason)
                admitted.append(yes)
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in ("s", "event_id", "t", "w", "cell")] + [pa.array(admitted, pa.bool_()), batch.column("earlier"), pa.array(reasons, pa.string())], names=["s", "event_id", "t", "w", "cell", "admitted", "earlier", "reason"])
            yield out.filter(batch.column("own"))

    return rows.mapInArrow(run, "s long, event_id long, t long, w long, cell long, admitted boolean, earlier boolean, reason string")


def admit(requests: DataFrame, limits: Limits, most: int = 200) -> DataFrame:
    """event_id, admitted, reason of each request (s, event_id, t, w: its subject, number, time, and microseconds in the queue).

    Ends when a round changes nothing; if `most` rounds aren't enough that is an error, never a guess.
    """
    rows = requests.select(*[F.col(c).cast("long").alias(c) for c in ("s", "event_id", "t", "w")]).withColumn("cell", F.floor((F.col("t") + limits.offset_us) / DAY))
    first = kept(own_rules(rows, limits), "admission-own")
    days = {r.cell: first for r in first.select("cell").distinct().collect()}  # the table that holds a day's decisions
    fold = sorted(days)
    for k in range(most):
        if not fold:
            break
        rows = decisions(days)
        after = kept(day_rules(rows.where(F.col("cell").isin(fold)), felt(rows, limits, max(days)).where(F.col("cell").isin(fold)), limits, len(fold)), f"admission-{k}")
        days |= dict.fromkeys(fold, after)
        # a row a day: which days feel a change
        wrong = after.where("admitted <> earlier")
        changed = not (limits.observe or wrong.isEmpty())
        reached = {r.cell for r in felt(wrong.withColumn("admitted", F.lit(True)), limits, max(days)).select("cell").distinct().collect()} if changed else set()
        fold = sorted(reached & set(days))
    else:
        if fold or changed:
            raise ValueError(f"decisions still change after {most} rounds")
    return decisions(days, first).select("event_id", "admitted", "reason")


def decisions(days: dict[int, DataFrame], none: DataFrame | None = None) -> DataFrame:
    """The decisions of all days, from the tables that hold them; `none` where there is no day."""
    held: dict[int, tuple[DataFrame, list[int]]] = {}
    for day, rows in days.items():
        held.setdefault(id(rows), (rows, []))[1].append(day)
    return reduce(DataFrame.unionByName, [rows.where(F.col("cell").isin(some)) for rows, some in held.values()]) if held else none


def usual(n: int) -> Limits:
    """Limits that n events of a month, half of an hour or so in the queue, now and then reach."""
    mean = n * 8.7e-4
    return Limits(queued=2, all_queued=int(mean + 3.6 * mean**0.5), window=3, daily=4, all_daily=int(0.0262 * n))


def ST4_all_rules(spark, d) -> DataFrame:
    """Stand-in: events are requests of their users, queued for as many minutes as their value says."""
    e = table(spark, d, "events")
    requests = e.select(F.col("user_id").alias("s"), "event_id", F.unix_micros("ts").alias("t"), F.rint(F.col("value") * 60_000_000).cast("long").alias("w"))
    return admit(requests, usual(requests.count())).select("event_id", F.coalesce("reason", F.lit("ADMITTED")).alias("reason"))


QUERIES["ST4_all_rules"] = ST4_all_rules
