"""Streams of events that lose nothing: daily counters, each task's log, and the expiry of queued tasks.

A micro-batch writes what it adds (increments of counters, rows of a log) under its own number, and a batch that runs again
overwrites the same folder, so a restart counts nothing twice.  What is read is the sum of all batches.  So there is no state
that a watermark would have to bound, and an event that comes days late is added to its day, or takes its place in its
task's log, like any other.  The cost is that increments pile up; `compacted` folds those up to a batch into one.

A stream goes on where it stopped: checkpoint and rows lie in one folder that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.sources.store import listed, new_folder, remove
from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def stream_of(spark: SparkSession, source: str, files: int = 1) -> DataFrame:
    """Events of a folder's Parquet files as a stream, so many files a batch."""
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("ts",) if c in rows.columns})


def drained(stream: DataFrame, path: str, step: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Runs the stream over what is there and not done yet; step(batch) is what the batch adds to `path`."""

    def write(rows: DataFrame, batch: int) -> None:
        step(rows).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def added(spark: SparkSession, path: str) -> DataFrame:
    """All that batches have added, with `batch`.  A compacted folder stands for those before it."""
    names = {int(n.partition("=")[2]): n for n in listed(spark, f"{path}/rows") if n.startswith("batch=")}
    folded = [int(n.partition("=")[2]) for n in listed(spark, f"{path}/folded") if "_SUCCESS" in listed(spark, f"{path}/folded/{n}")]
    upto = max(folded, default=-1)
    parts = [f"{path}/rows/{n}" for b, n in sorted(names.items()) if b > upto] + [f"{path}/folded/upto={upto}"] * (upto >= 0)
    return spark.read.parquet(*parts)


def compacted(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Folds what all batches so far have added into one folder, which holds once it is complete; then theirs go."""
    numbers = [int(n.partition("=")[2]) for n in listed(spark, f"{path}/rows") if n.startswith("batch=")]
    if numbers:
        last = max(numbers)
        older = [n for n in listed(spark, f"{path}/folded") if n != f"upto={last}"]
        fold(added(spark, path)).write.mode("overwrite").parquet(f"{path}/folded/upto={last}")
        for n in numbers:
            remove(spark, f"{path}/rows/batch={n}")
        for n in older:
            remove(spark, f"{path}/folded/{n}")


def late_feed(spark: SparkSession, d: str, files: int = 5) -> str:
    """Stand-in for a feed: the events in files that each reach over all the time, so most batches are late by weeks."""
    path = new_folder(spark, "event-feed")
    events = table(spark, d, "events")
    events.repartition(files, F.pmod(F.xxhash64("event_id"), F.lit(files))).write.parquet(path)
    return path


# --- daily counters -------------------------------------------------------------------------------------------------


def local_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Shanghai")).cast("string")


def increments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("tasks"), F.count_if(F.col("event_type") == "error").alias("rejected"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "day").agg(F.sum("tasks").alias("tasks"), F.sum("rejected").alias("rejected"))


@query("SELECT user_id, (ts + INTERVAL 8 HOUR)::DATE::VARCHAR AS day, count(*) AS tasks, count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY 1, 2")
def ST5_daily_counters(spark, d):
    """Counters of each subject and local day from five batches out of order, of which the first two were folded."""
    path, feed = new_folder(spark, "daily-counters"), late_feed(spark, d)
    drained(stream_of(spark, feed), path, increments)
    compacted(spark, path, summed)
    return summed(added(spark, path))


# --- event log ------------------------------------------------------------------------------------------------------


def log_of(rows: DataFrame) -> DataFrame:
    """Each task's events with dense numbers by event time, whatever batches they came in; an event that came twice is one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select("user_id", "event_id", "ts").dropDuplicates(["user_id", "event_id"]).withColumn("sequence", F.row_number().over(order).cast("long"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def ST1_event_log(spark, d):
    path, feed = new_folder(spark, "event-log"), late_feed(spark, d)
    drained(stream_of(spark, feed).select("user_id", "event_id", "ts"), path)
    return log_of(added(spark, path)).select("user_id", "event_id", "sequence")


@query("SELECT user_id, sequence, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE sequence > 10 AND sequence > n - 200")
def SK6_replay(spark, d):
    """Replay from the log: what comes after the tenth event, of the last 200."""
    last = F.max("sequence").over(Window.partitionBy("user_id"))
    return ST1_event_log(spark, d).withColumn("last", last).where("sequence > 10 AND sequence > last - 200").select("user_id", "sequence", "event_id")


# --- expiry of queued tasks -----------------------------------------------------------------------------------------


def expired(tasks: DataFrame, starts: DataFrame, clock: Column | str) -> DataFrame:
    """task, status of queued tasks (task, deadline) at a clock: running if a start came before the deadline, else canceled
    once the deadline has passed, else queued.

    A start that arrives in a later batch but lies before the deadline takes the cancellation back; one after it doesn't.
    """
    began = starts.groupBy("task").agg(F.min("at").alias("at"))
    rows = tasks.groupBy("task").agg(F.min("deadline").alias("deadline")).join(began, "task", "left")
    running = F.col("at").isNotNull() & (F.col("at") < F.col("deadline"))
    return rows.select("task", F.when(running, "running").when(F.col("deadline") <= clock, "canceled").otherwise("queued").alias("status"))


@query("""WITH q AS (SELECT user_id * 1000000 + event_id // 2 AS task, min(ts) + INTERVAL 6 HOUR AS deadline FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1),
s AS (SELECT user_id * 1000000 + event_id // 2 AS task, min(ts) AS began FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT task, CASE WHEN began < deadline THEN 'running' WHEN deadline <= (SELECT max(ts) FROM events) THEN 'canceled' ELSE 'queued' END AS status FROM q LEFT JOIN s USING (task)""")
def ST3_expiry_stream(spark, d):
    """Tasks that a stream queues and starts; the clock is the newest event of all batches.  Stand-in: a task is a user's pair
    of events; purchases start it, others queue it for six hours."""
    path, feed = new_folder(spark, "queue"), late_feed(spark, d)
    task = (F.col("user_id") * 1_000_000 + F.floor(F.col("event_id") / 2)).alias("task")
    drained(stream_of(spark, feed).select(task, "event_type", F.col("ts").alias("at")), path)
    rows = added(spark, path)
    clock = rows.agg(F.max("at")).first()[0]
    queued = rows.where("event_type IN ('view', 'click', 'signup')").groupBy("task").agg((F.min("at") + F.expr("INTERVAL 6 HOURS")).alias("deadline"))
    return expired(queued, rows.where("event_type = 'purchase'").select("task", "at"), F.lit(clock))
