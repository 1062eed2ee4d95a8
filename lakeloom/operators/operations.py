"""Operations reports: freshness, quotas, queues, latencies, and the windows they are made of."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict[str, Column], cuts: int = 64) -> DataFrame:
    """by, n and, for each name, the value at a rank (from 0) of the group; a rank is a column of the group's size n.

    Exact, and no task holds or sorts a group: a sketch gives each group `cuts` bounds, rows are counted between them, and
    only values of the ranges that hold a rank are counted one by one.  The bounds decide the work, not the result.
    """
    share = F.array(*[F.lit((k + 1) / (cuts + 1)) for k in range(cuts)])
    groups = rows.groupBy(by).agg(F.percentile_approx(value, share, 1000).alias("cuts"), F.count(value).alias("n"))
    placed = rows.where(F.col(value).isNotNull()).join(groups, by).select(by, value, F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("range"))
    order = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(by, "range").agg(F.count("*").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))  # cuts + 1 rows a group
    asked = groups.select(by, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()])).alias("x")).select(by, "n", "x.*")
    wanted = asked.join(ranges, by).where("rank >= before AND rank < before + held").select(by, "n", "range", "name", (F.col("rank") - F.col("before")).alias("rank"))
    inside = Window.partitionBy(by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.join(wanted.select(by, "range").distinct(), [by, "range"], "left_semi").groupBy(by, "range", value).agg(F.count("*").alias("held")).withColumn("past", F.coalesce(F.sum("held").over(inside), F.lit(0)))
    found = counts.join(wanted, [by, "range"]).where("rank >= past AND rank < past + held")
    return found.groupBy(by, "n").agg(*[F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in ranks])


def nearest_rank(p: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))) - 1


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def AG7_nearest_rank(spark, d):
    return at_ranks(table(spark, d, "events"), "event_type", "value", {f"p{round(100 * p)}": nearest_rank(p) for p in (0.5, 0.95, 0.99)}).drop("n")


@query("SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))")
def AG8_index_percentile(spark, d):
    return at_ranks(table(spark, d, "events"), "event_type", "value", {"p95": F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95)))}).drop("n")


@query("SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = floor((n - 1) * 0.95::DOUBLE)")
def AG9_floor_percentile(spark, d):
    return at_ranks(table(spark, d, "events"), "event_type", "value", {"p95": F.floor((F.col("n") - 1) * F.lit(0.95))}).drop("n")


@query("SELECT event_type, median(value) AS mid FROM events GROUP BY event_type")
def AG10_median(spark, d):
    both = at_ranks(table(spark, d, "events"), "event_type", "value", {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    return both.select("event_type", (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("mid"))


@query("SELECT event_type, round(avg(value), 8) AS mean FROM events GROUP BY event_type")
def AG11_mean(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 8).alias("mean"))


@query("SELECT user_id, coalesce(round((count(*) FILTER (event_type <> 'error'))::DOUBLE / nullif(count(*), 0), 9), 1.0) AS success FROM events GROUP BY user_id")
def AG12_success_rate(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.round(F.count_if(F.col("event_type") != "error") / F.nullif(F.count("*"), F.lit(0)), 9), F.lit(1.0)).alias("success"))


@query("""WITH s(scenario, bound) AS (VALUES ('view', 480.0::DOUBLE), ('click', 100.0::DOUBLE), ('purchase', 490.0::DOUBLE), ('none', 1.0::DOUBLE)),
m AS (SELECT event_type, count(*) AS n, count(*) FILTER (value >= 5) AS measurable, quantile_disc(value, 0.5) FILTER (value >= 5) AS p50, quantile_disc(value, 0.95) FILTER (value >= 5) AS p95, quantile_disc(value, 0.99) FILTER (value >= 5) AS p99 FROM events GROUP BY event_type)
SELECT scenario, coalesce(n, 0) AS samples, coalesce(measurable, 0) AS measurable, coalesce(n - measurable, 0) AS excluded, coalesce(p50, -1) AS p50, coalesce(p95, -1) AS p95, coalesce(p99, -1) AS p99, CASE WHEN coalesce(measurable, 0) < 3 THEN 'insufficient_samples' WHEN p95 <= bound THEN 'passed' ELSE 'failed' END AS gate FROM s LEFT JOIN m ON scenario = event_type""")
def AG13_scenario_gate(spark, d):
    """Each scenario, those without rows too: samples, how many can be measured, percentiles of these, and the gate."""
    dim = spark.createDataFrame([("view", 480.0), ("click", 100.0), ("purchase", 490.0), ("none", 1.0)], "scenario string, bound double")
    e = table(spark, d, "events").withColumnRenamed("event_type", "scenario")
    m = at_ranks(e.where("value >= 5"), "scenario", "value", {f"p{round(100 * p)}": nearest_rank(p) for p in (0.5, 0.95, 0.99)}).withColumnRenamed("n", "measurable")
    n = e.groupBy("scenario").agg(F.count("*").alias("n"))
    rows = dim.join(n, "scenario", "left").join(m, "scenario", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "measurable": F.coalesce("measurable", F.lit(0))})
    gate = F.when(F.col("measurable") < 3, "insufficient_samples").when(F.col("p95") <= F.col("bound"), "passed").otherwise("failed")
    return rows.select("scenario", F.col("n").alias("samples"), "measurable", (F.col("n") - F.col("measurable")).alias("excluded"), *[F.coalesce(p, F.lit(-1.0)).alias(p) for p in ("p50", "p95", "p99")], gate.alias("gate"))


@query("SELECT event_type, coalesce((props->>'k')::VARCHAR, 'unknown') AS code, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS errors FROM events GROUP BY 1, 2")
def AG14_findings_histogram(spark, d):
    """Findings are a list in each row: exploded, then counted by severity and code; those without a code are unknown."""
    finding = F.struct(F.col("event_type").alias("severity"), F.get_json_object("props", "$.k").alias("code"))
    rows = table(spark, d, "events").select("user_id", F.explode(F.array(finding)).alias("f"))
    code = F.coalesce("f.code", F.lit("unknown"))
    return rows.groupBy(F.col("f.severity").alias("event_type"), code.alias("code")).agg(F.count("*").alias("n"), F.sum((F.col("f.severity") == "error").cast("int")).alias("errors"))


@query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS created, count(*) FILTER (event_type = 'view') AS unchanged, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN bool_or(event_type = 'error') THEN 'completed_with_errors' ELSE 'completed' END AS status FROM events GROUP BY user_id")
def AG17_run_outcomes(spark, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    status = F.when(F.bool_or(F.col("event_type") == "error"), "completed_with_errors").otherwise("completed")
    return table(spark, d, "events").groupBy("user_id").agg(n("signup").alias("created"), n("view").alias("unchanged"), n("error").alias("failed"), status.alias("status"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + (value * 60000000)::BIGINT AS b, event_id FROM events),
p AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s)
SELECT user_id, sum(greatest(0, b - greatest(a, coalesce(prev, a))))::BIGINT AS busy_us FROM p GROUP BY user_id""")
def AG23_interval_union(spark, d):
    s = table(spark, d, "events").select("user_id", "event_id", F.unix_micros("ts").alias("a"), (F.unix_micros("ts") + F.rint(F.col("value") * 60000000).cast("long")).alias("b"))
    before = Window.partitionBy("user_id").orderBy("a", "b", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    p = s.withColumn("prev", F.max("b").over(before))
    return p.groupBy("user_id").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("prev", "a")))).alias("busy_us"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def WI2_last_message(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("SELECT conv_id, turn, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def WI3_last_n_messages(spark, d):
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("rn", rn).where("rn <= 3").select("conv_id", "turn", "rn")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER w AS rn, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
f AS (SELECT user_id, max((event_type NOT IN ('error', 'view'))::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS ok FROM r WHERE rn <= 20)
SELECT user_id, count(*) FILTER (ok = 0) AS failures FROM f GROUP BY user_id""")
def WI4_leading_failures(spark, d):
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    runs = table(spark, d, "events").withColumn("rn", F.row_number().over(newest)).where("rn <= 20")
    ok = F.max(F.when(F.col("event_type").isin("error", "view"), 0).otherwise(1)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("ok", ok).groupBy("user_id").agg(F.count_if(F.col("ok") == 0).alias("failures"))


@query("SELECT conv_id, turn, coalesce(lag(turn) OVER w, -1) AS prev, coalesce(lead(turn) OVER w, -1) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def WI8_neighbours(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag("turn").over(w), F.lit(-1)).alias("prev"), F.coalesce(F.lead("turn").over(w), F.lit(-1)).alias("next"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS heading FROM conversations")
def WI9_forward_fill(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w), F.lit(-1)).alias("heading"))


_ROLL = "OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"


def _day():
    return Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-86_399_999_999, 0)


@query(f"SELECT event_id, count(*) {_ROLL} AS n FROM events")
def WI10_rolling_count(spark, d):
    return table(spark, d, "events").select("event_id", F.count("*").over(_day()).alias("n"))


@query(f"SELECT event_id, greatest(1, ceil((min(epoch_us(ts)) {_ROLL} + 86400000000 - epoch_us(ts)) / 1000000.0::DOUBLE))::BIGINT AS reset_seconds FROM events")
def WI11_rolling_reset(spark, d):
    left = F.min(F.unix_micros("ts")).over(_day()) + 86_400_000_000 - F.unix_micros("ts")
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(1), F.ceil(left / 1000000.0)).alias("reset_seconds"))


@query("SELECT user_id, (ts + INTERVAL 8 HOUR)::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2")
def WI12_daily_buckets(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date(F.from_utc_timestamp("ts", "Asia/Shanghai")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def WI15_first_occurrence(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("x")).select("x.doc_id", "x.source")


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(html)::DOUBLE AS score FROM pages) SELECT page_id, host, total FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS rn, max(score) OVER h + 0.5::DOUBLE * (sum(score) OVER h - max(score) OVER h) AS total FROM p WINDOW h AS (PARTITION BY host)) WHERE rn = 1")
def WI17_parent_collapse(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.length("html").cast("double").alias("score"))
    best = p.groupBy("host").agg(F.max_by("page_id", F.struct("score", -F.col("page_id"))).alias("page_id"), F.max("score").alias("m"), F.sum("score").alias("s"))
    return best.select("page_id", "host", (F.col("m") + 0.5 * (F.col("s") - F.col("m"))).alias("total"))


@query("""WITH r AS (SELECT user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
  max((event_type NOT IN ('error', 'view'))::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS ok FROM events),
a AS (SELECT user_id, count(*) AS runs, max(ts) AS last_run, count(*) FILTER (ok = 0 AND rn <= 20) AS failures, max(CASE WHEN rn = 1 THEN event_type END) AS last_type FROM r GROUP BY user_id)
SELECT user_id, runs, last_run, failures, last_type, CASE WHEN failures >= 3 THEN 'failing' WHEN last_run < TIMESTAMP '2024-01-30' THEN 'stale' ELSE 'healthy' END AS health FROM a""")
def RT13_source_health(spark, d):
    """Health of each feed as of a given day: runs, the newest, the leading run of failures among the newest 20."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    bad = F.col("event_type").isin("error", "view")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    last = e.withColumn("rn", F.row_number().over(newest)).where("rn <= 20")  # cut before the exchange: no history is sorted whole
    last = last.withColumn("ok", F.max(F.when(bad, 0).otherwise(1)).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.groupBy("user_id").agg(F.count_if(F.col("ok") == 0).alias("failures"), F.max(F.when(F.col("rn") == 1, F.col("event_type"))).alias("last_type"))
    a = e.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("ts").alias("last_run")).join(last, "user_id")
    health = F.when(F.col("failures") >= 3, "failing").when(F.col("last_run") < F.lit("2024-01-30").cast("timestamp"), "stale").otherwise("healthy")
    return a.select("*", health.alias("health"))


@query("""WITH m AS (SELECT event_type, count(*) AS samples, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type)
SELECT *, CASE WHEN samples < 3 THEN 'insufficient_samples' WHEN p95 <= 480 THEN 'passed' ELSE 'failed' END AS gate, CASE WHEN bool_or(samples >= 3 AND p95 > 480) OVER () THEN 'failed' WHEN bool_or(samples < 3) OVER () THEN 'incomplete' ELSE 'passed' END AS stage FROM m""")
def RT16_latency_report(spark, d):
    """The latency block of each scenario with its gate, and the gate of the stage."""
    e = table(spark, d, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("samples"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    p = at_ranks(e, "event_type", "value", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)}).drop("n")
    gate = F.when(F.col("samples") < 3, "insufficient_samples").when(F.col("p95") <= 480, "passed").otherwise("failed")
    every = Window.partitionBy()  # one row a scenario
    m = sums.join(p, "event_type").withColumn("gate", gate)
    stage = F.when(F.bool_or(F.col("gate") == "failed").over(every), "failed").when(F.bool_or(F.col("gate") == "insufficient_samples").over(every), "incomplete").otherwise("passed")
    return m.withColumn("stage", stage).select("event_type", "samples", "mean", "p50", "p95", "most", "gate", "stage")


@query("""WITH r AS (SELECT user_id, count(*) AS running FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1),
q AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup')
SELECT event_id, user_id FROM q LEFT JOIN r USING (user_id) WHERE n <= 2 - coalesce(running, 0) ORDER BY ts, event_id LIMIT greatest(0, 60 - (SELECT sum(running) FROM r))""")
def ST2_fair_scheduler(spark, d):
    """First in, first out: a subject has two places, less what it runs; all have sixty, less what runs.

    A subject's first two are enough to choose from, so its queue isn't sorted as a whole.
    """
    e = table(spark, d, "events")
    running = e.where("event_type = 'view' AND ts >= '2024-01-30 12:00:00'").groupBy("user_id").agg(F.count("*").alias("running"))
    free = 60 - (running.agg(F.sum("running")).first()[0] or 0)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    queue = e.where("event_type = 'signup'").withColumn("n", n).where("n <= 2").join(running, "user_id", "left")
    return queue.where(F.col("n") <= 2 - F.coalesce("running", F.lit(0))).orderBy("ts", "event_id").limit(max(0, free)).select("event_id", "user_id")


@query("""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT user_id, min(sequence) AS stop FROM l WHERE sequence > n - 200 AND sequence > 10 AND event_type = 'error' GROUP BY 1)
SELECT user_id, sequence::INT AS sequence, event_type FROM l LEFT JOIN t USING (user_id) WHERE sequence > n - 200 AND sequence > 10 AND sequence <= coalesce(stop, n)""")
def ST1_event_replay(spark, d):
    """Each task's log in dense order, its last 200 events, replayed after the tenth up to the first terminal event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    log = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).alias("sequence"), F.count("*").over(Window.partitionBy("user_id")).alias("n")).where("sequence > n - 200 AND sequence > 10")
    stop = log.where("event_type = 'error'").groupBy("user_id").agg(F.min("sequence").alias("stop"))
    return log.join(stop, "user_id", "left").where(F.col("sequence") <= F.coalesce("stop", "n")).select("user_id", "sequence", "event_type")


def admit(rows: DataFrame, subject: str, window_s: int = 86_400, limit: int = 3, per_day: int = 2, offset_h: int = 8, enforce: bool = True) -> DataFrame:
    """event_id, reason of each request in order of (ts, event_id): null if admitted, else the first rule that it breaks.

    Only admitted requests use up the rolling quota and the quota of the local day (all do if not enforced), so a decision
    depends on those before.  Rows are dealt by subject and sorted within partitions; the fold goes along each partition
    with the state of one subject, `limit` times and a count, so a subject of any size needs no more memory.
    """
    sorted_rows = rows.select(F.col(subject).cast("long").alias("s"), "event_id", F.unix_micros("ts").alias("t")).repartition("s").sortWithinPartitions("s", "t", "event_id")

    def run(batches):
        last, times, day, n = object(), [], None, 0
        for batch in batches:
            reasons = []
            for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
                today = (t + offset_h * 3_600_000_000) // 86_400_000_000
                if s != last:
                    last, times, day, n = s, [], today, 0
                if today != day:
                    day, n = today, 0
                full = len(times) == limit and times[0] > t - window_s * 1_000_000
                reason = "SUBJECT_RATE_LIMITED" if full else "SUBJECT_DAILY_LIMITED" if n >= per_day else None
                if reason is None or not enforce:
                    times, n = [*times, t][-limit:], n + 1
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(reasons, pa.string())], names=["event_id", "reason"])

    return sorted_rows.mapInArrow(run, "event_id long, reason string")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, (epoch_us(ts) + 28800000000) // 86400000000 AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, []::BIGINT[] AS times, 0::BIGINT AS day, 0::BIGINT AS n, '' AS reason FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN why = '' THEN list_append(times, t)[-3:] ELSE times END, day, CASE WHEN why = '' THEN n + 1 ELSE n END, why
  FROM (SELECT *, CASE WHEN len(times) = 3 AND times[1] > t - 86400000000 THEN 'SUBJECT_RATE_LIMITED' WHEN n >= 2 THEN 'SUBJECT_DAILY_LIMITED' ELSE '' END AS why
    FROM (SELECT e.user_id, e.rn, e.event_id, e.t, e.day, r.times, CASE WHEN r.day = e.day THEN r.n ELSE 0 END AS n FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
SELECT event_id, coalesce(nullif(reason, ''), 'ADMITTED') AS reason FROM r WHERE rn > 0""")
def ST4_admission(spark, d):
    return admit(table(spark, d, "events"), "user_id").select("event_id", F.coalesce("reason", F.lit("ADMITTED")).alias("reason"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) > 1 AS limited FROM events")
def ST8_request_limiter(spark, d):
    """Requests of a source within sixty seconds of another: the analytic form of a sliding limiter."""
    minute = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-59_999_999, 0)
    return table(spark, d, "events").select("event_id", (F.count("*").over(minute) > 1).alias("limited"))


@query("""WITH s AS (SELECT *, coalesce(max(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cleared FROM events),
f AS (SELECT a.event_id, count(b.event_id) AS n FROM s a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'error' AND b.ts < a.ts AND epoch_us(b.ts) > epoch_us(a.ts) - 259200000000 AND epoch_us(b.ts) > a.cleared WHERE a.event_type IN ('error', 'signup') GROUP BY 1)
SELECT event_id, n >= 2 AS rejected FROM f""")
def ST13_attempt_limiter(spark, d):
    """Attempts that come after two failures in three days; a success clears what was before it."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    span = Window.partitionBy("user_id").orderBy("t").rangeBetween(-259_199_999_999, -1)
    failed = F.when(F.col("event_type") == "error", 1).otherwise(0)
    e = table(spark, d, "events").where("event_type IN ('error', 'signup')").select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("t"))
    e = e.withColumn("all", F.coalesce(F.sum(failed).over(order), F.lit(0)))
    cleared = F.coalesce(F.max(F.when(F.col("event_type") == "signup", F.col("all"))).over(order), F.lit(0))
    # both are the newest failures: those of the span and those since the last success
    lately = F.least(F.coalesce(F.sum(failed).over(span), F.lit(0)), F.col("all") - cleared)
    return e.select("event_id", (lately >= 2).alias("rejected"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'failed' ELSE event_type END AS status, CASE WHEN event_type = 'view' THEN 'INTERRUPTED' END AS code FROM events WHERE ts >= TIMESTAMP '2024-01-29'")
def ST10_restart_recovery(spark, d):
    """After a restart what was running has failed."""
    running = F.col("event_type") == "view"
    return table(spark, d, "events").where("ts >= '2024-01-29'").select("event_id", F.when(running, "failed").otherwise(F.col("event_type")).alias("status"), F.when(running, "INTERRUPTED").alias("code"))


@query("""WITH q AS (SELECT event_id, event_type, ts, CASE WHEN value > 250 THEN ts + INTERVAL 2 HOUR END AS deadline FROM events WHERE event_type IN ('signup', 'click'))
SELECT event_id, CASE WHEN event_type = 'signup' AND coalesce(deadline, ts + INTERVAL 6 HOUR) <= TIMESTAMP '2024-01-29' THEN 'canceled' ELSE event_type END AS status, event_type = 'signup' AND coalesce(deadline, ts + INTERVAL 6 HOUR) <= TIMESTAMP '2024-01-29' AS changed FROM q""")
def ST3_queue_expiry(spark, d):
    """Queued tasks past their deadline (or past six hours without one) are cancelled; others are left as they are."""
    deadline = F.when(F.col("value") > 250, F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    late = (F.col("event_type") == "signup") & (F.coalesce(deadline, F.col("ts") + F.expr("INTERVAL 6 HOURS")) <= F.lit("2024-01-29").cast("timestamp"))
    return table(spark, d, "events").where("event_type IN ('signup', 'click')").select("event_id", F.when(late, "canceled").otherwise(F.col("event_type")).alias("status"), late.alias("changed"))


@query("SELECT user_id, arg_max(event_id, (CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, ts, event_id)) AS current_id FROM events GROUP BY user_id")
def ST11_partial_back_fill(spark, d):
    """The newest version, but a partial one (a view) never replaces a full one."""
    full = F.when(F.col("event_type") == "view", 0).otherwise(1)
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(full, "ts", "event_id")).alias("current_id"))


#: Cells in which intervals of one key are united, in microseconds.
CELL = 3_600_000_000


def united(spans: DataFrame, key: str, cell: int = CELL) -> DataFrame:
    """key, length of the union of its intervals [a, b), in microseconds.

    Intervals are cut at the bounds of cells of time, in which unions are apart and add up; so a window holds one cell of
    one key, and a key with very many intervals is many windows.  Empty and reversed intervals have no length.
    """
    at = F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor((F.col("b") - 1) / cell)))
    cut = spans.where("b > a").select(key, "a", "b", at.alias("cell"))
    cut = cut.select(key, "cell", F.greatest("a", F.col("cell") * cell).alias("a"), F.least("b", (F.col("cell") + 1) * cell).alias("b"))
    before = Window.partitionBy(key, "cell").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    covered = cut.withColumn("to", F.coalesce(F.max("b").over(before), F.col("a")))
    return covered.groupBy(key).agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "to"))).alias("length"))


def traces(spans: DataFrame, hints: DataFrame) -> DataFrame:
    """What a trace took: trace, total_us, excluded_us, controllable_us, model_calls, tool_calls, measurable, scenario.

    spans: trace, kind (model or tool), a, first (when the first token came, or null), b, in microseconds; hints: trace, hint.
    Excluded is the union of what model calls waited for their first token, of calls that measure it; controllable is the
    rest of the time from the first start to the last end.  A trace is measurable if all its model calls are.  Of several
    hints the scenario is the first of image or multi_source, authenticated, public_live.
    """
    model = F.col("kind") == "model"
    waits = united(spans.where(model & F.col("first").isNotNull()).select("trace", "a", F.col("first").alias("b")), "trace").withColumnRenamed("length", "excluded_us")
    sums = spans.groupBy("trace").agg((F.max("b") - F.min("a")).alias("total_us"), F.count_if(model).alias("model_calls"), F.count_if(F.col("kind") == "tool").alias("tool_calls"), F.bool_and(~model | F.col("first").isNotNull()).alias("measurable"))
    any_ = lambda *names: F.coalesce(F.bool_or(F.col("hint").isin(*names)), F.lit(False))
    scenario = F.when(any_("image", "multi_source"), "multi_source_or_image").when(any_("authenticated"), "authenticated").when(any_("public_live"), "public_live").otherwise("no_live_read")
    rows = sums.join(waits, "trace", "left").join(hints.groupBy("trace").agg(scenario.alias("scenario")), "trace", "left")
    excluded = F.coalesce("excluded_us", F.lit(0))
    return rows.select("trace", "total_us", excluded.alias("excluded_us"), F.greatest(F.lit(0), F.col("total_us") - excluded).alias("controllable_us"), "model_calls", "tool_calls", "measurable", F.coalesce("scenario", F.lit("no_live_read")).alias("scenario"))


@query("""WITH s AS (SELECT user_id * 100 + day(ts) AS trace, CASE WHEN event_type IN ('view', 'signup') THEN 'model' WHEN event_type = 'click' THEN 'tool' END AS kind, epoch_us(ts) AS a, epoch_us(ts) + (value * 30000000)::BIGINT AS f, epoch_us(ts) + (value * 60000000)::BIGINT AS b, event_id, event_type FROM events),
x AS (SELECT * REPLACE (CASE WHEN kind = 'model' AND event_id % 9 <> 0 THEN f END AS f) FROM s WHERE kind IS NOT NULL),
w AS (SELECT trace, f, a, max(f) OVER (PARTITION BY trace ORDER BY a, f, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM x WHERE f IS NOT NULL),
u AS (SELECT trace, sum(greatest(0, f - greatest(a, coalesce(prev, a))))::BIGINT AS excluded_us FROM w GROUP BY trace),
h AS (SELECT trace, bool_or(event_type = 'error') AS many, bool_or(event_type = 'purchase') AS auth, bool_or(event_type = 'click') AS live FROM s GROUP BY trace),
t AS (SELECT trace, max(b) - min(a) AS total_us, count(*) FILTER (kind = 'model') AS model_calls, count(*) FILTER (kind = 'tool') AS tool_calls, bool_and(kind <> 'model' OR f IS NOT NULL) AS measurable FROM x GROUP BY trace)
SELECT trace, total_us, coalesce(excluded_us, 0) AS excluded_us, greatest(0, total_us - coalesce(excluded_us, 0)) AS controllable_us, model_calls, tool_calls, measurable,
  CASE WHEN many THEN 'multi_source_or_image' WHEN auth THEN 'authenticated' WHEN live THEN 'public_live' ELSE 'no_live_read' END AS scenario FROM t LEFT JOIN u USING (trace) JOIN h USING (trace)""")
def RT22_trace_snapshot(spark, d):
    """Stand-in: a trace is a user's day; views and signups are model calls of half as many minutes to the first token as
    their value, clicks are tools."""
    e = table(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("trace"), "event_type", "event_id", F.unix_micros("ts").alias("a"), *[(F.unix_micros("ts") + F.rint(F.col("value") * k * 1_000_000).cast("long")).alias(c) for c, k in (("f", 30), ("b", 60))])
    kind = F.when(F.col("event_type").isin("view", "signup"), "model").when(F.col("event_type") == "click", "tool")
    spans = e.withColumn("kind", kind).where("kind IS NOT NULL").select("trace", "kind", "a", F.when((F.col("kind") == "model") & (F.col("event_id") % 9 != 0), F.col("f")).alias("first"), "b")
    hint = F.when(F.col("event_type") == "error", "multi_source").when(F.col("event_type") == "purchase", "authenticated").when(F.col("event_type") == "click", "public_live")
    return traces(spans, e.select("trace", hint.alias("hint")))


@query("""WITH t AS (SELECT *, sha256('t' || event_id) AS id FROM events)
SELECT prefix, CASE WHEN count(id) = 0 THEN 'not_found' WHEN count(id) = 1 THEN min(id) ELSE 'ambiguous' END AS resolved FROM (SELECT DISTINCT substr(sha256('t' || c_custkey), 1, 4) AS prefix FROM customer) p LEFT JOIN t ON substr(id, 1, 4) = prefix GROUP BY prefix""")
def RT15_trace_by_prefix(spark, d):
    """Traces named by the first characters of their id: found, unknown or ambiguous."""
    t = table(spark, d, "events").select(F.sha2(F.concat(F.lit("t"), "event_id"), 256).alias("id")).withColumn("prefix", F.substring("id", 1, 4))
    asked = table(spark, d, "customer").select(F.substring(F.sha2(F.concat(F.lit("t"), "c_custkey"), 256), 1, 4).alias("prefix")).distinct()
    found = F.when(F.count("id") == 0, "not_found").when(F.count("id") == 1, F.min("id")).otherwise("ambiguous")
    return asked.join(t, "prefix", "left").groupBy("prefix").agg(found.alias("resolved"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' - INTERVAL 48 HOUR")
def ST6_retention(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-27").cast("timestamp")).select("event_id")


@query("SELECT min(conv_id) AS conv_id, role, text FROM conversations WHERE text IS NOT NULL GROUP BY role, text")
def ST12_dedup_messages(spark, d):
    c = table(spark, d, "conversations")
    return c.where("text IS NOT NULL").groupBy("role", "text").agg(F.min("conv_id").alias("conv_id"))


@query("""WITH p AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE event_id % 4 <> 0)
SELECT count(*) AS tasks, count(*) FILTER (event_type IN ('click', 'purchase')) AS completed, count(*) FILTER (event_type = 'error') AS failed, (count(*) FILTER (event_type IN ('click', 'purchase')))::DOUBLE / count(*) AS success,
  (SELECT median(value) FROM p) AS median, (SELECT value FROM p WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, (SELECT count(*) FROM labels) AS feedback, count(*) FILTER (event_type = 'error' AND user_id % 3 = 0) AS alerts FROM events""")
def RT15_overview(spark, d):
    """One row for those who run it: tasks and how they ended, durations of those that were measured, feedback, alerts.

    Durations are percentiles of all without sorting all; the parts are single rows, joined by a constant.
    """
    e = table(spark, d, "events")
    n = lambda test: F.count_if(test)
    kind = F.col("event_type")
    done = kind.isin("click", "purchase")
    sums = e.agg(F.count("*").alias("tasks"), n(done).alias("completed"), n(kind == "error").alias("failed"), F.coalesce(n(done) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("success"), n((kind == "error") & (F.col("user_id") % 3 == 0)).alias("alerts")).withColumn("one", F.lit(1))
    size = F.col("n")
    measured = at_ranks(e.where("event_id % 4 <> 0").select(F.lit(1).alias("one"), "value"), "one", "value", {"low": F.floor((size - 1) / 2), "high": F.floor(size / 2), "p95": F.least(size - 1, F.floor(size * F.lit(0.95)))})
    feedback = table(spark, d, "labels").agg(F.count("*").alias("feedback")).withColumn("one", F.lit(1))
    row = sums.join(measured, "one", "left").join(feedback, "one")
    return row.select("tasks", "completed", "failed", "success", (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("median"), "p95", "feedback", "alerts")
