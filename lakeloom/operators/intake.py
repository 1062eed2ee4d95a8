"""What comes in besides the crawl, and what is said of its sources: imports, mirrored files, source status and alerts.

Stand-ins: imported files are pages with a text from their title; a source's runs are the events of the users whose number
gives it; a source is enabled, and polled, by its place in the order of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import canonical_url
from lakeloom.operators.content import _canonical_sql
from lakeloom.sources.tables import published, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# --- imports --------------------------------------------------------------------------------------------------------


def imported(files: DataFrame, known: DataFrame) -> DataFrame:
    """id, source, outcome, version of files that an operator hands in: id, source, uri, status, body, text, title, publisher.

    A file is rejected if its address isn't canonical, its status is 400 or more, or its text, title or publisher is empty;
    the first of these says why.  Of equal bytes in a source, by SHA-256, the first file makes a version, unless `known`
    (source, digest) has it; the others are unchanged.  Files meet by (source, digest), which copies make one row of in the map
    tasks, so no copy is sorted.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    why = F.when(~F.coalesce(F.col("uri") == canonical_url(F.col("uri")), F.lit(False)), "uri_not_canonical").when(F.col("status") >= 400, "status")
    for c in ("text", "title", "publisher"):
        why = why.when(empty(c), f"no_{c}")
    rows = files.select("id", "source", why.alias("why"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"))
    first = rows.where("why IS NULL").groupBy("source", "digest").agg(F.min("id").alias("first"))
    seen = first.join(known.select("source", "digest").distinct().withColumn("known", F.lit(True)), ["source", "digest"], "left")
    out = rows.join(seen, ["source", "digest"], "left")
    new = F.col("known").isNull() & (F.col("id") == F.col("first"))
    outcome = F.when(F.col("why").isNotNull(), F.concat(F.lit("rejected:"), "why")).when(new, "created").otherwise("unchanged")
    return out.select("id", "source", outcome.alias("outcome"), F.when(F.col("why").isNull(), F.col("digest")).alias("version"))


_FILES = f"""f AS (SELECT page_id AS id, 's' || page_id % 5 AS source, {_canonical_sql('url')} AS canonical, CASE WHEN page_id % 6 = 0 THEN url ELSE {_canonical_sql('url')} END AS uri,
  CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status, 'b' || page_id // 3 AS body, CASE WHEN page_id % 19 = 0 THEN ' ' ELSE 't' END AS text, CASE WHEN page_id % 23 = 0 THEN NULL ELSE 'x' END AS title FROM pages),
w AS (SELECT *, sha256(body) AS digest, CASE WHEN uri <> canonical THEN 'uri_not_canonical' WHEN status >= 400 THEN 'status' WHEN trim(text) = '' THEN 'no_text' WHEN title IS NULL THEN 'no_title' END AS why FROM f),
k AS (SELECT DISTINCT 's' || page_id % 5 AS source, sha256('b' || page_id // 3) AS digest FROM pages WHERE page_id % 50 = 1),
o AS (SELECT w.*, CASE WHEN why IS NOT NULL THEN 'rejected:' || why WHEN k.digest IS NULL AND row_number() OVER (PARTITION BY w.source, w.digest, why ORDER BY id) = 1 THEN 'created' ELSE 'unchanged' END AS outcome
  FROM w LEFT JOIN k ON k.source = w.source AND k.digest = w.digest)"""


def _files(spark, d) -> tuple[DataFrame, DataFrame]:
    i = F.col("page_id")
    body = F.concat(F.lit("b"), F.floor(i / 3))
    files = table(spark, d, "pages").select(
        i.alias("id"), F.concat(F.lit("s"), i % 5).alias("source"), F.when(i % 6 == 0, F.col("url")).otherwise(canonical_url(F.col("url"))).alias("uri"), F.when(i % 17 == 0, 404).otherwise(200).alias("status"),
        body.alias("body"), F.when(i % 19 == 0, " ").otherwise("t").alias("text"), F.when(i % 23 != 0, "x").alias("title"), F.lit("p").alias("publisher"),
    )
    return files, files.where("id % 50 = 1").select("source", F.sha2("body", 256).alias("digest"))


@query(f"WITH {_FILES} SELECT id, source, outcome, CASE WHEN why IS NULL THEN digest END AS version FROM o")
def SC11_operator_import(spark, d):
    """Outcome and version of each file that is handed in."""
    return imported(*_files(spark, d))


@query(f"WITH {_FILES} SELECT source, count(*) AS files, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome LIKE 'rejected:%') AS rejected FROM o GROUP BY source")
def SC12_import_runs(spark, d):
    """The run of each source of such an import."""
    n = lambda test: F.count_if(test)
    o = F.col("outcome")
    return imported(*_files(spark, d)).groupBy("source").agg(F.count("*").alias("files"), n(o == "created").alias("created"), n(o == "unchanged").alias("unchanged"), n(o.startswith("rejected:")).alias("rejected"))


def mirrored(files: DataFrame) -> DataFrame:
    """id, title, text, parser_version, quality, bytes, sha256 of files that have no text of their own.

    files: id, uri, title, kind (image or attachment), parent, body.  The text says what the file is, where it belongs and
    lies; an image waits for its transcription.
    """
    name = F.regexp_extract("uri", "([^/]*)/*$", 1)
    title = F.substring(F.coalesce("title", name), 1, 500)
    image = F.col("kind") == "image"
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}:"), c))
    text = F.concat_ws("\n", F.concat(F.when(image, "正文图片").otherwise("附件"), F.lit(":"), title), line("所属页面", F.col("parent")), F.concat(F.lit("文件地址:"), "uri"))
    return files.select("id", title.alias("title"), text.alias("text"), F.when(image, "mirrored-image-v1").otherwise("mirrored-attachment-v1").alias("parser_version"), F.when(image, "image_pending_transcription").otherwise("binary_mirrored").alias("quality"), F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("sha256"))


@query("""SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '([^/]*)/*$', 1) ELSE 'file ' || page_id END AS title,
  CASE WHEN page_id % 2 = 0 THEN '正文图片:' ELSE '附件:' END || CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '([^/]*)/*$', 1) ELSE 'file ' || page_id END || CASE WHEN page_id % 4 <> 0 THEN chr(10) || '所属页面:p' || page_id ELSE '' END || chr(10) || '文件地址:' || url AS text,
  CASE WHEN page_id % 2 = 0 THEN 'mirrored-image-v1' ELSE 'mirrored-attachment-v1' END AS parser_version, CASE WHEN page_id % 2 = 0 THEN 'image_pending_transcription' ELSE 'binary_mirrored' END AS quality, octet_length(encode(html))::INT AS bytes, sha256(html) AS sha256 FROM pages""")
def SC22_mirrored_files(spark, d):
    """Pages as mirrored files: every second an image, every third without a title."""
    i = F.col("page_id")
    files = table(spark, d, "pages").select(i.alias("id"), F.col("url").alias("uri"), F.when(i % 3 != 0, F.concat(F.lit("file "), i)).alias("title"), F.when(i % 2 == 0, "image").otherwise("attachment").alias("kind"), F.when(i % 4 != 0, F.concat(F.lit("p"), i)).alias("parent"), F.col("html").alias("body"))
    return mirrored(files)


# --- status of sources ----------------------------------------------------------------------------------------------

#: States that raise an alert, with its severity, code and rank.
ALERTS = {"failing": ("critical", "SOURCE_CONSECUTIVE_FAILURES", 0), "stale": ("warning", "SOURCE_FRESHNESS_EXCEEDED", 1), "degraded": ("warning", "SOURCE_DEGRADED", 1), "waiting": ("info", "SOURCE_WAITING_FIRST_SYNC", 2)}
NOW = "2024-01-30 20:00:00"


def statuses(sources: DataFrame, runs: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Each source (source, enabled, poll_s) with what it holds, how its runs went, until when it is fresh, and its state.

    runs: source, run, at, status (completed, completed_with_errors, failed, interrupted); versions: source, resource, digest,
    chunks, day.  Of the runs only the newest twenty are ordered, cut before the exchange; the rest is counted.  The state is the
    first that applies: disabled; waiting without any success; failing from three failures in a row on; degraded if the last run
    had faults or there is no resource or chunk; stale after twice the polling time (five minutes at least); else healthy.
    """
    newest = Window.partitionBy("source").orderBy(F.desc("at"), F.desc("run"))
    bad = F.col("status").isin("failed", "interrupted")
    last = runs.withColumn("place", F.row_number().over(newest)).where("place <= 20")
    last = last.withColumn("ok", F.max(F.when(bad, 0).otherwise(1)).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.groupBy("source").agg(F.count_if(F.col("ok") == 0).alias("failures"), F.max_by("status", -F.col("place")).alias("last_status"))
    won = runs.where("status IN ('completed', 'completed_with_errors')").groupBy("source").agg(F.max("at").alias("last_success"))
    held = versions.groupBy("source").agg(F.count_distinct("resource").alias("resources"), F.count_distinct("digest").alias("versions"), F.sum("chunks").alias("chunks"), F.max("day").alias("latest"))
    rows = sources.join(last, "source", "left").join(won, "source", "left").join(held, "source", "left")
    count = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("failures", "resources", "versions", "chunks")}
    rows = rows.withColumns(count).withColumn("fresh_until", F.timestamp_micros(F.unix_micros("last_success") + F.greatest(F.col("poll_s") * 2, F.lit(300)) * 1_000_000))
    state = F.when(~F.col("enabled"), "disabled").when(F.col("last_success").isNull(), "waiting").when(F.col("failures") >= 3, "failing")
    state = state.when(F.col("last_status").isin("failed", "interrupted", "completed_with_errors") | (F.col("resources") == 0) | (F.col("chunks") == 0), "degraded").when(now > F.col("fresh_until"), "stale").otherwise("healthy")
    return rows.withColumn("state", state)


def alerts(rows: DataFrame) -> DataFrame:
    """source, severity, code of those that are neither healthy nor disabled, the gravest first."""
    part = lambda k: F.coalesce(*[F.when(F.col("state") == s, F.lit(x[k])) for s, x in ALERTS.items()])
    return rows.where(F.col("state").isin(*ALERTS)).orderBy(part(2), "source").select("source", part(0).alias("severity"), part(1).alias("code"))


_STATUS = f"""s AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::BIGINT AS k FROM documents WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT source, k, k % 9 <> 8 AS enabled, (k % 5 + 1) * 900 AS poll_s FROM s),
r AS (SELECT source, event_id AS run, ts AS began, CASE WHEN event_type = 'error' OR (k % 4 = 3 AND ts > TIMESTAMP '2024-01-29') THEN 'failed' WHEN event_type = 'purchase' THEN 'completed_with_errors' WHEN event_type = 'signup' THEN 'interrupted' ELSE 'completed' END AS status
  FROM events JOIN s ON user_id % (SELECT count(*) FROM s) = k WHERE k % 10 <> 7),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY began DESC, run DESC) AS place FROM r),
f AS (SELECT source, coalesce(min(place) FILTER (status NOT IN ('failed', 'interrupted')), max(place) + 1) - 1 AS failures, arg_min(status, place) AS last_status, max(began) FILTER (status IN ('completed', 'completed_with_errors')) AS last_success FROM n GROUP BY source),
h AS (SELECT source, count(DISTINCT doc_id) AS resources, count(DISTINCT sha256(text)) AS versions, sum(CASE WHEN n_chars > 3000 THEN n_chars // 3000 ELSE 0 END)::BIGINT AS chunks, max(DATE '2022-01-01' + (doc_id % 900)::INT) AS latest FROM documents GROUP BY source),
t AS (SELECT c.source, enabled, coalesce(resources, 0) AS resources, coalesce(versions, 0) AS versions, coalesce(chunks, 0) AS chunks, latest, least(20, coalesce(failures, 0)) AS failures, last_status, last_success, last_success + to_seconds(greatest(poll_s * 2, 300)) AS fresh_until
  FROM c LEFT JOIN f USING (source) LEFT JOIN h USING (source)),
z AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN last_success IS NULL THEN 'waiting' WHEN failures >= 3 THEN 'failing' WHEN last_status IN ('failed', 'interrupted', 'completed_with_errors') OR resources = 0 OR chunks = 0 THEN 'degraded' WHEN TIMESTAMP '{NOW}' > fresh_until THEN 'stale' ELSE 'healthy' END AS state FROM t)"""


def _status(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    names = docs.groupBy("source").agg(F.lit(1)).select("source")
    s = names.withColumn("k", F.row_number().over(Window.orderBy("source")).cast("long") - 1)  # a row a source
    n = s.count()
    k = F.col("k")
    status = F.when((F.col("event_type") == "error") | ((k % 4 == 3) & (F.col("ts") > F.lit("2024-01-29").cast("timestamp"))), "failed").when(F.col("event_type") == "purchase", "completed_with_errors").when(F.col("event_type") == "signup", "interrupted").otherwise("completed")
    runs = table(spark, d, "events").withColumn("k", F.col("user_id") % n).join(s.where("k % 10 <> 7"), "k").select("source", F.col("event_id").alias("run"), F.col("ts").alias("at"), status.alias("status"))
    held = docs.select("source", F.col("doc_id").alias("resource"), F.sha2("text", 256).alias("digest"), F.when(F.col("n_chars") > 3000, F.floor(F.col("n_chars") / 3000)).otherwise(0).alias("chunks"), published().alias("day"))
    return statuses(s.select("source", (k % 9 != 8).alias("enabled"), ((k % 5 + 1) * 900).alias("poll_s")), runs, held, F.lit(NOW).cast("timestamp"))


@query(f"WITH {_STATUS} SELECT source, resources, versions, chunks, latest::VARCHAR AS latest, failures, last_status, last_success, fresh_until, state FROM z")
def RT13_source_status(spark, d):
    """All that is known of each source, and its state."""
    return _status(spark, d).select("source", "resources", "versions", "chunks", F.col("latest").cast("string").alias("latest"), "failures", "last_status", "last_success", "fresh_until", "state")


@query(f"WITH {_STATUS} SELECT source, CASE state WHEN 'failing' THEN 'critical' WHEN 'waiting' THEN 'info' ELSE 'warning' END AS severity, CASE state WHEN 'failing' THEN 'SOURCE_CONSECUTIVE_FAILURES' WHEN 'stale' THEN 'SOURCE_FRESHNESS_EXCEEDED' WHEN 'degraded' THEN 'SOURCE_DEGRADED' ELSE 'SOURCE_WAITING_FIRST_SYNC' END AS code FROM z WHERE state IN ('failing', 'stale', 'degraded', 'waiting')")
def RT13_source_alerts(spark, d):
    return alerts(_status(spark, d))


# --- access by network ----------------------------------------------------------------------------------------------


def address_number(ip: Column) -> Column:
    """An IPv4 address as a number, also of its form within IPv6; null if it is none."""
    plain = F.regexp_replace(ip, "^(?i)::ffff:", "")
    parts = F.transform(F.split(plain, r"\."), lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("int")))
    fine = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    return F.when(fine, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p))


def network_rule(ip: Column, role: Column, networks: tuple[str, ...], enabled: bool = True, bypass: tuple[str, ...] = ("admin", "contributor")) -> Column:
    """Why a request passes, or denied: no restriction, a role that may pass, or an address in one of the networks (a.b.c.d/n)."""
    number = address_number(ip)
    inside = F.lit(False)
    for network in networks:
        base, _, bits = network.partition("/")
        bits = int(bits or 32)
        first = sum(int(p) << 8 * (3 - k) for k, p in enumerate(base.split("."))) >> (32 - bits)
        inside = inside | (F.shiftright(number, 32 - bits) == first)
    if not enabled:
        return F.lit("disabled")
    reason = F.lit("denied")
    reason = F.when(F.coalesce(inside, F.lit(False)), "allowlist").otherwise(reason)
    for r in reversed(bypass):
        reason = F.when(role == r, f"{r}_bypass").otherwise(reason)
    return reason


@query("""WITH u AS (SELECT DISTINCT user_id, CASE user_id % 11 WHEN 0 THEN 'admin' WHEN 1 THEN 'contributor' ELSE 'visitor' END AS role, user_id * 7919 % 256 AS a, user_id * 104729 % 256 AS b, user_id * 31 % 5 AS k FROM events)
SELECT user_id, role, CASE role WHEN 'admin' THEN 'admin_bypass' WHEN 'contributor' THEN 'contributor_bypass' ELSE CASE WHEN k = 0 AND a BETWEEN 64 AND 127 OR k = 1 AND a = 5 AND b >= 128 OR k = 2 AND a < 192 THEN 'allowlist' ELSE 'denied' END END AS reason FROM u""")
def FI16_network_access(spark, d):
    """Addresses of five kinds, made from the user: of two private networks, mapped into IPv6, and no addresses at all."""
    u, i = table(spark, d, "events").select("user_id").distinct(), F.col("user_id")
    a, b = (i * 7919 % 256).cast("string"), (i * 104729 % 256).cast("string")
    ip = F.element_at(F.array(F.concat_ws(".", F.lit("10"), a, b, F.lit("1")), F.concat_ws(".", F.lit("172.16"), a, b), F.concat(F.lit("::ffff:"), F.concat_ws(".", F.lit("192.168"), a, b)), F.concat_ws(".", F.lit("10.300"), a, b), F.lit("unknown")), (i * 31 % 5 + 1).cast("int"))
    role = F.when(i % 11 == 0, "admin").when(i % 11 == 1, "contributor").otherwise("visitor")
    return u.select("user_id", role.alias("role"), network_rule(ip, role, ("10.64.0.0/10", "172.16.5.128/25", "192.168.0.0/17", "192.168.128.0/18")).alias("reason"))
