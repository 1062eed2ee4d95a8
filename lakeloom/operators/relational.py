"""Filters, joins, aggregates, sorts and set operations as they occur in the workload.

Dimension tables (region, nation, sources) have a fixed, small number of rows; Spark broadcasts them by their size.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("SELECT 'c_' || c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer")
def FI1_projection(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("c_"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_totalprice IS NOT NULL AND o_custkey <> 1")
def FI2_comparisons(spark, d):
    o = table(spark, d, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "O") & ~F.coalesce("o_orderpriority", F.lit("")).isin("5-LOW") & F.col("o_totalprice").isNotNull() & (F.col("o_custkey") != 1)).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE starts_with(source, 'src1')")
def FI7_prefix(spark, d):
    return table(spark, d, "documents").where(F.col("source").startswith("src1")).select("doc_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def FI8_time_range(spark, d):
    return table(spark, d, "events").where((F.col("ts") > F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") <= F.lit("2024-01-12").cast("timestamp"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, o_orderdate + INTERVAL 30 DAY) <= TIMESTAMP '1996-01-01'")
def FI9_queue_expiry(spark, d):
    deadline = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return table(spark, d, "orders").where(F.coalesce(deadline, F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")) <= F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE length(p_name) BETWEEN 2 AND 16")
def FI11_length(spark, d):
    return table(spark, d, "part").where(F.length("p_name").between(2, 16)).select("p_partkey")


@query(r"WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority FROM pages), a AS (SELECT *, lower(regexp_replace(authority, ':[0-9]*$', '')) AS host, regexp_extract(authority, ':([0-9]*)$', 1) AS port FROM p) SELECT page_id, NOT contains(authority, '@') AND host IN (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) FROM pages GROUP BY 1 HAVING count(*) >= 3) AND ((scheme = 'https' AND port IN ('', '443')) OR (scheme = 'http' AND port IN ('', '80'))) AS allowed FROM a")
def FI12_url_allowed(spark, d):
    """No user in the address, a registered host (stand-in: hosts of three pages or more), and the scheme's own port."""
    pages = table(spark, d, "pages").select("page_id", "url")
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1))
    hosts = pages.groupBy(host.alias("host")).count().where("count >= 3").select("host", F.lit(True).alias("registered"))
    part = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    rows = pages.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), part.alias("authority"), F.lower(F.regexp_replace(part, ":[0-9]*$", "")).alias("host"), F.regexp_extract(part, ":([0-9]*)$", 1).alias("port"))
    own_port = ((F.col("scheme") == "https") & F.col("port").isin("", "443")) | ((F.col("scheme") == "http") & F.col("port").isin("", "80"))
    allowed = ~F.contains("authority", F.lit("@")) & F.coalesce("registered", F.lit(False)) & own_port
    return rows.join(hosts, "host", "left").select("page_id", allowed.alias("allowed"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(lower(p), '\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(p), '\.(docx?|xlsx?|pptx?|zip|rar|csv|txt)$') OR regexp_matches(lower(q), '(^|&)(file|download|attach)[^=&]*=') THEN 'attachment' WHEN regexp_matches(lower(p), '\.(png|jpe?g|gif|webp)$') THEN 'image' WHEN regexp_matches(lower(title), 'attachment|download') THEN 'attachment' ELSE 'html' END AS kind FROM (SELECT page_id, regexp_extract(url, '^[^?#]*', 0) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)")
def FI14_resource_kind(spark, d):
    """By the path's suffix, then the query, then the title."""
    p, q = F.lower(F.regexp_extract("url", "^[^?#]*", 0)), F.lower(F.regexp_extract("url", r"\?([^#]*)", 1))
    title = F.lower(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    file = p.rlike(r"\.(docx?|xlsx?|pptx?|zip|rar|csv|txt)$") | q.rlike("(^|&)(file|download|attach)[^=&]*=")
    kind = F.when(p.rlike(r"\.pdf$"), "pdf").when(file, "attachment").when(p.rlike(r"\.(png|jpe?g|gif|webp)$"), "image").when(title.rlike("attachment|download"), "attachment").otherwise("html")
    return table(spark, d, "pages").select("page_id", kind.alias("kind"))


@query("SELECT 'year' AS rule, count(*) AS n FROM orders WHERE o_orderdate IS NULL OR year(o_orderdate) >= 1995 UNION ALL SELECT 'ended', count(*) FROM (SELECT coalesce(CASE WHEN event_type <> 'view' THEN ts + INTERVAL 1 DAY END, CASE WHEN event_type <> 'click' THEN ts END) AS fin FROM events) WHERE fin IS NULL OR fin >= TIMESTAMP '2024-01-20'")
def FI17_cut_off(spark, d):
    """What was published before a year goes, and what has ended; rows without a date stay."""
    year = table(spark, d, "orders").where(F.col("o_orderdate").isNull() | (F.year("o_orderdate") >= 1995)).agg(F.count("*").alias("n")).select(F.lit("year").alias("rule"), "n")
    end = F.coalesce(F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 1 DAY")), F.when(F.col("event_type") != "click", F.col("ts")))
    ended = table(spark, d, "events").select(end.alias("fin")).where("fin IS NULL OR fin >= '2024-01-20'").agg(F.count("*").alias("n")).select(F.lit("ended").alias("rule"), "n")
    return year.unionByName(ended)


@query("SELECT r_name, n_name, count(*) AS orders_, max(o_orderdate) AS last_order, round(sum(l_quantity), 2) AS quantity FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name, n_name")
def JO3_chain_counts(spark, d):
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("c_custkey = o_custkey")).join(t("nation"), F.expr("n_nationkey = c_nationkey")).join(t("region"), F.expr("r_regionkey = n_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders_"), F.max("o_orderdate").alias("last_order"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON c_custkey = o_custkey")
def JO2_left_outer(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')")
def JO7_owned_semi(spark, d):
    owned = table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.expr("o_orderkey = l_orderkey"), "left_semi")
    return table(spark, d, "customer").join(owned, F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey")


@query("SELECT source, coalesce(part, 0) AS part, count(doc_id) AS n, coalesce(string_agg(title, ' ' ORDER BY doc_id), '') AS titles FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, doc_id, doc_id // 4096 AS part, substr(text, 1, 80) AS title FROM documents JOIN labels USING (doc_id) WHERE quality = 1) v USING (source) GROUP BY source, coalesce(part, 0)")
def JO9_source_profile(spark, d):
    """The titles of a source's good documents, joined, in parts of at most 4096 ids; sources without any stay.

    The condition on quality stands before the left join, so it drops no source.
    """
    docs = table(spark, d, "documents").select("source", "doc_id", F.substring("text", 1, 80).alias("title"))
    good = docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").withColumn("part", F.floor(F.col("doc_id") / 4096))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "title")))), lambda x: x["title"]), " ")
    return docs.select("source").distinct().join(good, "source", "left").groupBy("source", F.coalesce("part", F.lit(0)).alias("part")).agg(F.count("doc_id").alias("n"), listed.alias("titles"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def JO10_unread_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey) THEN o_custkey ELSE 0 END AS supplier_id, NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey) AS repaired FROM orders")
def JO11_repair_references(spark, d):
    """References to rows that don't exist are emptied (0) and counted as repaired."""
    there = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.lit(True).alias("there"))
    gone = F.col("there").isNull()
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(there, "o_custkey", "left").select("o_orderkey", F.when(gone, 0).otherwise(F.col("o_custkey")).alias("supplier_id"), gone.alias("repaired"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def JO13_scalar_count(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey)")
def JO15_insert_missing(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    new = s.join(c, F.expr("c_custkey = s_suppkey"), "left_anti").select((F.col("s_suppkey") + 1000000).alias("id"))
    return c.select(F.col("c_custkey").alias("id")).unionAll(new)


@query("SELECT o_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
def JO16_grouped_children(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    joined = table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce(F.array_join(F.transform("x", lambda s: s["l_partkey"].cast("string")), ","), F.lit("")).alias("parts"))


@query("WITH s AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/[^/?#]*', 0) AS path FROM pages) SELECT page_id, path FROM (SELECT page_id, path, row_number() OVER (PARTITION BY page_id ORDER BY length(path) DESC, path) AS rn FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) p JOIN s USING (host) WHERE starts_with(url, path)) WHERE rn = 1")
def JO19_best_prefix(spark, d):
    """Each page's site: of the sites of its host (all there are) the one of the longest base path that begins its url.

    A url's own beginnings, as many as its first segment has characters, meet the sites by equality, so a host of very many
    pages and sites is no product of the two.
    """
    host, base = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/]+/[^/?#]*", 0)
    pages = table(spark, d, "pages").select("page_id", host.alias("host"), base.alias("base"))
    sites = pages.select("host", F.col("base").alias("path")).distinct()
    least = F.length(F.regexp_extract("base", "^[a-z]+://[^/]+/", 0))
    begins = F.transform(F.sequence(least, F.length("base")), lambda n: F.substring(F.col("base"), F.lit(1), n))
    held = pages.select("page_id", "host", F.explode(F.array_distinct(F.concat(begins, F.array(F.lit(""))))).alias("path")).join(sites, ["host", "path"])
    return held.groupBy("page_id").agg(F.max_by("path", F.length("path")).alias("path"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position FROM events WHERE event_type = 'error'")
def JO20_queue_position(spark, d):
    """Place in the queue: the rank within the hour and the number of those of earlier hours, so no task sorts the queue."""
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts", F.date_trunc("hour", "ts").alias("cell"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row an hour
    cells = e.groupBy("cell").agg(F.count("*").alias("n")).select("cell", earlier.alias("before"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("ts", "event_id")) - 1
    return e.withColumn("place", place).join(cells, "cell").select("event_id", (F.col("before") + F.col("place")).alias("position"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(value) AS most, min(ts) AS first_ts FROM events GROUP BY user_id")
def AG3_grouped(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("most"), F.min("ts").alias("first_ts"))


@query("SELECT count(*) AS n, count(*) FILTER (value > 100) AS large, count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high FROM events")
def AG1_scalar_counts(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("large"), F.count_distinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def AG4_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("users"))


@query("SELECT replace(event_type, 'err', 'rejection:') AS code, count(*) AS n FROM events WHERE event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1")
def AG20_rejections(spark, d):
    e = table(spark, d, "events").where("event_type IN ('error', 'click') AND ts >= '2024-01-15' AND ts < '2024-01-16'")
    return e.groupBy(F.replace(F.col("event_type"), F.lit("err"), F.lit("rejection:")).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 25 OFFSET 10")
def SO7_offset_page(spark, d):
    return table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").offset(10).limit(25).select("s_suppkey", "s_name")


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) < (60, 2) ORDER BY conv_id DESC, turn DESC LIMIT 21")
def SO8_keyset_page(spark, d):
    c = table(spark, d, "conversations")
    return c.where(F.struct("conv_id", "turn") < F.struct(F.lit(60).cast("long"), F.lit(2).cast("long"))).orderBy(F.desc("conv_id"), F.desc("turn")).limit(21).select("conv_id", "turn")


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'O') DESC, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey LIMIT 50")
def SO4_ranked_sort(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, d, "orders").orderBy((F.col("o_orderstatus") == "O").desc(), rank, "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT doc_id, rn::INT AS rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 40")
def SO12_round_robin(spark, d):
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", rn.alias("rn")).where("rn <= 40").orderBy("rn", "source").limit(40).select("doc_id", "rn")


@query("WITH k AS (SELECT p_partkey, string_agg(lpad(x, 12, '0'), '' ORDER BY i) AS key FROM (SELECT p_partkey, unnest(regexp_extract_all(p_name || '-' || p_size, '[0-9]+|[^0-9]+')) AS x, generate_subscripts(regexp_extract_all(p_name || '-' || p_size, '[0-9]+|[^0-9]+'), 1) AS i FROM part) GROUP BY 1) SELECT p_partkey FROM k ORDER BY key, p_partkey LIMIT 100")
def SO13_natural_sort(spark, d):
    """The first hundred in natural order: every run of digits counts as a number."""
    runs = F.regexp_extract_all(F.concat_ws("-", "p_name", "p_size"), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    key = F.array_join(F.transform(runs, lambda x: F.lpad(x, 12, "0")), "")
    return table(spark, d, "part").orderBy(key, "p_partkey").limit(100).select("p_partkey")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 20000")
def SE1_union_distinct(spark, d):
    key = lambda n, c: table(spark, d, n).select(F.col(c).alias("nation"))
    return key("customer", "c_nationkey").union(key("supplier", "s_nationkey")).union(key("nation", "n_nationkey")).distinct().orderBy("nation").limit(20000)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def SE3_set_difference(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "supplier").where("s_acctbal > 5000"), F.expr("n_nationkey = s_nationkey"), "left_anti").select("n_nationkey")


@query("""WITH a AS (SELECT doc_id, source, 0 AS input FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, source, 1 FROM documents WHERE n_chars > 2000 UNION ALL SELECT doc_id, source, 2 FROM documents),
f AS (SELECT source, min(input * 1000000000000 + doc_id) AS k FROM a GROUP BY source), o AS (SELECT source, k // 1000000000000 AS input, k % 1000000000000 AS doc_id FROM f ORDER BY k LIMIT 15)
SELECT source, input::INT AS first_in, doc_id, count(*) OVER (PARTITION BY input) AS of_input FROM o""")
def SE2_first_wins(spark, d):
    """Three lists one after the other: of each source the first row stays, fifteen in all, with counts of each list."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    lists = [docs.where("lang = 'de'"), docs.where("n_chars > 2000"), docs]
    every = lists[0].select("doc_id", "source", F.lit(0).alias("input"))
    for k, x in enumerate(lists[1:], 1):
        every = every.unionAll(x.select("doc_id", "source", F.lit(k).alias("input")))
    first = every.groupBy("source").agg(F.min(F.struct("input", "doc_id")).alias("x")).select("source", F.col("x.input").alias("first_in"), "x.doc_id")
    few = first.orderBy("first_in", "doc_id").limit(15)
    return few.withColumn("of_input", F.count("*").over(Window.partitionBy("first_in")))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def SE7_intersection(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "supplier").where("s_acctbal < 0"), F.expr("c_nationkey = s_nationkey"), "left_semi").select("c_custkey")
