"""Joins and predicates across tables: chains, existence, fallbacks, due work, classification of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import AS_OF, SQL_CURRENT, current_documents, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 7, 42, 99999999)")
def SC3_point_lookup(spark, d):
    """Lookups by key are one join with the keys, never a loop."""
    keys = spark.createDataFrame([(k,) for k in (1, 7, 42, 99999999)], "c_custkey long")
    return table(spark, d, "customer").select("c_custkey", "c_name").join(keys, "c_custkey")


@query(f"SELECT d.doc_id, source, quality FROM documents d JOIN labels l USING (doc_id) WHERE {SQL_CURRENT.replace('doc_id NOT', 'd.doc_id NOT')} AND contains(lower(text), 'tion')")
def JO1_search_chain(spark, d):
    """Index hits joined to current documents and their labels."""
    hits = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id")
    return current_documents(spark, d).select("doc_id", "source").join(hits, "doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(value, 0) AS value FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def JO4_task_performance(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0.0)).alias("value"))


@query("SELECT o_orderkey, coalesce(s_name, n_name, 'unknown') AS display FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def JO5_display_name(spark, d):
    """Inner join to the author, left join to the credential, the first name that is there."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = c.join(s, "c_custkey", "left").join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("o_custkey"), F.coalesce("s_name", "n_name", F.lit("unknown")).alias("display"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(named, "o_custkey").select("o_orderkey", "display")


@query("SELECT event_id, c_custkey FROM events JOIN customer ON sha256(c_custkey::VARCHAR) = sha256(user_id::VARCHAR)")
def JO6_token_join(spark, d):
    """Sessions meet their subjects by the hash of a token only."""
    e = table(spark, d, "events").select("event_id", F.sha2(F.col("user_id").cast("string"), 256).alias("token"))
    c = table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("token"))
    return e.join(c, "token").select("event_id", "c_custkey")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def JO8_profile_source(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("r_regionkey = n_regionkey"))
    return table(spark, d, "supplier").join(n, F.expr("n_nationkey = s_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error') OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) OR EXISTS (SELECT 1 FROM conversations WHERE conv_id = c_custkey) OR EXISTS (SELECT 1 FROM pages WHERE page_id = c_custkey) OR EXISTS (SELECT 1 FROM labels WHERE doc_id = c_custkey AND toxic = 1)")
def JO12_any_of_six(spark, d):
    """Subjects that own anything: the keys of six tables as one set, then one semi-join."""
    key = lambda name, column, test="true": table(spark, d, name).where(test).select(F.col(column).cast("long").alias("c_custkey"))
    owned = [key("orders", "o_custkey", "o_orderstatus = 'P'"), key("events", "user_id", "event_type = 'error'"), key("supplier", "s_suppkey"), key("conversations", "conv_id"), key("pages", "page_id"), key("labels", "doc_id", "toxic = 1")]
    every = reduce(lambda a, b: a.unionAll(b), owned)
    return table(spark, d, "customer").select("c_custkey").join(every, "c_custkey", "left_semi")


@query("SELECT c_custkey, (SELECT max(o_orderdate)::DATE::VARCHAR FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
def JO14_scalar_update(spark, d):
    """An update from a correlated subquery is a left join; without a match the column becomes null."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.max("o_orderdate")).cast("string").alias("last_order"))
    return table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")


@query("""SELECT s_suppkey, coalesce(lines, 0) AS lines, coalesce(parts, 0) AS parts, coalesce(returned, 0) AS returned, last_ship::DATE::VARCHAR AS last_ship, coalesce(customers, 0) AS peers FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON c_nationkey = s_nationkey""")
def JO17_joined_aggregates(spark, d):
    """Aggregates of several tables on one row a source: each is grouped once, then joined."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.to_date(F.max("l_shipdate")).cast("string").alias("last_ship"))
    peers = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("peers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(lines, "s_suppkey", "left").join(peers, "s_nationkey", "left").select("s_suppkey", zero("lines"), zero("parts"), zero("returned"), "last_ship", zero("peers"))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def JO18_batched_lookups(spark, d):
    """What would be several lookups for each conversation is one grouped pass."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("SELECT source, doc_id, n_chars FROM documents JOIN (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source) USING (source, doc_id)")
def JO23_current_rebuild(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return docs.join(docs.groupBy("source").agg(F.max("doc_id").alias("doc_id")), ["source", "doc_id"])


@query("SELECT u.user_id, CASE WHEN last_run IS NULL THEN 'never' ELSE 'late' END AS why FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, max(ts) AS last_run FROM events WHERE event_type IN ('view', 'error') GROUP BY 1) r USING (user_id) WHERE last_run IS NULL OR TIMESTAMP '2024-01-30 12:00:00' - last_run >= INTERVAL 1 DAY")
def FI10_due_sources(spark, d):
    """Sources without a finished run, or whose newest began a poll interval ago; interrupted runs don't count."""
    e = table(spark, d, "events")
    runs = e.where(F.col("event_type").isin("view", "error")).groupBy("user_id").agg(F.max("ts").alias("last_run"))
    late = F.col("last_run") <= F.lit("2024-01-29 12:00:00").cast("timestamp")
    joined = e.select("user_id").distinct().join(runs, "user_id", "left").where(F.col("last_run").isNull() | late)
    return joined.select("user_id", F.when(F.col("last_run").isNull(), "never").otherwise("late").alias("why"))


@query(r"SELECT page_id, path = '/' OR (NOT regexp_matches(path, '/(login|search|admin|tag)(/|$)') AND (regexp_matches(path, '\.(html?|pdf|docx?|xlsx?)$') OR NOT contains(regexp_extract(path, '[^/]*$', 0), '.'))) AS content FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), ''), '/') AS path FROM pages)")
def FI13_content_path(spark, d):
    """Whether a path looks like content: the root, no denied segment, and a known suffix or a leaf without a dot."""
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    good = F.col("path").rlike(r"\.(html?|pdf|docx?|xlsx?)$") | ~F.contains(F.regexp_extract("path", "[^/]*$", 0), F.lit("."))
    test = (F.col("path") == "/") | (~F.col("path").rlike("/(login|search|admin|tag)(/|$)") & good)
    return table(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", test.alias("content"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '[?&](page|p)=[0-9]+') THEN 'pagination' WHEN regexp_matches(url, '(/|/list|/index)([?#]|$)') THEN 'listing' ELSE 'detail' END AS kind, regexp_replace(regexp_replace(url, '[?&](page|p)=[0-9]+', '', 'g'), '#.*$', '') AS scope FROM pages")
def FI15_listing_kind(spark, d):
    """Pagination, listing or detail, and the scope that pages of one listing share."""
    kind = F.when(F.col("url").rlike("[?&](page|p)=[0-9]+"), "pagination").when(F.col("url").rlike("(/|/list|/index)([?#]|$)"), "listing").otherwise("detail")
    return table(spark, d, "pages").select("page_id", kind.alias("kind"), F.regexp_replace(F.regexp_replace("url", "[?&](page|p)=[0-9]+", ""), "#.*$", "").alias("scope"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'password|secret') THEN 'refuse' WHEN length(text) < 40 THEN 'clarify' WHEN regexp_matches(lower(text), '^(and|the|of)\b') THEN 'generic' ELSE 'answer' END AS decision FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def FI18_scope_guard(spark, d):
    low = F.lower("text")
    decision = F.when(low.rlike("password|secret"), "refuse").when(F.length("text") < 40, "clarify").when(low.rlike(r"^(and|the|of)\b"), "generic").otherwise("answer")
    return table(spark, d, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", decision.alias("decision"))


@query("""WITH q AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{3,}'), lambda t: t NOT IN ('the', 'and', 'for')) AS terms FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, lower(text) AS answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, len(list_filter(list_distinct(terms), lambda t: contains(answer, t))) > 0 AS bridged FROM q JOIN a USING (conv_id, turn) WHERE terms IS NOT NULL AND answer IS NOT NULL""")
def FI19_lexical_bridge(spark, d):
    """Whether any term of a question (three letters or more, no stop word) stands in the answer that follows."""
    c = table(spark, d, "conversations")
    stop = F.array(*map(F.lit, ("the", "and", "for")))
    q = c.where("role = 'user'").select("conv_id", "turn", F.array_except(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)), stop).alias("terms"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("answer"))
    bridged = F.exists("terms", lambda t: F.contains(F.col("answer"), t))
    return q.join(a, ["conv_id", "turn"]).where("terms IS NOT NULL AND answer IS NOT NULL").select("conv_id", "turn", bridged.alias("bridged"))


@query(r"SELECT conv_id, turn, regexp_matches(lower(text), '\b(all|list|which|every)\b') AS enumeration, regexp_matches(lower(text), '\b(than|versus|or)\b') AS comparison FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def FI20_query_shape(spark, d):
    low = F.lower("text")
    return table(spark, d, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", low.rlike(r"\b(all|list|which|every)\b").alias("enumeration"), low.rlike(r"\b(than|versus|or)\b").alias("comparison"))


@query(r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> '') AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(text) <= 24000 AND len(x) >= 8 AND len(list_distinct(list_filter(x, lambda y: length(y) BETWEEN 2 AND 80 AND NOT regexp_full_match(y, '(?:[0-9a-f_-]{8,}|[0-9]+)')))) >= 5
AND len(list_filter(x, lambda y: length(y) BETWEEN 2 AND 40))::DOUBLE / greatest(len(x), 1) >= 0.55 AND length(text) - length(translate(text, '。！？；', '')) <= greatest(8, len(x) // 3) AS listing FROM l""")
def FI21_scope_listing(spark, d):
    from lakeloom.operators.retrieval import listing

    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", listing(F.col("text")).alias("listing"))


@query("SELECT event_id FROM events WHERE (event_type = 'view' AND (props->>'k') IS NOT NULL) OR (event_type = 'purchase' AND value > 10 AND (props->>'k')::INT > 2)")
def FI22_step_arguments(spark, d):
    """Steps that have the arguments which their tool needs."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(((F.col("event_type") == "view") & k.isNotNull()) | ((F.col("event_type") == "purchase") & (F.col("value") > 10) & (k.cast("int") > 2))).select("event_id")


@query("SELECT user_id, (TIMESTAMP '2024-01-30 00:00:00' - last_seen) <= INTERVAL 12 HOUR AND c_acctbal > 0 AS valid FROM (SELECT user_id, max(ts) AS last_seen FROM events WHERE ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1) JOIN customer ON c_custkey = user_id")
def FI23_session_validity(spark, d):
    """Sessions that were seen lately and whose user is active."""
    seen = table(spark, d, "events").where("ts < '2024-01-30'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_seen"))
    fresh = F.col("last_seen") >= F.lit("2024-01-29 12:00:00").cast("timestamp")
    return seen.join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey").select(F.col("c_custkey").alias("user_id"), (fresh & (F.col("c_acctbal") > 0)).alias("valid"))


@query("SELECT user_id, role, reason FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 11 = 0 THEN 'admin' ELSE 'user' END AS role, '10.' || (user_id % 4) || '.' || (user_id // 256) || '.' || (user_id % 256) AS ip FROM events), LATERAL (SELECT CASE WHEN role = 'admin' THEN 'ADMIN_BYPASS' WHEN regexp_matches(ip, '^10\\.[01]\\.') THEN 'ALLOWLIST' ELSE 'DENIED' END AS reason)")
def FI16_network_rule(spark, d):
    """Membership of 10.0.0.0/15 by the address's first 15 bits, which its first two parts hold; admins pass first.

    Addresses are stand-ins, made from the user: their third part goes past 255 from user 65,536 on, as in the SQL."""
    u = table(spark, d, "events").select("user_id").distinct()
    ip = F.concat(F.lit("10."), F.col("user_id") % 4, F.lit("."), F.floor(F.col("user_id") / 256), F.lit("."), F.col("user_id") % 256)
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).cast("long")
    within = F.shiftright(part(1) * 256 + part(2), 1) == (10 * 256) >> 1
    role = F.when(F.col("user_id") % 11 == 0, "admin").otherwise("user")
    return u.select("user_id", role.alias("role"), F.when(role == "admin", "ADMIN_BYPASS").when(within, "ALLOWLIST").otherwise("DENIED").alias("reason"))


@query("SELECT o_orderkey, coalesce(ship, o_orderdate)::DATE::VARCHAR AS day FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY coalesce(ship, o_orderdate) DESC, o_orderkey LIMIT 40")
def SO5_coalesced_key(spark, d):
    ship = table(spark, d, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    day = F.coalesce("ship", "o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(ship, "o_orderkey", "left").orderBy(day.desc(), "o_orderkey").limit(40).select("o_orderkey", F.to_date(day).cast("string").alias("day"))


@query("SELECT event_id, rank::INT AS rank FROM (SELECT event_id, row_number() OVER (ORDER BY round(value, 0) DESC, event_id) AS rank FROM (SELECT * FROM events ORDER BY event_id LIMIT 160)) WHERE rank <= 48")
def SO9_bounded_trace(spark, d):
    """160 candidates in their order, of which the 48 best are reported."""
    few = table(spark, d, "events").orderBy("event_id").limit(160)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("value", 0)), "event_id"))  # 160 rows
    return few.select("event_id", rank.alias("rank")).where("rank <= 48")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, len(list_filter(['the', 'and', 'ing', 'tion'], lambda t: contains(lower(text), t))) AS score FROM conversations WHERE text IS NOT NULL) ORDER BY score DESC, conv_id, turn LIMIT 50")
def SO10_relevance_then_rank(spark, d):
    """By score; ties keep the order in which they came."""
    score = F.size(F.filter(F.array(*map(F.lit, ("the", "and", "ing", "tion"))), lambda t: F.contains(F.lower("text"), t)))
    return table(spark, d, "conversations").where("text IS NOT NULL").orderBy(score.desc(), "conv_id", "turn").limit(50).select("conv_id", "turn")


@query("SELECT user_id, severity FROM (SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') >= 12 THEN 'error' WHEN count(*) FILTER (event_type = 'error') >= 8 THEN 'warning' ELSE 'info' END AS severity FROM events GROUP BY 1) ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, user_id LIMIT 60")
def SO11_severity_order(spark, d):
    errors = F.count_if(F.col("event_type") == "error")
    severity = F.when(errors >= 12, "error").when(errors >= 8, "warning").otherwise("info")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return table(spark, d, "events").groupBy("user_id").agg(severity.alias("severity")).orderBy(rank, "user_id").limit(60)


@query("SELECT doc_id, tier, rn FROM (SELECT doc_id, source, CASE WHEN source = 'src3' THEN 0 WHEN source IN ('src1', 'src2') THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rn FROM documents) WHERE rn <= 30 ORDER BY tier, rn, source LIMIT 30")
def SO14_pinned_interleave(spark, d):
    """Pinned sources first, then hinted, then open ones, in turns within a tier; each source is cut before the sort."""
    tier = F.when(F.col("source") == "src3", 0).when(F.col("source").isin("src1", "src2"), 1).otherwise(2)
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", tier.alias("tier"), rn.alias("rn")).where("rn <= 30").orderBy("tier", "rn", "source").limit(30).select("doc_id", "tier", "rn")


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT role), ['reader']))), ',') AS roles FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def SE4_set_union(spark, d):
    return table(spark, d, "conversations").where("role IS NOT NULL").groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("role"), F.array(F.lit("reader")))), ",").alias("roles"))


@query("SELECT user_id, len(list_filter(['signup', 'view'], lambda x: NOT list_contains(types, x))) = 0 AS ready FROM (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY 1)")
def SE5_subset_test(spark, d):
    """Whether all that a step depends on is done."""
    needs = F.array(F.lit("signup"), F.lit("view"))
    return table(spark, d, "events").groupBy("user_id").agg((F.size(F.array_except(needs, F.collect_set("event_type"))) == 0).alias("ready"))


@query(r"SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'at': list_position(w, x), 'x': x})), lambda s: s.x)[1:8], ' ') AS words FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE text IS NOT NULL)")
def SE6_ordered_distinct(spark, d):
    """The first eight different words, in order."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.array_join(F.slice(F.array_distinct(words), 1, 8), " ").alias("words"))


@query("SELECT round(avg(x), 9) AS mean, min(x) AS least, count(*) FILTER (x = 1.0) AS complete FROM (SELECT doc_id, ((n_chars > 0)::INT + (source IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (l.doc_id IS NOT NULL)::INT) / 4.0::DOUBLE AS x FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))")
def AG15_quality_summary(spark, d):
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang").join(known, "doc_id", "left")
    x = ((F.col("n_chars") > 0).cast("int") + F.col("source").isNotNull().cast("int") + F.col("lang").isNotNull().cast("int") + F.col("has").isNotNull().cast("int")) / 4.0
    return rows.select(x.alias("x")).agg(F.round(F.avg("x"), 9).alias("mean"), F.min("x").alias("least"), F.count_if(F.col("x") == 1.0).alias("complete"))


@query("SELECT CASE WHEN bool_or(g = 'failed') THEN 'failed' WHEN bool_or(g = 'insufficient_samples') THEN 'incomplete' ELSE 'passed' END AS stage, count(*) FILTER (g = 'failed') AS failed FROM (SELECT event_type, CASE WHEN count(*) < 3 THEN 'insufficient_samples' WHEN avg(value) > 200 THEN 'failed' ELSE 'passed' END AS g FROM events GROUP BY 1)")
def AG16_stage_gate(spark, d):
    """One gate of all scenarios: failed before insufficient before passed."""
    gate = F.when(F.count("*") < 3, "insufficient_samples").when(F.avg("value") > 200, "failed").otherwise("passed")
    g = table(spark, d, "events").groupBy("event_type").agg(gate.alias("g"))
    return g.agg(F.when(F.bool_or(F.col("g") == "failed"), "failed").when(F.bool_or(F.col("g") == "insufficient_samples"), "incomplete").otherwise("passed").alias("stage"), F.count_if(F.col("g") == "failed").alias("failed"))


@query("SELECT count(DISTINCT source) AS sources, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars = 0 OR text IS NULL) AS empty FROM documents")
def AG26_dashboard_totals(spark, d):
    docs = table(spark, d, "documents").select("source", "n_chars", F.col("text").isNull().alias("none"))
    return docs.agg(F.count_distinct("source").alias("sources"), F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if((F.col("n_chars") == 0) | F.col("none")).alias("empty"))


@query("SELECT count(*) AS versions, sum(chunks)::BIGINT AS chunks, sum((chunks > 1)::INT)::BIGINT AS split FROM (SELECT greatest(ceil(length(text) / 4000.0), 1)::BIGINT AS chunks FROM documents WHERE text IS NOT NULL)")
def AG28_reindex_summary(spark, d):
    chunks = F.greatest(F.ceil(F.length("text") / 4000), F.lit(1))
    return table(spark, d, "documents").where("text IS NOT NULL").select(chunks.alias("chunks")).agg(F.count("*").alias("versions"), F.sum("chunks").alias("chunks"), F.sum((F.col("chunks") > 1).cast("int")).alias("split"))


@query(f"SELECT source, count(*) AS documents, count(*) FILTER (date_diff('day', day, DATE '{AS_OF}') <= 180) AS fresh FROM (SELECT source, (DATE '2022-01-01' + (doc_id % 900)::INT) AS day FROM documents) GROUP BY source")
def AG3_fresh_by_source(spark, d):
    from lakeloom.sources.tables import published

    age = F.date_diff(F.lit(AS_OF).cast("date"), published())
    return table(spark, d, "documents").select("source", (age <= 180).alias("new")).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("new").alias("fresh"))


