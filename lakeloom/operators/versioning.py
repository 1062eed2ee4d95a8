"""Versions of documents as rewrites of tables: content hashes, pointers, upserts, merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.windows import running_total
from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("SELECT source, sha256(text) AS content_hash, min(doc_id) AS version_id, count(*) AS seen FROM documents GROUP BY source, sha256(text)")
def DM4_version_dedup(spark, d):
    return table(spark, d, "documents").groupBy("source", F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("version_id"), F.count("*").alias("seen"))


@query("SELECT source, max(doc_id) AS current_version, arg_max(sha256(text), doc_id) AS content_hash FROM documents GROUP BY source")
def SK1_pointer_table(spark, d):
    """The newest version of each source; texts are hashed for those versions only."""
    docs = table(spark, d, "documents")
    newest = docs.groupBy("source").agg(F.max("doc_id").alias("doc_id"))
    return docs.select("source", "doc_id", "text").join(newest, ["source", "doc_id"]).select("source", F.col("doc_id").alias("current_version"), F.sha2("text", 256).alias("content_hash"))


@query("SELECT coalesce(c_custkey, s_suppkey) AS k, CASE WHEN c_custkey IS NULL THEN 'created' WHEN s_suppkey IS NULL THEN 'disabled' WHEN c_nationkey = s_nationkey THEN 'unchanged' ELSE 'updated' END AS action FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def DM1_registry_upsert(spark, d):
    """A registry (customers) against a new list (suppliers): created, disabled, updated or unchanged entries."""
    old = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    new = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    action = F.when(F.col("c_custkey").isNull(), "created").when(F.col("s_suppkey").isNull(), "disabled").when(F.col("c_nationkey") == F.col("s_nationkey"), "unchanged").otherwise("updated")
    return old.join(new, F.expr("c_custkey = s_suppkey"), "full").select(F.coalesce("c_custkey", "s_suppkey").alias("k"), action.alias("action"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.kind, a.kind) AS kind, a.doc_id IS NULL AS created FROM (SELECT doc_id, 'labelled' AS kind FROM labels) a FULL JOIN (SELECT doc_id, lang AS kind FROM documents) b USING (doc_id)")
def DM2_resource_upsert(spark, d):
    """Known resources (labels) and what was seen now (documents): what was seen updates its row or makes one."""
    known = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("old"))
    seen = table(spark, d, "documents").select("doc_id", F.col("lang").alias("new"), F.lit(True).alias("seen"))
    j = known.join(seen, "doc_id", "full")
    return j.select("doc_id", F.coalesce("new", "old").alias("kind"), F.col("old").isNull().alias("created"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN '\"safe-' || sha256(text) || '\"' ELSE '' END AS etag FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def DM3_force_refetch(spark, d):
    """Where the parser that made a version isn't the expected one, its etag is emptied, so it is fetched anew.

    Stand-in: labelled documents were made by the expected parser.
    """
    made = table(spark, d, "labels").select("doc_id").distinct().withColumn("parser", F.lit("2"))
    etag = F.concat(F.lit('"safe-'), F.sha2("text", 256), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", "text").join(made, "doc_id", "left").select("doc_id", F.when(F.col("parser") == "2", etag).otherwise("").alias("etag"))


@query("WITH w AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS expected FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN o_orderstatus = expected THEN 'C' ELSE o_orderstatus END AS status, coalesce(o_orderstatus = expected, false) AS swapped FROM orders LEFT JOIN w USING (o_orderkey)")
def DM5_compare_and_set(spark, d):
    """A status changes only where it is still what the writer saw."""
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("expected"))
    same = F.coalesce(F.col("o_orderstatus") == F.col("expected"), F.lit(False))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(seen, "o_orderkey", "left").select("o_orderkey", F.when(same, "C").otherwise(F.col("o_orderstatus")).alias("status"), same.alias("swapped"))


@query("SELECT doc_id, 'r' || row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS release, sha256(text) AS facts FROM documents")
def DM6_publish_release(spark, d):
    """Each publication is a version of its own, though its facts are the same as before; a text of very many copies is
    numbered in cells of ids."""
    facts = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("facts"))
    numbered = running_total(facts, F.lit(1), F.floor(F.col("doc_id") / 4096), [F.col("doc_id")], [F.col("facts")])
    return numbered.select("doc_id", F.concat(F.lit("r"), F.col("before") + 1).alias("release"), "facts")


@query("SELECT doc_id, 'accepted' AS status, NOT toxic AS is_current FROM (SELECT doc_id, max(toxic) = 1 AS toxic FROM labels GROUP BY 1) UNION ALL SELECT doc_id, 'retracted', true FROM labels GROUP BY doc_id HAVING max(toxic) = 1")
def DM7_retire(spark, d):
    """What is retired gets a tombstone as a new version, and the pointer moves to it."""
    rows = table(spark, d, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("gone")).where("gone IS NOT NULL")
    old = rows.select("doc_id", F.lit("accepted").alias("status"), (~F.col("gone")).alias("is_current"))
    return old.unionByName(rows.where("gone").select("doc_id", F.lit("retracted").alias("status"), F.lit(True).alias("is_current")))


SQL["DM7_retire"] = "SELECT doc_id, 'accepted' AS status, NOT toxic AS is_current FROM (SELECT doc_id, max(toxic) = 1 AS toxic FROM labels GROUP BY 1) WHERE toxic IS NOT NULL UNION ALL SELECT doc_id, 'retracted', true FROM labels GROUP BY doc_id HAVING max(toxic) = 1"


@query("SELECT o_orderkey, bool_or(p_size IS NULL OR p_size > 45) AS source_changed, NOT bool_or(p_size IS NULL OR p_size > 45) AND count(*) >= 2 AS eligible FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def DM8_origins(spark, d):
    """Entries whose origins changed or are gone are marked; the others may be published if they have two origins."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(p, "l_partkey", "left")
    changed = F.bool_or(F.col("p_size").isNull() | (F.col("p_size") > 45))
    return lines.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").groupBy("o_orderkey").agg(changed.alias("source_changed"), (~changed & (F.count("*") >= 2)).alias("eligible"))


@query("SELECT CASE WHEN user_id % 2 = 0 THEN user_id + 1 ELSE user_id END AS owner, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def DM9_reown(spark, d):
    owner = F.when(F.col("user_id") % 2 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    return table(spark, d, "events").groupBy(owner.alias("owner"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT owner, event_type, event_id FROM (SELECT CASE WHEN user_id % 2 = 0 THEN user_id + 1 ELSE user_id END AS owner, event_type, event_id, row_number() OVER (PARTITION BY CASE WHEN user_id % 2 = 0 THEN user_id + 1 ELSE user_id END, event_type ORDER BY user_id % 2 = 0, ts, event_id) AS rn FROM events) WHERE rn = 1")
def DM9_identity_merge(spark, d):
    """Rows of the source subject go to the target; where both have a key the target's first row stays."""
    e = table(spark, d, "events").withColumn("owner", F.when(F.col("user_id") % 2 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    best = F.min_by("event_id", F.struct(F.col("user_id") % 2 == 0, "ts", "event_id"))
    return e.groupBy("owner", "event_type").agg(best.alias("event_id"))


@query("SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE o_custkey END AS owner, o_orderpriority AS public FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE NOT coalesce(c_acctbal < 0 AND o_orderstatus = 'P', false)")
def DM10_cascade(spark, d):
    """Of deleted subjects (a balance below 0) private rows go; public ones stay without their owner."""
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("gone"))
    rows = table(spark, d, "orders").join(gone, "o_custkey", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return rows.where("NOT (gone AND o_orderstatus = 'P')").select("o_orderkey", F.when(F.col("gone"), 0).otherwise(F.col("o_custkey")).alias("owner"), F.col("o_orderpriority").alias("public"))


@query("SELECT c_custkey, CASE WHEN coalesce(n, 0) = 0 THEN 'open' WHEN n < 10 THEN 'answered' ELSE 'resolved' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def DM11_status_from_count(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "open").when(F.col("n") < 10, "answered").otherwise("resolved")
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def DM13_latest_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'confirmed' ELSE 'rejected' END AS status FROM events")
def DM15_first_confirmed(spark, d):
    rn = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return table(spark, d, "events").select("event_id", F.when(rn == 1, "confirmed").otherwise("rejected").alias("status"))


FIELDS = ("lang", "n_chars", "quality", "toxic", "title")


@query("""WITH v AS (SELECT d.doc_id, source, lang, n_chars, substr(text, 1, 80) AS title, quality, toxic FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
p AS (SELECT *, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS other_id FROM v)
SELECT a.doc_id, a.other_id, a.n_chars - b.n_chars AS grown, array_to_string(list_filter([CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END, CASE WHEN a.quality IS DISTINCT FROM b.quality THEN 'quality' END, CASE WHEN a.toxic IS DISTINCT FROM b.toxic THEN 'toxic' END, CASE WHEN a.title IS DISTINCT FROM b.title THEN 'title' END], lambda x: x IS NOT NULL), ',') AS changed
FROM p a JOIN v b ON b.doc_id = a.other_id""")
def RT14_version_compare(spark, d):
    """Each version against the one before it of its source, and which fields differ.

    Versions lie in cells of 4096 ids; only the last id of each cell is carried on along a source, so no task sorts one.
    """
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.substring("text", 1, 80).alias("title"), F.floor(F.col("doc_id") / 4096).alias("cell"))
    cells = docs.groupBy("source", "cell").agg(F.max("doc_id").alias("last"))
    earlier = cells.select("source", "cell", F.lag("last").over(Window.partitionBy("source").orderBy("cell")).alias("carried"))
    near = F.lag("doc_id").over(Window.partitionBy("source", "cell").orderBy("doc_id"))
    v = docs.join(labels, "doc_id", "left")
    p = docs.select("doc_id", "source", "cell", near.alias("near")).join(earlier, ["source", "cell"]).select("doc_id", F.coalesce("near", "carried").alias("other_id")).where("other_id IS NOT NULL")
    a, b = v.select("doc_id", F.struct(*FIELDS).alias("a")), v.select(F.col("doc_id").alias("other_id"), F.struct(*FIELDS).alias("b"))
    changed = F.concat_ws(",", *[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in FIELDS])
    return p.join(a, "doc_id").join(b, "other_id").select("doc_id", "other_id", (F.col("a.n_chars") - F.col("b.n_chars")).alias("grown"), changed.alias("changed"))


@query("""WITH f AS (SELECT doc_id, source, sha256(text) AS h FROM documents), k AS (SELECT DISTINCT source, h FROM f WHERE doc_id IN (SELECT doc_id FROM labels)),
r AS (SELECT f.source, CASE WHEN f.h IS NULL THEN 'failed' WHEN k.h IS NOT NULL THEN 'unchanged' WHEN row_number() OVER (PARTITION BY f.source, f.h ORDER BY f.doc_id) > 1 THEN 'unchanged' ELSE 'created' END AS result FROM f LEFT JOIN k ON k.source = f.source AND k.h = f.h)
SELECT source, count(*) AS discovered, count(*) FILTER (result <> 'failed') AS fetched, count(*) FILTER (result = 'created') AS created, count(*) FILTER (result = 'unchanged') AS unchanged, count(*) FILTER (result = 'failed') AS failed, CASE WHEN bool_or(result = 'failed') THEN 'completed_with_errors' ELSE 'completed' END AS status FROM r GROUP BY source""")
def RT18_sync_run(spark, d):
    """A sync of all sources: what is fetched makes a version unless its hash is known (labelled documents stand in for the
    versions of earlier runs) or came earlier in this run; counts and status of each source's run."""
    f = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    known = f.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("source", "h").where("h IS NOT NULL").distinct().withColumn("known", F.lit(True))
    # of equal hashes one is new; a count per hash does instead of an order within it
    per = f.groupBy("source", "h").agg(F.count("*").alias("n")).join(known, ["source", "h"], "left")
    new = F.when(F.col("h").isNotNull() & F.col("known").isNull(), 1).otherwise(0)
    bad = F.when(F.col("h").isNull(), F.col("n")).otherwise(0)
    sums = per.groupBy("source").agg(F.sum("n").alias("discovered"), F.sum(new).alias("created"), F.sum(bad).alias("failed"))
    return sums.select("source", "discovered", (F.col("discovered") - F.col("failed")).alias("fetched"), "created", (F.col("discovered") - F.col("failed") - F.col("created")).alias("unchanged"), "failed", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed").alias("status"))


@query("SELECT substr(sha256(text), 1, 2) AS prefix, count(DISTINCT sha256(text)) AS objects FROM documents WHERE text IS NOT NULL GROUP BY 1")
def SK2_snapshots(spark, d):
    """Content-addressed snapshots: each different text once, compressed, in a folder by the first two digits of its hash."""
    from lakeloom.sources.store import shared_folder

    texts = table(spark, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("sha"), "text").dropDuplicates(["sha"])
    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    texts.withColumn("prefix", F.substring("sha", 1, 2)).repartitionByRange("sha").write.partitionBy("prefix").option("compression", "gzip").parquet(path)
    kept = spark.read.schema("sha string, text string, prefix string").parquet(path)
    return kept.where(F.sha2("text", 256) == F.col("sha")).groupBy("prefix").agg(F.count("*").alias("objects"))


@query("SELECT 'documents' AS name, count(*) AS n, true AS ok FROM documents UNION ALL SELECT 'labels', count(*), true FROM labels")
def SK8_backup_check(spark, d):
    """Copies two tables and compares counts and an order-free hash of the copies with the originals."""
    from lakeloom.sources.store import kept

    def check(name):
        a = table(spark, d, name)
        b = kept(a, f"backup-{name}")
        total = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)")).alias("h"))
        return total(a).crossJoin(total(b).toDF("n2", "h2")).select(F.lit(name).alias("name"), "n", ((F.col("n") == F.col("n2")) & F.col("h").eqNullSafe(F.col("h2"))).alias("ok"))

    return check("documents").unionByName(check("labels"))


@query("""SELECT *, bool_or(required AND NOT ok) OVER () AS fatal FROM (SELECT 'documents_present' AS name, true AS required, count(*) > 0 AS ok FROM documents UNION ALL SELECT 'ids_unique', true, count(*) = count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'labels_complete', false, count(*) FILTER (l.doc_id IS NULL) = 0 FROM documents d LEFT JOIN labels l USING (doc_id))""")
def SK9_preflight(spark, d):
    """Named checks, whether each is needed, and whether any that is needed fails."""
    docs = table(spark, d, "documents").select("doc_id")
    row = lambda df, name, required, ok: df.agg(ok.alias("ok")).select(F.lit(name).alias("name"), F.lit(required).alias("required"), "ok")
    known = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has"))
    checks = row(docs, "documents_present", True, F.count("*") > 0).unionByName(row(docs, "ids_unique", True, F.count("*") == F.count_distinct("doc_id"))).unionByName(row(docs.join(known, "doc_id", "left"), "labels_complete", False, F.count_if(F.col("has").isNull()) == 0))
    return checks.withColumn("fatal", F.bool_or(F.col("required") & ~F.col("ok")).over(Window.partitionBy()))


@query(r"""SELECT event_id, '{"event":"' || event_type || '"' || CASE WHEN value > 400 THEN ',"slow":' || value::VARCHAR ELSE '' END || ',"user":' || user_id || '}' AS line FROM events""")
def SK7_structured_log(spark, d):
    """A log line of allowed fields only; fields without a value are left out."""
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("event"), F.when(F.col("value") > 400, F.col("value")).alias("slow"), F.col("user_id").alias("user"))).alias("line"))


def merged_attributes(rows: DataFrame) -> DataFrame:
    """owner, id, key, status, moved after a visitor's attributes went to the owner of its account.

    rows: owner (after the merge), visitor (whether the row was the visitor's), id, key, status.  Of a visitor's confirmed
    values of a key the first stays confirmed, if the owner has confirmed none; the others become suggestions.  All else
    keeps its status.  The first is a minimum over (owner, key), met by a join, so no group is sorted.
    """
    confirmed = F.col("status") == "confirmed"
    held = rows.where(confirmed).groupBy("owner", "key").agg(F.bool_or(~F.col("visitor")).alias("own"), F.min(F.when(F.col("visitor"), F.col("id"))).alias("first"))
    both = rows.join(held, ["owner", "key"], "left")
    loses = F.col("visitor") & confirmed & (F.col("own") | (F.col("id") != F.col("first")))
    return both.select("owner", "id", "key", F.when(loses, "suggested").otherwise(F.col("status")).alias("status"), F.col("visitor").alias("moved"))


@query("""WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN user_id + 1 ELSE user_id END AS owner, user_id % 2 = 0 AS visitor, event_id AS id, event_type || event_id % 7 AS key, ['confirmed', 'suggested', 'dismissed'][event_id % 3 + 1] AS status FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY owner, key, visitor, status ORDER BY id) AS n, max(CASE WHEN NOT visitor AND status = 'confirmed' THEN 1 ELSE 0 END) OVER (PARTITION BY owner, key) AS own FROM r)
SELECT owner, id, key, CASE WHEN visitor AND status = 'confirmed' AND (own = 1 OR n > 1) THEN 'suggested' ELSE status END AS status, visitor AS moved FROM s""")
def DM9_attribute_clash(spark, d):
    """Attributes after even users went over to the next one's account.  Stand-in: events are attributes."""
    even = F.col("user_id") % 2 == 0
    status = F.element_at(F.array(*map(F.lit, ("confirmed", "suggested", "dismissed"))), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, d, "events").select(F.when(even, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("owner"), even.alias("visitor"), F.col("event_id").alias("id"), F.concat("event_type", F.col("event_id") % 7).alias("key"), status.alias("status"))
    return merged_attributes(e)


def once_by_client(messages: DataFrame) -> DataFrame:
    """The messages (conversation, client_id, at, ...) of which a client's repeats came in once; those without client_id all stay.

    Of repeats the least `at` is kept by a minimum of whole rows, which tasks take before the exchange.
    """
    named = messages.where("client_id IS NOT NULL")
    rest = [c for c in messages.columns if c not in ("conversation", "client_id", "at")]
    first = named.groupBy("conversation", "client_id").agg(F.min(F.struct("at", *rest)).alias("x")).select("conversation", "client_id", "x.*")
    return first.select(*messages.columns).unionByName(messages.where("client_id IS NULL"))


@query("""WITH m AS (SELECT conv_id AS conversation, CASE WHEN turn % 3 <> 2 THEN turn // 3 END AS client_id, turn AS place, role FROM conversations)
SELECT * FROM m WHERE client_id IS NULL UNION ALL SELECT conversation, client_id, min(place) AS place, arg_min(role, place) AS role FROM m WHERE client_id IS NOT NULL GROUP BY conversation, client_id""")
def ST12_client_messages(spark, d):
    """Stand-in: of three turns the first two carry one client id, the third none."""
    turn = F.col("turn")
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation"), F.when(turn % 3 != 2, F.floor(turn / 3)).alias("client_id"), turn.alias("at"), "role")
    return once_by_client(m).select("conversation", "client_id", F.col("at").alias("place"), "role")


#: How long rows are kept: admissions 48 hours, verifications 24 hours, counters while their local day is one of the last two.
def kept_rows(rows: DataFrame, now: str, offset_h: int = 8) -> DataFrame:
    """rows (kind: admission, verification or counter; at) that a clean-up leaves."""
    clock = F.lit(now).cast("timestamp")
    day = lambda t: F.to_date(t + F.expr(f"INTERVAL {offset_h} HOURS"))
    age = F.when(F.col("kind") == "admission", F.col("at") >= clock - F.expr("INTERVAL 48 HOURS")).when(F.col("kind") == "verification", F.col("at") >= clock - F.expr("INTERVAL 24 HOURS"))
    return rows.where(age.when(F.col("kind") == "counter", day(F.col("at")) >= F.date_sub(day(clock), 1)))


@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'admission' WHEN 'click' THEN 'verification' ELSE 'counter' END AS kind, ts FROM events)
SELECT event_id, kind FROM r WHERE CASE kind WHEN 'admission' THEN ts >= TIMESTAMP '2024-01-29 18:00:00' - INTERVAL 48 HOUR WHEN 'verification' THEN ts >= TIMESTAMP '2024-01-29 18:00:00' - INTERVAL 24 HOUR ELSE (ts + INTERVAL 8 HOUR)::DATE >= DATE '2024-01-29' END""")
def ST6_retentions(spark, d):
    """Stand-in: views are admissions, clicks verifications, other events counters."""
    kind = F.when(F.col("event_type") == "view", "admission").when(F.col("event_type") == "click", "verification").otherwise("counter")
    return kept_rows(table(spark, d, "events").select("event_id", kind.alias("kind"), F.col("ts").alias("at")), "2024-01-29 18:00:00").select("event_id", "kind")
