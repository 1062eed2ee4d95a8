"""Payloads to documents, and the scalar functions that clean, compare and classify their fields.

Payloads are columns: JSON and HTML come from the test tables, fetching is no part of this.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lakeloom.functions.likeness import alike, contained
from lakeloom.operators.content import boilerplate_sql, without_boilerplate
from lakeloom.sources.store import kept, new_folder
from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- listings -------------------------------------------------------------------------------------------------------

ITEM = "id long, name string, startTime long, endTime long, registrationDeadline long, secret string"


def listing_payloads(spark, d) -> DataFrame:
    """Stand-in for pages of a listing: the events of a user and day as one JSON answer."""
    e = table(spark, d, "events")
    ms = F.unix_millis("ts")
    item = F.struct(F.when(F.col("event_id") % 50 != 0, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 41 != 0, F.col("event_type")).alias("name"), ms.alias("startTime"), F.when(F.col("event_type") != "view", ms + F.round(F.col("value") * 60000).cast("long")).alias("endTime"), F.lit(None).cast("long").alias("registrationDeadline"), F.lit("x").alias("secret"))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("data")).alias("data"))).alias("body"))


@query("""SELECT event_id AS id, event_type AS name, '"safe-' || sha256('{"endTime":' || coalesce(fin::VARCHAR, 'null') || ',"id":' || event_id || ',"name":"' || event_type || '","startTime":' || (epoch_us(ts) // 1000) || '}') || '"' AS etag
FROM (SELECT *, CASE WHEN event_type <> 'view' THEN epoch_us(ts) // 1000 + round(value * 60000)::BIGINT END AS fin FROM events) WHERE event_id % 50 <> 0 AND event_id % 41 <> 0 AND coalesce(fin, epoch_us(ts) // 1000) >= epoch_us(TIMESTAMP '2024-01-20') // 1000""")
def SC8_listing_items(spark, d):
    """Items of the answers: those without id or name are skipped, those that ended before now are dropped (end, else
    start, else deadline), and the etag is the hash of the allowed fields in order, nulls written out."""
    items = listing_payloads(spark, d).select(F.explode(F.from_json("body", f"data struct<data array<struct<{ITEM.replace(' ', ': ').replace(',:', ',')}>>>")["data"]["data"]).alias("x")).select("x.*")
    ends = F.coalesce("endTime", "startTime", "registrationDeadline")
    now = F.unix_millis(F.lit("2024-01-20").cast("timestamp"))
    safe = F.to_json(F.struct("endTime", "id", "name", "startTime"), {"ignoreNullFields": "false"})
    return items.where(F.col("id").isNotNull() & F.col("name").isNotNull() & (ends.isNull() | (ends >= now))).select("id", "name", F.concat(F.lit('"safe-'), F.sha2(safe, 256), F.lit('"')).alias("etag"))


@query("SELECT event_id, 'title: ' || event_type || CASE WHEN value > 250 THEN chr(10) || 'speaker: ' || user_id ELSE '' END || chr(10) || 'starts: ' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS text FROM events")
def SC23_labelled_text(spark, d):
    """An item as lines of label and value; empty values have no line."""
    line = lambda label, v: F.concat(F.lit(f"{label}: "), v)
    start = F.date_format(F.from_utc_timestamp("ts", "Asia/Shanghai"), "yyyy-MM-dd HH:mm")
    return table(spark, d, "events").select("event_id", F.concat_ws("\n", line("title", F.col("event_type")), F.when(F.col("value") > 250, line("speaker", F.col("user_id"))), line("starts", start)).alias("text"))


@query(r"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) END AS text, CASE WHEN length(CASE WHEN page_id % 5 = 0 THEN url ELSE trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) END) >= 40 THEN 'accepted' ELSE 'low_text' END AS quality FROM pages")
def SC24_cms_document(spark, d):
    """A message's HTML as text, unless it is only a link; accepted from 40 characters on."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    text = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(plain)
    return table(spark, d, "pages").select("page_id", text.alias("text")).withColumn("quality", F.when(F.length("text") >= 40, "accepted").otherwise("low_text"))


@query("""SELECT page_id, CASE WHEN starts_with(html, '%PDF') THEN 'pdf' WHEN regexp_matches(url, '\\.(docx|xlsx|pptx)([?#]|$)') THEN 'ooxml' WHEN regexp_matches(url, '\\.(txt|csv)([?#]|$)') THEN 'text' WHEN regexp_matches(url, '\\.(png|jpe?g|gif|zip)([?#]|$)') THEN 'binary' WHEN regexp_matches(url, '/api/lecture') THEN 'lecture' WHEN starts_with(html, '{') THEN 'cms' ELSE 'html' END AS parser FROM pages""")
def SC16_parser_dispatch(spark, d):
    """The parser of a payload: magic bytes first, then suffixes, then the profile; order matters."""
    has = lambda p: F.col("url").rlike(p)
    parser = F.when(F.col("html").startswith("%PDF"), "pdf").when(has(r"\.(docx|xlsx|pptx)([?#]|$)"), "ooxml").when(has(r"\.(txt|csv)([?#]|$)"), "text").when(has(r"\.(png|jpe?g|gif|zip)([?#]|$)"), "binary").when(has("/api/lecture"), "lecture").when(F.col("html").startswith("{"), "cms").otherwise("html")
    return table(spark, d, "pages").select("page_id", parser.alias("parser"))


_BODY = r"coalesce(nullif(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(html, '(?s)<main[^>]*>(.*?)</main>', 1), ''), html)"
_PLAIN = rf"trim(regexp_replace(regexp_replace({boilerplate_sql(_BODY)}, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


@query(rf"SELECT page_id, trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''), nullif(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), ''), url), '<[^>]*>', '', 'g')) AS title, substr({_PLAIN}, 1, 600000) AS body, CASE WHEN length({_PLAIN}) >= 80 THEN 'accepted' ELSE 'low_text' END AS quality FROM pages")
def SC17_html_document(spark, d):
    """A page as a document: the first title that there is, the first content part that there is, no boilerplate, at most
    600,000 characters, accepted from 80 on."""
    first = lambda *tags: F.coalesce(*[F.nullif(F.regexp_extract("html", f"(?s)<{t}[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in tags])
    part = F.coalesce(first("article", "main"), "html")
    plain = F.trim(F.regexp_replace(F.regexp_replace(without_boilerplate(part), "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    title = F.trim(F.regexp_replace(F.coalesce(first("h1", "title"), "url"), "<[^>]*>", ""))
    return table(spark, d, "pages").select("page_id", title.alias("title"), plain.alias("body")).select("page_id", "title", F.substring("body", 1, 600000).alias("body"), F.when(F.length("body") >= 80, "accepted").otherwise("low_text").alias("quality"))


@query("SELECT p_partkey, string_agg(lpad(x, 12, '0'), '' ORDER BY i) AS natural_key FROM (SELECT p_partkey, unnest(regexp_extract_all(p_name || '-' || p_size, '[0-9]+|[^0-9]+')) AS x, generate_subscripts(regexp_extract_all(p_name || '-' || p_size, '[0-9]+|[^0-9]+'), 1) AS i FROM part) GROUP BY p_partkey")
def SC26_natural_order(spark, d):
    """A key that sorts runs of digits as numbers, all of them."""
    runs = F.regexp_extract_all(F.concat_ws("-", "p_name", "p_size"), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(runs, lambda x: F.lpad(x, 12, "0")), "").alias("natural_key"))


@query("SELECT o_orderkey, epoch_us(o_orderdate - INTERVAL 8 HOUR) AS utc_us FROM orders")
def SC28_local_times(spark, d):
    """Times without a zone are Shanghai's."""
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(F.to_utc_timestamp("o_orderdate", "Asia/Shanghai")).alias("utc_us"))


def ocr_rows(words: DataFrame) -> DataFrame:
    """page, row, text, cells of recognised words (page, text, x, y, width, height), by rows of the layout, top row first.

    Words go by centre and left edge; each joins the nearest of the last eight rows whose mean centre is within max(4, 0.65
    times the lesser height), or begins one.  The fold is an aggregate over the words of a page, which is what one image
    holds.
    """
    kind = "array<struct<sum:double,n:int,height:double,top:double,cells:array<struct<x:double,k:int,text:string>>>>"
    word = F.struct((F.col("y") + F.col("height") / 2).cast("double").alias("centre"), F.col("x").cast("double").alias("x"), "text", F.col("y").cast("double").alias("top"), F.col("height").cast("double").alias("height"))
    pages = words.groupBy("page").agg(F.array_sort(F.collect_list(word)).alias("words"))

    def joined(rows: Column, w: Column) -> Column:
        skipped = F.greatest(F.size(rows) - 8, F.lit(0))
        gaps = F.transform(F.slice(rows, skipped + 1, F.lit(8)), lambda r, k: F.struct(F.abs(r["sum"] / r["n"] - w["centre"]).alias("gap"), (skipped + k).alias("at"), r["height"].alias("height")))
        nearest = F.array_min(F.filter(gaps, lambda g: g["gap"] <= F.greatest(F.lit(4.0), 0.65 * F.least(g["height"], w["height"]))))["at"]
        cell = lambda k: F.array(F.struct(w["x"].alias("x"), k.alias("k"), w["text"].alias("text")))
        row = lambda total, n, height, top, cells: F.struct(total.alias("sum"), n.alias("n"), height.alias("height"), top.alias("top"), cells.alias("cells"))
        last = F.transform(F.slice(rows, skipped + 1, F.lit(8)), lambda r, k: F.when(skipped + k == nearest, row(r["sum"] + w["centre"], r["n"] + 1, F.greatest(r["height"], w["height"]), F.least(r["top"], w["top"]), F.concat(r["cells"], cell(r["n"])))).otherwise(r))
        grown = F.concat(F.slice(rows, F.lit(1), skipped), last)  # rows before stay as they are
        return F.when(nearest.isNotNull(), grown).otherwise(F.concat(rows, F.array(row(w["centre"], F.lit(1), w["height"], w["top"], cell(F.lit(0))))))

    rows = pages.select("page", F.aggregate("words", F.array().cast(kind), joined).alias("rows"))
    ordered = F.array_sort(F.transform("rows", lambda r, k: F.struct(r["top"].alias("top"), k.alias("k"), r["cells"].alias("cells"))))
    texts = F.transform(ordered, lambda r: F.struct(F.array_join(F.transform(F.array_sort(r["cells"]), lambda c: c["text"]), " | ").alias("text"), F.size(r["cells"]).alias("cells")))
    return rows.select("page", F.posexplode(texts).alias("row", "x")).select("page", F.col("row").cast("long").alias("row"), "x.text", "x.cells")


def ocr_text(words: DataFrame) -> DataFrame:
    """page, text of recognised words: page, line, k (place in the line), text, x, y, width, height.

    Where each line of a page has a word with a box, its lines are set in rows, and rows of two cells, mostly a name and its
    value, stand once more before all rows.  Other pages are their lines, each its words without blanks.  Words without text
    don't count; of a line with boxes only words that have one do.
    """
    said = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").repartition("page")  # all that follows goes by page
    boxed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    joined = lambda order, test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(F.col(order).alias("o"), F.col("k").alias("k"), F.trim("text").alias("text"))))), lambda w: w["text"]), "")
    lines = said.groupBy("page", "line").agg(
        F.bool_or(boxed).alias("placed"), joined("x", boxed).alias("set"), joined("k", F.lit(True)).alias("plain"),
        F.min(F.when(boxed, F.col("x"))).alias("x"), F.min(F.when(boxed, F.col("y"))).alias("y"),
        F.max(F.when(boxed, F.col("x") + F.col("width"))).alias("right"), F.max(F.when(boxed, F.col("y") + F.col("height"))).alias("bottom"),
    )
    pages = lines.groupBy("page").agg(F.bool_and("placed").alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "plain"))), lambda x: x["plain"]), "\n").alias("plain"))
    rows = ocr_rows(lines.join(pages.where("all").select("page"), "page", "left_semi").select("page", F.col("set").alias("text"), "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height")))
    parts = rows.select("page", F.explode(F.when(F.col("cells") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("part"), "row", "text")
    laid = parts.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "row", "text"))), lambda x: x["text"]), "\n").alias("laid"))
    return pages.join(laid, "page", "left").select("page", F.coalesce("laid", "plain").alias("text"))


@query(r"""WITH w AS (SELECT conv_id * 1000 + turn AS page, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ 	-
]+') AS x FROM conversations WHERE text IS NOT NULL)),
r AS (SELECT page, i // 3 AS n, string_agg(w, ' | ' ORDER BY i) AS t, count(*) AS cells FROM w GROUP BY ALL),
p AS (SELECT page, 0 AS part, n, t FROM r WHERE cells = 2 UNION ALL SELECT page, 1, n, t FROM r)
SELECT page, CASE WHEN page % 7 = 0 THEN (SELECT string_agg(w, chr(10) ORDER BY i) FROM w WHERE w.page = p.page) ELSE string_agg(t, chr(10) ORDER BY part, n) END AS text FROM p GROUP BY page""")
def SC25_page_text(spark, d):
    """Stand-in: a turn is a page whose words stand in three columns, somewhat out of line; every seventh page has a word
    without a box."""
    page = F.col("conv_id") * 1000 + F.col("turn")
    words = table(spark, d, "conversations").where("text IS NOT NULL").select(page.alias("page"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("i", "text"))
    i, column = F.col("i"), F.col("i") % 3
    x = F.when((F.col("page") % 7 != 0) | (i > 0), (column * 100).cast("double"))
    y = (F.floor(i / 3) * 20 + column * 2).cast("double")
    return ocr_text(words.select("page", i.alias("line"), F.lit(0).alias("k"), "text", x.alias("x"), y.alias("y"), F.lit(50.0).alias("width"), F.lit(12.0).alias("height")))


def validated(sources: DataFrame) -> DataFrame:
    """Findings of a source registry (id, base_url, allowed_hosts array): id, problem.

    Ids are unique, hosts are compared in lower case without blanks, and a source's own address is on its list.
    """
    twice = sources.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("problem"))
    hosts = F.array_distinct(F.transform("allowed_hosts", lambda h: F.lower(F.trim(h))))
    host = F.lower(F.regexp_extract("base_url", "^[A-Za-z]+://([^/:?#]+)", 1))
    bad = F.when(host == "", "malformed_url").when(~F.array_contains(hosts, host), "host_not_allowed").when(F.size(hosts) == 0, "no_hosts")
    return twice.unionByName(sources.select("id", bad.alias("problem")).where("problem IS NOT NULL"))


@query(r"""WITH s AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS id, url, CASE WHEN page_id % 4 = 0 THEN ['other.example'] ELSE [' ' || upper(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))] END AS hosts FROM pages)
SELECT id, 'duplicate_id' AS problem, 1 AS n FROM s GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'host_not_allowed', count(*) FROM s WHERE NOT list_contains(list_transform(hosts, lambda h: lower(trim(h))), lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))) GROUP BY id""")
def SC1_registry_findings(spark, d):
    """Stand-in for a registry: pages as sources named by their host, every fourth with a foreign list of hosts."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    hosts = F.when(F.col("page_id") % 4 == 0, F.array(F.lit("other.example"))).otherwise(F.array(F.concat(F.lit(" "), F.upper(host))))
    sources = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("id"), F.col("url").alias("base_url"), hosts.alias("allowed_hosts"))
    return validated(sources).groupBy("id", "problem").agg(F.count("*").alias("n"))


#: Readers by the kind of a source; each takes (spark, path).
READERS = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path: spark.read.option("multiLine", True).json(path),
    "csv": lambda spark, path: spark.read.option("header", True).csv(path),
    "text": lambda spark, path: spark.read.text(path, wholetext=True),
    "binary": lambda spark, path: spark.read.format("binaryFile").load(path),
}


def read(spark, kind: str, path: str) -> DataFrame:
    """The reader of a kind; an unknown kind is an error."""
    if kind not in READERS:
        raise ValueError(f"no reader for sources of kind {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path)


@query("""WITH i AS (SELECT event_type AS channel, event_id % 700 AS id, ts FROM events WHERE value IS NOT NULL AND ts >= TIMESTAMP '2024-01-05'),
u AS (SELECT channel, id, max(ts) AS ts FROM i GROUP BY channel, id), n AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, id) AS turn FROM u QUALIFY turn <= 60),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, channel) AS seen FROM n) SELECT channel, id, turn::INT AS turn FROM f WHERE seen = 1 ORDER BY turn, channel LIMIT 60""")
def SC9_channel_listing(spark, d):
    """Listings of several channels: once an id within a channel, nothing before the cut-off, channels in turns, an id that
    several channels have by the first.  Each channel is cut before the merge."""
    items = table(spark, d, "events").where("value IS NOT NULL AND ts >= '2024-01-05'").select(F.col("event_type").alias("channel"), (F.col("event_id") % 700).alias("id"), "ts")
    turn = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("ts"), "id"))
    few = items.groupBy("channel", "id").agg(F.max("ts").alias("ts")).withColumn("turn", turn).where("turn <= 60")
    seen = F.row_number().over(Window.partitionBy("id").orderBy("turn", "channel"))
    return few.withColumn("seen", seen).where("seen = 1").orderBy("turn", "channel").limit(60).select("channel", "id", "turn")


@query("SELECT c_custkey, '\"safe-' || sha256('{\"c_acctbal\":' || CASE WHEN c_nationkey = 3 THEN 'null' ELSE c_nationkey::VARCHAR END || ',\"c_name\":\"' || c_name || '\"}') || '\"' AS etag FROM customer")
def SC10_safe_etag(spark, d):
    """The hash of the allowed fields as JSON with sorted keys; nulls are written, other fields don't count."""
    safe = F.to_json(F.struct(F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("c_acctbal"), "c_name"), {"ignoreNullFields": "false"})
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit('"safe-'), F.sha2(safe, 256), F.lit('"')).alias("etag"))


@query("SELECT doc_id, length(trim(replace(text, chr(13), ''))) AS chars, CASE WHEN length(trim(replace(text, chr(13), ''))) = 0 THEN 'binary_mirrored' ELSE 'accepted' END AS quality FROM documents WHERE text IS NOT NULL")
def SC21_text_attachment(spark, d):
    """Bytes of a text attachment as text, wrong bytes replaced; without text it is kept as a mirror only."""
    raw = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    text = F.trim(F.replace(F.decode("content", "UTF-8"), F.lit("\r"), F.lit("")))
    return raw.select("doc_id", F.length(text).cast("long").alias("chars"), F.when(F.length(text) == 0, "binary_mirrored").otherwise("accepted").alias("quality"))


@query("SELECT page_id, 'pdf_pending_ocr' AS quality, sha256(html) AS raw_sha256 FROM pages WHERE regexp_matches(url, '\\.html?([?#]|$)')")
def SC19_placeholder(spark, d):
    """A document that waits for recognition: no text yet, but the hash of its bytes, so other bytes make a new version.

    Stand-in: pages whose address ends in .html."""
    return table(spark, d, "pages").where(F.col("url").rlike(r"\.html?([?#]|$)")).select("page_id", F.lit("pdf_pending_ocr").alias("quality"), F.sha2("html", 256).alias("raw_sha256"))


# --- scalars --------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, lower(regexp_replace(trim(regexp_replace(replace(replace(text, '\"', ''), '''', ''), '\\s+', ' ', 'g')), '[—–－]', '-', 'g')) AS normal FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def SF2_normal_query(spark, d):
    """Queries without quotes, dashes as hyphens, single blanks, lower case."""
    from lakeloom.operators.indexing import nfkc

    t = F.translate(nfkc(F.col("text")), "—–－​\"'“”‘’", "---")
    return table(spark, d, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))).alias("normal"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) AS n FROM documents")
def SF3_clean_text(spark, d):
    """No control characters but line ends and tabs."""
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace("text", r"[\p{Cc}&&[^\n\r\t]]", "")).cast("long").alias("n"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM conversations WHERE text IS NOT NULL),
u AS (SELECT conv_id, turn, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM w),
f AS (SELECT conv_id, turn, t, min(i) AS i FROM u WHERE length(t) >= 2 AND t NOT IN ('the', 'and', 'of') GROUP BY conv_id, turn, t QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(i)) <= 8)
SELECT w.conv_id, w.turn, coalesce(string_agg(t, ' ' ORDER BY i), '') AS terms FROM w LEFT JOIN f ON f.conv_id = w.conv_id AND f.turn = w.turn GROUP BY w.conv_id, w.turn""")
def SF26_query_terms(spark, d):
    """The first eight different terms of two characters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    good = F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin("the", "and", "of")))
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.array_join(F.slice(good, 1, 8), " ").alias("terms"))


@query("""WITH t AS (SELECT conv_id, turn, lower(text) AS x FROM conversations WHERE text IS NOT NULL), g AS (SELECT DISTINCT conv_id, turn, substr(x, i, 3) AS gram FROM (SELECT conv_id, turn, x, unnest(range(1, length(x) - 1)) AS i FROM t))
SELECT conv_id, turn, count(*) AS grams FROM g GROUP BY ALL""")
def SF27_ngram_sets(spark, d):
    """Number of different character trigrams: runs of three neighbours, zipped."""
    chars = F.split(F.lower("text"), "")
    n = F.size(chars)
    shifted = [F.slice(chars, k + 1, F.greatest(n - 2, F.lit(0))).alias(f"c{k}") for k in range(3)]
    grams = F.array_distinct(F.transform(F.arrays_zip(*shifted), lambda x: F.concat(x["c0"], x["c1"], x["c2"])))
    return table(spark, d, "conversations").where("length(text) >= 3").select("conv_id", "turn", F.size(grams).cast("long").alias("grams"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\\\\?[\"'']([^\"''\\\\>]+)', 1))) AS links FROM pages")
def SF31_embedded_links(spark, d):
    """Different links in a page's source, in quotes that may be escaped."""
    return table(spark, d, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit("href=\\\\?[\"']([^\"'\\\\>]+)"), F.lit(1)))).cast("long").alias("links"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), ''), nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), ''), regexp_extract(url, '[^/]*$', 0)) AS title FROM pages")
def SF32_title_cascade(spark, d):
    got = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", p, 1), "<[^>]*>", "")), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.coalesce(got("(?s)<h1[^>]*>(.*?)</h1>"), got("(?s)<title>(.*?)</title>"), F.regexp_extract("url", "[^/]*$", 0)).alias("title"))


@query("SELECT event_id, ceil(value)::BIGINT AS up, abs(value - 250) AS away, least(value, 100) AS low, greatest(value, 100) AS high, round(value / 490.02::DOUBLE, 6) AS ratio FROM events")
def SF36_arithmetic(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.ceil(v).alias("up"), F.abs(v - 250).alias("away"), F.least(v, F.lit(100.0)).alias("low"), F.greatest(v, F.lit(100.0)).alias("high"), F.round(v / 490.02, 6).alias("ratio"))


@query("SELECT event_id, (ts + INTERVAL 8 HOUR)::DATE::VARCHAR AS local_day, epoch_us(date_trunc('day', ts + INTERVAL 8 HOUR) + INTERVAL 1 DAY - INTERVAL 8 HOUR) // 1000000 - epoch_us(ts) // 1000000 AS seconds_left FROM events")
def SF37_time_utilities(spark, d):
    """The local day, and the seconds until the next local midnight."""
    day = F.to_date(F.from_utc_timestamp("ts", "Asia/Shanghai"))
    midnight = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), "Asia/Shanghai")
    return table(spark, d, "events").select("event_id", day.cast("string").alias("local_day"), (F.unix_seconds(midnight) - F.unix_seconds("ts")).alias("seconds_left"))


@query("SELECT o_orderkey, 'from ' || o_orderdate::DATE::VARCHAR || CASE WHEN o_orderstatus = 'F' THEN chr(10) || 'to ' || (o_orderdate::DATE + 30)::VARCHAR ELSE '' END AS window_ FROM orders")
def SF41_date_window(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("\n", F.concat(F.lit("from "), day.cast("string")), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("to "), F.date_add(day, 30).cast("string")))).alias("window_"))


@query(r"SELECT page_id, regexp_full_match(name, '(?i)(?:image|img|pic|picture|photo|[0-9a-f_-]{8,}|\d+)(?:\.(?:png|jpe?g|gif|webp))?') AS generic FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$', 0) AS name FROM pages)")
def SF42_generic_names(spark, d):
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", 0)
    return table(spark, d, "pages").select("page_id", name.rlike(r"^(?i)(?:image|img|pic|picture|photo|[0-9a-f_-]{8,}|\d+)(?:\.(?:png|jpe?g|gif|webp))?$").alias("generic"))


def clean_list(values: Column, most: int = 8, longest: int = 80) -> Column:
    """Trimmed, not empty, cut to `longest`, different, in order, at most `most`."""
    trimmed = F.filter(F.transform(values, lambda x: F.substring(F.trim(x), 1, longest)), lambda x: x != "")
    return F.slice(F.array_distinct(trimmed), 1, most)


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]')) AS x, generate_subscripts(regexp_split_to_array(text, '[.\n]'), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, substr(trim(x), 1, 80) AS x, min(i) AS i FROM l WHERE trim(x) <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 8)
SELECT d.doc_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS categories FROM documents d LEFT JOIN f USING (doc_id) WHERE text IS NOT NULL GROUP BY d.doc_id""")
def SF45_clean_categories(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(clean_list(F.split("text", r"[.\n]")), "|").alias("categories"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END), ''), nullif(c_mktsegment, ''), 'untitled') AS title FROM customer")
def SF46_suggestion(spark, d):
    """The first of name, segment and a default that isn't empty."""
    name = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.col("c_mktsegment"), F.lit("")), F.lit("untitled")).alias("title"))


def match_labels(labels: DataFrame, titles: DataFrame, least: float = 0.72, margin: float = 0.08, block: int = 2048) -> DataFrame:
    """answer, label, url: the one title of the label's answer that is a clear match.

    labels: answer, label; titles: answer, url, title.  Case, spaces and marks don't count.  A score is 1 if both are equal, from
    0.9 on if one holds the other, else by matching blocks.  A url counts with its best title; the best must reach `least` and
    lead by `margin`.

    Different labels and titles of an answer meet in blocks of `block` each.  A first pass finds equal and contained ones; that
    gives each label a bar, its best score less the margin, below which another title changes nothing, and settles labels that
    have two urls near 1.  The second compares what reaches the bar.  Work is labels times titles of an answer, in tasks of one
    size.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    named = labels.select("answer", "label", bare("label").alias("a")).where("a <> ''").distinct()
    place = F.row_number().over(Window.partitionBy("answer", "b").orderBy("url"))
    held = titles.select("answer", "url", bare("title").alias("b")).where("b <> ''").distinct().withColumn("place", place).where("place <= 2")  # of a title's urls a third can't be second
    held = kept(held.groupBy("answer", "b").agg(F.min_by("url", "place").alias("u1"), F.max(F.when(F.col("place") == 2, F.col("url"))).alias("u2")), "match-titles")
    own = kept(named.join(held.select("answer").distinct(), "answer", "left_semi").select("answer", "a").distinct(), "match-labels")
    blocks = lambda rows, name: rows.groupBy("answer").agg(F.ceil(F.count("*") / block).alias(name))
    sizes = blocks(own, "n_a").join(blocks(held, "n_b"), "answer")

    def meet(own: DataFrame, compare) -> DataFrame:
        left = own.join(sizes, "answer").select("answer", "a", "bar", F.pmod(F.xxhash64("a"), "n_a").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_b") - 1)).alias("j"))
        right = held.join(sizes, "answer").select("answer", "b", "u1", "u2", F.pmod(F.xxhash64("b"), "n_b").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_a") - 1)).alias("i"))

        def run(x: pa.Table, y: pa.Table) -> pa.Table:
            a, b = x.column("a").to_pylist(), y.column("b").to_pylist()
            urls = list(zip(y.column("u1").to_pylist(), y.column("u2").to_pylist(), strict=True))
            best: dict[int, dict] = {}
            for p, q, score in compare(a, b, np.array(x.column("bar"))) if a and b else ():
                for url in urls[q][: 1 + (urls[q][1] is not None)]:
                    mine = best.setdefault(p, {})
                    mine[url] = max(score, mine.get(url, 0.0))
                    if len(mine) > 2:
                        del mine[max(mine, key=lambda u: (-mine[u], u is not None, u or ""))]
            rows = [(a[p], url, score) for p, mine in best.items() for url, score in mine.items()]
            answer = (x if a else y).column("answer").slice(0, 1)
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
            return pa.table([pa.chunked_array(answer.chunks).take(pa.array([0] * len(rows), pa.int64())), *columns], names=["answer", "a", "url", "score"])

        key = ["answer", "i", "j"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, f"answer {dict(own.dtypes)['answer']}, a string, url string, score double")

    def two_best(scored: DataFrame) -> DataFrame:
        of_url = scored.groupBy("answer", "a", "url").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("answer", "a").orderBy(F.desc("score"), "url"))
        second = F.coalesce(F.min(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("second")
        return of_url.withColumn("place", place).where("place <= 2").groupBy("answer", "a").agg(F.max_by("url", -F.col("place")).alias("url"), F.max("score").alias("first"), second, F.count("*").alias("n"))

    sure = kept(meet(own.withColumn("bar", F.lit(0.0)), lambda a, b, bar: contained(a, b)), "match-contained")
    known = own.join(two_best(sure), ["answer", "a"], "left").where(F.coalesce(F.col("second") <= 1 - margin, F.lit(True)))
    bar = F.greatest(F.coalesce("first", F.lit(0.0)), F.lit(least)) - margin - 1e-9
    best = two_best(sure.unionByName(meet(known.select("answer", "a", bar.alias("bar")), alike)))
    clear = best.where((F.col("first") >= least) & ((F.col("n") == 1) | (F.col("first") - F.col("second") >= margin)))
    return named.join(clear, ["answer", "a"]).select("answer", "label", "url")


@query()
def JO24_citation_labels(spark, d):
    """Stand-in: the labels of an answer (a host) are titles of its pages without their first word; the titles its pages'."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = table(spark, d, "pages").select(host.alias("answer"), "url", title.alias("title"))
    return match_labels(pages.select("answer", F.regexp_replace("title", r"^\S+\s+", "").alias("label")).distinct(), pages)


@pandas_udf(T.StringType())
def unified(a: pd.Series, b: pd.Series) -> pd.Series:
    """Unified diff of the lines of two texts, three lines around, at most 12,000 characters."""
    lines = lambda t: (t or "").splitlines()
    return pd.Series(["\n".join(difflib.unified_diff(lines(x), lines(y), lineterm="", n=3))[:12000] for x, y in zip(a, b, strict=True)])


@query()
def SF23_unified_diff(spark, d):
    """Each question against the next of its conversation."""
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", unified("text", "next").alias("diff"))


# --- plans and notices ----------------------------------------------------------------------------------------------


def ready_levels(steps: DataFrame, needs: DataFrame, most: int = 16) -> DataFrame:
    """step, level: the round in which a step can run: after all that it needs.  Steps on a cycle have none.

    A round for each level, `most` at most; each joins the open steps with what isn't done.
    """
    done = steps.join(needs, "step", "left_anti").select("step", F.lit(0).alias("level"))
    for level in range(1, most):
        left = steps.join(done, "step", "left_anti")
        waiting = needs.join(done.select(F.col("step").alias("needs")), "needs", "left_anti").select("step")
        now = left.join(waiting, "step", "left_anti").select("step", F.lit(level).alias("level"))
        if now.isEmpty():
            break
        done = kept(done.unionByName(now), "ready-steps")
    return done


@query("""WITH RECURSIVE s AS (SELECT n_nationkey AS step FROM nation), e AS (SELECT n_nationkey AS step, n_nationkey // 2 AS needs FROM nation WHERE n_nationkey > 0 AND n_nationkey <> n_nationkey // 2),
l AS (SELECT step, 0 AS level FROM s WHERE step NOT IN (SELECT step FROM e) UNION ALL SELECT e.step, level + 1 FROM e JOIN l ON l.step = e.needs) SELECT step, max(level) AS level FROM l GROUP BY step""")
def RT19_ready_steps(spark, d):
    """Rounds of a plan; stand-in: nations, each needs the one of half its number."""
    steps = table(spark, d, "nation").select(F.col("n_nationkey").alias("step"))
    needs = steps.where("step > 0").select("step", F.floor(F.col("step") / 2).cast("int").alias("needs"))
    return ready_levels(steps, needs)


def batches(steps: DataFrame, most: int = 4) -> DataFrame:
    """plan, level, tool, batch, steps, calls of the steps of plans: what is sent together.

    steps: plan, step, level, tool, arguments (map).  Of steps of one tool with the same arguments, in whatever order these
    are given, the first of a plan stands for all.  Those of a level and tool go in batches of `most`, in order of step; steps
    are the numbers that a batch answers, calls how many it sends.
    """
    entries = F.array_sort(F.map_entries("arguments"))
    signature = F.sha2(F.to_json(F.struct("tool", entries.alias("arguments"))), 256)
    first = F.struct("level", "step")
    once = steps.withColumn("signature", signature).groupBy("plan", "tool", "signature").agg(F.min(first).alias("first"), F.array_sort(F.collect_list("step")).alias("same"))
    place = F.row_number().over(Window.partitionBy("plan", "level", "tool").orderBy("step")) - 1
    dealt = once.select("plan", "tool", "first.level", "first.step", "same").withColumn("batch", F.floor(place / most))
    return dealt.groupBy("plan", "level", "tool", "batch").agg(F.array_sort(F.flatten(F.collect_list("same"))).alias("steps"), F.count("*").alias("calls"))


@query("""WITH s AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS step, l_partkey % 2 AS tool, l_suppkey % 3 AS q, l_linenumber % 2 AS k FROM lineitem),
u AS (SELECT plan, tool, q, k, min((step // 3) * 1000 + step) AS first, list(step ORDER BY step) AS same FROM s GROUP BY ALL),
b AS (SELECT *, first // 1000 AS level, (row_number() OVER (PARTITION BY plan, first // 1000, tool ORDER BY first) - 1) // 2 AS batch FROM u)
SELECT plan, level, tool, batch, array_to_string(list_sort(flatten(list(same))), ',') AS steps, count(*) AS calls FROM b GROUP BY plan, level, tool, batch""")
def RT19_batches(spark, d):
    """Stand-in: an order's lines are the steps of a plan, three a level, of two tools with two arguments; two a batch."""
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), seq.alias("step"), (F.col("l_partkey") % 2).alias("tool"), (F.col("l_suppkey") % 3).alias("q"), (F.col("l_linenumber") % 2).cast("long").alias("k"))
    one, other = F.create_map(F.lit("q"), "q", F.lit("k"), "k"), F.create_map(F.lit("k"), "k", F.lit("q"), "q")
    steps = s.select("plan", "step", F.floor(F.col("step") / 3).alias("level"), "tool", F.when(F.col("step") % 2 == 0, one).otherwise(other).alias("arguments"))
    return batches(steps, 2).select("plan", "level", "tool", "batch", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"), "calls")


@query("""WITH q AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS terms FROM conversations WHERE turn = 0 AND text IS NOT NULL), t AS (SELECT conv_id, unnest(terms) AS term FROM q),
p AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(substr(text, 1, 80)), '[a-z]{4,}')) AS term FROM documents WHERE text IS NOT NULL),
s AS (SELECT conv_id, source, count(*) AS score FROM t JOIN p USING (term) GROUP BY ALL)
SELECT source, max(score) AS score, count(*) AS queries FROM s GROUP BY source""")
def RT21_source_rank(spark, d):
    """Sources by the best of all queries: how many of a query's terms stand in the titles of a source; an equi-join on terms."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))).alias("term")
    t = table(spark, d, "conversations").where("turn = 0").select("conv_id", words("text"))
    p = table(spark, d, "documents").select("source", words(F.substring("text", 1, 80))).distinct()
    return t.join(p, "term").groupBy("conv_id", "source").agg(F.count("*").alias("score")).groupBy("source").agg(F.max("score").alias("score"), F.count("*").alias("queries"))


@query("""WITH a AS (SELECT event_id, user_id, 0 AS pos FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, 1 FROM events WHERE value > 400), f AS (SELECT user_id, event_id, min(pos) AS pos FROM a GROUP BY ALL)
SELECT user_id, event_id, pos FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos, event_id) <= 6""")
def RT20_merged_queries(spark, d):
    """Results of two queries: the first that has a row wins, at most six of a source."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    every = e.where("event_type = 'click'").select("user_id", "event_id", F.lit(0).alias("pos")).unionAll(e.where("value > 400").select("user_id", "event_id", F.lit(1).alias("pos")))
    once = every.groupBy("user_id", "event_id").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("pos", "event_id"))
    return once.withColumn("place", place).where("place <= 6").select("user_id", "event_id", "pos")


def waves(rows: DataFrame, ranked: list[str], limit: int, size: int = 6) -> tuple[DataFrame, int]:
    """What is found in the sources, best source first, `size` at a time, and how many waves were asked.

    rows: a table partitioned by source, with url and score.  A wave reads the folders of its sources only, and none is asked
    once those before have `limit` different urls: what they found is counted before the next one.  Of a url's rows the best
    holds; the first `limit` by wave and score are returned.
    """
    found = None
    for k in range(0, len(ranked), size):
        wave = rows.where(F.col("source").isin(ranked[k : k + size])).groupBy("url").agg(F.max("score").alias("score")).withColumn("wave", F.lit(k // size))
        wave = kept(wave if found is None else wave.join(found, "url", "left_anti"), f"wave-{k}")
        found = wave if found is None else found.unionByName(wave)
        if found.count() >= limit:
            break
    return found.orderBy("wave", F.desc("score"), "url").limit(limit), k // size + 1


_WAVED = """WITH r AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS place FROM documents WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT md5(text) AS url, place // 6 AS wave, max(length(text)) AS score FROM documents JOIN r USING (source) WHERE text IS NOT NULL GROUP BY ALL),
o AS (SELECT url, min(wave) AS wave FROM f GROUP BY url), g AS (SELECT url, wave, score FROM o JOIN f USING (url, wave))"""


@query(_WAVED + " SELECT url, wave, score FROM g ORDER BY wave, score DESC, url LIMIT 40")
def RT20_waves(spark, d):
    """The forty longest texts of the first waves of six sources; stand-in: sources rank by their number of documents.

    The table by source is written once; a full wave leaves the folders of all later ones unread.
    """
    docs = table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    path = new_folder(spark, "by-source")
    docs.select("source", F.md5("text").alias("url"), F.length("text").alias("score")).write.partitionBy("source").parquet(path)
    ranked = [r.source for r in table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").collect()]  # a row a source
    return waves(spark.read.schema("url string, score int, source string").parquet(path), ranked, 40)[0].select("url", "wave", "score")
