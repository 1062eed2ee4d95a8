"""Text, URL and page operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.text import canonical_url, fold_dashes
from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title FROM pages")
def SC17_html_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")).alias("title"))


#: Tags whose content is no text of a page.  Scripts and styles go first, as what they hold is no markup.
BOILERPLATE = ("script", "style", "nav", "header", "footer", "aside")


def without_boilerplate(html: Column) -> Column:
    """html without these elements; each ends at its own closing tag only."""
    for tag in BOILERPLATE:
        html = F.regexp_replace(html, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>", " ")
    return html


def boilerplate_sql(html: str) -> str:
    for tag in BOILERPLATE:
        html = f"regexp_replace({html}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    return html


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({boilerplate_sql('html')}, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages")
def SC17_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(without_boilerplate(F.col("html")), "<[^>]*>", " "), r"[ \t\r\n]+", " ")).alias("body"))


_HREF = "CASE WHEN regexp_matches(h, '^[a-z]+://') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' || h END"


def _canonical_sql(url: str) -> str:
    items = f"list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: {{'k': url_decode(regexp_extract(p, '^([^=]*)', 1)), 'v': url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1))}}), lambda p: lower(p.k) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'spm')))"
    path = f"coalesce(nullif(regexp_extract({url}, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1), ''), '/')"
    query = f"array_to_string(list_transform({items}, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&')"
    return f"lower(regexp_extract({url}, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract({url}, '^[A-Za-z]+://([^/:?#]*)', 1)) || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


@query(f"SELECT DISTINCT page_id, {_canonical_sql('u')} AS link FROM (SELECT page_id, {_HREF} AS u FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\x22([^\x22]+)\x22', 1)) AS h FROM pages))")
def SC5_links(spark, d):
    """The links of each page, made absolute and canonical, each once."""
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    anchors = table(spark, d, "pages").select("page_id", site.alias("site"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("h"))
    absolute = F.when(F.col("h").rlike("^[a-z]+://"), F.col("h")).when(F.col("h").startswith("/"), F.concat("site", "h")).otherwise(F.concat_ws("/", "site", "h"))
    return anchors.select("page_id", canonical_url(absolute).alias("link")).distinct()


@query(f"SELECT page_id, {_canonical_sql('url')} AS url FROM pages")
def SF29_canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", canonical_url(F.col("url")).alias("url"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), ''), regexp_extract(url, '([0-9]+)[^0-9]*$', 1)) AS external_id FROM pages")
def SF30_external_id(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", "[?&]id=([^&#]*)", 1), F.lit("")), F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1)).alias("external_id"))


@query("SELECT doc_id, sha256(to_json({'lang': lang, 'source': source, 'text': text, 'title': substr(text, 1, 80)})) AS content_hash, '\"safe-' || sha256(to_json({'lang': lang, 'source': source})) || '\"' AS etag FROM documents")
def SF20_canonical_hash(spark, d):
    """The hash of a document's canonical JSON (keys in order, nulls written out), and the etag of its allowed fields."""
    made = lambda *cols: F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    return table(spark, d, "documents").select("doc_id", made("lang", "source", "text", F.substring("text", 1, 80).alias("title")).alias("content_hash"), F.concat(F.lit('"safe-'), made("lang", "source"), F.lit('"')).alias("etag"))


@query("SELECT doc_id, replace(replace(replace(text, '–', '-'), '—', '-'), '－', '-') AS folded FROM documents")
def SF4_fold_dashes(spark, d):
    return table(spark, d, "documents").select("doc_id", fold_dashes(F.col("text")).alias("folded"))


@query("SELECT conv_id, turn, length(text) AS n, upper(role) AS role_, instr(text, 'the')::INT AS at FROM conversations")
def SF5_string_functions(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"), F.upper("role").alias("role_"), F.instr("text", "the").alias("at"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS dates, regexp_extract(text, '([A-Za-z0-9._]+)@', 1) AS user_ FROM documents")
def SF10_regex_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}")).cast("long").alias("dates"), F.regexp_extract("text", "([A-Za-z0-9._]+)@", 1).alias("user_"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local FROM events")
def SF12_epoch(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_millis("ts").alias("ms"), F.date_format(F.from_utc_timestamp("ts", "Asia/Shanghai"), "yyyy-MM-dd HH:mm").alias("local"))


@query("SELECT o_orderkey, CASE WHEN n <= 180 THEN 0.012::DOUBLE WHEN n <= 400 THEN 0.006::DOUBLE WHEN n <= 800 THEN 0.002::DOUBLE ELSE 0 END AS bonus FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-01-01') AS n FROM orders)")
def SF28_freshness(spark, d):
    n = F.date_diff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.when(n <= 180, 0.012).when(n <= 400, 0.006).when(n <= 800, 0.002).otherwise(0.0).alias("bonus"))


@query("SELECT conv_id, turn, replace(replace(rtrim(to_base64(encode(conv_id || '|' || turn)), '='), '+', '-'), '/', '_') AS cursor FROM conversations")
def SF33_cursor(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.rtrim(F.translate(F.base64(F.concat_ws("|", "conv_id", "turn").cast("binary")), "+/", "-_"), F.lit("=")).alias("cursor"))


@query("SELECT event_id, coalesce((props->>'k')::INT, 0) AS k FROM events")
def SF34_json_or_empty(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999")).cast("int"), F.lit(0)).alias("k"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS segment FROM customer")
def SF40_field_map(spark, d):
    names = F.create_map(F.lit("BUILDING"), F.lit("b"), F.lit("MACHINERY"), F.lit("m"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), F.lit("other")).alias("segment"))


@query("SELECT doc_id, i::INT AS locator, substr(text, i * 4000 + 1, 4000) AS block FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil(length(text) / 4000.0), 1)::BIGINT)) AS i FROM documents)")
def SF43_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 4000) - 1, F.lit(0)).cast("int"))
    return docs.select("doc_id", "text", F.explode(starts).alias("locator")).select("doc_id", "locator", F.substring("text", F.col("locator") * 4000 + 1, F.lit(4000)).alias("block"))


@query("SELECT a.s_suppkey, array_to_string(list_filter([CASE WHEN a.s_nationkey IS DISTINCT FROM b.s_nationkey THEN 'nation' END, CASE WHEN a.s_acctbal IS DISTINCT FROM b.s_acctbal THEN 'balance' END], lambda x: x IS NOT NULL), ',') AS changed FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def SF44_field_diff(spark, d):
    a = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    b = a.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_nationkey").alias("n2"), F.col("s_acctbal").alias("b2"))
    changed = F.concat_ws(",", F.when(~F.col("s_nationkey").eqNullSafe(F.col("n2")), "nation"), F.when(~F.col("s_acctbal").eqNullSafe(F.col("b2")), "balance"))
    return a.join(b, "s_suppkey").select("s_suppkey", changed.alias("changed"))
