"""Exploring documents: pages and blocks, reading by offset or locator, finding passages.

A document whose text has page markers is read page by page, others in blocks of BLOCK characters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import preview
from lakeloom.sources.tables import table

BLOCK = 4000
#: Fixed value: the marker that begins a page.
PAGE = "【PDF 第 ([0-9]+) 页】"
QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def units(docs: DataFrame) -> DataFrame:
    """doc_id, locator, kind, start, end (offsets from 0), content of each page or block; docs has doc_id and body.

    Null and empty bodies have none.  Text before the first marker belongs to no page.
    """
    body = F.col("body")
    pages = F.regexp_extract_all(body, F.lit(PAGE), F.lit(1))
    pieces = F.split(body, "(?=【PDF 第 [0-9]+ 页】)", -1)
    paged = docs.where(body.rlike(PAGE)).select("doc_id", F.posexplode(F.filter(pieces, lambda x: x.rlike("^" + PAGE))).alias("at", "content"), pages.alias("pages"), F.transform(pieces, F.length).alias("sizes"))
    # the pieces before a page, and the text before the first marker if there is any
    before = F.aggregate(F.slice("sizes", 1, F.col("at") + F.when(F.col("sizes")[0] > 0, F.size("sizes") - F.size("pages")).otherwise(0)), F.lit(0), lambda a, x: a + x)
    paged = paged.select("doc_id", F.col("pages")[F.col("at")].cast("int").alias("locator"), F.lit("page").alias("kind"), before.alias("start"), "content")
    plain = docs.where((F.length(body) > 0) & ~body.rlike(PAGE))
    starts = F.sequence(F.lit(0), F.floor((F.length(body) - 1) / BLOCK).cast("int"))
    blocks = plain.select("doc_id", "body", F.explode(starts).alias("k")).select("doc_id", (F.col("k") + 1).alias("locator"), F.lit("block").alias("kind"), (F.col("k") * BLOCK).alias("start"), F.substring("body", F.col("k") * BLOCK + 1, F.lit(BLOCK)).alias("content"))
    every = paged.unionByName(blocks)
    return every.select("doc_id", "locator", "kind", "start", (F.col("start") + F.length("content")).alias("end"), "content")


def bodies(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))


_UNITS = "u AS (SELECT doc_id, i::INT + 1 AS locator, i * 4000 AS start, substr(text, (i * 4000 + 1)::BIGINT, 4000) AS content, length(text) AS n FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 4000.0)::BIGINT)) AS i FROM documents WHERE length(text) > 0))"


@query("WITH " + _UNITS + r" SELECT doc_id, locator, start::INT AS start, (start + length(content))::INT AS end_, substr(trim(regexp_replace(content, '[ \t\r\n]+', ' ', 'g')), 1, 180) AS preview FROM u")
def RT9_inspect(spark, d):
    """The pages or blocks of every document with a preview of each."""
    return units(bodies(spark, d)).select("doc_id", "locator", "start", F.col("end").alias("end_"), preview(F.col("content")).alias("preview"))


@query("SELECT doc_id, substr(text, 5001, 3000) AS part, CASE WHEN length(text) > 8000 THEN 8000 ELSE -1 END AS next_offset FROM documents WHERE length(text) > 5000")
def RT9_read(spark, d):
    """Up to 3000 characters from offset 5000, and where to go on (-1: nowhere)."""
    n = F.length("body")
    return bodies(spark, d).where(n > 5000).select("doc_id", F.substring("body", 5001, 3000).alias("part"), F.when(n > 8000, 8000).otherwise(-1).alias("next_offset"))


@query("WITH " + _UNITS + ", c AS (SELECT doc_id, max(locator) AS m FROM u GROUP BY doc_id) SELECT doc_id, locator, m AS locators, CASE WHEN locator > 1 THEN locator - 1 ELSE 0 END AS previous, CASE WHEN locator < m THEN locator + 1 ELSE 0 END AS next, sha256(content) AS content_hash FROM u JOIN c USING (doc_id) WHERE locator = 2")
def RT9_read_locator(spark, d):
    """The second page or block of each document with its neighbours (0: none), by one aggregate of locators a document."""
    u = units(bodies(spark, d))
    n = F.coalesce(F.size(F.filter("known", lambda x: x <= F.col("locator"))), F.lit(0))
    lists = u.groupBy("doc_id").agg(F.array_sort(F.collect_list("locator")).alias("known"))
    at = lambda k: F.coalesce(F.try_element_at("known", k), F.lit(0))
    rows = u.where("locator = 2").join(lists, "doc_id")
    return rows.select("doc_id", "locator", F.size("known").alias("locators"), F.when(n > 1, at(n - 1)).otherwise(0).alias("previous"), at(n + 1).alias("next"), F.sha2("content", 256).alias("content_hash"))


def page_at(starts: Column, offset) -> Column:
    """The last of the sorted starts (struct of start, locator) that isn't past an offset; null if none."""
    return F.try_element_at(F.filter(starts, lambda s: s["start"] <= offset), F.lit(-1))["locator"]


@query("WITH " + _UNITS + " SELECT doc_id, max(locator) FILTER (start <= 9000) AS locator FROM u GROUP BY doc_id")
def WI14_page_at_offset(spark, d):
    u = units(bodies(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "locator"))).alias("starts"))
    return u.select("doc_id", page_at(F.col("starts"), 9000).alias("locator"))


def passages(text: str, terms: list[str], context: int, top: int) -> list[tuple[int, int, int, int]]:
    """(offset, context start, context end, number of terms) of the best passages around occurrences of any term.

    An occurrence whose context begins inside the passage before it joins that one, which stays as wide as it is.
    """
    low = text.lower()
    hits = sorted((m.start(), t) for t in terms for m in re.finditer(re.escape(t), low))
    out: list[list] = []
    for at, term in hits:
        start = max(0, at - context // 2)
        end = min(len(text), start + context)
        start = max(0, end - context)
        if out and start <= out[-1][2]:
            out[-1][3].add(term)
        else:
            out.append([at, start, end, {t for t in terms if t in low[start:end]}])
    out.sort(key=lambda p: (-len(p[3]), p[0]))
    return [(a, s, e, len(t)) for a, s, e, t in out[:top]]


TERMS, CONTEXT, TOP = ["license", "tionth"], 600, 4


@query(f"""WITH RECURSIVE t AS (SELECT unnest(['license', 'tionth']) AS term),
w AS (SELECT doc_id, term, length(text) AS n, length(text) - length(ltrim(text)) AS x, string_split(lower(text), term) AS p, text FROM documents, t WHERE contains(lower(text), term)),
l AS (SELECT doc_id, term, n, unnest(list_transform(p[:-2], lambda y: length(y))) AS gap, generate_subscripts(p[:-2], 1) AS i FROM w),
o AS (SELECT doc_id, n, term, (sum(gap) OVER (PARTITION BY doc_id, term ORDER BY i) + (i - 1) * length(term))::BIGINT AS pos FROM l),
c AS (SELECT *, greatest(0, pos - {CONTEXT // 2}) AS s0 FROM o),
k AS (SELECT *, greatest(0, least(n, s0 + {CONTEXT}) - {CONTEXT}) AS st, least(n, s0 + {CONTEXT}) AS en FROM c),
chain AS (SELECT doc_id, min(pos) AS pos FROM k GROUP BY doc_id UNION ALL
  SELECT h.doc_id, min(j.pos) FROM (SELECT c2.doc_id, max(k2.en) AS en FROM chain c2 JOIN k k2 ON k2.doc_id = c2.doc_id AND k2.pos = c2.pos GROUP BY c2.doc_id, c2.pos) h JOIN k j ON j.doc_id = h.doc_id AND j.st > h.en GROUP BY h.doc_id),
m AS (SELECT DISTINCT chain.doc_id, k.pos, k.st, k.en FROM chain JOIN k USING (doc_id, pos)),
b AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), 9223372036854775807) AS nxt FROM m),
r AS (SELECT b.doc_id, b.pos, b.st, b.en, count(DISTINCT z.term) AS terms FROM b JOIN documents d USING (doc_id), t z
  WHERE contains(substr(lower(d.text), b.st + 1, b.en - b.st), z.term) OR EXISTS (SELECT 1 FROM k q WHERE q.doc_id = b.doc_id AND q.term = z.term AND q.pos >= b.pos AND q.pos < b.nxt) GROUP BY ALL)
SELECT doc_id, pos AS offset_, st AS context_start, en AS context_end, terms FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY terms DESC, pos) <= {TOP}""")
def RT9_find(spark, d):
    """The best passages of each document: one pass, a fold inside each text, nothing shuffled."""

    def run(batches):
        for batch in batches:
            rows = [(i, *p) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True) if t for p in passages(t, TERMS, CONTEXT, TOP)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "offset_", "context_start", "context_end", "terms"])

    held = F.lower("body").rlike("|".join(map(re.escape, TERMS)))
    return bodies(spark, d).where(held).mapInArrow(run, "doc_id long, offset_ long, context_start long, context_end long, terms long")


QUERIES["WI13_coalesced_passages"] = lambda spark, d: RT9_find(spark, d).groupBy("doc_id").agg(F.count("*").alias("passages"), F.min("offset_").alias("first"))
SQL["WI13_coalesced_passages"] = SQL["RT9_find"].replace("SELECT doc_id, pos AS offset_", "SELECT doc_id, count(*) AS passages, min(offset_) AS first FROM (SELECT doc_id, pos AS offset_") + ") GROUP BY doc_id"


def column_map(text: Column) -> Column:
    """Each line with its number, and before each stretch of text the column where it begins, so that tables can be read.

    A stretch is what single blanks hold together.  Columns are running totals of the pieces of a line.
    """
    stretch = r"\S+(?: \S+)*"
    place = "array<struct<at:int,end:int,text:string>>"

    def stretches(line: Column) -> Column:
        gaps = F.transform(F.split(line, stretch, -1), F.length)
        step = F.filter(F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(line, F.lit(stretch), F.lit(0)).alias("text")), lambda x: x["text"].isNotNull())
        end = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        placed = F.aggregate(step, F.array().cast(place), lambda acc, x: F.concat(acc, F.array(F.struct((end(acc) + x["gap"]).alias("at"), (end(acc) + x["gap"] + F.length(x["text"])).alias("end"), x["text"].alias("text")))))
        return F.array_join(F.transform(placed, lambda x: F.concat(F.format_string("[c%03d]", x["at"]), x["text"])), " ")

    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.array_join(F.transform(lines, lambda line, k: F.concat(F.format_string("L%03d ", k + 1), stretches(line))), "\n")


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k, len(string_split(t, chr(10))) AS n FROM (SELECT conv_id, turn, replace(text, ', ', ',   ') AS t FROM conversations WHERE text IS NOT NULL)),
p AS (SELECT *, regexp_extract_all(line, '\S+(?: \S+)*') AS x, string_split_regex(line, '\S+(?: \S+)*') AS g FROM l WHERE NOT (k = n AND line = '')),
m AS (SELECT conv_id, turn, k, 'L' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INT, '0') || ' ' || array_to_string(list_transform(range(1, len(x) + 1), lambda i: '[c' || lpad((list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(x[1:i-1], lambda y: length(y))), 0))::VARCHAR,
  greatest(3, length((list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(x[1:i-1], lambda y: length(y))), 0))::VARCHAR))::INT, '0') || ']' || x[i]), ' ') AS mapped FROM p)
SELECT conv_id, turn, string_agg(mapped, chr(10) ORDER BY k) AS mapped FROM m GROUP BY ALL""")
def SF35_column_map(spark, d):
    """Turns as tables; stand-in: what commas part are cells."""
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", column_map(F.replace("text", F.lit(", "), F.lit(",   "))).alias("mapped"))
