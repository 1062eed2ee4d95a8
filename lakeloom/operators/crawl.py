"""Crawling a link graph in rounds: a frontier is joined to the links, and what was seen before is taken away.

Stand-ins, as the pages of the test tables link to no page among them: a link leads to the page that its digest gives, a page
is a listing by its address or its number, and is dated by its number (every tenth has no date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import canonical_url
from lakeloom.operators.content import _HREF, _canonical_sql
from lakeloom.sources.store import kept
from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, earliest: str, most: int = 1000) -> DataFrame:
    """page, depth, kind, parent of what is reached from the seeds (page), in rounds of a breadth-first search.

    pages: page, kind, day; links: source, target.  Only listings lead on; details are taken and end there.  Pages dated
    before `earliest` are neither taken nor followed, undated ones are.  parent is the least page of the round before that
    links here.  A round is two joins and an anti-join against what was reached; its table is written, so a lost executor
    costs one round.  There are as many rounds as the graph is deep; one deeper than `most` is an error, not a part.
    """
    open_ = pages.where(F.col("day").isNull() | (F.col("day") >= F.lit(earliest).cast("date"))).select("page", "kind")
    start = seeds.select("page").distinct().join(open_, "page").select("page", F.lit(0).alias("depth"), "kind", F.lit(None).cast(pages.schema["page"].dataType).alias("parent"))
    frontier = reached = kept(start, "crawl-0")
    for depth in range(1, most + 1):
        told = frontier.where("kind = 'listing'").select(F.col("page").alias("source")).join(links.select("source", "target"), "source")
        found = told.groupBy(F.col("target").alias("page")).agg(F.min("source").alias("parent"))
        fresh = found.join(open_, "page").join(reached.select("page"), "page", "left_anti")
        frontier = kept(fresh.select("page", F.lit(depth).alias("depth"), "kind", "parent"), f"crawl-{depth}")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    raise ValueError(f"more than {most} rounds")


_GRAPH = """p AS (SELECT page_id AS page, CASE WHEN regexp_matches(url, '[?&](page|p)=[0-9]+') OR page_id % 3 <> 1 THEN 'listing' ELSE 'detail' END AS kind,
  CASE WHEN page_id % 10 <> 0 THEN DATE '2022-01-01' + (page_id * 7 % 900)::INT END AS day, html FROM pages),
e AS (SELECT DISTINCT page AS source, ('0x' || substr(md5(h), 1, 8))::BIGINT % (SELECT count(*) FROM pages) AS target FROM (SELECT page, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM p)),
ok AS (SELECT page, kind FROM p WHERE day IS NULL OR day >= DATE '2022-06-01')"""


@query(f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT page, 0 AS depth FROM ok WHERE page < 40
  UNION SELECT e.target, depth + 1 FROM r JOIN ok o ON o.page = r.page AND o.kind = 'listing' JOIN e ON e.source = r.page JOIN ok t ON t.page = e.target WHERE depth < 60),
f AS (SELECT page, min(depth) AS depth FROM r GROUP BY page)
SELECT f.page, f.depth, ok.kind, (SELECT min(e.source) FROM e JOIN f g ON g.page = e.source JOIN ok k ON k.page = g.page WHERE e.target = f.page AND g.depth = f.depth - 1 AND k.kind = 'listing') AS parent FROM f JOIN ok USING (page)""")
def SC6_full_crawl(spark, d):
    """What a crawl of all pages reaches from the first forty, with its depth and where it came from."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("page"), "url", "html")
    n = pages.agg(F.count("*")).first()[0]
    kind = F.when(F.col("url").rlike("[?&](page|p)=[0-9]+") | (F.col("page") % 3 != 1), "listing").otherwise("detail")
    day = F.when(F.col("page") % 10 != 0, F.date_add(F.lit("2022-01-01").cast("date"), (F.col("page") * 7 % 900).cast("int")))
    leads = F.conv(F.substring(F.md5("h"), 1, 8), 16, 10).cast("long") % F.lit(n)
    links = pages.select(F.col("page").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("h")).select("source", leads.alias("target")).distinct()
    nodes = kept(pages.select("page", kind.alias("kind"), day.alias("day")), "crawl-pages")
    return crawl(nodes, kept(links, "crawl-links"), nodes.where("page < 40"), "2022-06-01")


def discovered(links: DataFrame, limit: int) -> DataFrame:
    """group, link, seed, place of what a source's seeds offer: links has group (the source), seed, at (place on the page),
    link, hinted (it looks like content).

    Of a seed its first max(4 limit, limit + 20) links count, each once, hinted ones first, else in order. Seeds take turns, so
    that none crowds out the others; a link that several offer goes to the one whose turn comes first. Of a source `limit` stay.
    """
    once = links.groupBy("group", "seed", "link").agg(F.min("at").alias("at"), F.bool_or("hinted").alias("hinted"))
    of_seed = Window.partitionBy("group", "seed")  # the links of one page
    scanned = once.withColumn("n", F.row_number().over(of_seed.orderBy("at", "link"))).where(F.col("n") <= max(4 * limit, limit + 20))
    turn = scanned.withColumn("turn", F.row_number().over(of_seed.orderBy(F.desc("hinted"), "n")))
    first = turn.groupBy("group", "link").agg(F.min(F.struct("turn", "seed")).alias("x")).select("group", "link", "x.turn", "x.seed")
    place = F.row_number().over(Window.partitionBy("group").orderBy("turn", "seed"))
    return first.withColumn("place", place).where(F.col("place") <= limit).select("group", "link", "seed", "place")


@query(f"""WITH a AS (SELECT page_id AS seed, page_id % 40 AS "group", unnest(h) AS h, generate_subscripts(h, 1) AS at_, url FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\x22([^\x22]+)\x22', 1) AS h FROM pages)),
l AS (SELECT "group", seed, at_, {_canonical_sql('u')} AS link FROM (SELECT "group", seed, at_, {_HREF} AS u FROM a)),
o AS (SELECT "group", seed, link, min(at_) AS at_, length(link) % 3 = 0 AS hinted FROM l GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY "group", seed ORDER BY at_, link) AS n FROM o QUALIFY n <= 25),
t AS (SELECT *, row_number() OVER (PARTITION BY "group", seed ORDER BY hinted DESC, n) AS turn FROM s),
f AS (SELECT "group", link, min(turn * 100000000 + seed) AS x FROM t GROUP BY ALL)
SELECT "group", link, x % 100000000 AS seed, row_number() OVER (PARTITION BY "group" ORDER BY x) AS place FROM f QUALIFY place <= 5""")
def SC5_discovery(spark, d):
    """Five links of each source.  Stand-in: pages are seeds of one of forty sources; lengths of links tell hints."""
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    anchors = table(spark, d, "pages").select(F.col("page_id").alias("seed"), (F.col("page_id") % 40).alias("group"), site.alias("site"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("at", "h"))
    absolute = F.when(F.col("h").rlike("^[a-z]+://"), F.col("h")).when(F.col("h").startswith("/"), F.concat("site", "h")).otherwise(F.concat_ws("/", "site", "h"))
    links = anchors.select("group", "seed", "at", canonical_url(absolute).alias("link"))
    return discovered(links.withColumn("hinted", F.length("link") % 3 == 0), 5)
