"""Full-text retrieval: BM25 phrase search, the search ladder, hybrid search over channels, and its evaluation.

A search makes one pass over the texts, which counts all its phrases in title and body; that table of a few numbers a
document is kept, and statistics, channels and scores are taken from it.  Corpus statistics cover all versions; results
are current documents only.  Text is joined last, to the few documents that are returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import back_off_windows, dash_variants, distinct_in_order, eligible, normal_query, occurrences, preview, query_terms, trigrams
from lakeloom.sources import index
from lakeloom.sources.store import fingerprint, kept, new_folder
from lakeloom.sources.tables import AS_OF, SQL_CURRENT, SQL_VERSIONS, current, current_documents, excluded, table, versions

K1, B, TITLE_WEIGHT = 1.2, 0.75, 5.0
PHRASES = ("the", "and er", "license")
#: Rows of a channel, constant of the fusion, candidates that are scored, rows returned, rows of a source before others.
DEPTH, RRF, CANDIDATES, RETURNED, CAP = 32, 60, 160, 12, 3
#: Words of queries that ask for a list.
ENUMERATION = "几个|多少|哪些|有什么|列出|列表|名单|目录|一览|全部|所有|分别"
QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def counted(docs: DataFrame, phrases: list[str] | tuple[str, ...]) -> DataFrame:
    """The columns of versions but its texts, lengths, and t0, b0 ...: how often each phrase stands in title and body."""
    low = docs.select("*", F.lower("title").alias("t"), F.lower("body").alias("b"))
    sizes = [F.length("t").alias("title_chars"), F.length("b").alias("body_chars"), (trigrams(F.col("t")) + trigrams(F.col("b"))).alias("dl")]
    found = [occurrences(F.col(c), p).alias(f"{c}{k}") for k, p in enumerate(phrases) for c in "tb"]
    return kept(low.select(*[c for c in docs.columns if c not in ("title", "body")], *sizes, *found), "phrase-counts")


def hit(k: int) -> Column:
    return F.col(f"t{k}") + F.col(f"b{k}") > 0


def bm25(counts: DataFrame, n_phrases: int) -> tuple[DataFrame, dict[int, Column]]:
    """counts with corpus statistics (one row, joined to all), and each phrase's share of the score."""
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(hit(k)).alias(f"n{k}") for k in range(n_phrases)])
    return counts.crossJoin(F.broadcast(stats)), shares(n_phrases)


def shares(n_phrases: int) -> dict[int, Column]:
    """Each phrase's share of the BM25 score, from counts and statistics; lower is better."""
    parts = {}
    for k in range(n_phrases):
        idf = F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        f = (TITLE_WEIGHT * F.col(f"t{k}") + F.col(f"b{k}")).cast("double")
        parts[k] = -F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return parts


def score_of(parts: dict[int, Column], keys) -> Column:
    """Rounded, so that equal scores tie whatever the order of addition."""
    return F.round(reduce(add, [parts[k] for k in keys]), 9)


def search(spark, d, phrases: tuple[str, ...], how=or_, k: int = DEPTH) -> DataFrame:
    """The k best current documents that hold any (or_) or all (and_) phrases."""
    rows, parts = bm25(counted(versions(spark, d), phrases), len(phrases))
    found = rows.where(reduce(how, map(hit, range(len(phrases))))).withColumn("score", score_of(parts, parts))
    return current(found, spark, d).orderBy("score", F.desc("published"), "doc_id").limit(k).select("doc_id", "score")


# SQL: f has the counts, s the statistics
def _occ(column: str, phrase: str) -> str:
    # none of the phrases here overlaps itself, so counting by removal is exact
    return f"((length({column}) - length(replace({column}, '{phrase}', ''))) // {len(phrase)})"


def _counts_sql(phrases) -> str:
    n = range(len(phrases))
    found = ", ".join(f"{_occ(c, p)} AS {c}{k}" for k, p in enumerate(phrases) for c in "tb")
    some = ", ".join(f"count(*) FILTER (t{k} + b{k} > 0) AS n{k}" for k in n)
    return f"""v AS {SQL_VERSIONS}, l AS (SELECT *, lower(title) AS t, lower(body) AS b FROM v),
f AS (SELECT * EXCLUDE (title, body, t, b), length(t) AS title_chars, length(b) AS body_chars, greatest(length(t) - 2, 0) + greatest(length(b) - 2, 0) AS dl, {found} FROM l),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {some} FROM f)"""


def _score_sql(keys) -> str:
    idf = lambda k: f"ln((n - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE))"
    f = lambda k: f"(5.0::DOUBLE * t{k} + b{k})"
    part = lambda k: f"(CASE WHEN {idf(k)} <= 0 THEN 1e-6::DOUBLE ELSE {idf(k)} END) * {f(k)} * 2.2::DOUBLE / ({f(k)} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    return f"round(-({' + '.join(part(k) for k in keys)}), 9)"


def _search_sql(phrases, how: str) -> str:
    keys = range(len(phrases))
    return f"WITH {_counts_sql(phrases)} SELECT doc_id, {_score_sql(keys)} AS score FROM f, s WHERE ({f' {how} '.join(f't{k} + b{k} > 0' for k in keys)}) AND {SQL_CURRENT} ORDER BY score, published DESC, doc_id LIMIT 32"


@query(_search_sql(PHRASES, "OR"))
def RT1_bm25_topk(spark, d):
    return search(spark, d, PHRASES)


@query(_search_sql(("the", "ing"), "AND"))
def RT1_and_search(spark, d):
    return search(spark, d, ("the", "ing"), and_)


_BUILT: dict[tuple[str, str, str], index.Index] = {}
INDEXED = ("the", "ing", "license")


def built(spark, d) -> index.Index:
    """The index of a folder's tables, built once in an application for each state of their files."""
    key = (spark.sparkContext.applicationId, d, fingerprint(spark, f"{d}/documents.parquet", f"{d}/labels.parquet"))
    if key not in _BUILT:
        _BUILT[key] = index.build(spark, d)
    return _BUILT[key]


@query(_search_sql(INDEXED, "OR"))
def RT1_index_search(spark, d):
    """The search from the index: postings of two trigrams, and of a longer phrase verified candidates."""
    return index.search(built(spark, d), INDEXED)


@query(_search_sql(("the", "ing"), "OR").replace("WHERE (", "WHERE doc_id IN (SELECT doc_id FROM l WHERE contains(t || ' ' || b, '7') AND contains(t || ' ' || b, 'wh')) AND ("))
def FI5_index_required(spark, d):
    """An indexed search whose terms of one and two characters, which have no postings, must stand in the texts."""
    return index.search(built(spark, d), ("the", "ing"), required=("7", "wh"))


@query("SELECT doc_id, len(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) AS grams, length(t) - 2 AS places FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE length(text) >= 3)")
def SK3_index_postings(spark, d):
    """Of each document how many different trigrams the index holds, and in how many places of its body."""
    held = built(spark, d).read("postings", index.POSTINGS).where("b > 0")
    return held.groupBy("doc_id").agg(F.count("*").alias("grams"), F.sum("b").alias("places"))


def changes(spark, d) -> list[DataFrame]:
    """Three batches of changes of the documents: new texts for a third, of which some twice; deletions; copies under new
    ids, of which some go again in the same batch."""
    docs = versions(spark, d).join(excluded(spark, d).withColumn("bad", F.lit(True)), "doc_id", "left")
    current = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False)) & F.col("bad").isNull()
    row = lambda prefix, seq, deleted=False: [
        F.substring(F.concat(F.lit(prefix), "body"), 1, 80).alias("title"), F.concat(F.lit(prefix), "body").alias("body"), "published", current.alias("current"), F.lit(deleted).alias("deleted"), F.lit(seq).alias("seq")
    ]
    first = docs.where("doc_id % 3 = 0").select("doc_id", *row("the ", 1)).unionByName(docs.where("doc_id % 9 = 0").select("doc_id", *row("the the ing ", 2)))
    gone = docs.where("doc_id % 7 = 1").select("doc_id", *row("", 3, deleted=True))
    copied = docs.where("doc_id % 5 = 2").withColumn("doc_id", F.col("doc_id") + 900_000_000)
    current = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))
    again = copied.select("doc_id", *row("ing ", 4)).unionByName(copied.where("doc_id % 2 = 0").select("doc_id", *row("", 5, deleted=True)))
    return [first, gone, again]


#: The documents after these changes; 900,000,000 is a multiple of 900, so the stand-in for the date stays.
SQL_CHANGED = """(SELECT * REPLACE (CASE WHEN doc_id % 9 = 0 THEN 'the the ing ' || text WHEN doc_id % 3 = 0 THEN 'the ' || text ELSE text END AS text) FROM documents WHERE doc_id % 7 <> 1
  UNION ALL SELECT * REPLACE (doc_id + 900000000 AS doc_id, 'ing ' || text AS text) FROM documents WHERE doc_id % 5 = 2 AND doc_id % 2 = 1)"""


@query(_search_sql(("the", "ing", "e ing"), "OR").replace("FROM documents)", f"FROM {SQL_CHANGED})"))
def DM14_reindexed_search(spark, d):
    """A search after three batches of updates, deletions and insertions were applied to the index."""
    root = new_folder(spark, "index")
    state = index.build(spark, d, root)
    for batch in changes(spark, d):
        state = index.apply(state, batch)
    index.vacuum(state)
    return index.search(state, ("the", "ing", "e ing"))


@query(_search_sql(("the", "icense"), "OR").replace("FROM documents)", f"FROM {SQL_CHANGED})"))
def ST9_followed_search(spark, d):
    """A search on an index that a stream of changes keeps: each set of changes is a micro-batch of as many files as it was
    written in, and is applied once though it comes twice.  The stream ends and goes on from its state between them."""
    root, source = new_folder(spark, "index"), new_folder(spark, "changes")
    index.build(spark, d, root)
    write = index.followed(root, d)

    def twice(rows: DataFrame, batch: int) -> None:
        write(rows, batch)
        write(rows, batch)

    for k, batch in enumerate(changes(spark, d)):
        batch.write.parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(batch.schema).parquet(f"{source}/part=*")
        stream.writeStream.option("checkpointLocation", f"{source}-state").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return index.search(index.opened(spark, root, d), ("the", "icense"))


HYPHENED = dash_variants("pre-war")


@query(_search_sql(HYPHENED, "OR").replace("FROM documents)", "FROM (SELECT * REPLACE (CASE doc_id % 4 WHEN 0 THEN 'pre–war ' || text WHEN 1 THEN 'Pre-war, pre-war ' || text ELSE text END AS text) FROM documents))"))
def SK4_unfolded_search(spark, d):
    """A search on an index that keeps dashes as they are: the phrase is asked with each of them."""
    docs = versions(spark, d).join(excluded(spark, d).withColumn("bad", F.lit(True)), "doc_id", "left").where("doc_id % 4 < 2")
    body = F.concat(F.when(F.col("doc_id") % 4 == 0, "pre–war ").otherwise("Pre-war, pre-war "), "body")
    current = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False)) & F.col("bad").isNull()
    changed = docs.select("doc_id", F.substring(body, 1, 80).alias("title"), body.alias("body"), "published", current.alias("current"), F.lit(False).alias("deleted"), F.lit(1).alias("seq"))
    return index.search(index.apply(index.build(spark, d, new_folder(spark, "index")), changed), HYPHENED)


# --- the ladder -----------------------------------------------------------------------------------------------------


def ladder(spark, d, text: str, k: int = 12) -> DataFrame:
    """Documents with all terms; if there are none, with any; if none, with any window of the long terms.

    Order: terms in the title, kind, terms in the body, score, newest; of the first max(4 k, 24) each uri once.  The step
    is the least that has rows, taken in the same plan.
    """
    long, windows = [t for t in query_terms(text) if eligible(t)], back_off_windows(text)
    short = [t for t in query_terms(text) if not eligible(t)]
    phrases = [*long, *[w for w in windows if w not in long]]
    own, wide = list(range(len(long))), [phrases.index(w) for w in windows]
    docs = versions(spark, d)
    exact = reduce(and_, [F.contains("title", F.lit(t)) | F.contains("body", F.lit(t)) for t in short], F.lit(True))
    rows, parts = bm25(counted(docs.withColumn("short", exact), phrases), len(phrases))
    rows = current(rows, spark, d)
    steps = [(1, reduce(and_, map(hit, own)) & F.col("short"), own), (2, reduce(or_, map(hit, own)), own)]
    steps += [(3, reduce(or_, map(hit, wide)), wide)] if wide else []
    in_column = lambda c, keys: reduce(add, [F.when(F.col(f"{c}{i}") > 0, 1).otherwise(0) for i in keys])
    made = [F.when(test, F.struct(F.lit(n).alias("step"), in_column("t", keys).alias("titles"), in_column("b", keys).alias("bodies"), score_of(parts, keys).alias("score"))) for n, test, keys in steps]
    found = rows.select("doc_id", "uri", "kind", "published", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("doc_id", "uri", "kind", "published", "x.*")
    first = found.agg(F.min("step").alias("step"))
    order = [F.desc("titles"), F.when(F.col("kind") == "pdf", 0).when(F.col("kind") == "attachment", 1).when(F.col("kind") == "html", 2).otherwise(3), F.desc("bodies"), "score", F.desc("published"), "doc_id"]
    best = found.join(F.broadcast(first), "step").orderBy(*order).limit(max(4 * k, 24)).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # few rows
    once = F.row_number().over(Window.partitionBy("uri").orderBy("place"))
    return best.withColumn("_once", once).where("_once = 1").orderBy("place").limit(k).select("doc_id", "step", "titles", "bodies", "score")


def _ladder_sql(text: str, k: int = 12) -> str:
    long, windows = [t for t in query_terms(text) if eligible(t)], back_off_windows(text)
    short = [t for t in query_terms(text) if not eligible(t)]
    phrases = [*long, *[w for w in windows if w not in long]]
    own, wide = list(range(len(long))), [phrases.index(w) for w in windows]
    any_ = lambda keys: "(" + " OR ".join(f"t{i} + b{i} > 0" for i in keys) + ")"
    in_column = lambda c, keys: " + ".join(f"({c}{i} > 0)::INT" for i in keys)
    exact = "".join(f" AND (contains(title, '{t}') OR contains(body, '{t}'))" for t in short)
    strict = " AND ".join(f"t{i} + b{i} > 0" for i in own) + f" AND doc_id IN (SELECT doc_id FROM v WHERE true{exact})"
    steps = [(1, strict, own), (2, any_(own), own)] + ([(3, any_(wide), wide)] if wide else [])
    union = " UNION ALL ".join(f"SELECT doc_id, uri, kind, published, {n} AS step, {in_column('t', keys)} AS titles, {in_column('b', keys)} AS bodies, {_score_sql(keys)} AS score FROM f, s WHERE {test} AND {SQL_CURRENT}" for n, test, keys in steps)
    return f"""WITH {_counts_sql(phrases)}, u AS ({union}),
    p AS (SELECT *, row_number() OVER (ORDER BY titles DESC, CASE kind WHEN 'pdf' THEN 0 WHEN 'attachment' THEN 1 WHEN 'html' THEN 2 ELSE 3 END, bodies DESC, score, published DESC, doc_id) AS place FROM u WHERE step = (SELECT min(step) FROM u)),
    o AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY place) AS once FROM p WHERE place <= {max(4 * k, 24)})
    SELECT doc_id, step, titles, bodies, score FROM o WHERE once = 1 ORDER BY place LIMIT {k}"""


#: Queries of which the first finds all its terms, the second only some, the third only parts of its term.
LADDER = ("license with of", "license qqqzz", "xqlicensezq")


@query(_ladder_sql(LADDER[0]))
def RT2_strict(spark, d):
    return ladder(spark, d, LADDER[0])


@query(_ladder_sql(LADDER[1]))
def RT2_relaxed(spark, d):
    return ladder(spark, d, LADDER[1])


@query(_ladder_sql(LADDER[2]))
def RT2_back_off(spark, d):
    return ladder(spark, d, LADDER[2])


# --- hybrid search --------------------------------------------------------------------------------------------------


@dataclass
class Channel:
    """A way to find documents: all or any of some phrases, short terms that must stand in the text, and its weight."""

    kind: str
    phrases: tuple[str, ...]
    all_of: bool
    short: tuple[str, ...]
    weight: float
    variants: list[int]


def channels_of(variants: list[str]) -> list[Channel]:
    """Exact, all terms, any term of each variant; channels that ask the same are one, for all its variants."""
    made: dict[tuple, Channel] = {}
    for n, text in enumerate(variants):
        terms = query_terms(text)
        long, short = tuple(t for t in terms if eligible(t)), tuple(t for t in terms if not eligible(t))
        whole = text.replace(" ", "")
        for kind, phrases, all_of, need, weight in (("exact", (whole,) if eligible(whole) else (), True, (), 3.0), ("token_and", long, True, short, 4.0), ("token_or", long, False, (), 0.8)):
            if phrases:
                key = (phrases, all_of or len(phrases) == 1, need)
                channel = made.setdefault(key, Channel(kind, phrases, all_of, need, weight, []))
                channel.variants += [n] if n not in channel.variants else []
    return [*made.values()]


@dataclass
class Plan:
    """What a hybrid search asks: variants, channels, all phrases that are counted, terms of routing."""

    variants: list[str]
    channels: list[Channel]
    phrases: list[str]
    terms: list[str]
    hints: tuple[str, ...]

    @classmethod
    def of(cls, texts: tuple[str, ...], hints: tuple[str, ...] = ()) -> Plan:
        variants = distinct_in_order(map(normal_query, texts))[:4]
        channels = channels_of(variants)
        terms = distinct_in_order(t for v in variants for t in query_terms(v))[:12]
        return cls(variants, channels, distinct_in_order([*(p for c in channels for p in (*c.phrases, *c.short)), *terms, *variants]), terms, hints)

    def key(self, phrase: str) -> int:
        return self.phrases.index(phrase)


def searched(spark, d, plan: Plan) -> DataFrame:
    """What everything else is taken from: the counts of current documents, with the corpus statistics of all versions."""
    rows, _ = bm25(counted(versions(spark, d), plan.phrases), len(plan.phrases))
    return kept(current(rows, spark, d), "search-rows")


def source_cover(rows: DataFrame, plan: Plan) -> DataFrame:
    """source, coverage: how many terms the profile of a source (its name and its current titles) holds.

    A term has no blank, so it stands in the joined titles if it stands in one of them: no profile is put together.
    """
    has = [F.max(F.when((F.col(f"t{plan.key(t)}") > 0) | F.contains(F.lower("source"), F.lit(t)), 1).otherwise(0)) for t in plan.terms[:10]]
    return rows.groupBy("source").agg(reduce(add, has).cast("int").alias("coverage"))


def route(rows: DataFrame, plan: Plan, most: int = 5) -> DataFrame:
    """source, place, hinted: hinted sources first, then those of the best coverage, each followed by its siblings.

    Stand-in for a source's site: the last digit of its name.
    """
    cover = source_cover(rows, plan)
    official = F.substring("source", -1, 1).isin(*"01234")
    best = cover.where("coverage > 0").orderBy(F.desc("coverage"), F.when(official, 0).otherwise(1), "source").limit(12)
    rank = F.row_number().over(Window.orderBy(F.desc("coverage"), F.when(official, 0).otherwise(1), "source"))  # 12 rows
    best = best.withColumn("rank", rank).withColumn("site", F.min("rank").over(Window.partitionBy(F.substring("source", -1, 1))))
    hinted = F.coalesce(F.array_position(F.array(*[F.lit(h) for h in plan.hints]).cast("array<string>"), F.col("source")), F.lit(0))
    every = cover.join(best.select("source", "rank", "site"), "source", "left").withColumn("hint", hinted).where("hint > 0 OR rank IS NOT NULL")
    order = [F.when(F.col("hint") > 0, F.col("hint")).otherwise(1000), "site", "rank"]
    return every.orderBy(*order).limit(most).select("source", F.row_number().over(Window.orderBy(*order)).alias("place"), (F.col("hint") > 0).alias("hinted"))


def found_by_channels(rows: DataFrame, plan: Plan) -> DataFrame:
    """Each channel's DEPTH best: doc_id, channel, kind, weight, variants, rank, with the counts and features."""
    parts = shares(len(plan.phrases))
    features = [c for c in rows.columns if c not in ("n", "avgdl") and not c.startswith("n")]
    made = []
    for n, c in enumerate(plan.channels):
        keys = [plan.key(p) for p in c.phrases]
        test = reduce(and_ if c.all_of else or_, map(hit, keys))
        test = reduce(and_, [hit(plan.key(t)) for t in c.short], test)
        made.append(F.when(test, F.struct(F.lit(n).alias("channel"), F.lit(c.kind).alias("how"), F.lit(c.weight).alias("weight"), F.array(*map(F.lit, c.variants)).cast("array<int>").alias("variants"), score_of(parts, keys).alias("score"))))
    hits = rows.select(*features, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select(*features, "x.*")
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy("score", F.desc("published"), "doc_id"))).where(F.col("rank") <= DEPTH)
    wanted = [plan.key(t) for t in plan.terms if eligible(t)]
    if not wanted:
        return best
    # each routed source (five at most) is a channel: any term, its own documents before others
    routed = route(rows, plan).select(F.col("source").alias("routed"), (F.lit(len(made) - 1) + F.col("place")).alias("channel"), F.when(F.col("hinted"), 1.2).otherwise(1.0).alias("weight"))
    any_term = rows.where(reduce(or_, map(hit, wanted))).withColumn("score", score_of(parts, wanted)).crossJoin(F.broadcast(routed))
    order = Window.partitionBy("channel").orderBy(F.when(F.col("source") == F.col("routed"), 0).otherwise(1), "score", F.desc("published"), "doc_id")
    more = any_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEPTH).withColumns({"how": F.lit("source_routed"), "variants": F.array().cast("array<int>")})
    return best.unionByName(more.select(*best.columns))


def fuse(found: DataFrame, n_variants: int) -> DataFrame:
    """One row a uri: the sum of weight / (RRF + rank), the kinds of channels, the sum of each variant's channels, and the
    document that was seen first."""
    share = found.withColumn("share", F.col("weight") / (RRF + F.col("rank")))
    sums = [F.round(F.sum(F.when(F.array_contains("variants", v), F.col("share")).otherwise(0.0)), 12).alias(f"v{v}_sum") for v in range(n_variants)]
    seen = F.struct("channel", "rank")
    features = [c for c in found.columns if c not in ("channel", "how", "weight", "variants", "score", "rank", "uri")]
    return share.groupBy("uri").agg(F.round(F.sum("share"), 12).alias("rrf"), F.array_join(F.array_sort(F.collect_set("how")), ",").alias("channels"), F.min_by(F.struct(*features), seen).alias("x"), *sums).select("uri", "rrf", "channels", "x.*", *[f"v{v}_sum" for v in range(n_variants)])


def freshness(day: Column) -> Column:
    age = F.date_diff(F.lit(AS_OF).cast("date"), day)
    return F.when(age <= 180, 0.025).when(age <= 400, 0.018).when(age <= 800, 0.008).otherwise(0.0)


def listing(body: Column) -> Column:
    """Whether a text is a list of entries: eight lines, five of them different and of 2 to 80 characters, mostly short,
    with few sentence marks."""
    lines = F.filter(F.transform(F.split(body, r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != "")
    n = F.size(lines)
    good = F.size(F.array_distinct(F.filter(lines, lambda x: F.length(x).between(2, 80) & ~x.rlike("^(?:[0-9a-f_-]{8,}|[0-9]+)$"))))
    short = F.size(F.filter(lines, lambda x: F.length(x).between(2, 40)))
    marks = F.length(body) - F.length(F.translate(body, "。！？；", ""))
    return (F.length(body) <= 24000) & (n >= 8) & (good >= 5) & (short / F.greatest(n, F.lit(1)) >= 0.55) & (marks <= F.greatest(F.lit(8), F.floor(n / 3)))


def scored(spark, d, rows: DataFrame, plan: Plan) -> DataFrame:
    """The CANDIDATES best of the fusion with coverage and final score."""
    few = fuse(found_by_channels(rows, plan), len(plan.variants)).orderBy(F.desc("rrf"), "uri").limit(CANDIDATES)
    if asks_list := any(w in v for v in plan.variants for w in ENUMERATION.split("|")):  # texts are read for this only
        few = kept(few, "search-candidates")
        texts = table(spark, d, "documents").join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi").select("doc_id", listing(F.lower("text")).alias("lines"))
        few = few.join(texts, "doc_id")
    else:
        few = few.withColumn("lines", F.lit(False))
    sets = [[plan.key(t) for t in query_terms(v)] for v in plan.variants]
    in_text = lambda k: F.when(hit(k), 1).otherwise(0)
    in_title = lambda k: F.when(F.col(f"t{k}") > 0, 1).otherwise(0)
    share = lambda has: F.greatest(F.lit(0.0), *[reduce(add, map(has, s)) / len(s) for s in sets if s])
    focus = distinct_in_order(query_terms(v)[-1] for v in plan.variants if query_terms(v))
    focused = reduce(or_, [F.col(f"t{plan.key(t)}") > 0 for t in focus], F.lit(False))
    named = reduce(or_, [F.col(f"t{plan.key(v)}") > 0 for v in plan.variants], F.lit(False))
    routed = F.broadcast(route(rows, plan).select("source", "hinted"))
    rows = few.join(routed, "source", "left").withColumns({"coverage": share(in_text), "title_coverage": share(in_title), "listing": F.col("lines") & focused})
    bonus = [
        F.col("rrf"),
        0.030 * F.col("coverage") + 0.018 * F.col("title_coverage"),
        F.when(F.col("hinted"), 0.032).when(F.col("hinted").isNotNull(), 0.012).otherwise(0.0),
        F.when(F.col("authority") == "official", 0.012).when(F.col("authority") == "official_secondary", 0.006).otherwise(0.0),
        F.when(F.col("kind") != "html", 0.0).when(F.col("body_chars") < F.greatest(F.lit(180), 3 * F.col("title_chars")), 0.005 - 0.015).otherwise(0.005),
        freshness(F.col("published")),
        F.when(F.lit(asks_list) & F.col("listing") & (F.col("coverage") >= 0.75), 0.080).otherwise(0.0),
        F.when(F.lit(asks_list) & focused, 0.022).otherwise(0.0),
        F.when(named, 0.018).otherwise(0.0),
        F.when(F.col("body_chars") < IMAGE, -0.035).otherwise(0.0),
    ]
    return rows.withColumn("final", F.round(reduce(add, bonus), 9))


#: Stand-in for images of an article, which the test tables lack: texts of less than so many characters, whose parent is
#: one page for each source.
IMAGE = 60


def collapse(ranked: DataFrame) -> DataFrame:
    """Images of one article are one: the best stays and gains half of the others' fused score."""
    parent = F.when(F.col("body_chars") < IMAGE, F.concat(F.lit("page of "), "source")).otherwise(F.col("uri"))
    group = Window.partitionBy(parent)
    place = F.row_number().over(group.orderBy(F.desc("final"), "uri"))
    others = (F.sum("rrf").over(group) - F.first("rrf").over(group.orderBy(F.desc("final"), "uri"))) * 0.5
    return ranked.withColumn("_place", place).withColumn("final", F.round(F.col("final") + others, 9)).where("_place = 1").drop("_place")


def diversify(ranked: DataFrame, n_variants: int, limit: int = RETURNED, cap: int = CAP) -> DataFrame:
    """Each variant's best first, then by final score; at most `cap` of a source before those past the cap fill up."""
    seed = lambda v: F.when((F.col(f"v{v}_sum") > 0) & (F.row_number().over(Window.partitionBy(F.col(f"v{v}_sum") > 0).orderBy(F.desc(F.round(F.col(f"v{v}_sum") + 0.030 * F.col("title_coverage") + 0.250 * F.col("final"), 9)), F.desc("final"), "uri")) == 1), v)
    first = F.least(F.lit(n_variants), *[seed(v) for v in range(n_variants)]) if n_variants > 1 else F.lit(0)
    rows = ranked.withColumn("seed", first)
    order = ["seed", F.desc("final"), "uri"]
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    best = rows.withColumn("past", place > cap).orderBy("past", *order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("past", *order)))  # few rows


def excerpt(body: Column, terms, width: int = 1400) -> Column:
    """The text around the first hit of any term, from 220 characters before it; dots show where it is cut."""
    places = F.filter(F.array(*[F.instr(F.lower(body), t) for t in terms]), lambda x: x > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - 1 - 220, F.lit(0))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(body, start + 1, F.lit(width)), F.when(start + width < F.length(body), "…").otherwise(""))
    return F.when(F.length(body) <= width, body).otherwise(cut)


def hybrid(spark, d, plan: Plan) -> DataFrame:
    return diversify(collapse(scored(spark, d, searched(spark, d, plan), plan)), len(plan.variants))


#: The search of the queries below: three variants, of which the last asks for a list, and a hinted source.
PLAN = Plan.of(("License", "the of tion", "列出 tion"), ("src3",))


def _hybrid_sql(plan: Plan) -> str:
    keyed = lambda ps: [plan.key(p) for p in ps]
    some = lambda k: f"(t{k} + b{k} > 0)"
    union, weights, hows, variants = [], [], [], []
    for n, c in enumerate(plan.channels):
        test = (" AND " if c.all_of else " OR ").join(map(some, keyed(c.phrases)))
        need = "".join(f" AND {some(k)}" for k in keyed(c.short))
        union.append(f"SELECT f.*, {n} AS channel, {_score_sql(keyed(c.phrases))} AS score FROM f, s WHERE ({test}){need} AND {SQL_CURRENT}")
        weights.append(f"WHEN {n} THEN {c.weight}::DOUBLE")
        hows.append(f"WHEN {n} THEN '{c.kind}'")
        variants.append(f"WHEN {n} THEN {c.variants}::INT[]")
    n = len(plan.channels)
    wanted = keyed(t for t in plan.terms if eligible(t))
    contains = " + ".join(f"max((contains(lower(title), '{t}') OR contains(lower(source), '{t}'))::INT)" for t in plan.terms[:10])
    hint = "CASE source " + " ".join(f"WHEN '{h}' THEN {i}" for i, h in enumerate(plan.hints, 1)) + " ELSE 0 END" if plan.hints else "0"
    official = "(CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 0 ELSE 1 END)"
    sets = [keyed(query_terms(v)) for v in plan.variants]
    share = lambda has: f"greatest(0.0::DOUBLE, {', '.join('(' + ' + '.join(has(k) for k in s) + f')::DOUBLE / {len(s)}' for s in sets if s)})"
    focus = keyed(distinct_in_order(query_terms(v)[-1] for v in plan.variants if query_terms(v)))
    focused = "(" + " OR ".join(f"t{k} > 0" for k in focus) + ")"
    asks = any(w in v for v in plan.variants for w in ENUMERATION.split("|"))
    nv = len(plan.variants)
    lines = "list_filter(list_transform(regexp_split_to_array(lower(text), '\\n+'), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> '')"
    sums = ", ".join(f"round(sum(CASE WHEN list_contains(variants, {v}) THEN share ELSE 0 END), 12) AS v{v}_sum" for v in range(nv))
    seed_of = lambda v: f"CASE WHEN v{v}_sum > 0 AND row_number() OVER (PARTITION BY v{v}_sum > 0 ORDER BY round(v{v}_sum + 0.030::DOUBLE * title_coverage + 0.250::DOUBLE * final, 9) DESC, final DESC, uri) = 1 THEN {v} END"
    seed = f"least({nv}, {', '.join(map(seed_of, range(nv)))})" if nv > 1 else "0"
    return f"""WITH {_counts_sql(plan.phrases)}, h AS ({' UNION ALL '.join(union)}),
cover AS (SELECT source, ({contains})::INT AS coverage FROM v WHERE {SQL_CURRENT} GROUP BY source),
best AS (SELECT *, row_number() OVER (ORDER BY coverage DESC, {official}, source) AS rank FROM cover WHERE coverage > 0 QUALIFY rank <= 12),
sited AS (SELECT *, min(rank) OVER (PARTITION BY right(source, 1)) AS site FROM best),
routed AS (SELECT source AS routed, hint > 0 AS hinted, row_number() OVER (ORDER BY CASE WHEN hint > 0 THEN hint ELSE 1000 END, site, rank) AS place FROM (SELECT c.source, {hint.replace('source', 'c.source')} AS hint, site, rank FROM cover c LEFT JOIN sited USING (source)) WHERE hint > 0 OR rank IS NOT NULL QUALIFY place <= 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score, published DESC, doc_id) AS rank, CASE channel {' '.join(weights)} END AS weight, CASE channel {' '.join(hows)} END AS how, CASE channel {' '.join(variants)} END AS variants FROM h QUALIFY rank <= 32
  UNION ALL SELECT * EXCLUDE (routed, hinted, place), row_number() OVER (PARTITION BY channel ORDER BY (source = routed) DESC, score, published DESC, doc_id) AS rank, CASE WHEN hinted THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS weight, 'source_routed' AS how, []::INT[] AS variants
  FROM (SELECT f.*, ({n - 1} + place)::INT AS channel, {_score_sql(wanted)} AS score, r.* FROM f, s, routed r WHERE ({' OR '.join(map(some, wanted))}) AND {SQL_CURRENT}) QUALIFY rank <= 32),
shares AS (SELECT *, weight / (60 + rank) AS share FROM ranked),
fused AS (SELECT uri, round(sum(share), 12) AS rrf, string_agg(DISTINCT how, ',' ORDER BY how) AS channels, arg_min(doc_id, channel * 1000 + rank) AS doc_id, {sums} FROM shares GROUP BY uri ORDER BY rrf DESC, uri LIMIT 160),
lined AS (SELECT doc_id, length(text) AS chars, {lines} AS x, text FROM documents WHERE doc_id IN (SELECT doc_id FROM fused)),
feat AS (SELECT fused.*, f.* EXCLUDE (doc_id, uri), hinted, {share(lambda k: f'{some(k)}::INT')} AS coverage, {share(lambda k: f'(t{k} > 0)::INT')} AS title_coverage, {focused} AS focused,
  {focused} AND chars <= 24000 AND len(x) >= 8 AND len(list_distinct(list_filter(x, lambda y: length(y) BETWEEN 2 AND 80 AND NOT regexp_full_match(y, '(?:[0-9a-f_-]{{8,}}|[0-9]+)')))) >= 5
  AND len(list_filter(x, lambda y: length(y) BETWEEN 2 AND 40))::DOUBLE / greatest(len(x), 1) >= 0.55 AND length(text) - length(translate(text, '。！？；', '')) <= greatest(8, len(x) // 3) AS listing
  FROM fused JOIN f USING (doc_id) JOIN lined USING (doc_id) LEFT JOIN routed ON routed = f.source),
fin AS (SELECT *, round(rrf + 0.030::DOUBLE * coverage + 0.018::DOUBLE * title_coverage + CASE WHEN hinted THEN 0.032::DOUBLE WHEN hinted IS NOT NULL THEN 0.012::DOUBLE ELSE 0 END
  + CASE authority WHEN 'official' THEN 0.012::DOUBLE WHEN 'official_secondary' THEN 0.006::DOUBLE ELSE 0 END
  + CASE WHEN kind <> 'html' THEN 0 WHEN body_chars < greatest(180, 3 * title_chars) THEN -0.010::DOUBLE ELSE 0.005::DOUBLE END
  + CASE WHEN date_diff('day', published, DATE '{AS_OF}') <= 180 THEN 0.025::DOUBLE WHEN date_diff('day', published, DATE '{AS_OF}') <= 400 THEN 0.018::DOUBLE WHEN date_diff('day', published, DATE '{AS_OF}') <= 800 THEN 0.008::DOUBLE ELSE 0 END
  + CASE WHEN {asks} AND listing AND coverage >= 0.75 THEN 0.080::DOUBLE ELSE 0 END + CASE WHEN {asks} AND focused THEN 0.022::DOUBLE ELSE 0 END
  + CASE WHEN {' OR '.join(f't{plan.key(x)} > 0' for x in plan.variants)} THEN 0.018::DOUBLE ELSE 0 END - CASE WHEN body_chars < {IMAGE} THEN 0.035::DOUBLE ELSE 0 END, 9) AS final FROM feat),
par AS (SELECT *, CASE WHEN body_chars < {IMAGE} THEN 'page of ' || source ELSE uri END AS parent FROM fin),
col AS (SELECT * REPLACE (round(final + 0.5::DOUBLE * (sum(rrf) OVER (PARTITION BY parent) - rrf), 9) AS final) FROM par QUALIFY row_number() OVER (PARTITION BY parent ORDER BY par.final DESC, uri) = 1),
sd AS (SELECT *, {seed} AS seed FROM col),
pl AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seed, final DESC, uri) > 3 AS past FROM sd),
found AS (SELECT *, row_number() OVER (ORDER BY past, seed, final DESC, uri)::INT AS rank FROM pl QUALIFY rank <= 12)"""


_HYBRID = _hybrid_sql(PLAN)


@query(_HYBRID + " SELECT rank, doc_id, uri, source, rrf, channels, round(coverage, 9) AS coverage, listing, final FROM found")
def RT3_hybrid_search(spark, d):
    return hybrid(spark, d, PLAN).select("rank", "doc_id", "uri", "source", "rrf", "channels", F.round("coverage", 9).alias("coverage"), "listing", "final")


@query(_HYBRID + " SELECT uri, rrf, channels, doc_id FROM fused")
def RT3_rrf_fusion(spark, d):
    return fuse(found_by_channels(searched(spark, d, PLAN), PLAN), len(PLAN.variants)).orderBy(F.desc("rrf"), "uri").limit(CANDIDATES).select("uri", "rrf", "channels", "doc_id")


@query(_HYBRID + " SELECT doc_id, source, final, rank FROM found")
def WI5_diversified_topk(spark, d):
    return hybrid(spark, d, PLAN).select("doc_id", "source", "final", "rank")


@query(_HYBRID + " SELECT doc_id, round(title_coverage, 9) AS title_coverage, final FROM fin")
def RT5_candidate_score(spark, d):
    return scored(spark, d, searched(spark, d, PLAN), PLAN).select("doc_id", F.round("title_coverage", 9).alias("title_coverage"), "final")


@query(_HYBRID + " SELECT parent, min(uri) AS uri, count(*) AS held, round(sum(rrf), 9) AS rrf FROM par GROUP BY parent")
def WI17_collapsed_assets(spark, d):
    parent = F.when(F.col("body_chars") < IMAGE, F.concat(F.lit("page of "), "source")).otherwise(F.col("uri"))
    return scored(spark, d, searched(spark, d, PLAN), PLAN).groupBy(parent.alias("parent")).agg(F.min("uri").alias("uri"), F.count("*").alias("held"), F.round(F.sum("rrf"), 9).alias("rrf"))


@query(_HYBRID + " SELECT seed, doc_id FROM sd WHERE seed < 3")
def WI16_variant_seed(spark, d):
    """The best row of each variant."""
    rows = diversify(collapse(scored(spark, d, searched(spark, d, PLAN), PLAN)), len(PLAN.variants), limit=CANDIDATES, cap=CANDIDATES)
    return rows.where(F.col("seed") < len(PLAN.variants)).select("seed", "doc_id")


@query(_HYBRID + f""", e AS (SELECT f.doc_id, d.text, list_min(list_filter([{', '.join(f"instr(lower(d.text), '{t}')" for t in PLAN.terms)}], lambda x: x > 0)) AS pos FROM found f JOIN documents d USING (doc_id)),
b AS (SELECT *, greatest(coalesce(pos, 1) - 1 - 220, 0) AS st FROM e)
SELECT doc_id, CASE WHEN length(text) <= 1400 THEN text ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || substr(text, (st + 1)::BIGINT, 1400) || CASE WHEN st + 1400 < length(text) THEN '…' ELSE '' END END AS excerpt FROM b""")
def SF6_excerpt(spark, d):
    """Excerpts of what the hybrid search returns; texts are read for those documents only."""
    few = hybrid(spark, d, PLAN).select("doc_id")
    return table(spark, d, "documents").join(F.broadcast(few), "doc_id", "left_semi").select("doc_id", excerpt(F.col("text"), PLAN.terms).alias("excerpt"))


@query(_HYBRID + " SELECT routed AS source, place::INT AS place, hinted FROM routed")
def RT4_source_routing(spark, d):
    return route(searched(spark, d, PLAN), PLAN)


@query(_HYBRID + f""", c AS (SELECT source, count(*) AS n, bool_or(listing) AS l FROM found GROUP BY source)
SELECT round(max(n) / sum(n), 9) AS concentration, (max(n) / sum(n) > 0.75 AND NOT bool_or(l)) OR NOT bool_or(l) OR NOT bool_or(source = '{PLAN.hints[0]}') AS at_risk FROM c""")
def AG19_concentration(spark, d):
    """Share of the commonest source among what was found, and whether the answer may be incomplete (a list was asked for)."""
    c = hybrid(spark, d, PLAN).groupBy("source").agg(F.count("*").alias("n"), F.bool_or("listing").alias("l"))
    share = F.max("n") / F.sum("n")
    risk = ((share > 0.75) & ~F.bool_or("l")) | ~F.bool_or("l") | ~F.bool_or(F.col("source") == PLAN.hints[0])
    return c.agg(F.round(share, 9).alias("concentration"), risk.alias("at_risk"))


@query(f"SELECT doc_id, source, lang, substr(text, 1, 80) AS title FROM documents WHERE {SQL_CURRENT}")
def FI3_current_documents(spark, d):
    return current_documents(spark, d).select("doc_id", "source", "lang", "title")


@query("SELECT count(*) AS n, round(avg(greatest(length(substr(text, 1, 80)) - 2, 0) + greatest(length(text) - 2, 0)), 6) AS avgdl, count(*) FILTER (contains(lower(text), 'license')) AS n_hit FROM documents")
def AG25_corpus_statistics(spark, d):
    docs = versions(spark, d).select("source", (trigrams(F.col("title")) + trigrams(F.col("body"))).alias("dl"), F.contains(F.lower("body"), F.lit("license")).alias("hit"))
    return docs.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.count_if("hit").alias("n_hit"))


@query("""WITH c AS (SELECT doc_id, unnest(range(0, greatest(ceil(length(text) / 4000.0), 1)::BIGINT)) AS ordinal, text FROM documents),
      s AS (SELECT doc_id, ordinal::INT AS ordinal, lower(substr(text, (ordinal * 4000 + 1)::BIGINT, 4000)) AS x FROM c),
      n AS (SELECT doc_id, ordinal, length(x) AS size, len(regexp_extract_all(x, 'the')) AS a, len(regexp_extract_all(x, 'license')) AS b, len(regexp_extract_all(x, 'tion')) AS c FROM s),
      r AS (SELECT *, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS present, row_number() OVER (PARTITION BY doc_id ORDER BY (a > 0)::INT + (b > 0)::INT + (c > 0)::INT DESC, a + b + c DESC, size, ordinal) AS rn FROM n)
      SELECT doc_id, ordinal, present FROM r WHERE rn = 1""")
def AG22_best_chunk(spark, d):
    """Of each document's blocks of 4000 characters the one with most terms, then most occurrences, then shortest, then first."""
    terms = ("the", "license", "tion")
    docs = table(spark, d, "documents").select("doc_id", "text")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 4000) - 1, F.lit(0)).cast("int"))
    chunks = docs.select("doc_id", "text", F.explode(starts).alias("ordinal")).select("doc_id", "ordinal", F.lower(F.substring("text", F.col("ordinal") * 4000 + 1, F.lit(4000))).alias("content"))
    count = [occurrences(F.col("content"), t) for t in terms]
    made = chunks.select("doc_id", "ordinal", F.length("content").alias("size"), reduce(add, [F.least(c, F.lit(1)) for c in count]).alias("present"), reduce(add, count).alias("hits"))
    best = F.max_by("ordinal", F.struct("present", "hits", -F.col("size"), -F.col("ordinal")))
    return made.groupBy("doc_id").agg(best.alias("ordinal"), F.max("present").alias("present"))


# --- evaluation -----------------------------------------------------------------------------------------------------

ANCHOR = 5


def runs_of(words: Column, n: int) -> Column:
    """All runs of n words, joined; zipped rather than sliced in a lambda, which would evaluate `words` for each run."""
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words) - n + 1, F.lit(0))).alias(f"w{k}") for k in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)]))


def holders(spark, d) -> DataFrame:
    """item_id, doc_id: documents that hold a benchmark passage as it is.

    A passage of seven words or more is met on a run of ANCHOR whole words after its first, an equi-join, and verified;
    shorter ones, which should be few, are compared with every text.
    """
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")).withColumn("words", F.split(F.trim("passage"), r"\s+"))
    first = F.xxhash64(F.array_join(F.slice("words", 2, ANCHOR), " "))
    long = items.where(F.size("words") >= ANCHOR + 2).select("item_id", "passage", first.alias("anchor"))
    runs = docs.select("doc_id", F.explode(F.array_distinct(F.transform(runs_of(F.split("text", r"\s+"), ANCHOR), lambda x: F.xxhash64(x)))).alias("anchor"))
    met = kept(runs.join(long.select("item_id", "anchor"), "anchor").select("doc_id", "item_id"), "met-passages")  # few, so texts aren't sorted to meet them
    met = met.join(items.select("item_id", "passage"), "item_id").join(docs, "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    short = items.where(F.size("words") < ANCHOR + 2).select("item_id", "passage")
    return kept(met.union(docs.join(short, F.contains("text", "passage")).select("item_id", "doc_id")), "passages-held")


@query("WITH f AS (SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY item_id) SELECT b.item_id, coalesce(n_docs, 0) AS n_docs, coalesce(first_doc, -1) AS first_doc FROM benchmark b LEFT JOIN f USING (item_id)")
def SC27_evaluation_cases(spark, d):
    """The evaluation set: passages with the documents that should be found."""
    found = holders(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return table(spark, d, "benchmark").select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("first_doc", F.lit(-1)).alias("first_doc"))


def ranked_cases(spark, d, depth: int = 10) -> DataFrame:
    """item_id, doc_id, rank: documents by how many different runs of three words they share with a passage."""
    words = F.split(F.trim(F.lower("text")), r"\s+")
    run = F.explode(F.array_distinct(F.when(F.size(words) < 3, F.array(F.array_join(words, " "))).otherwise(runs_of(words, 3)))).alias("run")
    items = table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", run)
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", run)
    shared = docs.join(items, "run").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return kept(shared.withColumn("rank", place).where(F.col("rank") <= depth), "ranked-cases")


def _runs_sql(name: str, key: str, source: str) -> str:
    """Distinct runs of three words (or all, of fewer) of each row."""
    return rf"""{name}w AS (SELECT {key}, regexp_split_to_array(regexp_replace(lower(text), '^[ ]+|[ ]+$', '', 'g'), '\s+') AS w FROM {source} WHERE text IS NOT NULL),
{name}u AS (SELECT {key}, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM {name}w WHERE len(w) >= 3),
{name} AS (SELECT DISTINCT {key}, run FROM (SELECT {key}, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS run FROM {name}u WINDOW p AS (PARTITION BY {key} ORDER BY i)
  UNION ALL SELECT {key}, array_to_string(w, ' ') FROM {name}w WHERE len(w) < 3) WHERE run IS NOT NULL)"""


_RANKED = f"""WITH {_runs_sql('x', 'item_id', 'benchmark')}, {_runs_sql('dx', 'doc_id', 'documents')},
sh AS (SELECT item_id, doc_id, count(*) AS shared FROM dx JOIN x USING (run) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM sh QUALIFY rank <= 10),
want AS (SELECT b.item_id, d.doc_id, d.lang FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
hit AS (SELECT want.*, rank FROM want LEFT JOIN r USING (item_id, doc_id))"""


@query(_RANKED + " SELECT item_id, count(*) AS expected, round(avg((rank IS NOT NULL AND rank <= 5)::INT), 9) AS recall_5, round(avg((rank IS NOT NULL)::INT), 9) AS recall_10, bool_or(rank IS NOT NULL AND rank <= 3) AS top_3 FROM hit GROUP BY item_id")
def AG18_recall(spark, d):
    """Recall at 5 and 10 of each case over ranked results."""
    hits = holders(spark, d).join(ranked_cases(spark, d).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left")
    within = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    return hits.groupBy("item_id").agg(F.count("*").alias("expected"), F.round(F.avg(within(5).cast("int")), 9).alias("recall_5"), F.round(F.avg(within(10).cast("int")), 9).alias("recall_10"), F.bool_or(within(3)).alias("top_3"))


@query(_RANKED + """ SELECT coalesce(lang, 'all') AS domain, count(DISTINCT item_id) AS cases, round(avg((rank IS NOT NULL AND rank <= 5)::INT), 9) AS recall_5, round(avg((rank IS NOT NULL)::INT), 9) AS recall_10,
  avg((rank IS NOT NULL AND rank <= 5)::INT) >= 0.95 AND avg((rank IS NOT NULL)::INT) >= 1.0 AS passed FROM hit GROUP BY GROUPING SETS ((), (lang))""")
def RT17_evaluation_report(spark, d):
    """Cases, recall and the gate, for each domain (the language stands in) and in all."""
    hits = holders(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").join(ranked_cases(spark, d).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left")
    r5, r10 = (F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")) for k in (5, 10))
    report = hits.cube("lang").agg(F.count_distinct("item_id").alias("cases"), F.round(r5, 9).alias("recall_5"), F.round(r10, 9).alias("recall_10"), ((r5 >= 0.95) & (r10 >= 1.0)).alias("passed"))
    return report.select(F.coalesce("lang", F.lit("all")).alias("domain"), "cases", "recall_5", "recall_10", "passed")


# --- predicates and scalars -----------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') AND contains(lower(text), 'the')) OR contains(lower(text), 'apache')")
def FI4_phrase_match(spark, d):
    """A phrase matches as a substring of the title or of the body, in any case; titles here begin the body."""
    low = versions(spark, d).select("doc_id", F.lower("title").alias("t"), F.lower("body").alias("b"))
    has = lambda p: F.contains("t", F.lit(p)) | F.contains("b", F.lit(p))
    return low.where((has("license") & has("the")) | has("apache")).select("doc_id")


@query("WITH j AS (SELECT doc_id, lower(substr(text, 1, 80) || ' ' || text) AS x FROM documents) SELECT doc_id, instr(x, 'zu')::INT AS at FROM j WHERE instr(x, 'ou') > 0 AND instr(x, 'zu') > 0")
def FI5_short_terms(spark, d):
    joined = F.lower(F.concat_ws(" ", "title", "body"))
    return versions(spark, d).where((F.instr(joined, "ou") > 0) & (F.instr(joined, "zu") > 0)).select("doc_id", F.instr(joined, "zu").alias("at"))


@query("SELECT source, sum(c)::BIGINT AS covered, max(c)::INT AS best FROM (SELECT source, contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'los')::INT AS c FROM documents) GROUP BY source")
def JO21_term_coverage(spark, d):
    docs = versions(spark, d).select("source", F.lower("body").alias("b"))
    covered = reduce(add, [F.when(F.contains("b", F.lit(t)), 1).otherwise(0) for t in ("the", "license", "der", "los")])
    return docs.select("source", covered.alias("covered")).groupBy("source").agg(F.sum("covered").cast("long").alias("covered"), F.max("covered").alias("best"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), 1, 180) AS preview FROM documents")
def SF9_preview(spark, d):
    return versions(spark, d).select("doc_id", preview(F.col("body")).alias("preview"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def SF19_cosine_topk(spark, d):
    """The ten vectors nearest to vector 0 (an extra: the vectors are compared by nothing else)."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return e.where("vec_id <> 0").crossJoin(F.broadcast(one)).select("vec_id", F.round(dot, 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)




# --- the older excerpt ----------------------------------------------------------------------------------------------

#: What is asked; how wide an excerpt is, how far before a term it may begin, and how many places of a term are tried.
ASKED = ("license", "there", "tion", "zzzz")
WIDTH, LEAD, TRIED = 1200, 180, 256


def rare_excerpt(text: Column, terms: tuple[str, ...], width: int = WIDTH) -> Column:
    """The passage with the most of the terms, then with the rarest (sum of 1 / how often each stands in the text), then the
    last such; it begins at 0, or LEAD or half a width before one of the first TRIED places of a term.

    Ellipses say where text was left out.  Terms are tried longest first, so sums add up alike for equal sets of terms.
    """
    terms = tuple(sorted(dict.fromkeys(t.lower() for t in terms), key=len, reverse=True))
    body = F.trim(text)
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    quoted = lambda t: f"\\Q{t}\\E"

    def starts(low: Column, t: str) -> Column:
        sizes = F.transform(F.split(low, quoted(t), TRIED + 1), F.length)
        found = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(t), F.lit(0)) + n)))
        return F.flatten(F.transform(found, lambda at: F.array(F.greatest(at - LEAD, F.lit(0)), F.greatest(at - width // 2, F.lit(0)))))

    def best(low: Column) -> Column:
        each = F.array_distinct(F.concat(F.array(F.lit(0)), *[starts(low, t) for t in terms]))
        often = F.array(*[F.size(F.split(low, quoted(t), -1)) - 1 for t in terms])

        def scored(often: Column) -> Column:
            def score(at: Column) -> Column:
                held = lambda passage: [F.contains(passage, F.lit(t)) for t in terms]
                total = lambda p: (reduce(add, [h.cast("int") for h in held(p)]), reduce(add, [F.when(h, 1.0 / often[k]).otherwise(0.0) for k, h in enumerate(held(p))]))
                return let(F.substring(low, at + 1, F.lit(width)), lambda p: F.struct(total(p)[0].alias("terms"), total(p)[1].alias("rare"), at.alias("at")))

            return F.array_max(F.transform(each, score))["at"]

        return let(often, scored)

    cut = lambda at: F.concat(F.when(at > 0, "…").otherwise(""), F.substring(body, at + 1, F.lit(width)), F.when(at + width < F.length(body), "…").otherwise(""))
    return let(let(F.lower(body), best), cut)


def _rare_sql() -> str:
    terms = sorted(ASKED, key=len, reverse=True)
    places = lambda k, t: f"list_transform(range(1, least(len(g{k}), {TRIED + 1})), lambda i: (list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + (i - 1) * {len(t)})::BIGINT)"
    both = [f"list_transform({places(k, t)}, lambda p: greatest(0, p - {back}))" for k, t in enumerate(terms) for back in (LEAD, WIDTH // 2)]
    passage = f"substr(low, pos + 1, {WIDTH})"
    count = " + ".join(f"contains({passage}, '{t}')::INT" for t in terms)
    rare = " + ".join(f"CASE WHEN contains({passage}, '{t}') THEN 1.0::DOUBLE / (len(g{k}) - 1) ELSE 0.0::DOUBLE END" for k, t in enumerate(terms))
    return f"""WITH a AS (SELECT doc_id, trim(text) AS body, lower(trim(text)) AS low FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, {', '.join(f"string_split(low, '{t}') AS g{k}" for k, t in enumerate(terms))} FROM a),
s AS (SELECT *, unnest(list_distinct(list_concat([0::BIGINT], {', '.join(both)}))) AS pos FROM g),
m AS (SELECT doc_id, any_value(body) AS body, arg_max(pos, ({count}, {rare}, pos)) AS pos FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN pos > 0 THEN '…' ELSE '' END || substr(body, pos + 1, {WIDTH}) || CASE WHEN pos + {WIDTH} < length(body) THEN '…' ELSE '' END AS excerpt FROM m"""


@query(_rare_sql())
def SF7_rare_excerpt(spark, d):
    """The older excerpt of every document for one question; one of its terms stands nowhere."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", rare_excerpt(F.col("text"), ASKED).alias("excerpt"))
