"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

1. Candidates of each document: three base kinds by pattern, and `live`, long mixed tokens of any shape.
2. Each value's hash is counted over the corpus: distinct repositories and distinct owners that hold it.
3. A value held by many owners is an example that was copied about; a value of one owner, in few repositories, that
   looks drawn at random is a credential that may still be in use.  Only such `live` candidates become spans.

Base spans always stay; the counts only label them.

Offsets: Spark's regular expressions give no offsets, but split() and regexp_extract_all() find the same matches, so
the lengths of the pieces between matches and of the matches before give each match's place.

Scale: texts are read once and never shuffled.  Only matches are: to (hash, owner) first, with partial aggregation, so
a value that a third of all rows hold is one row a task; then to hash.  The labels come back through a join that is
skewed only on the side of the matches, which adaptive execution splits.  Nothing is broadcast by this code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed patterns of the contract.  A value that is too short is dropped after matching, without another try; for
#: access and hex a minimal count in the pattern says the same, as their matches are maximal runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The added kind: long tokens of the base64 and base64url alphabets.
LIVE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
#: A value of more owners than this is an example; one in more repositories of one owner is shared configuration.
MOST_OWNERS, MOST_REPOS = 1, 2
#: Distinct characters that a value must have to look drawn at random.
LEAST_DISTINCT = 12


_SPANS = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once and not at each place, or each turn of a lambda, that names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(kind: int, pattern: str, least: int = 0) -> Column:
    """array<struct<start, end, kind, value>> of a pattern's matches in text; offsets in code points.

    Offsets are running totals, which a fold gives by appending, at the cost of a copy of all so far.  So the matches are
    cut into as many blocks as a block has matches: totals of blocks are folded first, then each block from its own.
    """
    p, zero = F.lit(pattern), F.lit(0).cast("long")
    found = F.regexp_extract_all("text", p, F.lit(0))
    value = F.regexp_extract_all("text", p, F.lit(2)) if least else found
    lengths = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    step = F.arrays_zip(lengths(F.split("text", pattern, -1)).alias("gap"), lengths(found).alias("size"), value.alias("value"))
    step = F.filter(step, lambda x: x["size"].isNotNull())

    def blocks(steps: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        last = F.ceil(F.size(steps) / width).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(steps, k * width + 1, width))

    def begins(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, lambda n, x: n + x["gap"] + x["size"]))
        return F.slice(F.aggregate(totals, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), F.lit(1), F.size(parts))

    def within(part: Column, at: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(at.alias("at"), F.array().cast(_SPANS).alias("spans")),
            lambda acc, x: _let(
                F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")),
                lambda s: F.struct(s["end"].alias("at"), F.when(F.length(s["value"]) >= least, F.concat(acc["spans"], F.array(s))).otherwise(acc["spans"]).alias("spans")),
            ),
            lambda acc: acc["spans"],
        )

    placed = _let(step, lambda steps: _let(blocks(steps), lambda parts: F.flatten(F.zip_with(parts, begins(parts), within))))
    return F.when(F.col("text").rlike(pattern), placed).otherwise(F.array().cast(_SPANS))


def _free(extra: str, base: str) -> Column:
    """The spans of `extra`, which are in order and apart, that meet none of `base`.

    A span meets as many others as start before its end less those that end up to its start.  Both numbers are places in
    a sorted array of both kinds, so the work is that of sorting, however many spans a text has.
    """

    def before(own: str, other: str, other_first: bool) -> Column:
        """For each span of extra, how many of base have `other` before its `own`; at it too, if other_first."""
        events = F.concat(
            F.transform(base, lambda s: F.struct(s[other].alias("at"), F.lit(int(not other_first)).alias("order"), F.lit(-1).alias("k"))),
            F.transform(extra, lambda s, k: F.struct(s[own].alias("at"), F.lit(int(other_first)).alias("order"), k.alias("k"))),
        )
        counted = F.transform(F.array_sort(events), lambda e, place: F.struct(e["k"].alias("k"), (place - e["k"]).alias("n")))
        return F.transform(F.filter(counted, lambda e: e["k"] >= 0), lambda e: e["n"])

    both = F.arrays_zip(F.col(extra).alias("span"), before("end", "start", False).alias("begun"), before("start", "end", True).alias("over"))
    return F.transform(F.filter(both, lambda x: x["begun"] == x["over"]), lambda x: x["span"])


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def candidates(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """_doc, _text (a hash), _owner, _repo, base and extra spans of each document."""
    rows = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("_repo"))
    rows = rows.select("_doc", "_owner", "_repo", F.sha2("text", 256).alias("_text"), _matches(0, ASSIGN, ASSIGN_LEAST).alias("a"), _matches(1, ACCESS).alias("k"), _matches(2, HEX).alias("h"), _matches(3, LIVE).alias("l"))
    base = F.array_sort(F.concat("a", "k", "h"))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= LEAST_DISTINCT)
    rows = rows.withColumn("base", base)
    return rows.select("_doc", "_owner", "_repo", "_text", "base", F.filter(_free("l", "base"), mixed).alias("extra"))


def ownership(found: DataFrame) -> DataFrame:
    """_hash, owners, repos of each candidate value.  A pair (repository, owner) counts once."""
    values = found.select("_owner", "_repo", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: F.sha2(s["value"], 256)))).alias("_hash"))
    by_repo = values.groupBy("_hash", "_owner", "_repo").agg(F.lit(1).alias("_one"))
    by_owner = by_repo.groupBy("_hash", "_owner").agg(F.count("*").alias("_repos"))
    return by_owner.groupBy("_hash").agg(F.count("*").alias("owners"), F.sum("_repos").alias("repos"))


def scan_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_live, n_example, base_sha256, spans.

    A repository is a value of `repo`, an owner a value of `owner`.  n_live counts values, base ones too, that look
    live by their ownership; n_example those of several owners.  Null or empty text has no spans.  Null owners and
    repositories count as one, the empty one.  Repeated rows give equal rows.  An empty table gives an empty one.
    Only doc_id, text and the two named columns are read, so other columns may have any name.
    """
    found = written(candidates(docs, owner, repo), "secrets")
    freq = ownership(found)
    spans = found.where((F.size("base") > 0) | (F.size("extra") > 0)).select("_doc", "_text", F.explode(F.concat("base", "extra")).alias("s"))
    spans = spans.distinct().withColumn("_hash", F.sha2("s.value", 256)).join(freq, "_hash")
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    one = F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"))
    kept = spans.groupBy(F.coalesce("_doc", F.lit(0)).alias("_id"), F.col("_doc").isNull().alias("_null"), F.col("_text").alias("_t")).agg(
        F.array_sort(F.collect_list(F.when(live | (F.col("s.kind") < 3), one))).alias("all"),
        F.count_if(live).alias("n_live"),
        F.count_if(F.col("owners") > most_owners).alias("n_example"),
    )
    ids = found.select(F.col("_doc").alias("doc_id"), F.coalesce("_doc", F.lit(0)).alias("_id"), F.col("_doc").isNull().alias("_null"), F.col("_text").alias("_t"), "base")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return ids.join(kept, ["_id", "_null", "_t"], "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"),
    )


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
p AS (SELECT * FROM (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'AKIA[A-Z0-9]{16,}', 0), (2, '[0-9a-f]{24,}', 0), (3, '[A-Za-z0-9+/_-]{20,}', 0)) v(kind, pat, least)),
hit AS (SELECT DISTINCT doc_id, owner, kind, text, pat, least FROM d, p WHERE regexp_matches(text, pat)),
part AS (SELECT doc_id, owner, kind, least, regexp_extract_all(text, pat, 0) AS m,
                CASE WHEN kind = 0 THEN regexp_extract_all(text, pat, 2) ELSE regexp_extract_all(text, pat, 0) END AS v,
                string_split_regex(text, pat) AS g FROM hit),
flat AS (SELECT doc_id, owner, kind, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g FROM part),
pos AS (SELECT *, sum(length(g)) OVER w + sum(length(m)) OVER w AS fin FROM flat
        WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
span AS (SELECT doc_id, owner, kind, (fin - length(m))::BIGINT AS s, fin::BIGINT AS e, v FROM pos WHERE length(v) >= least),
base AS (SELECT * FROM span WHERE kind < 3),
extra AS (SELECT * FROM span x WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
          AND len(list_distinct(string_split(v, ''))) >= 12
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
both_ AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
freq AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, doc_id)) AS repos FROM both_ GROUP BY v),
lab AS (SELECT b.*, owners, repos FROM both_ b JOIN freq USING (v)),
agg AS (SELECT doc_id,
  count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  count(*) FILTER (owners <= 1 AND repos <= 2) AS n_live, count(*) FILTER (owners > 1) AS n_example,
  string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, e, kind) FILTER (kind < 3) AS base,
  string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, e, kind) FILTER (kind < 3 OR (owners <= 1 AND repos <= 2)) AS spans
  FROM lab GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""
