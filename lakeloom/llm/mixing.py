"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a target number of words.  Every document of a source expects the same number of copies,
e = target / words of the source.  Lay the documents of a source end to end, each e long: a document is taken
once for each whole number that its stretch crosses, after one shift in [0, 1) that is drawn for the source.
So a document is taken floor(e) or ceil(e) times, and the copies of any run of neighbours are right to within one.

The order is by size first, so the words taken come near the target as well as the copies do: runs of like-sized
documents each get their share.

Scale: the running sum is e times a document's rank in its source.  Ranks come in two levels, for a source may hold
a third of all rows: rows are dealt to cells (source, class of size, parts by hash of doc_id), only counts of cells are
summed along a source, and ranks are taken inside a cell.  The number of parts follows the number of rows, so a cell
doesn't grow with the table.  Cells are counted with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the contract: weights by order of the sources, share of all words, and the most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: A run of characters that are neither blank nor one of the control characters that count as white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of each class of size, and more of them where parts of a table would pass ROWS rows; a part is sorted by one task.
CELLS, ROWS = 64, 1 << 20


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets rise together in proportion to the weights until they meet `most` times the source's words; what a full
    source leaves goes to the others by weight.  Sorted by the level at which a source is full, the common level is
    that of the first source at which what is left over the remaining weights doesn't exceed its own.  These levels
    rise up to that source and fall after it, so it has the greatest level of those that fit.
    One row a source: this is the only step that sees all of them at once.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % n + 1).cast("int"))
    s = sizes.withColumn("ordinal", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    s = s.withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    by_level = Window.orderBy("full_at", "ordinal")
    past = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.lit(share) * F.col("total") - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(past), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(past), F.lit(0.0)))
        .withColumn("level", F.greatest(F.col("left"), F.lit(0.0)) / F.col("open"))
        .withColumn("common", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
    )
    cap = F.lit(most) * F.col("source_size")
    # No level fits only if the share is above `most`: then every source is full.
    return s.select("source", "source_size", F.least(cap, F.coalesce(F.col("weight") * F.col("common"), cap)).alias("target"))


def sample_copies(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = "mix") -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken added.

    docs needs doc_id, text and source; other columns stay as they are.  Null or empty text has size 0 and takes
    part with it; null source is a source of its own, the last.  Null doc_ids rank last in their cell.  Repeated rows
    are rows of their own, told apart by size and text only.  An empty table gives an empty one.  Columns of docs that
    bear one of the added names are replaced.
    """
    mine = ("size", "source_size", "target", "copies", "taken")
    rows = docs.drop(*mine).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    has = F.col("source").isNotNull()
    key = F.coalesce(F.col("source"), F.lit(""))
    bits = F.length(F.bin("size"))  # class: number of bits, then the first three bits
    klass = (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).cast("int")
    parts = max(CELLS, docs.count() // ROWS)
    digest = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8)
    part = F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(parts)).cast("int")
    cell = ["_has", "_source", "_class", "_part"]
    rows = rows.withColumns({"_has": has, "_source": key, "_class": klass, "_part": part})
    counts = written(rows.groupBy(cell).agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "mix-cells")
    sizes = counts.groupBy("_has", "_source").agg(F.sum("_words").alias("source_size"))
    sizes = sizes.select(F.when(F.col("_has"), F.col("_source")).alias("source"), "source_size")
    targets = source_targets(sizes, share, weights, most).select(F.col("source").isNotNull().alias("_has"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    along = Window.partitionBy("_has", "_source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.when(F.col("_has"), F.lit("s")).otherwise(F.lit("n")), "_source")), 1, 8)
    shift = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
    starts = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
        .join(targets, ["_has", "_source"])
        .select(*cell, "_before", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_each"), shift.alias("_shift"))
    )
    inside = Window.partitionBy(cell).orderBy(F.col("doc_id").asc_nulls_last(), "size", F.xxhash64("text"))
    ranked = rows.withColumn("_rank", F.row_number().over(inside)).join(starts, cell)
    crossed = lambda rank: F.floor(F.col("_each") * rank + F.col("_shift"))
    rank = (F.col("_before") + F.col("_rank")).cast("double")
    copies = (crossed(rank) - crossed(rank - 1)).cast("long")
    return ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*[F.col(f"`{c}`") for c in docs.columns if c not in mine], *mine)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs.

    Null, empty and repeated rows are treated as by sample_copies; an empty table gives an empty one.  Columns of docs
    that bear a name that sample_copies adds keep their own values.
    """
    own = {"size", "source_size", "target", "copies", "taken"} & set(docs.columns)
    hidden = docs.withColumnsRenamed({c: f"_own_{c}" for c in own})
    taken = sample_copies(hidden, **how).where("copies > 0")
    names = [F.col(f"`_own_{c}`").alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns]
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return sample_copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Targets by rounds: all open sources share what the full ones leave; sources that this would fill are full in the next.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NOT NULL AS has,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
c AS (SELECT *, (length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)::BIGINT))::INT AS class,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(64, (SELECT count(*) FROM documents) // 1048576))::INT AS part FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY has, s ORDER BY class, part, doc_id NULLS LAST, size) AS rank FROM c),
z AS (SELECT has, s, sum(size)::BIGINT AS source_size FROM d GROUP BY has, s),
w AS (SELECT has, s, source_size, 2.0::DOUBLE * source_size AS cap,
             CASE (row_number() OVER (ORDER BY has DESC, s)) % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0 ELSE 2.0 END AS weight FROM z),
rounds AS (
  SELECT 0 AS round, has, s, false AS full_ FROM w
  UNION ALL
  SELECT round + 1, has, s, full_ OR share >= cap FROM (
    SELECT q.round, q.has, q.s, q.full_, w.cap,
           w.weight * (1.5::DOUBLE * sum(w.source_size) OVER () - coalesce(sum(w.cap) FILTER (q.full_) OVER (), 0))
             / (sum(w.weight) FILTER (NOT q.full_) OVER ()) AS share
    FROM rounds q JOIN w USING (has, s))
  WHERE round < (SELECT count(*) FROM w)),
f AS (SELECT has, s, bool_or(full_) AS full_ FROM rounds GROUP BY has, s),
t AS (SELECT has, s, source_size,
             CASE WHEN full_ THEN cap ELSE weight * ((1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) FILTER (full_) OVER (), 0))
               / (sum(weight) FILTER (NOT full_) OVER ())) END AS target,
             ('0x' || substr(md5('mix:' || CASE WHEN has THEN 's' ELSE 'n' END || ':' || s), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
      FROM w JOIN f USING (has, s)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each FROM t),
x AS (SELECT r.doc_id, r.size, e.source_size, e.target,
             (floor(each * rank::DOUBLE + shift) - floor(each * (rank - 1)::DOUBLE + shift))::BIGINT AS copies FROM r JOIN e USING (has, s))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM x
"""
