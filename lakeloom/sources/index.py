"""A persisted index for phrase search that follows inserts, updates and deletes of documents.

The index is a folder of immutable segments.  A segment has postings (how often each character trigram stands in title and
body), a row for each of its documents, and tombstones: the documents of older segments that it replaces or deletes.  A
change writes one small segment, so what is written follows the change.  When FAN segments are of about one size, or half of a
segment is dead, they are merged.  A manifest names the segments that count; the newest complete one holds, so a search sees
a change as a whole or not at all, and a change that is applied again after a failure is applied once.

A phrase of three characters is a trigram, so its postings are its counts; of a longer one the documents that hold all its
trigrams are candidates, which are verified on their texts.  Shorter phrases have no postings: they can only be required, and
are looked up in the texts of the candidates.  Postings are written by the tasks that read the texts, without an exchange, in
runs of GATHERED sorted by gram, so a search reads of each run the pages of its trigrams only, and a trigram that all documents
hold lies in all files.  Corpus statistics cover all versions, results are current documents.  A search is one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import occurrences, trigrams
from lakeloom.sources.store import in_small_batches, kept, listed, new_folder, remove
from lakeloom.sources.tables import excluded, versions

SHIFT = 21
#: So many segments of about one size are merged.
FAN = 4
#: Postings that a task gathers and sorts before it sends them on: a run of a file.
GATHERED = 1 << 20

POSTINGS = "gram long, doc_id long, t int, b int"
DOCUMENTS = "doc_id long, published date, current boolean, dl int, at int"
DEAD = "doc_id long, victim int, dl int"
TEXTS = "doc_id long, title string, body string, published date, current boolean, deleted boolean"
CHANGE = ("title", "body", "published", "current", "deleted")
MANIFEST = "segment int, n long, dead long, documents long, total_dl long, batch long, next int"


def code(gram: str) -> int:
    """Three characters as one number."""
    a, b, c = map(ord, gram)
    return a << 2 * SHIFT | b << SHIFT | c


def grams_of(low: str) -> np.ndarray:
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 2 * SHIFT | c[1:-1] << SHIFT | c[2:] if len(c) > 2 else np.zeros(0, np.int64)


def postings(docs: DataFrame) -> DataFrame:
    """gram, doc_id, t, b: how often each trigram stands in title and body, in sorted runs; docs has doc_id, title, body."""

    def sent(out):
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        g, d, n_t, n_b = (c[order] for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(d, pa.int64()), pa.array(n_t, pa.int32()), pa.array(n_b, pa.int32())], names=["gram", "doc_id", "t", "b"])

    def run(batches):
        out, gathered = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                i, title, body = (batch.column(c)[k].as_py() for c in range(3))
                t, b = grams_of(title or ""), grams_of(body or "")
                every, n = np.unique(np.concatenate([t, b]), return_counts=True)
                n_t = np.zeros(len(every), np.int64)
                own, of_title = np.unique(t, return_counts=True)
                n_t[np.searchsorted(every, own)] = of_title
                out.append((every, np.full(len(every), i), n_t, n - n_t))
                gathered += len(every)
                if gathered > GATHERED:
                    yield sent(out)
                    out, gathered = [], 0
        if out:
            yield sent(out)

    return in_small_batches(docs).select("doc_id", F.lower("title"), F.lower("body")).mapInArrow(run, POSTINGS)


def length() -> Column:
    """Trigrams of title and body."""
    return (F.coalesce(trigrams(F.lower("title")), F.lit(0)) + F.coalesce(trigrams(F.lower("body")), F.lit(0))).cast("int")


@dataclass(frozen=True)
class Segment:
    number: int
    n: int
    dead: int = 0


@dataclass(frozen=True)
class Index:
    """One state of the index at `root`; texts that no change brought are read from `folder`."""

    spark: SparkSession
    root: str
    folder: str
    segments: tuple[Segment, ...] = ()
    documents: int = 0
    total_dl: int = 0
    batch: int = -1
    next: int = 0
    #: Tables of this state that were opened: their files are listed once.
    seen: dict = field(default_factory=dict, compare=False, repr=False)

    def read(self, kind: str, schema: str, numbers=None) -> DataFrame:
        """A kind of table of the segments (all that count), with `segment`."""
        if numbers is None:
            key = (kind, self.segments)
            if key not in self.seen:
                self.seen[key] = self.read(kind, schema, [s.number for s in self.segments])
            return self.seen[key]
        if not numbers:
            return self.spark.createDataFrame([], schema + ", segment int")
        paths = [f"{self.root}/{kind}/segment={n}" for n in numbers]
        return self.spark.read.schema(schema + ", segment int").option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/segment={number}")

    def live(self, numbers=None) -> DataFrame:
        """The rows of documents that no tombstone names."""
        rows = self.read("documents", DOCUMENTS, numbers)
        if not any(s.dead for s in self.segments if numbers is None or s.number in numbers):
            return rows
        dead = self.read("dead", DEAD).select("doc_id", F.col("victim").alias("segment"))
        return rows.join(dead, ["doc_id", "segment"], "left_anti")

    @property
    def average(self) -> float:
        return self.total_dl / self.documents if self.documents else 1.0

    def commit(self, version: int) -> Index:
        """Writes the manifest that makes this state the one that holds."""
        rows = [(s.number, s.n, s.dead, self.documents, self.total_dl, self.batch, self.next) for s in self.segments]
        self.spark.createDataFrame(rows or [(None, 0, 0, self.documents, self.total_dl, self.batch, self.next)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version:08d}")
        return self


def versions_of(spark: SparkSession, root: str) -> list[int]:
    """Complete manifests, oldest first."""
    return [int(v) for v in listed(spark, f"{root}/manifest") if "_SUCCESS" in listed(spark, f"{root}/manifest/{v}")]


def opened(spark: SparkSession, root: str, folder: str) -> Index:
    """The newest complete state."""
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{versions_of(spark, root)[-1]:08d}").collect()
    segments = tuple(sorted((Segment(r.segment, r.n, r.dead) for r in rows if r.segment is not None), key=lambda s: s.number))
    return Index(spark, root, folder, segments, rows[0].documents, rows[0].total_dl, rows[0].batch, rows[0].next)


def build(spark: SparkSession, folder: str, root: str | None = None) -> Index:
    """The index of a folder's documents: one segment, whose texts stay where they are."""
    index = Index(spark, root or new_folder(spark, "index"), folder)
    v = versions(spark, folder).where("doc_id IS NOT NULL")
    bad = excluded(spark, folder).withColumn("excluded", F.lit(True))
    current = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False)) & F.col("excluded").isNull()
    index.write(v.join(bad, "doc_id", "left").select("doc_id", "published", current.alias("current"), length().alias("dl"), F.lit(None).cast("int").alias("at")), "documents", 0)
    index.write(postings(v), "postings", 0)
    index.write(spark.createDataFrame([], DEAD), "dead", 0)
    n, total = index.read("documents", DOCUMENTS, [0]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return replace(index, segments=(Segment(0, n),), documents=n, total_dl=total, next=1).commit(0)


def newest(changes: DataFrame) -> DataFrame:
    """Of each document the change of greatest `seq`, told by keys, so no texts are grouped but where several have it."""
    counted = changes.groupBy("doc_id", "seq").agg(F.count("*").alias("n"))
    keys = kept(counted.groupBy("doc_id").agg(F.max("seq").alias("seq"), F.max_by("n", "seq").alias("n")), "newest-changes")
    alone = changes.join(keys.where("n = 1").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi").select("doc_id", *CHANGE)
    twice = keys.where("n > 1 OR seq IS NULL").select("doc_id")
    if twice.isEmpty():
        return alone
    held = F.max_by(F.struct(*CHANGE), "seq").alias("x")
    return alone.unionByName(changes.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(held).select("doc_id", "x.*"))


def apply(index: Index, changes: DataFrame, batch: int | None = None) -> Index:
    """The index after a batch of changes: doc_id, title, body, published, current, deleted, seq.

    Of several changes of a document the one of greatest `seq` holds.  A document that isn't there yet is inserted, another
    replaced; a deleted one goes, and is no error if it isn't there.  A batch number that was applied already changes nothing.
    """
    if batch is not None and batch <= index.batch:
        return index
    number = index.next
    index.write(newest(changes.where("doc_id IS NOT NULL")), "texts", number)
    texts = index.read("texts", TEXTS, [number])
    fresh = texts.where("NOT deleted")
    index.write(fresh.select("doc_id", "published", "current", length().alias("dl"), F.lit(number).alias("at")), "documents", number)
    index.write(postings(fresh), "postings", number)
    replaced = index.live().join(texts.select("doc_id"), "doc_id", "left_semi")
    index.write(replaced.select("doc_id", F.col("segment").alias("victim"), "dl"), "dead", number)
    came = index.read("documents", DOCUMENTS, [number]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    gone = index.read("dead", DEAD, [number]).groupBy("victim").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()  # a row a segment
    marked = {r.victim: r.n for r in gone}
    segments = tuple(replace(s, dead=s.dead + marked.get(s.number, 0)) for s in index.segments) + (Segment(number, came[0]),)
    documents, total = index.documents + came[0] - sum(r.n for r in gone), index.total_dl + came[1] - sum(r.dl for r in gone)
    after = replace(index, segments=segments, documents=documents, total_dl=total, batch=index.batch if batch is None else batch, next=number + 1)
    return merged(after.commit(number))


def _to_merge(segments: tuple[Segment, ...]) -> list[Segment]:
    """FAN segments or more of one power of FAN, the smallest first; else one of which half is dead; else none."""
    tiers: dict[int, list[Segment]] = {}
    for s in segments:
        tiers.setdefault(int(np.log(max(s.n - s.dead, 1)) / np.log(FAN) + 1e-9), []).append(s)
    for tier in sorted(tiers):
        if len(tiers[tier]) >= FAN:
            return tiers[tier]
    return next(([s] for s in segments if s.dead * 2 > s.n), [])


def merged(index: Index) -> Index:
    """The same documents in fewer segments, where it is time."""
    while some := _to_merge(index.segments):
        numbers, number = [s.number for s in some], index.next
        rest = tuple(s for s in index.segments if s not in some)
        live = index.live(numbers)
        index.write(live.select("doc_id", "published", "current", "dl", "at"), "documents", number)
        held = index.read("postings", POSTINGS, numbers).join(live.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        index.write(held.select("gram", "doc_id", "t", "b").sortWithinPartitions("gram", "doc_id"), "postings", number)
        marks = index.read("dead", DEAD, numbers).where(F.col("victim").isin([s.number for s in rest]))
        index.write(marks.select("doc_id", "victim", "dl"), "dead", number)
        index = replace(index, segments=(*rest, Segment(number, sum(s.n - s.dead for s in some))), next=number + 1).commit(number)
    return index


def vacuum(index: Index) -> None:
    """Removes what this state doesn't need: segments that were merged, and older manifests."""
    counted = {f"segment={s.number}" for s in index.segments}
    for kind in ("documents", "postings", "dead"):
        for name in listed(index.spark, f"{index.root}/{kind}"):
            if name not in counted:
                remove(index.spark, f"{index.root}/{kind}/{name}")
    for version in versions_of(index.spark, index.root)[:-1]:
        remove(index.spark, f"{index.root}/manifest/{version:08d}")


def followed(root: str, folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch of changes is applied once, also when it runs again."""

    def write(changes: DataFrame, batch: int) -> None:
        apply(opened(changes.sparkSession, root, folder), changes, batch)

    return write


def texts_of(index: Index, some: DataFrame) -> DataFrame:
    """doc_id, segment, title, body of the documents in `some` (doc_id, segment, at)."""
    own = versions(index.spark, index.folder).select("doc_id", "title", "body").join(some.where("at IS NULL").select("doc_id", "segment"), "doc_id")
    brought = [int(name.partition("=")[2]) for name in listed(index.spark, f"{index.root}/texts") if name.startswith("segment=")]
    brought = [n for n in brought if n < index.next]
    if not brought:
        return own.select("doc_id", "segment", "title", "body")
    changed = index.read("texts", TEXTS, brought).select("doc_id", F.col("segment").alias("at"), "title", "body").join(some.select("doc_id", "segment", "at"), ["doc_id", "at"])
    return own.select("doc_id", "segment", "title", "body").unionByName(changed.select("doc_id", "segment", "title", "body"))


def counts(index: Index, phrases: tuple[str, ...], required: tuple[str, ...] = ()) -> DataFrame:
    """A row for each live document that holds a phrase: its columns, and t0, b0 ...: how often each stands in title and body.

    A column `held` says whether all required terms stand in its texts.
    """
    if not phrases or any(len(p) < 3 for p in phrases):
        raise ValueError("an indexed search needs phrases of three characters or more; require shorter terms of its candidates")
    live, grams = index.live(), index.read("postings", POSTINGS)
    zero = lambda but: [(F.col(f"x{c}") if k == but else F.lit(0)).cast("int").alias(f"{c}{k}") for k in range(len(phrases)) for c in "tb"]
    parts = []
    for k, p in enumerate(phrases):
        if len(p) == 3:
            found = grams.where(F.col("gram") == code(p)).select("doc_id", "segment", F.col("t").alias("xt"), F.col("b").alias("xb"))
        else:
            need = sorted(set(grams_of(p).tolist()))
            some = grams.where(F.col("gram").isin(*need)).groupBy("doc_id", "segment").agg(F.count("*").alias("all")).where(F.col("all") == len(need))
            texts = texts_of(index, some.join(live, ["doc_id", "segment"]).select("doc_id", "segment", "at"))
            found = texts.select("doc_id", "segment", *[F.coalesce(occurrences(F.lower(c), p), F.lit(0)).alias(f"x{c[0]}") for c in ("title", "body")]).where("xt + xb > 0")
        parts.append(found.select("doc_id", "segment", *zero(k)))
    names = [f"{c}{k}" for k in range(len(phrases)) for c in "tb"]
    each = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "segment").agg(*[F.sum(c).alias(c) for c in names])
    rows = each.join(live, ["doc_id", "segment"])
    if not required:
        return rows.withColumn("held", F.lit(True))
    inside = reduce(lambda x, y: x & y, [F.contains(F.lower(F.concat_ws(" ", "title", "body")), F.lit(r)) for r in required])
    return rows.join(texts_of(index, rows.select("doc_id", "segment", "at")).select("doc_id", "segment", inside.alias("held")), ["doc_id", "segment"])


def search(index: Index, phrases: tuple[str, ...], k: int = 32, k1: float = 1.2, b: float = 0.75, title: float = 5.0, required: tuple[str, ...] = ()) -> DataFrame:
    """The k best current documents that hold any phrase and all required terms: doc_id, score (lower is better)."""
    rows = counts(index, phrases, required)
    hit = [F.col(f"t{i}") + F.col(f"b{i}") > 0 for i in range(len(phrases))]
    held = rows.agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hit)])  # one row, from the same exchange
    share = []
    for i in range(len(phrases)):
        n = F.col(f"n{i}")
        idf = F.log((index.documents - n + 0.5) / (n + 0.5))
        f = (title * F.col(f"t{i}") + F.col(f"b{i}")).cast("double")
        share.append(-F.when(idf <= 0, 1e-6).otherwise(idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(index.average))))
    best = rows.where(F.col("current") & F.col("held") & reduce(or_, hit)).crossJoin(F.broadcast(held)).withColumn("score", F.round(reduce(add, share), 9))
    return best.orderBy("score", F.desc("published"), "doc_id").limit(k).select("doc_id", "score")
