"""Exact deduplication as a Grace hash: records are partitioned until each bucket fits a table that compares full content.

1. Collapse.  Each task of the scan puts its texts in an open-addressing table and sends on one record for each different
   text: its content, how many rows hold it, and which of them would stay.  A text that a third of all rows hold is then a
   record for each task, not for each row.  A table that has FLUSH bytes is emptied, and the task goes on with a new one.
   A member row for each document, without text, says which record it belongs to.
2. Partition.  Records are dealt to buckets by a hash of their content and written there: Spark's exchange is the spill.
3. Table.  A bucket's records stream through an open-addressing table, equal hashes being settled by comparing the
   complete content.  A bucket fits if its different texts have LIMIT bytes at most.  Once a table is full, records whose
   text isn't in it are left over (so are all their copies, which can't be in it either) and written as spill files.
4. Recursion.  What is left over is partitioned again, by the same hash with the level as its seed, until nothing is.  Each
   round settles LIMIT bytes of each bucket or one text at least, so it ends, whatever the sizes or hashes.
5. Members learn the row that stays and their group's size by a join on the record's number, of which a task's table has
   FLUSH_ROWS members at most; so no key is hot, however many copies a text has.

Scale: each different text of each task is written once and shuffled once; the rest are rows of numbers.  A task holds one
table of bounded bytes (or a single longer text) and twelve bytes for each record of its bucket.  Buckets are as many as
bytes ask for.  All steps are written to the shared folder, so a lost executor repeats tasks of one step; the last table is
the result, and the others are removed then.

Edge cases: null counts as the empty text, and empty texts are equal to each other; the row with the largest doc_id stays,
null being smaller than any, and of rows equal in text and doc_id exactly one; an empty table gives an empty one; columns of
any name pass through `keep_one`.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, written

#: Bytes of different content of a scanning task's table, and how many rows it may take in, before it is emptied.
FLUSH, FLUSH_ROWS = 16 << 20, 1 << 16
#: Bytes of content that a bucket should have, and that its table may hold.
BUCKET, LIMIT = 24 << 20, 64 << 20
#: Bytes of one Arrow batch that a task sends on.
OUT = 8 << 20


class ContentTable:
    """Open addressing with linear probing: the entry number of a content, which is compared in full."""

    def __init__(self, slots: int = 1024):
        self.slots = array("i", [-1]) * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _slot(self, hashed: int, content: bytes | None) -> int:
        """The slot that holds the content, or the free one where it would go (content None: just a free one)."""
        mask = len(self.slots) - 1
        at = (hashed ^ hashed >> 29) & mask
        while (entry := self.slots[at]) >= 0:
            if content is not None and self.hashes[entry] == hashed and self.contents[entry] == content:
                return at
            at = (at + 1) & mask
        return at

    def find(self, hashed: int, content: bytes) -> int:
        """Entry number, or -1."""
        return self.slots[self._slot(hashed, content)]

    def add(self, hashed: int, content: bytes) -> int:
        """Entry number of a content that isn't there yet."""
        if 2 * len(self.contents) >= len(self.slots):
            self.slots = array("i", [-1]) * (2 * len(self.slots))
            for entry, h in enumerate(self.hashes):
                self.slots[self._slot(h, None)] = entry
        entry = len(self.contents)
        self.slots[self._slot(hashed, content)] = entry
        self.hashes.append(hashed)
        self.contents.append(content)
        self.bytes += len(content)
        return entry


def _rank(doc_id: int | None, row: int) -> tuple:
    """Of equal texts the greatest rank stays."""
    return doc_id is not None, doc_id or 0, -row


class _Groups:
    """A table with, for each entry, its best row and its number of rows."""

    def __init__(self):
        self.table, self.best, self.count = ContentTable(), [], []

    def put(self, hashed: int, content: bytes, doc_id: int | None, row: int, n: int, full: Callable[[], bool] = bool) -> int:
        """The entry that took the rows in, or -1 if the content is new and the table full."""
        entry = self.table.find(hashed, content)
        if entry >= 0:
            self.count[entry] += n
            if _rank(doc_id, row) > _rank(*self.best[entry]):
                self.best[entry] = doc_id, row
        elif not full():
            entry = self.table.add(hashed, content)
            self.best.append((doc_id, row))
            self.count.append(n)
        return entry


def _runs(sizes: list[int], most: int):
    """Ranges of neighbours of about `most` bytes, one at least."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


RECORD = [("record", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("content", pa.binary())]


def _records(rows: list[tuple], more: list[pa.Field], out: int = OUT):
    """Arrow batches of record rows (record, doc_id, row, n, content); the columns of `more` are null."""
    for a, b in _runs([len(r[4]) for r in rows], out):
        record, doc_id, row, n, content = zip(*rows[a:b], strict=True)
        values = [record, doc_id, row, n, [len(c) for c in content], content]
        columns = [pa.array(v, t) for v, (_, t) in zip(values, RECORD, strict=True)] + [pa.nulls(b - a, f.type) for f in more]
        yield pa.RecordBatch.from_arrays(columns, names=[*(k for k, _ in RECORD), *(f.name for f in more)])


def collapsed(docs: DataFrame, flush: int | None = None, flush_rows: int | None = None) -> DataFrame:
    """Records (content not null) and members (own not null: the columns of docs but text; row, record)."""
    flush, flush_rows = flush or FLUSH, flush_rows or FLUSH_ROWS
    content = F.coalesce("text", F.lit("")).cast("binary")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("_null_text"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), content.alias("content"))
    rows = rows.withColumn("hashed", F.xxhash64("content"))

    def run(batches):
        groups, first, taken = _Groups(), [], 0  # first: of each entry its first row, which names the record

        def emptied():
            yield from _records([(r, *best, n, c) for r, best, n, c in zip(first, groups.best, groups.count, groups.table.contents, strict=True)], [owned])

        owned = None
        for batch in batches:
            owned = batch.schema.field("own")
            records = []
            for row, doc_id, hashed, content in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "hashed", "content")), strict=True):
                if taken >= flush_rows or (groups.table.bytes >= flush and groups.table.find(hashed, content) < 0):
                    yield from emptied()
                    groups, first, taken = _Groups(), [], 0
                entry = groups.put(hashed, content, doc_id, row, 1)
                if entry == len(first):
                    first.append(row)
                records.append(first[entry])
                taken += 1
            none = [pa.nulls(batch.num_rows, t) for _, t in RECORD[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.int64()), batch.column("doc_id"), batch.column("row"), *none, batch.column("own")], names=[*(k for k, _ in RECORD), "own"])
        if first:
            yield from emptied()

    return map_arrow(rows, run, f"record long, doc_id long, row long, n long, size long, content binary, own {rows.schema['own'].dataType.simpleString()}")


def settled(records: DataFrame, level: int, buckets: int, limit: int | None = None) -> DataFrame:
    """One round: of each record the row that stays, its group's size and digest; what no table took has content instead."""
    limit = limit or LIMIT
    dealt = records.select("record", "doc_id", "row", "n", "content", F.xxhash64("content", F.lit(level)).alias("hashed")).repartition(buckets, "hashed")
    more = [pa.field("keep_id", pa.int64()), pa.field("keep_row", pa.int64()), pa.field("group_size", pa.int64()), pa.field("text_sha256", pa.string())]

    def run(batches):
        groups, records, entries = _Groups(), array("q"), array("i")
        full = lambda: groups.table.bytes >= limit
        for batch in batches:
            left = []
            for record, doc_id, row, n, content, hashed in zip(*(batch.column(c).to_pylist() for c in ("record", "doc_id", "row", "n", "content", "hashed")), strict=True):
                entry = groups.put(hashed, content, doc_id, row, n, full)
                if entry < 0:
                    left.append((record, doc_id, row, n, content))
                else:
                    records.append(record)
                    entries.append(entry)
            yield from _records(left, more)
        if not records:
            return
        entry = np.frombuffer(entries, np.int32)
        digest = pa.array([hashlib.sha256(c).hexdigest() for c in groups.table.contents], pa.string())
        values = [pa.array([b[0] for b in groups.best], pa.int64()), pa.array([b[1] for b in groups.best], pa.int64()), pa.array(groups.count, pa.int64()), digest]
        for a in range(0, len(entry), FLUSH_ROWS):
            at = pa.array(entry[a : a + FLUSH_ROWS])
            columns = [pa.array(np.frombuffer(records, np.int64)[a : a + FLUSH_ROWS]), *(pa.nulls(len(at), t) for _, t in RECORD[1:]), *(v.take(at) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(k for k, _ in RECORD), *(f.name for f in more)])

    return map_arrow(dealt, run, "record long, doc_id long, row long, n long, size long, content binary, keep_id long, keep_row long, group_size long, text_sha256 string")


def _grace(docs: DataFrame, sizes: dict) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Collapsed rows, the settled records of all rounds, and the tables that they lie in."""
    rows = written(collapsed(docs, sizes.get("flush"), sizes.get("flush_rows")), "exact-collapsed")
    tables, records, level, found = [rows], rows.where("content IS NOT NULL"), 0, None
    while True:
        left, size = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if level and not left:
            return rows, found, tables
        buckets = max(1, -(-size // sizes.get("bucket", BUCKET)))
        table = written(settled(records, level, buckets, sizes.get("limit")), f"exact-level-{level}")
        tables.append(table)
        done = table.where("content IS NULL").select("record", "keep_id", "keep_row", "group_size", "text_sha256")
        found = done if found is None else found.unionByName(done)
        records, level = table.where("content IS NOT NULL"), level + 1


def exact_groups(docs: DataFrame, **sizes: int) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    sizes: bytes and rows at which tables are emptied or full (flush, flush_rows, bucket, limit), by default as above.
    """
    rows, found, tables = _grace(docs.select("doc_id", "text"), sizes)
    members = rows.where("own IS NOT NULL").select("record", "row", F.col("own.doc_id").alias("doc_id"))
    out = members.join(found, "record").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    out = written(out, "exact-groups")
    for table in tables:
        forget(table)
    return out


def keep_one(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows, found, tables = _grace(docs, sizes)
    stay = found.select(F.col("keep_row").alias("row")).distinct()
    content = rows.where("content IS NOT NULL").select("row", F.col("content").cast("string").alias("_text")).join(stay, "row", "left_semi")
    members = rows.where("own IS NOT NULL").select("row", "own").join(content, "row")
    text = F.when(~F.col("own._null_text"), F.col("_text"))
    out = members.select(*[text.alias(c) if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns])
    out = written(out, "exact-kept")
    for table in tables:
        forget(table)
    return out


def op11_exact(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS n FROM documents)
"""
