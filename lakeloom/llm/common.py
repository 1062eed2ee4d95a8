"""What the corpus operators share: cutting lineage, slicing Arrow batches, hashing words.

Words are runs of bytes outside 0x20 and 0x09-0x0D.  In UTF-8 those bytes are never part of a longer
character, so words can be found in the raw buffer of an Arrow column, a whole batch at a time.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised function looks at.
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.arange(256)
_LOWER = np.where((_PLAIN >= 65) & (_PLAIN <= 90), _PLAIN + 32, _PLAIN)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


#: What one Arrow batch of a Python task holds at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of bounded bytes; a task's worker gives back at its end what it has freed.

    Workers stay for later tasks and stages, so what they keep would add up.  The bounds are settings of the session.
    """
    for name, value in BATCH.items():
        rows.sparkSession.conf.set(name, value)

    def task(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(task, schema)


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def forget(table: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more; other DataFrames are left alone."""
    path = getattr(table, "_written_path", None)
    if path:
        sc = table.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Has the shuffle files of steps that nothing refers to any more removed.

    Spark removes them when the driver's garbage is collected, which a driver with little to do hardly ever is, while the
    executors' disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(column: str, m: int):
    """crc32 of the column as text, modulo m (null: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def below(hashed, share):
    """Whether a 64-bit hash is among the least `share` of all hashes."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(2.0**53) < share


def margin(n: int) -> float:
    """How many rows to expect below a hash, so that n rows or more are there but once in a thousand million times."""
    return n + 6 * n**0.5 + 36


def least_hashed(rows: DataFrame, hashed, n: int, *ties: str) -> DataFrame:
    """The n rows of least hash.  A first count gives the hash below which they lie, so no more rows are sorted."""
    total = rows.count()
    near = rows.withColumn("_hash", hashed)
    if total > margin(n):
        near = near.where(below(F.col("_hash"), margin(n) / total))
    return near.orderBy("_hash", *ties).limit(n).drop("_hash")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `limit` bytes at most (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


#: White space and all other ASCII characters but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_bounds(data: np.ndarray, off: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and one past) its first word's index."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    white = white[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, white[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, white[1:]
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = True
    after[off[1:][full] - 1] = True
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process: a polynomial over byte codes, then mixed.

    Works on runs of words of about SLICE_BYTES, so temporaries stay small for very long texts.
    """
    table = _BYTE[_LOWER] if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        lo, hi = int(starts[at]), int(ends[end - 1])
        up, down = _powers(max(hi - lo, SLICE_BYTES))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    return out


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n neighbouring words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + words[k : k + count]
    return mix(h)
