"""Tables that later steps read more than once: written to the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What one Arrow batch of a Python task holds at most; settings of the session.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def in_small_batches(rows: DataFrame) -> DataFrame:
    """rows, whose texts go to Python in batches of bounded bytes, so a worker's memory doesn't follow their number."""
    for name, value in BATCH.items():
        rows.sparkSession.conf.set(name, value)
    return rows


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only on one machine, where it is unset, a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that isn't there yet, in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, *sort: str) -> DataFrame:
    """df as a Parquet table, each file in the order of `sort`: what costs a pass over the texts is done once."""
    path = new_folder(df.sparkSession, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none if it isn't there."""
    files, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def written_bytes(spark: SparkSession, path: str) -> int:
    files, place = _place(spark, path)
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when a file of the paths comes, goes or is written anew."""
    seen = hashlib.sha256()
    for path in paths:
        files, place = _place(spark, path)
        each = files.listFiles(place, True)
        found = []
        while each.hasNext():
            s = each.next()
            found.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
        seen.update("\n".join(sorted(found)).encode())
    return seen.hexdigest()
