"""What both searches share: clean vectors, blocks of queries and candidates, and the merge of partial lists.

Queries grow with the table, so neither side is broadcast.  Both are dealt to blocks by hash; each pair of blocks
meets in one task, which finds the best of its candidates for each of its queries; a second grouping by query merges
a few rows a block.  Sizes of blocks are bounded, so a task's memory is, at every size of the table.

Repeats are met once.  A candidate can be among the `top` of a query only if it is among the top + 1 smallest ids of its
vector, so each distinct vector keeps that many ids; queries of equal vectors are searched as one class, for one place
more, from which each drops itself.  So a vector that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import written

QUERY_BLOCK, ROW_BLOCK = 2048, 32768
#: Small tables are dealt to this many blocks of LEAST rows or more, so that several tasks have work.
SPREAD_OUT, LEAST = 16, 2048


def clean(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of rows that take part: no null id, vector or component, all components finite."""
    v = F.col(vec).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def candidates(rows: DataFrame, top: int) -> DataFrame:
    """Distinct (vec_id, v) that can be among the top of a query: the top + 1 smallest ids of each vector."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.distinct().withColumn("_place", place).where(F.col("_place") <= top + 1).drop("_place")


def query_classes(rows: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """(qid, v): each distinct vector of the queries, named by its least id; and (qid, query_id) of all queries."""
    asked = rows.where(F.col("vec_id") % every == 0)
    classes = asked.groupBy("v").agg(F.min("vec_id").alias("least"))
    # one id may have several vectors, so classes are told apart by a digest too
    classes = written(classes.select(F.concat_ws(":", "least", F.sha2(F.array_join("v", ","), 256)).alias("qid"), "v"), "search-queries")
    return classes, asked.distinct().join(classes, "v").select("qid", F.col("vec_id").alias("query_id"))


def blocks_of(rows: int, block: int) -> int:
    return max(1, math.ceil(rows / block), min(SPREAD_OUT, rows // LEAST))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def meet(queries: DataFrame, rows: DataFrame, nq: int, nc: int, find: Callable[[pa.Table, pa.Table], pa.Table], schema: pa.Schema) -> DataFrame:
    """find(queries, rows) on each pair of blocks and each length of vector.

    queries have qid, _n and more, rows have vec_id, _n and more; rows that have _q meet that block of queries only.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("_c", every(nc))
    right = rows.withColumn("_c", F.pmod(F.xxhash64("vec_id"), F.lit(nc)).cast("int"))
    if "_q" not in rows.columns:
        right = right.withColumn("_q", every(nq))
    keys = ("_q", "_c", "_n")

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return find(a.sort_by("qid"), b.sort_by("vec_id"))
        return schema.empty_table()

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, from_arrow_schema(schema))


def best_pairs(q: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Indices of the `top` best of each query, by query, score and smaller id; an id counts once, with its best score."""
    order = np.lexsort((ids, -score, q))
    again = np.lexsort((np.arange(len(order)), ids[order], q[order]))
    sq, si = q[order][again], ids[order][again]
    first = np.ones(len(order), bool)
    first[1:] = (sq[1:] != sq[:-1]) | (si[1:] != si[:-1])
    order = order[np.sort(again[first])]
    sq = q[order]
    return order[np.arange(len(order)) - np.searchsorted(sq, sq) < top]


def merge(found: DataFrame, key: str, top: int) -> DataFrame:
    """(key, rank, vec_id, score): the top of all blocks' lists."""
    one = found.groupBy(key, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select(key, "rank", "vec_id", "score")


def expand(found: DataFrame, members: DataFrame, top: int) -> DataFrame:
    """Lists of top + 1 of each class become lists of top of each of its queries, without the query itself."""
    own = members.join(merge(found, "qid", top + 1), "qid").where("query_id <> vec_id")
    return merge(own.select("query_id", "vec_id", "score"), "query_id", top)
