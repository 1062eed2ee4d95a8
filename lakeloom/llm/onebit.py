"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: vectors are centred, scaled to length 1 and rotated by one random orthogonal matrix; only the signs stay, packed,
with three numbers a vector: its length after centring, how well the signs fit it (their inner product with the
rotated vector, over the square root of the dimension), and its product with the centre.  The signs give an unbiased
estimate of the inner product with a query, and the fit gives the spread of its error.  The codes are written once as a
table; they, not the vectors, meet every block of queries.

Search: a rotated query is cut to `QUERY_BITS` bits a component, so its product with the signs is a few counts of
common bits.  A first pass over the codes gives each query its bar, the `top`-th largest of all estimates less their
bounds.  A second pass gives the candidates whose estimate plus the bound reaches the bar; no list is cut to a fixed
length.  Only candidates fetch their vectors, each once for a block of queries, and are reranked by exact products.

The centre is the mean over all vectors of a length, for the `CENTRES` commonest lengths; vectors of other lengths keep
the origin as centre, which the bounds allow for.  Every row is indexed.  Pairs of blocks are searched apart, see
vectors.py; estimates are taken in tiles of `TILE` pairs.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written
from .vectors import QUERY_BLOCK, ROW_BLOCK, best_pairs, blocks_of, candidates, clean, expand, matrix, meet, merge, query_classes

TOP, EVERY, QUERY_BITS = 20, 20, 6
#: Error bounds are this many standard deviations of the estimate.
SPREAD = 1.25
SEED = 20
CENTRES = 16
#: Pairs of a query and a code that are estimated at a time, and pairs that are reranked at a time.
TILE, PAIRS = 1 << 19, 1 << 14


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed signs and correction scalars of vectors around a centre."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, shift: np.ndarray, dim: int):
        self.bits, self.length, self.fit, self.shift, self.dim = bits, length, fit, shift, dim
        self.ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray) -> Codes:
        off = x - centre
        length = np.linalg.norm(off, axis=1)
        unit = (off / np.where(length > 0, length, 1)[:, None]) @ rotation(x.shape[1]).T
        fit = np.where(length > 0, np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1]), 1.0)
        return cls(packed(unit > 0), length, fit, off @ centre, x.shape[1])

    def estimates(self, q: np.ndarray, centre: np.ndarray, bits: int = QUERY_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries and vectors, and one standard deviation of each."""
        off = q - centre
        size = np.linalg.norm(off, axis=1)
        unit = (off / np.where(size > 0, size, 1)[:, None]) @ rotation(self.dim).T
        low = unit.min(axis=1, keepdims=True)
        step = (unit.max(axis=1, keepdims=True) - low) / ((1 << bits) - 1)
        step = np.where(step > 0, step, 1.0)
        levels = np.rint((unit - low) / step).astype(np.uint8)
        common = np.zeros((len(q), len(self.ones)), np.int32)
        for b in range(bits):
            plane = packed((levels >> b) & 1)
            for w in range(plane.shape[1]):
                common += np.bitwise_count(plane[:, w, None] & self.bits[None, :, w]).astype(np.int32) << b
        # sum over components of sign * value, with value = low + step * level and sign = 2 * bit - 1
        signed = 2 * (low * self.ones + step * common) - (low * self.dim + step * levels.sum(axis=1, keepdims=True, dtype=np.int64))
        scale = size[:, None] * self.length
        error = np.sqrt(np.maximum(1 - self.fit**2, 0) / max(self.dim - 1, 1)) / self.fit + step / np.sqrt(12) / self.fit
        # <q, x> = <q - c, x - c> + <q, c> + <c, x - c>
        return signed / (np.sqrt(self.dim) * self.fit) * scale + (q @ centre)[:, None] + self.shift, error * scale


def packed(signs: np.ndarray) -> np.ndarray:
    """Rows of bits in words of 64."""
    found = np.packbits(signs, axis=1)
    return np.pad(found, ((0, 0), (0, -found.shape[1] % 8))).view(np.uint64)


def centres_of(rows: DataFrame, most: int = CENTRES) -> dict[int, np.ndarray]:
    """Means of the vectors of the commonest lengths: `most` rows of sums come to the driver."""
    common = rows.groupBy("_n").count().orderBy(F.desc("count"), "_n").limit(most).select("_n")
    means = rows.join(F.broadcast(common), "_n").select("_n", F.posexplode("v")).groupBy("_n", "pos").agg(F.avg("col").alias("m"))
    found: dict[int, list] = {}
    for r in means.orderBy("_n", "pos").collect():
        found.setdefault(r["_n"], []).append(r["m"])
    return {n: np.array(m) for n, m in found.items()}


def encode(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, _n, bits, length, fit, shift of each row."""
    names = ["vec_id", "_n", "bits", "length", "fit", "shift"]

    def run(batches):
        for batch in batches:
            for n in pc.unique(batch.column("_n")).to_pylist():
                part = batch.filter(pc.equal(batch.column("_n"), n))
                codes = Codes.of(matrix(part.column("v")), centres.get(n, np.zeros(n)))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("_n"), pa.array([x.tobytes() for x in codes.bits], pa.binary()), pa.array(codes.length), pa.array(codes.fit), pa.array(codes.shift)], names=names)

    return map_arrow(rows, run, "vec_id long, _n int, bits binary, length double, fit double, shift double")


def _sides(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, Codes]:
    bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(b.num_rows, -1)
    q = matrix(a.column("v"))
    return q, b.column("vec_id").to_numpy(), Codes(bits, *(b.column(c).to_numpy() for c in ("length", "fit", "shift")), q.shape[1])


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, spread: float = SPREAD, vec: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` its nearest by inner product.

    Rows with null ids, or vectors that are null, zero or hold null or non-finite components, take no part.  Vectors of
    different lengths never meet.  Repeated rows count once; an id with several vectors is as near as its nearest.  Ties
    go to the smaller vec_id.  An empty table gives an empty one.  Only vec_id and the vector's column are read.
    """
    rows = clean(vectors, vec).where(F.exists("v", lambda x: x != 0))
    index = written(candidates(rows, top).withColumn("_n", F.size("v")), "onebit-rows")
    classes, members = query_classes(rows, every)
    queries = classes.withColumn("_n", F.size("v"))
    nq, nc = blocks_of(queries.count(), query_block), blocks_of(index.count(), row_block)
    centres = centres_of(index)
    codes = written(encode(index, centres), "onebit-codes")
    wanted = top + 1  # a query may find itself

    def least(a: pa.Table, b: pa.Table) -> pa.Table:
        """The best lower bounds of each query in the block."""
        q, ids, block = _sides(a, b)
        found = []
        height = max(1, TILE // len(ids))
        unique = len(np.unique(ids)) == len(ids)
        for i in range(0, len(q), height):
            about, deviation = block.estimates(q[i : i + height], centres.get(q.shape[1], np.zeros(q.shape[1])))
            low = about - spread * deviation
            if unique and low.shape[1] > wanted:
                rows_, cols = np.nonzero(low >= np.partition(low, -wanted, axis=1)[:, -wanted, None])
            else:
                rows_, cols = np.nonzero(np.isfinite(low))
            score = low[rows_, cols]
            k = best_pairs(rows_, ids[cols], score, wanted)
            found.append((rows_[k] + i, ids[cols[k]], score[k]))
        at, who, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([a.column("qid").take(pa.array(at)), pa.array(who), pa.array(score)], schema=lists)

    def within(a: pa.Table, b: pa.Table) -> pa.Table:
        """The candidates of the block, each with the places of the queries that want it among the block's."""
        q, ids, block = _sides(a, b)
        bar = a.column("bar").to_numpy()
        owners, places = [], []
        height = max(1, TILE // len(ids))
        for i in range(0, len(q), height):
            about, deviation = block.estimates(q[i : i + height], centres.get(q.shape[1], np.zeros(q.shape[1])))
            cols, rows_ = np.nonzero((about + spread * deviation >= bar[i : i + height, None]).T)
            owners.append(cols.astype(np.int32))
            places.append((rows_ + i).astype(np.int32))
        owner, place = np.concatenate(owners), np.concatenate(places)
        order = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[order], np.arange(len(ids) + 1)).astype(np.int32)
        full = np.flatnonzero(np.diff(at))
        wants = pa.ListArray.from_arrays(pa.array(at), pa.array(place[order])).take(pa.array(full))
        return pa.table([pa.array(ids[full]), pa.array(np.full(len(full), b.column("_n")[0].as_py(), np.int32)), pa.array(np.full(len(full), b.column("_q")[0].as_py(), np.int32)), wants], schema=pairs)

    def rerank(a: pa.Table, b: pa.Table) -> pa.Table:
        """Exact products of the pairs; after each run of pairs only the best of each query stay."""
        q, x, ids = matrix(a.column("v")), matrix(b.column("v")), b.column("vec_id").to_numpy()
        wants = b.column("wants").combine_chunks()
        sizes = np.asarray(pc.list_value_length(wants))
        owner, place = np.repeat(np.arange(len(ids)), sizes), wants.flatten().to_numpy()
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        held = [[], [], []]
        for i in range(0, len(owner), PAIRS):
            o, p = owner[i : i + PAIRS], place[i : i + PAIRS]
            for k, v in enumerate((p.astype(np.int64), ids[o], np.einsum("ij,ij->i", q[p], x[o]))):
                held[k].append(v)
            if len(held[0]) == 64 or i + PAIRS >= len(owner):
                merged = [np.concatenate([kept[k], *held[k]]) for k in range(3)]
                best = best_pairs(*merged, wanted)
                kept, held = [m[best] for m in merged], [[], [], []]
        return pa.table([a.column("qid").take(pa.array(kept[0])), pa.array(kept[1]), pa.array(kept[2])], schema=lists)

    lists = pa.schema([("qid", pa.string()), ("vec_id", pa.int64()), ("score", pa.float64())])
    pairs = pa.schema([("vec_id", pa.int64()), ("_n", pa.int32()), ("_q", pa.int32()), ("wants", pa.list_(pa.int32()))])
    lows = merge(meet(queries, codes, nq, nc, least, lists), "qid", wanted)
    bars = lows.groupBy("qid").agg(F.when(F.count("*") == wanted, F.min("score")).otherwise(float("-inf")).alias("bar"))
    barred = queries.join(bars, "qid")
    found = meet(barred, codes, nq, nc, within, pairs).join(index.select("vec_id", "_n", "v"), ["vec_id", "_n"])
    exact = meet(queries, found, nq, nc, rerank, lists)
    return expand(exact, members, top)


def op2_onebit(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
