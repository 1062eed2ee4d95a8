"""Exact top-k inner products of integer vectors by dual-tree search over cover trees.

Each pair of blocks (see vectors.py) builds a cover tree of its queries and one of its candidates: the points of a
node lie within its radius of a member of it, and the radii shrink by a fixed factor from level to level.  Search
walks pairs of nodes.  For centres p, r and radii a, b no product of a pair of points exceeds
<p, r> + a|r| + b|p| + ab, so a pair of nodes is dropped if that is below the worst of the k-th scores that the
queries of the group have so far.  Each leaf of queries first meets the leaves of candidates of the largest products of
centres; the worst k-th scores that come of it are carried up the tree of queries, so pairs of nodes meet finite bars
from the first.  Candidate nodes are taken with the largest bound first, so scores rise early.

All products are taken in float64 where it is exact for integers of the block's size, else in int64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import QUERY_BLOCK, ROW_BLOCK, blocks_of, candidates, clean, expand, matrix, meet, query_classes

TOP, EVERY, SCALE = 20, 20, 64
LEAF, SHRINK = 64, 0.6
#: Candidates of several leaves that one product takes.
CHUNK = 1024


class Node:
    """A centre, the radius that covers the node's points, their rows (of a leaf), children, and for queries the worst k-th score."""

    __slots__ = ("bar", "centre", "children", "radius", "rows")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.radius, self.rows, self.children, self.bar = centre, radius, rows, children, -np.inf


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A node's children are covers of its points by balls of SHRINK times its radius around points of it."""

    def build(rows: np.ndarray, centre: int, radius: float) -> Node:
        if len(rows) <= leaf or radius == 0:
            return Node(x[centre], radius, rows, [])
        aim = radius * SHRINK
        # farthest-point cover: each new centre is at least `aim` from all before, and takes the points it is nearest to
        near = np.linalg.norm(x[rows] - x[centre], axis=1)
        owner, centres = np.zeros(len(rows), np.int64), [centre]
        while near.max() > aim and len(centres) < 64:
            far = int(near.argmax())
            d = np.linalg.norm(x[rows] - x[rows[far]], axis=1)
            closer = d < near
            owner[closer], near[closer] = len(centres), d[closer]
            centres.append(rows[far])
        if len(centres) == 1:
            return Node(x[centre], radius, rows, [])
        parts = [np.flatnonzero(owner == k) for k in range(len(centres))]
        return Node(x[centre], radius, rows, [build(rows[p], c, float(near[p].max())) for p, c in zip(parts, centres, strict=True) if len(p)])

    root = int(np.linalg.norm(x - x.mean(axis=0), axis=1).argmin())
    return build(np.arange(len(x)), root, float(np.linalg.norm(x - x[root], axis=1).max()))


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


class DualTree:
    """Top-k state of a block of queries (rows of q) against one block of candidates."""

    def __init__(self, q, c_ids, c, top):
        self.q, self.c_ids, self.c, self.top = q, c_ids, c, top
        self.exact_float = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53
        self.fq, self.fc = q.astype(np.float64), c.astype(np.float64)
        none = np.zeros(0, np.int64)
        self.lists = [(none, none) for _ in range(len(q))]  # scores and ids, best first
        self.bars = np.full(len(q), -np.inf)
        self.products = self.pruned = 0

    def alive(self, a: Node, nodes: list[Node]) -> tuple[list[Node], np.ndarray]:
        """The candidate nodes that can matter to the queries of a, the largest bound first, and the bounds."""
        if not nodes:
            return [], np.zeros(0)
        centres, radii = np.array([n.centre for n in nodes]), np.array([n.radius for n in nodes])
        bound = centres @ a.centre + a.radius * np.linalg.norm(centres, axis=1) + radii * np.linalg.norm(a.centre) + a.radius * radii
        bound = bound + 1e-9 * np.abs(bound) + 1e-6  # rounding must not prune
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= a.bar]
        self.pruned += len(nodes) - len(order)
        return [nodes[k] for k in order], bound[order]

    def seed(self, tree: Node, candidates: Node) -> None:
        """Gives each leaf of queries its first bar, from the leaves of candidates around the nearest centres."""
        ends = leaves(candidates)
        centres, sizes = np.array([n.centre for n in ends]), np.array([len(n.rows) for n in ends])
        for a in leaves(tree):
            order = np.argsort(-(centres @ a.centre), kind="stable")
            enough = int(np.searchsorted(np.cumsum(sizes[order]), self.top)) + 1
            self.base(a, np.concatenate([ends[k].rows for k in order[:enough]]))
        self.raise_bars(tree)

    def raise_bars(self, a: Node) -> float:
        if a.children:
            a.bar = min(self.raise_bars(c) for c in a.children)
        return a.bar

    def walk(self, a: Node, nodes: list[Node]) -> None:
        """Both trees level by level; at a leaf of queries the candidates go down to their leaves."""
        nodes, bound = self.alive(a, nodes)
        if a.children:
            nodes = [c for n in nodes for c in (n.children or [n])]
            for child in a.children:
                self.walk(child, nodes)
            a.bar = min(c.bar for c in a.children)
            return
        ready, ready_bound = [], []
        while nodes:
            ready += [n for n in nodes if not n.children]
            ready_bound += [x for n, x in zip(nodes, bound, strict=True) if not n.children]
            nodes, bound = self.alive(a, [c for n in nodes for c in n.children])
        order = np.argsort(-np.array(ready_bound), kind="stable")
        at = 0
        while at < len(order) and ready_bound[order[at]] >= a.bar:
            rows, size = [], 0
            while at < len(order) and size < CHUNK and ready_bound[order[at]] >= a.bar:
                rows.append(ready[order[at]].rows)
                size += len(rows[-1])
                at += 1
            self.base(a, np.concatenate(rows))

    def base(self, a: Node, rows: np.ndarray) -> None:
        """Exact products of a leaf of queries and some candidates go into the queries' lists, ties to the smaller id."""
        s = self.fq[a.rows] @ self.fc[rows].T if self.exact_float else self.q[a.rows] @ self.c[rows].T
        ids = self.c_ids[rows]
        self.products += s.size
        at, cols = np.nonzero(s >= self.bars[a.rows][:, None])
        bounds = np.searchsorted(at, np.arange(len(a.rows) + 1))
        for k, r in enumerate(a.rows):
            c = cols[bounds[k] : bounds[k + 1]]
            if not len(c):
                continue
            scores, found = np.concatenate([self.lists[r][0], s[k, c].astype(np.int64)]), np.concatenate([self.lists[r][1], ids[c]])
            order = np.lexsort((found, -scores))
            # an id counts once, with its best: it may stand on several rows, or come again after the first bars
            order = order[np.sort(np.unique(found[order], return_index=True)[1])][: self.top]
            self.lists[r] = (scores[order], found[order])
            if len(order) == self.top:
                self.bars[r] = scores[order[-1]]
        a.bar = float(self.bars[a.rows].min())

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, vec_id and score of each entry of the lists."""
        queries, rows = cover_tree(self.fq), cover_tree(self.fc)
        self.seed(queries, rows)
        self.walk(queries, [rows])
        sizes = [len(x) for x, _ in self.lists]
        return np.repeat(np.arange(len(self.q)), sizes), np.concatenate([x for _, x in self.lists]), np.concatenate([x for x, _ in self.lists])


def top_products(vectors: DataFrame, top: int = TOP, every: int = EVERY, scale: float = SCALE, vec: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` the largest products of floor(scale * x).

    Rows with null ids, or vectors that are null or hold null or non-finite components, take no part; zero vectors do.
    Vectors of different lengths never meet.  Repeated rows count once; an id with several vectors ranks by its best.
    Ties go to the smaller vec_id.  Products beyond 64 bits aren't defined.  An empty table gives an empty one.  Only
    vec_id and the vector's column are read.
    """
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    rows = clean(vectors, vec).select("vec_id", whole.alias("v"))
    index = written(candidates(rows, top).withColumn("_n", F.size("v")), "covertree-rows")
    classes, members = query_classes(rows, every)
    queries = classes.withColumn("_n", F.size("v"))
    lists = pa.schema([("qid", pa.string()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def find(a: pa.Table, b: pa.Table) -> pa.Table:
        q, c = (matrix(x.column("v")).astype(np.int64) for x in (a, b))
        at, ids, score = DualTree(q, b.column("vec_id").to_numpy(), c, top + 1).run()  # a query may find itself
        return pa.table([a.column("qid").take(pa.array(at)), pa.array(ids), pa.array(score)], schema=lists)

    found = meet(queries, index, blocks_of(queries.count(), query_block), blocks_of(index.count(), row_block), find, lists)
    return expand(found, members, top)


def op4_covertree(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
