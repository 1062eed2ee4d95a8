r"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye on each document.

A run is a stretch of words with smallest period q that no neighbouring word extends.  A text's words
`[^\x20\x09-\x0D]+` are numbered from 0; of its runs those of `least_words` words and `least_exponent` periods at least count.

1. Cut.  Every word of such a run stands in it `least_exponent` times.  So a word that is rarer in its document can't be in
   one and cuts the text; rarer words of the pieces cut these, until nothing changes.  Of prose little is left.  This leaves
   out only what can't hold a run.
2. Tree.  The pieces of one Arrow slice, ended by symbols of their own, are one sequence of exact word numbers, with its
   suffix tree (Ukkonen) and its Lempel-Ziv blocks, both linear.
3. Blocks.  The leftmost occurrence of a square crosses the start of the block in which it ends, and its right half touches
   two blocks at most.  Extending to both sides of each block's start, for each period that the blocks admit, gives squares
   that cover all leftmost ones by rotation.
4. Vocabulary.  These squares are located in the tree; from each, suffix links and one step down lead to its rotations, until
   one isn't there or is marked.  Then each different square is marked once, at most two for each word.
5. Runs.  The leaves below a marked place are all occurrences of that square.  Those of primitive roots with neighbouring
   starts and one period merge into runs.

Scale: one map over the scan; no shuffle, nothing broadcast, no task holds more than a slice of about SLICE_BYTES or one
longer text.  Work grows as n log n with what is left after the cut (names of runs of 2^k words serve the extensions).

Edge cases: null counts as the empty text, which has no words and no runs; repeated rows give equal rows; an empty table
gives an empty one; columns of docs other than text pass through, and a clash with a new column is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, buffer, map_arrow, mix, slices, word_bounds, word_hashes

LEAST_WORDS, LEAST_EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"


def pieces(hashes: np.ndarray, row: np.ndarray, least_words: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words, within rows, that runs can lie in."""
    at, group = np.arange(len(hashes)), row
    while len(at):
        _, back, count = np.unique(mix(hashes[at] + mix(group.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        alive = count[back] >= times
        kept, old = at[alive], group[alive]
        if not len(kept):
            break
        fresh = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(old) > 0)])
        group = np.cumsum(fresh) - 1
        long = (np.bincount(group) >= least_words)[group]
        if alive.all() and long.all() and group[-1] == len(np.unique(old)) - 1:
            first = np.flatnonzero(fresh)
            return kept[first], kept[np.append(first[1:], len(kept)) - 1] + 1
        at, group = kept[long], group[long]
    none = np.zeros(0, np.int64)
    return none, none


class Names:
    """Names of all runs of 2^k symbols: equal names, equal runs.  They give common extensions of two places."""

    def __init__(self, s: np.ndarray, longest: int):
        self.n, self.levels = len(s), [s.astype(np.int32)]
        span = 1
        while span * 2 <= longest:
            x = self.levels[-1].astype(np.int64)
            pair = x[:-span] * (int(x.max()) + 1) + x[span:]
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
            span *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names, span = self.levels[k], 1 << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                inside = np.flatnonzero((i < len(names)) & (j < len(names)))
                same = inside[names[i[inside]] == names[j[inside]]]
                i[same] += span
                j[same] += span
        return i - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j are equal."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names, span = self.levels[k], 1 << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                inside = np.flatnonzero((i >= span - 1) & (j >= span - 1))
                same = inside[names[i[inside] - span + 1] == names[j[inside] - span + 1]]
                i[same] -= span
                j[same] -= span
        return begin - i


class SuffixTree:
    """Of a sequence whose last symbol stands nowhere else.  Node 0 is the root; `first` is a node's leftmost suffix."""

    def __init__(self, s: list[int]):
        self.s = s
        self._build()
        self._measure()

    def _build(self) -> None:
        s, n = self.s, len(self.s)
        start, end, link, child = [0], [0], [0], [{}]
        node = edge = length = remain = 0
        for i, c in enumerate(s):
            remain += 1
            waits = 0
            while remain:
                if not length:
                    edge = i
                kids, a = child[node], s[edge]
                v = kids.get(a)
                if v is None:
                    kids[a] = len(start)
                    start.append(i), end.append(n), link.append(0), child.append(None)
                    if waits:
                        link[waits] = node
                    waits = node
                else:
                    size = (end[v] if child[v] is not None else i + 1) - start[v]
                    if length >= size:
                        edge += size
                        length -= size
                        node = v
                        continue
                    if s[start[v] + length] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    mid = len(start)
                    kids[a] = mid
                    start.append(start[v]), end.append(start[v] + length), link.append(0)
                    start[v] += length
                    child.append({c: mid + 1, s[start[v]]: v})
                    start.append(i), end.append(n), link.append(0), child.append(None)
                    if waits:
                        link[waits] = mid
                    waits = mid
                remain -= 1
                if not node and length:
                    length -= 1
                    edge = i - remain + 1
                else:
                    node = link[node]
        self.link, self.child, self._size = link, child, [e - b for b, e in zip(start, end, strict=True)]

    def _measure(self) -> None:
        child, size, n = self.child, self._size, len(self.s)
        nodes = len(child)
        parent, depth, first, order, stack = [0] * nodes, [0] * nodes, [n] * nodes, [], [0]
        while stack:
            v = stack.pop()
            order.append(v)
            kids = child[v]
            if kids is None:
                first[v] = n - depth[v]
            else:
                d = depth[v]
                for w in kids.values():
                    parent[w] = v
                    depth[w] = d + size[w]
                    stack.append(w)
        for v in reversed(order):
            if first[v] < first[parent[v]]:
                first[parent[v]] = first[v]
        self.parent, self.depth, self.first = parent, depth, first
        self.depths, self.firsts = np.array(depth), np.array(first)
        order = np.array(order)
        leaf = np.array([k is None for k in child])
        self.leaves = self.firsts[order[leaf[order]]]  # suffixes in the order of the walk
        self.leaf_of = np.empty(n, np.int64)
        self.leaf_of[self.firsts[leaf]] = np.flatnonzero(leaf)
        before = np.concatenate([[0], np.cumsum(leaf[order])])
        place = np.empty(nodes, np.int64)
        place[order] = np.arange(nodes)
        under = leaf.astype(np.int64).tolist()
        for v in order[:0:-1].tolist():
            under[parent[v]] += under[v]
        self.low = before[place]
        self.high = self.low + np.array(under)
        self.jumps = [np.array(parent)]
        while self.jumps[-1].any():
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def climb(self, v: np.ndarray, holds) -> np.ndarray:
        """The highest node at or above each v for which holds(nodes) is still true; it is false from there on up."""
        for up in reversed(self.jumps):
            over = up[v]
            v = np.where(holds(over), over, v)
        return v

    def locus(self, i: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The node on whose edge the `length` symbols from i end."""
        return self.climb(self.leaf_of[i], lambda v: self.depths[v] >= length)

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is as long as what starts at an earlier place too, one symbol at least."""
        places = np.arange(len(self.s))
        top = self.climb(self.leaf_of, lambda v: self.firsts[v] == places)  # the root, whose first is 0, may be the top of place 0
        longest = self.depths[self.jumps[0][top]].tolist()
        starts, i = [], 0
        while i < len(longest):
            starts.append(i)
            i += max(1, longest[i])
        return np.array(starts)

    def rotation(self, v: int, length: int) -> int:
        """The node where the place's string lies with its first symbol moved to its end; -1 if the text hasn't it."""
        s, i, p = self.s, self.first[v], self.parent[v]
        c, end = s[i], length - 1
        node, d = (self.link[p], self.depth[p] - 1) if p else (0, 0)
        while d < end:
            node = self.child[node][s[i + 1 + d]]
            d = self.depth[node]
        if d > end:
            return node if s[self.first[node] + end] == c else -1
        kids = self.child[node]
        return kids.get(c, -1) if kids else -1


def covering(tree: SuffixTree, names: Names) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares from which rotations to the right lead to the leftmost occurrence of every square."""
    s, starts = np.array(tree.s), tree.blocks()
    u, before, after = starts[1:], starts[:-1], np.append(starts[2:], len(tree.s))

    def periods(most):
        most = np.maximum(most, 0)
        return np.repeat(u, most), np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1

    # the block's start lies in the right half, whose first word comes after the start of the block before
    b, k = periods(np.minimum(after - before - 1, u))
    near = s[b] == s[b - k]
    b, k = b[near], k[near]
    back = np.where(b - k > 0, names.behind(np.maximum(b - 1, 0), np.maximum(b - k - 1, 0)), 0)
    low, high = np.maximum(b - 2 * k + 1, b - k - back), np.minimum(b - k, b - 2 * k + names.ahead(b, b - k))
    right = low <= high
    # the block's start lies in the left half; the right half is within the block
    c, m = periods(after - u - 1)
    near = s[c - 1] == s[c + m - 1]
    c, m = c[near], m[near]
    low2, high2 = np.maximum(c - m + 1, c - names.behind(c - 1, c + m - 1)), np.minimum(c - 1, c - m + names.ahead(c, c + m))
    left = low2 <= high2
    found = np.unique(np.stack([np.concatenate([low[right], low2[left]]), np.concatenate([k[right], m[left]])]), axis=1)
    return found[0], found[1]


def vocabulary(tree: SuffixTree, i: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and period of every different square, from a covering set: suffix-link walks over its places in the tree."""
    begin = list(zip(tree.locus(i, 2 * period).tolist(), (2 * period).tolist(), strict=True))
    marked = set(begin)
    for v, length in begin:
        while (v := tree.rotation(v, length)) >= 0 and (v, length) not in marked:
            marked.add((v, length))
    places = np.array(sorted(marked), np.int64).reshape(-1, 2)
    return places[:, 0], places[:, 1] // 2


def primitive(i: np.ndarray, period: np.ndarray, names: Names) -> np.ndarray:
    """Whether the roots of the squares at i are no powers: none has a period that is its length by a prime."""
    most = int(period.max()) if len(period) else 1
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    fine, rest = np.ones(len(i), bool), period.copy()
    while (open_ := np.flatnonzero(rest > 1)).size:
        p = factor[rest[open_]]
        shift = period[open_] // p
        fine[open_] &= names.ahead(i[open_], i[open_] + shift) < 2 * period[open_] - shift
        rest[open_] //= p
    return fine


def runs_of(s: list[int], longest: int) -> np.ndarray:
    """Start, length and period of all runs of two periods at least, by start and period; `longest` bounds repeats.

    The last symbol must stand nowhere else.
    """
    tree, names = SuffixTree(s), Names(np.array(s), longest)
    i, period = covering(tree, names)
    node, period = vocabulary(tree, i, period)
    fine = primitive(tree.firsts[node], period, names)
    node, period = node[fine], period[fine]
    count = tree.high[node] - tree.low[node]
    each = np.repeat(np.arange(len(node)), count)
    start = tree.leaves[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + tree.low[node][each]]
    p = period[each]
    order = np.lexsort((start, p))
    start, p = start[order], p[order]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(p) != 0)]))
    last = np.append(first[1:], len(start)) - 1
    found = np.stack([start[first], start[last] - start[first] + 2 * p[first], p[first]], axis=1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of_texts(data: np.ndarray, off: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each text (row offsets in a buffer) its runs (start, length, period), by start and period."""
    starts, ends, begin = word_bounds(data, off)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    if not len(starts):
        return out
    row = np.repeat(np.arange(len(off) - 1), np.diff(begin))
    first, last = pieces(word_hashes(data, starts, ends), row, least_words, least_exponent)
    if not len(first):
        return out
    number: dict[bytes, int] = {}
    s, place = [], []
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        place.append(len(s))
        s += [number.setdefault(data[x:y].tobytes(), len(number)) for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        s.append(-1 - k)  # ends of their own; made unique numbers below
    s = [x if x >= 0 else len(number) - 1 - x for x in s]
    found = runs_of(s, int((last - first).max()))
    found = found[found[:, 1] >= np.maximum(least_words, least_exponent * found[:, 2])]
    piece = np.searchsorted(place, found[:, 0], "right") - 1
    word = found[:, 0] - np.array(place)[piece] + first[piece]
    for r, w, (_, length, period) in zip(row[word].tolist(), word.tolist(), found.tolist(), strict=True):
        out[r].append((w - int(begin[r]), length, period))
    return out


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    words = text.split()  # bytes split at exactly the white space of WORD
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = [words[k] for k in np.flatnonzero(~gone).tolist()]
    return b" ".join(words)


def with_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """docs without text, with `runs` (array of start, length, period, by start and period) and `collapsed`, the text whose
    runs keep their first period only."""
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    own = [c for c in docs.columns if c != "text"]
    if {"runs", "collapsed"} & set(own):
        raise ValueError("docs already has runs or collapsed")
    rows = docs.select(F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                data, off = buffer(part.column("_text"))
                found = runs_of_texts(data, off, least_words, least_exponent)
                kept = [collapsed(data[a:b].tobytes(), r) for a, b, r in zip(off[:-1].tolist(), off[1:].tolist(), found, strict=True)]
                listed = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for r in found], kind)
                yield pa.RecordBatch.from_arrays([part.column("_own"), listed, pa.array(kept, pa.binary()).cast(pa.string())], names=["_own", "runs", "collapsed"])

    schema = f"_own {rows.schema['_own'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_arrow(rows, run, schema).select("_own.*", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """docs in which every tenth text, by crc32 of doc_id, repeats a stretch of its words to its end, as the contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size("_words")
    a = F.pmod("_g", F.col("_n")).cast("int")
    p = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.pmod("_g", F.lit(8))))).cast("int")
    rest = F.col("_n") - F.col("_a")
    unit = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    rewritten = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), " ")
    chosen = (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(WORD)
    steps = docs.withColumn("_g", g).withColumn("_words", F.when(chosen, words)).withColumn("_n", n).withColumn("_a", a).withColumn("_p", p)
    return steps.withColumn("text", F.when(F.col("_words").isNotNull(), rewritten).otherwise(F.col("text"))).select(*docs.columns)


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_runs(planted(docs))
    # greatest exact length / period, then smallest start, then period
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda acc, x: F.when(acc.isNull() | better(x, acc), x).otherwise(acc))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("_best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.*",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
