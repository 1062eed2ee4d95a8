"""Substring deduplication of runs of words by suffix automata of reference shards.

A window is `WINDOW` words in a row.  A window whose words also start earlier (smaller doc_id, or the same document and
an earlier start) is repeated, and every word that a repeated window covers is removed.

1. Anchors.  Of a window's runs of `GRAM` words the one of least hash (the leftmost on ties) is its anchor, so equal
   windows have equal anchors.  Neighbouring windows share anchors; those of one anchor make a region.  Only a row of
   four numbers for each region is shuffled, by anchor.
2. Common anchors.  A count of anchors, of those that a task sees twice, gives the anchors of more than `COMMON` regions,
   which come of passages that very many documents share.  Their windows are regions of their own, dealt by their own
   hash, and of equal ones each task sends on the first only: the others are repeated for certain.  Which anchors are
   taken for common decides the way, not the result.
3. Regions that are equal as a whole to an earlier one are repeated.  Where an anchor has several different regions,
   the first of each goes on as reference text.
4. Reference shards.  A shard holds all reference regions of some anchors, in order of their place; its suffix
   automaton keeps for each state where it first ended.  The regions stream through it for matching statistics: a
   match of WINDOW words that first ended earlier marks a repeated window.

The named method broadcasts the automata of all shards to all documents.  The reference text grows with the corpus, so
there is no bound for that (figures in the README); here text meets the one shard that can hold its matches.  An anchor
with more than `HOT` different regions is split: its windows go one by one to shards by their own hash, where equal
ones still meet.

Scale: shards have about `SHARD` regions, so an automaton's memory is bounded.  Sorting by anchor spills; no group is
held in memory.  The texts are shuffled by doc_id once (one exchange serves both uses).
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffer, map_arrow, mix, rolling, slices, word_bounds, word_hashes, written

WINDOW, GRAM = 20, 8
SHARD, HOT = 2000, 2000
#: Regions from which an anchor is common, and how many of the commonest anchors are told to all tasks.
COMMON, MOST_COMMON = 4096, 1 << 16
#: Null doc_ids come after all others.
LAST = (1 << 63) - 1


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    span, m = 1, x
    while span * 2 <= n:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - span : n - span + len(x) - n + 1])


def regions(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor's hash, first window, number of windows, content hash and anchor's distance of each region of one text."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none, none
    grams = rolling(words, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    keyed = (grams & ~np.uint64((1 << 32) - 1)) | place  # the upper half decides, then the place
    least = (_sliding_min(keyed, window - gram + 1) & np.uint64((1 << 32) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(first, len(least)))
    return grams[least[first]].view(np.int64), first, size, content(rolling(words, window), first, size), least[first] - first


def content(windows: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the words of runs of windows that overlap: its first and last window and their number."""
    return mix(windows[first] * np.uint64(0x9E3779B97F4A7C15) + windows[first + size - 1] + size.astype(np.uint64)).view(np.int64)


class SuffixAutomaton:
    """Of one sequence of words; each state knows the first end of its words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last, self.size = 0, 0

    def add(self, word: int) -> None:
        nexts, link, length, first = self.next, self.link, self.length, self.first
        cur, p = len(nexts), self.last
        nexts.append({})
        link.append(0)
        length.append(length[p] + 1)
        first.append(self.size)
        self.size += 1
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        self.last = cur

    def matches(self, words: list[int], most: int):
        """Matching statistics up to `most`: for each word the length of the match that ends there, and its first end."""
        v = size = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if word in self.next[v]:
                v, size = self.next[v][word], size + 1
            if size >= most:
                size = most
                while self.length[self.link[v]] >= most:
                    v = self.link[v]
            yield size, self.first[v]


def repeated_in_shard(texts: list[list[int]], places: list[tuple[int, int]], window: int = WINDOW) -> list[list[int]]:
    """For each text the starts of its windows that stand at an earlier place too.

    places: document and first word of each text.  Equal windows must come in the order of their places; those at equal
    places (of rows with one doc_id) aren't earlier than each other.
    """
    automaton, at = SuffixAutomaton(), []
    for k, t in enumerate(texts):
        at.append(automaton.size)
        for word in t:
            automaton.add(word)
        automaton.add(("end", k))  # matches don't reach across
    out = []
    for base, t, (doc, start) in zip(at, texts, places, strict=True):
        again = []
        for i, (size, first) in enumerate(automaton.matches(t, window)):
            if size == window and first < base + i:
                k = bisect_right(at, first) - 1
                if (places[k][0], places[k][1] + first - at[k]) < (doc, start + i):
                    again.append(i - window + 1)
        out.append(again)
    return out


def _texts_of(batch: pa.RecordBatch):
    """Of each document of WINDOW words or more in a batch: its row and the hashes of its words."""
    data, off = buffer(batch.column("text"))
    starts, ends, at = word_bounds(data, off)
    h = word_hashes(data, starts, ends)
    for d in np.flatnonzero(np.diff(at) >= WINDOW):
        yield d, h[at[d] : at[d + 1]]


def common_anchors(docs: DataFrame) -> np.ndarray:
    """The anchors of most regions, sorted: at most MOST_COMMON, each of more than COMMON regions."""

    def run(batches):
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told():
            several = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(known[several]), pa.array(counts[several])], names=["anchor", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                new = np.concatenate([known, *[regions(words)[0] for _, words in _texts_of(part)]])
                weights = np.concatenate([counts, np.ones(len(new) - len(known), np.int64)])
                known, at = np.unique(new, return_inverse=True)
                counts = np.bincount(at, weights=weights, minlength=len(known)).astype(np.int64)
                if len(known) > 1 << 20:
                    yield told()
                    known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield told()

    counted = map_arrow(docs.select("text"), run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    return np.sort(counted.orderBy(F.desc("n"), "anchor").limit(MOST_COMMON).select("anchor").toArrow().column(0).to_numpy())


class Firsts:
    """The least place of each window that a task has met."""

    def __init__(self, most: int = 200_000):
        self.held: dict[int, tuple[int, int]] = {}
        self.most = most

    def later(self, windows: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which windows have been met at an earlier place, among these or before."""
        again = np.zeros(len(windows), bool)
        order = np.lexsort((start, doc, windows))
        w, d, s = windows[order], doc[order], start[order]
        begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(w))
        for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
            place = (int(d[a]), int(s[a]))
            least = min(self.held.get(int(w[a]), place), place)
            self.held[int(w[a])] = least
            again[order[a:b]] = (d[a:b] > least[0]) | ((d[a:b] == least[0]) & (s[a:b] > least[1]))
        if len(self.held) > self.most:
            self.held.clear()
        return again


def _anchor_rows(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """part, anchor, content, doc, place, again: the regions; windows of common anchors are regions of their own.

    part deals the rows: by anchor, but by document those that are known to be repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    names = ["part", "anchor", "content", "doc", "place", "again"]

    def run(batches):
        firsts = Firsts()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("_doc").to_numpy()
                plain, single = [], []
                for d, words in _texts_of(part):
                    anchor, first, size, same, off = regions(words)
                    usual = ~np.isin(anchor, shared.value) if len(shared.value) else np.ones(len(anchor), bool)
                    plain.append((anchor[usual], same[usual], np.full(usual.sum(), ids[d]), (first << 16 | off << 8 | size)[usual]))
                    if not usual.all():
                        windows = rolling(words, WINDOW)
                        at = np.concatenate([np.arange(a, a + n) for a, n in zip(first[~usual].tolist(), size[~usual].tolist(), strict=True)])
                        single.append((windows[at].view(np.int64), content(windows, at, np.ones(len(at), np.int64)), np.full(len(at), ids[d]), at << 16 | 1))
                for found, known in ((plain, False), (single, True)):
                    if found:
                        anchor, same, doc, place = (np.concatenate([f[k] for f in found]) for k in range(4))
                        again = firsts.later(anchor, doc, place >> 16) if known else np.zeros(len(anchor), bool)
                        yield pa.RecordBatch.from_arrays([pa.array(np.where(again, doc, anchor)), pa.array(anchor), pa.array(same), pa.array(doc), pa.array(place), pa.array(again)], names=names)

    return map_arrow(docs, run, "part long, anchor long, content long, doc long, place long, again boolean")


def repeated_windows(docs: DataFrame, shuffled: DataFrame) -> DataFrame:
    """(_doc, start, size, content): runs of repeated windows.  docs and shuffled (by _doc) have _doc and text."""
    rows = _anchor_rows(docs, common_anchors(docs)).repartition(F.col("part"))
    same = Window.partitionBy("part", "again", "anchor", "content").orderBy("doc", F.shiftright("place", 16))
    ranked = rows.withColumn("_rank", F.when(F.col("again"), 2).otherwise(F.rank().over(same)))
    ranked = ranked.withColumn("_kinds", F.sum(F.when(F.col("_rank") == 1, 1).otherwise(0)).over(Window.partitionBy("part", "again", "anchor")))
    ranked = ranked.where((F.col("_rank") > 1) | (F.col("_kinds") > 1))
    found = written(ranked.select(F.col("doc").alias("_doc"), F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(255).alias("size"), F.shiftright("place", 8).bitwiseAND(255).alias("off"), "content", "anchor", (F.col("_rank") > 1).alias("again"), (F.col("_kinds") > HOT).alias("hot")), "substring-regions")
    whole = found.where("again").select("_doc", "start", "size", "content")

    # the first of each different region becomes reference text
    firsts = found.where("NOT again")
    shards = max(1, math.ceil(firsts.count() / SHARD))
    wanted = firsts.groupBy("_doc").agg(F.collect_list(F.struct("start", "size", "content", "anchor", "hot", "off")).alias("want"))
    texts = shuffled.join(wanted, "_doc")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = buffer(part.column("text"))
                starts, ends, at = word_bounds(data, off)
                h = word_hashes(data, starts, ends)
                ids = part.column("_doc").to_numpy()
                out = []
                for d, want in enumerate(part.column("want")):
                    words = h[at[d] : at[d + 1]]
                    if len(words) < WINDOW:
                        continue
                    w = want.values
                    first, size, check, anchor, hot, dist = (w.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                    windows = rolling(words, WINDOW)
                    fits = first + size <= len(windows)  # rows of one id may have different texts
                    fits[fits] = content(windows, first[fits], size[fits]) == check[fits]
                    for a, n, key, split, far in zip(*(v[fits].tolist() for v in (first, size, anchor, hot, dist)), strict=True):
                        if split:
                            out += [(int(windows[i]) % shards, ids[d], i, words[i : i + WINDOW].view(np.int64), i) for i in range(a, a + n)]
                        else:
                            out.append((key % shards, ids[d], a, words[a : a + n + WINDOW - 1].view(np.int64), a + far))
                if out:
                    sizes = np.cumsum([0] + [len(o[3]) for o in out])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([o[3] for o in out]))), pa.array([o[4] for o in out], pa.int64())],
                        names=["shard", "_doc", "start", "words", "order"],
                    )

    reference = map_arrow(texts.select("_doc", "text", "want"), cut, "shard long, _doc long, start long, words array<long>, order long")

    def match(shard: pd.DataFrame) -> pd.DataFrame:
        # equal places are rows that were given twice: not earlier than each other; equal windows have their anchors at
        # equal distances, so the order of anchors is theirs
        shard = shard.assign(key=[w.tobytes() for w in shard["words"]]).drop_duplicates(["_doc", "start", "key"]).sort_values(["_doc", "order"], kind="stable")
        texts = list(shard["words"])
        places = list(zip(shard["_doc"].tolist(), shard["start"].tolist(), strict=True))
        out = []
        for doc, start, words, again in zip(shard["_doc"], shard["start"], texts, repeated_in_shard([t.tolist() for t in texts], places), strict=True):
            if again:
                windows = rolling(words.view(np.uint64), WINDOW)
                again = np.array(again)
                first = again[np.concatenate([[True], again[1:] != again[:-1] + 1])]
                size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], again[1:] != again[:-1] + 1])), len(again)))
                out += zip([doc] * len(first), (start + first).tolist(), size.tolist(), content(windows, first, size).tolist(), strict=True)
        return pd.DataFrame(out, columns=["_doc", "start", "size", "content"])

    matched = reference.groupBy("shard").applyInPandas(match, "_doc long, start long, size long, content long")
    return whole.unionByName(matched)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (the words that stay, joined by one blank), n_words, n_removed of each row of docs.

    Null and empty texts have no words and give an empty text.  Null doc_ids come last in order.  Rows that repeat a
    doc_id are judged by that id: none is earlier than the other at the same start.  An empty table gives an empty one.
    Only doc_id and text are read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), "text")
    shuffled = rows.repartition(F.col("_doc"))
    runs = repeated_windows(rows.select("_doc", "text"), shuffled)
    runs = runs.groupBy("_doc").agg(F.collect_list(F.struct("start", "size", "content")).alias("runs"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = buffer(part.column("text"))
                starts, ends, at = word_bounds(data, off)
                h, raw = word_hashes(data, starts, ends), data.tobytes()
                out, n, gone = [], [], []
                for d, run in enumerate(part.column("runs")):
                    lo, hi = int(at[d]), int(at[d + 1])
                    keep = np.ones(hi - lo, bool)
                    if run.is_valid and hi - lo >= WINDOW:
                        first, size, check = (run.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                        windows = rolling(h[lo:hi], WINDOW)
                        fits = first + size <= len(windows)
                        fits[fits] = content(windows, first[fits], size[fits]) == check[fits]
                        change = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(change, first[fits], 1)
                        np.add.at(change, first[fits] + size[fits] + WINDOW - 1, -1)
                        keep = np.cumsum(change)[:-1] == 0
                    stay = lo + np.flatnonzero(keep)
                    out.append(b" ".join([raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]).decode())
                    n.append(hi - lo)
                    gone.append(hi - lo - len(stay))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(shuffled.join(runs, "_doc", "left").select("doc_id", "text", "runs"), cut, f"doc_id {kind}, text string, n_words long, n_removed long")


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    left = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
