"""MinHash near-duplicates by bottom-k sketches from one hash function.

1. A document is its set of hashed 5-word shingles.  Documents of equal sets are one class; all that follows sees each
   class once, so copies cost nothing.
2. Inverted lists.  A sketch retains the DEPTH least hashes of each residue class of the hash.  The list that two sets
   meet in is headed by all retained values of one residue class: single values would make long lists of the passages
   that many documents share.  The number of classes follows the size of the set, so that it exceeds the number of
   values in which two linked sets can differ by two.  Two classes at least are the same in both sets, then; should
   these hold nothing, both sets have two empty classes or more.  Such sets of at most SMALL values also join the lists
   of their prefix, the single least values of which linked sets share one, apart for each level of size.  So sets of
   at most SMALL values that are linked meet for certain; larger ones, whose classes hold three values or more on
   average, miss each other with less than MISS.  From most_groups(limit) classes on (sets of some 260 values) classes
   hold more than DEPTH values and sets at the limit agree in one with probability limit**DEPTH or more (0.38 at 0.85,
   0.26 at 0.8), so they miss each other in all with less than MISS, too; sets of 0.2 hardly ever meet.
3. A class is compared with one leader, the class that is least in most of its lists: an estimate from the bottom-k of
   the union of the two sketches drops pairs more than five standard deviations below the limit, the exact similarity
   of the full sets decides the others.  That is one pair a class, however large a group is.
4. Lists whose members are now all connected are done.  What the other lists that share their least class hold is a
   group: two classes that share a list meet in its group, and groups are as large as what shares lists with one class,
   whatever other lists their classes are in.  (What lists hold together over any number of steps would be a cluster whose
   size follows the corpus, as common passages chain most classes, and its pairs the square of that.)  A group of at most
   BLOCK classes and SHINGLES values meets in one task, each class once.  Larger groups are dealt to tasks of at most two
   such blocks.  Tasks compare full sets exactly and give one link for each two components that they join.  So no link is
   lost, and no task writes all pairs of a group.  Blocks hold classes of one level of size and meet those of their own
   and the neighbouring levels only.  Blocks of a large group's largest component don't meet each other, only the rest: a
   large group of near copies costs its own size for each block of others.  Each block is compared within itself first;
   with the components that come of it, lists of large groups are closed again, and pairs of blocks then have few
   components to join, so links stay in proportion to classes.
5. Components by rounds of large and small stars, whose number doesn't depend on how long chains are.

Scale: texts are never shuffled.  Lists are shuffled once as (key, class) pairs.  Full sets are built, in a second pass
over the texts, only for classes that share a list; which these are goes to the tasks as a bitmap of bounded size, so a
false hit costs time only.  Joins on hot keys are plain equi-joins, which adaptive execution splits.  All stages that
others build on are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer, forget, map_arrow, mix, release, rolling, slices, word_bounds, word_hashes, written

SHINGLE, LIMIT = 5, 0.85
DEPTH, SKETCH = 6, 128
#: Probability that two large sets at the limit share no list.
MISS = 1e-9
#: Sets of more values are found by residue classes alone (see tests for the probability of a miss).
SMALL = 64
#: Tells lists of single values from those of residue classes.
PREFIX = np.uint64(0xA0761D6478BD642F)
BITMAP_BITS = 1 << 24
#: Classes and values of a group that one side of a comparison holds.
BLOCK, SHINGLES = 1000, 1 << 19
#: Signatures that a task remembers so as to send copies once.
SEEN = 1 << 17
#: Edges that a task turns into a forest at a time.
CHUNK = 1 << 16
#: Edges for each task that writes them.
EDGES = 1 << 12


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, flat and sorted (as signed numbers), and where each text begins."""
    data, off = buffer(texts)
    starts, ends, at = word_bounds(data, off)
    h = word_hashes(data, starts, ends, lower=True)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(rolling(h[a:b], min(n, b - a)).view(np.int64)) if b > a else np.zeros(0, np.int64))
    return np.concatenate([np.zeros(0, np.int64), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def signatures(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits that tell sets apart."""
    u = sets.view(np.uint64)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(u ^ np.uint64(salt)))]) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    n = np.diff(at).astype(np.uint64)
    both = np.stack([mix(s[at[1:]] - s[at[:-1]] + n) for s in sums], axis=1)
    return [x.tobytes() for x in both]


def most_groups(limit: float) -> int:
    """Number of residue classes of large sets: 44 at 0.85, 69 at 0.8."""
    return int(np.ceil(np.log(MISS) / np.log(1 - limit**DEPTH)))


def _groups(level: np.ndarray, limit: float) -> np.ndarray:
    """Number of residue classes at a level of size: two more than the values that can differ, most_groups at most.

    Sets of similarity limit or more in a level or the next have a union of at most limit**-(level + 2) values, of which
    a share of 1 - limit at most is not common; so two classes are untouched, unless most_groups is the smaller number.
    """
    return np.minimum(most_groups(limit), np.floor((1 - limit) * limit ** -(level + 2.0)) + 2).astype(np.int64)


def levels(n: np.ndarray, limit: float) -> np.ndarray:
    """Level of size: floor(log n to base 1 / limit).  Sets that can be linked are at one level or at neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / -np.log(limit) + 1e-9)


def list_keys(sets: np.ndarray, at: np.ndarray, limit: float = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the inverted lists of all sets, flat, and where each set's begin.

    Each set joins the lists of its level and of the next, where these have other numbers of classes.  Small sets with
    two empty classes join the lists of their n - ceil(limit n) + 1 least values too, of their level and the next: as
    linked sets have limit n values or more of each in common, one of these is among the least of both.
    """
    limit = min(round(100 * limit) / 100, 0.95)  # lists for a limit serve all higher ones
    most = most_groups(limit)
    n = np.diff(at)
    level = levels(n, limit)
    low, high = _groups(level, limit), _groups(level + 1, limit)
    keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sparse = np.zeros(len(n), bool)
    for groups, used in ((low, n > 0), (high, (n > 0) & (high != low))):
        owner = np.repeat(np.arange(len(n)), n)
        mine = used[owner]
        owner, value = owner[mine], sets[mine]
        if not len(owner):
            continue
        cell = owner * most + (value.view(np.uint64) % groups[owner].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((value, cell))
        cell, value = cell[order], value[order].view(np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        place = np.arange(len(cell)) - np.repeat(begin, np.diff(np.append(begin, len(cell))))
        held = place < DEPTH
        cell, value, place = cell[held], value[held], place[held]
        begin = np.flatnonzero(place == 0)
        own = cell[begin] // most
        keys.append(mix(np.add.reduceat(mix(value + place.astype(np.uint64)), begin) + (cell[begin] % most + most * groups[own]).astype(np.uint64)).view(np.int64))
        owners.append(own)
        sparse |= used & (groups - np.bincount(own, minlength=len(n)) >= 2)
    least = np.where(sparse & (n <= SMALL), n + (-n * round(100 * limit)) // 100 + 1, 0)
    owner = np.repeat(np.arange(len(n)), least)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(least) - least, least)
    values = mix(sets[at[owner] + place].view(np.uint64) ^ PREFIX)
    for above in (0, 1):
        keys.append(mix(values + (level[owner] + above).astype(np.uint64)).view(np.int64))
        owners.append(owner)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.searchsorted(owners[order], np.arange(len(at)))


def _classes(docs: DataFrame, limit: float) -> DataFrame:
    """doc_id, n, sig, keys of each row; of the copies that a task sees the first alone has keys, so that a class is a few rows
    for each task before its lists are dealt, however many copies it has."""

    def run(batches):
        seen: set[bytes] = set()  # emptied before it grows large
        for batch in batches:
            for part in slices(batch, "text"):
                sets, at = shingle_sets(part.column("text"))
                keys, begin = list_keys(sets, at, limit)
                sigs = signatures(sets, at)
                first = np.array([not (x in seen or seen.add(x)) for x in sigs], bool)
                if len(seen) > SEEN:
                    seen.clear()
                size = np.diff(begin)
                keys, begin = keys[np.repeat(first, size)], np.concatenate([[0], np.cumsum(size * first)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(keys))],
                    names=["doc_id", "n", "sig", "keys"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, sig binary, keys array<long>")


def bit_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little") % BITMAP_BITS


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """Of the signatures' first bytes: BITMAP_BITS bits, 2 MB, at every size of the input."""

    def run(batches):
        bits = np.zeros(BITMAP_BITS // 8, np.uint8)
        for batch in batches:
            place = np.array([bit_of(x) for x in batch.column("sig").to_pylist()], np.int64)
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        words = bits.view(np.int64)
        found = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(words[found])], names=["word", "bits"])

    words = map_arrow(wanted.select("sig"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS >> 6, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bitmap.view(np.uint8)


def _wanted_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sig, leader, n, shingles of the wanted classes, each once, from a second pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches):
        seen: set[bytes] = set()  # copies in one task are sent once; emptied before it grows large
        for batch in batches:
            for part in slices(batch, "text"):
                sets, at = shingle_sets(part.column("text"))
                sigs, out = signatures(sets, at), []
                for k, sig in enumerate(sigs):
                    place = bit_of(sig)
                    if shared.value[place >> 3] >> (place & 7) & 1 and sig not in seen:
                        seen.add(sig)
                        out.append(k)
                if len(seen) > 200_000:
                    seen.clear()
                kept = [sets[at[k] : at[k + 1]] for k in out]
                yield pa.RecordBatch.from_arrays([pa.array([sigs[k] for k in out], pa.binary()), pa.array([len(x) for x in kept], pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["sig", "n", "shingles"])

    full = map_arrow(docs.select("text"), run, "sig binary, n long, shingles array<long>")
    return full.join(wanted, "sig").dropDuplicates(["sig"])


def _leader_links(sets: DataFrame, limit: float) -> DataFrame:
    """(a, b) of classes and their leaders that are as similar as the limit."""
    first = sets.where("sig <> leader").select(F.col("sig").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    second = sets.join(sets.select(F.col("leader").alias("sig")).distinct(), "sig", "left_semi").select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = first.join(second, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(100 * limit))
    ka, kb = F.slice("sa", 1, SKETCH), F.slice("sb", 1, SKETCH)
    union = F.slice(F.array_sort(F.array_union(ka, kb)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(union, ka), kb))
    exact = F.size(F.array_intersect("sa", "sb"))
    slack = 5 * (limit * (1 - limit) / SKETCH) ** 0.5  # five standard deviations of the estimate at the limit
    near = shared >= (limit - slack) * F.size(union)
    return both.where(F.when(near, exact * 100 >= (F.col("na") + F.col("nb") - exact) * round(100 * limit)).otherwise(False)).select("a", "b")


def joining_links(sets: list[np.ndarray], labels: list, limit: float) -> list[tuple[int, int]]:
    """Index pairs of similar sets of different labels, one for each two components that are joined."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[word] > 1
    owner, word = owner[shared], np.unique(word[shared], return_inverse=True)[1]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for lo in range(0, int(word[-1]) + 1 if len(word) else 0, width):
        a, b = np.searchsorted(word, [lo, lo + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], word[a:b] - lo] = 1
        both += x @ x.T
    percent = round(100 * limit)
    names = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    root = list(range(len(names)))
    mine = [names[x] for x in labels]

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(sets) - 1):
        common = both[i, i + 1 :]
        for j in (np.flatnonzero(common * 100 >= (sizes[i] + sizes[i + 1 :] - common) * percent) + i + 1).tolist():
            x, y = find(mine[i]), find(mine[j])
            if x != y:
                root[x] = y
                out.append((i, j))
    return out


def _open_lists(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, n, low, label) of the members of lists that hold several components."""
    labelled = members.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    still = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    return written(labelled.join(still, "key").select("sig", "n", "low", "label").distinct(), "neardup-open")


def _large_groups(rest: DataFrame) -> DataFrame:
    """low of the groups that are more than one block."""
    sized = rest.groupBy("low").agg(F.count("*").alias("classes"), F.sum("n").alias("values"))
    return written(sized.where((F.col("classes") > BLOCK) | (F.col("values") > SHINGLES)).select("low"), "neardup-large")


def _blocks(rest: DataFrame, limit: float, within: bool) -> DataFrame:
    """(sig, low, label, x, y): the pairs of blocks of large groups that a class takes part in; `within`: each block with itself only."""
    level = F.floor(F.log("n") / -float(np.log(limit)) + 1e-9).cast("int")
    sized = rest.withColumn("level", level)
    by_label = sized.groupBy("low", "label").agg(F.count("*").alias("classes"))
    largest = by_label.groupBy("low").agg(F.max_by("label", F.struct("classes", "label")).alias("largest"))
    sided = sized.join(largest, "low").withColumn("side", (F.col("label") == F.col("largest")).cast("int"))
    parts = sided.groupBy("low", "level", "side").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    number = lambda part: F.col("level").cast("long") * (1 << 32) + F.col("side") * (1 << 31) + part
    own = sided.join(parts, ["low", "level", "side"]).select("sig", "low", "label", "level", "side", number(F.pmod(F.xxhash64("sig"), F.col("parts"))).alias("own"))
    others = parts.select("low", "level", F.col("side").alias("other_side"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), number)).alias("other"))
    if within:
        met = own.where("side = 0").withColumn("other", F.col("own"))
    else:
        met = own.withColumn("level", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))).join(others, ["low", "level"]).where("side + other_side < 2")
    return met.select("sig", "low", "label", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def _group_links(sets: DataFrame, met: DataFrame, limit: float) -> DataFrame:
    """(a, b) that join components among the classes that meet: met has sig, label and the key low, x, y."""
    rows = sets.select("sig", "shingles").join(met, "sig")

    def compare(group: pa.Table) -> pa.Table:
        sigs, values = group.column("sig"), group.column("shingles").combine_chunks()
        at, flat = np.append(0, np.cumsum(pa.compute.list_value_length(values))), values.flatten().to_numpy()
        held = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        pairs = np.array(joining_links(held, group.column("label").to_pylist(), limit), np.int64).reshape(-1, 2)
        return pa.table([sigs.take(pa.array(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return rows.groupBy("low", "x", "y").applyInArrow(compare, "a binary, b binary")


def forest(a: list, b: list) -> tuple[list, list]:
    """The links as (node, least node of its component), each node that isn't the least one once."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    return nodes, [find(x) for x in nodes]


def _forests(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b: each run of CHUNK edges in a task becomes a forest of depth one that connects the same nodes."""

    def run(batches):
        a, b = [], []
        for batch in batches:
            a += batch.column("a").to_pylist()
            b += batch.column("b").to_pylist()
            if len(a) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in forest(a, b)], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in forest(a, b)], names=["a", "b"])

    return map_arrow(edges.select("a", "b"), run, "a binary, b binary")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    # written, so that both sides of the join are plain exchanges and adaptive execution can split a star's centre
    low = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "neardup-least")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(low.select("a", "m"))


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes with two parents, or with a parent and a child."""
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("up"), F.lit(0).alias("child")).union(edges.select("b", F.lit(None).cast("binary"), F.lit(1)))
    seen = ends.groupBy("u").agg(F.min("up").alias("x"), F.max("up").alias("y"), F.max("child").alias("child"))
    return seen.where("x <> y OR (x IS NOT NULL AND child = 1)")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(sig, label) of each class with a link: the least class that is reachable.

    Rounds of large and small stars: edges never outnumber the links, and the number of rounds grows with the logarithm
    of the number of classes, not with the length of chains.  Before each table is written, tasks turn what edges they
    hold into forests; there are as many tasks as the edges need, so small partitions share one.
    """
    edges = written(_forests(links.where("a <> b").coalesce(links.count() // CHUNK + 1)), name)
    while not _unfinished(edges).isEmpty():
        stars = _small_star(_large_star(edges))
        before, edges = edges, written(_forests(stars.coalesce(edges.count() // EDGES + 1)), name)
        forget(before)
    labels = edges.groupBy(F.col("a").alias("sig")).agg(F.min("b").alias("label"))
    return labels.union(edges.select("b", F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    component_id is the least doc_id reachable over links.  Null and empty texts have no shingles, no links, and are
    their own component.  Copies and repeated rows share a component; kept is true for each row whose doc_id is the
    component's.  Null doc_ids are never a component's id unless all of it are null; then kept is true.  An empty table
    gives an empty one.  Only doc_id and text are read.
    """
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    classes = written(_classes(docs, limit), "neardup-classes")
    lists = classes.where("n > 0").select("sig", "n", F.explode("keys").alias("key")).repartition(F.col("key"))
    ends = lists.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low < high").select("key", "low")
    members = written(lists.join(ends, "key").distinct(), "neardup-lists")
    del lists, ends
    release(spark)
    votes = members.groupBy("sig", "low").agg(F.count("*").alias("votes"))
    leaders = votes.groupBy("sig").agg(F.max_by("low", F.struct("votes", "low")).alias("leader"))
    wanted = written(leaders, "neardup-wanted")
    sets = written(_wanted_sets(docs, wanted), "neardup-sets")
    release(spark)
    first = written(_leader_links(sets, limit), "neardup-links")
    release(spark)
    rest = _open_lists(members, components(first))
    large = _large_groups(rest)
    whole = rest.join(large, "low", "left_anti").select("sig", "low", "label", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    blocks = _blocks(rest.join(large, "low", "left_semi"), limit, within=True)
    inside = written(_group_links(sets, whole.unionByName(blocks), limit), "neardup-inside")
    forget(rest)
    del rest, whole, blocks
    release(spark)
    links = first.unionByName(inside)
    rest = _open_lists(members.join(large, "low", "left_semi"), components(links))
    across = written(_group_links(sets, _blocks(rest, limit, within=False), limit), "neardup-across")
    for done in (rest, large):
        forget(done)
    forget(members)
    forget(sets)
    release(spark)
    labels = components(links.unionByName(across), "neardup-components")
    for done in (wanted, first, inside, across):
        forget(done)
    rows = classes.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = rows.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "label", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """docs without the near-duplicates: of each component the rows of its least doc_id, exact repeats of these once.

    Rows of null and empty texts stay, once for each doc_id and text.  Columns of any other name pass through; of rows
    that agree in doc_id and text one is kept.  An empty table gives an empty one.
    """
    found = near_duplicates(docs, limit).where("kept").select(*_id_key()).distinct()
    rows = docs.select(*_id_key(), F.struct("*").alias("row")).join(found, ["absent", "key"], "left_semi")
    # rows that agree in doc_id lie in one task after the join, so texts are dealt once
    return rows.groupBy("absent", "key", F.col("row.text").alias("text")).agg(F.first("row").alias("row")).select("row.*")


def _id_key() -> tuple[Column, Column]:
    """doc_id as two columns without nulls."""
    return F.col("doc_id").isNull().alias("absent"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")


def op10_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
