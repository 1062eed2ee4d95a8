import random

import pytest

from lakeloom.llm import neardup


def brute(rows):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both * 100 >= 85 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and in to it is on er an th re".split()) + rng.choice("abcdefgh")
    boiler = " ".join(word() for _ in range(40))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 9, 30, 80, 200]))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t += boiler.split()
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n", " \t"]).join(t)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (None, "only one such text of five words"), (5003, rows[0][1].upper()), (5004, "é" * 3), (5005, "word " * 3000)]
    return rows + rows[:3]


@pytest.mark.parametrize(("seed", "block"), [(1, 1000), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, b"x", "z") for r in rows], "doc_id long, text string, sig binary, label string").repartition(3)
    found = neardup.near_duplicates(docs).collect()
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found], key=str)
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got if g[0] is not None] == [w[3] for w in want if w[0] is not None]
    assert {g[3] for g in got if g[0] == 5000} == {True}
    kept = neardup.keep_one(docs).select("doc_id", "text")
    assert kept.count() == kept.distinct().count()


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_stars_and_repeats(spark, monkeypatch):
    import random

    from lakeloom.llm import neardup

    monkeypatch.setattr(neardup, "CHUNK", 3)
    rng = random.Random(5)
    names = [f"{k:04d}".encode() for k in rng.sample(range(10_000), 400)]
    links = [(names[k], names[k + 1]) for k in range(199)] + [(names[200], names[k]) for k in range(201, 300)] + [(names[k], names[rng.randrange(300, 400)]) for k in range(300, 400)]
    links += links[:20] + [(names[0], names[0])]
    rng.shuffle(links)
    rows = neardup.components(spark.createDataFrame(links, "a binary, b binary").repartition(7)).collect()
    nodes, roots = neardup.forest(*map(list, zip(*links, strict=True)))
    least = dict(zip(nodes, roots, strict=True)) | {r: r for r in roots}
    assert {bytes(r.sig): bytes(r.label) for r in rows} == least and len(rows) == len(least)
    assert least[names[150]] == min(names[:200]) and least[names[250]] == min(names[200:300])
    assert neardup.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_lower_limit_and_very_different_sizes(spark):
    from lakeloom.llm import neardup

    names = iter(range(10**6))
    words = lambda k: [f"w{next(names)}" for _ in range(k)]
    rows, linked = [], {}
    for size in (10, 20, 40, 100, 300, 600):
        for _ in range(8):
            long = words(size + 4)  # so many shingles; the first four fifths of them are 0.8 of the whole
            rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(long[: size * 4 // 5 + 4])), (len(rows) + 2, " ".join(long[: size * 4 // 5 + 3]))]
            linked |= {len(rows) - 3 + k: len(rows) - 3 for k in range(3)}  # the third only by way of the second
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 0.8).collect()}
    assert {k: found[k] for k in linked} == linked


def test_stage_takes_similarity_of_four_fifths(spark):
    import corpus_pipeline

    text = [f"w{k}" for k in range(104)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text[:30], "x", *text[31:70], "y", *text[71:]]))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]  # 90 of 110


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_small_sets_share_a_list(percent):
    import numpy as np

    rng = np.random.default_rng(percent)
    pairs = []
    for small in range(1, 121):
        for large in range(small, small * 100 // percent + 1):
            least = -(-percent * (small + large) // (100 + percent))  # as little in common as the limit lets
            for common in {least, small}:
                pairs += [(small, large, common)] * (1000 if large <= 20 else 5)
    sizes = np.array(pairs)
    sets = []
    for small, large, common in pairs:
        values = rng.integers(-(2**63), 2**63 - 1, small + large - common)
        sets += [np.sort(values[:small]), np.sort(values[small - common :])]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    keys, begin = neardup.list_keys(np.concatenate(sets), at, percent / 100)
    assert (np.diff(at) == sizes[:, :2].ravel()).all()
    for k in range(len(pairs)):
        a, b, c = begin[2 * k : 2 * k + 3].tolist()
        assert set(keys[a:b].tolist()) & set(keys[b:c].tolist()), pairs[k]


def test_copies_are_one_row_a_task_before_lists_are_dealt(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(i, text if i % 3 else text + f" x{i} y z") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = neardup._classes(docs, 0.85)
    hot = classes.groupBy("sig").count().orderBy("count", ascending=False).first()
    assert hot["count"] == 600 and classes.where(classes.sig == hot.sig).where("size(keys) > 0").count() == 4


def test_chained_lists_are_compared_in_proportion(spark, monkeypatch):
    """Windows along one stream of words: neighbours share lists without being linked, so lists chain all of them."""
    from pyspark.sql import GroupedData

    sent, apply = [], GroupedData.applyInArrow
    monkeypatch.setattr(neardup, "BLOCK", 10)
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: (sent.append(self._df.count()), apply(self, *a))[1])
    rows = [(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 64))) for i in range(300)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert len(found) == 300 and all(r.kept for r in found)
    assert 300 < sum(sent) < 10 * 300  # rows of full sets that go to comparisons


def test_lists_of_a_large_group_are_compared_whole(spark, monkeypatch):
    """One group in many blocks: unlinked windows around pairs that only blocks of two parts find."""
    import random

    rng = random.Random(6)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(90), 4):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: least for d, _, least, _ in brute(rows)}
