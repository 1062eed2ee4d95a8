import random

import pytest

from lakeloom.llm import substrings


def brute(rows):
    seen, out = {}, []
    split = [(d if d is not None else substrings.LAST, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            seen[key] = min(seen.get(key, (d, i)), (d, i))
    for (d, w), (real, _) in zip(split, rows, strict=True):
        gone = set()
        for i in range(len(w) - 19):
            if seen[tuple(w[i : i + 20])] < (d, i):
                gone.update(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((real, len(w), len(gone), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(15, 60))) for _ in range(8)]
    rows = []
    for d in range(120):
        pieces = [rng.choice(passages) if rng.random() < 0.4 else " ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        rows.append((d * 3 % 120, "  \n".join(pieces)))
    rows += [(500, "x " * 200), (501, "x y " * 50), (502, None), (503, ""), (None, passages[0]), (504, "é" + passages[1]), (505, passages[2] * 2)]
    return rows + rows[:5] + [(7, passages[3] + " other text")]


@pytest.mark.parametrize(("hot", "common"), [(2000, 4096), (1, 4096), (2000, 3), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, hot, common):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "COMMON", common)
    monkeypatch.setattr(substrings, "SHARD", 20)
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, start int, content string").repartition(5)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(docs).collect()], key=str)
    assert got == brute(rows)
    assert sum(g[2] for g in got) > 500


def test_one_passage_in_many_documents(spark, monkeypatch):
    """A passage of 30 words in 10,000 documents, each with words of its own around it."""
    monkeypatch.setattr(substrings, "COMMON", 500)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(d, " ".join([*(f"a{d}x{k}" for k in range(d % 25)), passage, *(f"b{d}x{k}" for k in range(d % 9))])) for d in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    common = substrings.common_anchors(docs)
    assert len(common) and substrings._anchor_rows(docs.withColumn("_doc", docs.doc_id), common).where("NOT again").groupBy("anchor").count().agg({"count": "max"}).first()[0] < 500
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert got[0] == (30, 0) and all(got[d] == (30 + d % 25 + d % 9, 30) for d in range(1, 10_000))


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton():
    rng = random.Random(5)
    for _ in range(200):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 15))] for _ in range(4)]
        got = substrings.repeated_in_shard(texts, [(k, 0) for k in range(4)], 4)
        seen = set()
        for t, starts in zip(texts, got, strict=True):
            want = []
            for i in range(len(t) - 3):
                if tuple(t[i : i + 4]) in seen:
                    want.append(i)
                seen.add(tuple(t[i : i + 4]))
            assert starts == want
