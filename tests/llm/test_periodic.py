"""Periodic runs against a direct search for each period."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lakeloom.llm import periodic
from lakeloom.llm.periodic import op13_periodic, planted, runs_of_texts, with_runs


def brute(words, least_words=6, least_exponent=4):
    """Runs by trying every period, smallest first."""
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words])
    found = []
    for p in range(1, len(w) // least_exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(np.int8), [0]])))
        for a, b in edges.reshape(-1, 2).tolist():
            length = b - a + p
            if length >= max(least_words, least_exponent * p) and not any(s <= a and a + length <= s + n for s, n, _ in found):
                found.append((a, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    words = rewritten(doc_id, words)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def of_words(lists, **how):
    texts = [" ".join(w).encode() for w in lists]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return runs_of_texts(np.frombuffer(b"".join(texts), np.uint8), off, **how)


@pytest.mark.parametrize("seed", range(6))
def test_equals_direct_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        lists = []
        for _ in range(rng.randint(1, 8)):
            alphabet = "abcd"[: rng.choice([1, 2, 2, 3, 4])]
            w = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5:
                unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 7))]
                w = w[: rng.randint(0, 10)] + unit * rng.randint(1, 8) + unit[: rng.randint(0, len(unit))] + w[: rng.randint(0, 20)]
            lists.append(w)
        how = {"least_words": rng.choice([2, 6]), "least_exponent": rng.choice([2, 3, 4])}
        assert of_words(lists, **how) == [brute(w, **how) for w in lists]


def test_texts_that_are_hard_for_periods():
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    lists = [list(fib[-1]), list(thue), ["a"] * 5000, [f"w{i % 333}" for i in range(4000)], list("ab" * 300 + "a" * 300 + "ba" * 300), list("abaab" * 90 + "abaababa" * 90)]
    for how in ({}, {"least_exponent": 2, "least_words": 2}):
        assert of_words(lists, **how) == [brute(w, **how) for w in lists]


def test_vocabulary_has_every_square():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randint(0, 1) for _ in range(rng.randint(1, 40))] + [9]
        tree, names = periodic.SuffixTree(s), periodic.Names(np.array(s), len(s))
        node, period = periodic.vocabulary(tree, *periodic.covering(tree, names))
        got = {tuple(s[tree.first[v] : tree.first[v] + 2 * p]) for v, p in zip(node.tolist(), period.tolist(), strict=True)}
        want = {tuple(s[i : i + 2 * p]) for i in range(len(s)) for p in range(1, len(s)) if i + 2 * p <= len(s) and s[i : i + p] == s[i + p : i + 2 * p]}
        assert got == want and len(node) == len(want)


TEXTS = [None, "", "  \n", "one", "x " * 5, "x " * 6, "x " * 7, "a b " * 4, "a b " * 4 + "a", "b a b a b a b", "go  go\tgo\ngo\x0bgo\x0cgo\rgo", "é é é é é é", "a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a", "lead " + "one two three " * 5 + "tail", "x x x x x x y " * 5, "the end"]


def test_edges_and_columns(spark):
    rows = [(i if i else None, t, "kept", 1.5) for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, length double")
    got = with_runs(docs).collect()
    assert len(got) == len(rows)
    of = {i: t for i, t, *_ in rows}
    for r in got:
        words = [w.decode() for w in (of[r.doc_id] or "").encode().split()]
        assert [tuple(x) for x in r.runs] == brute(words) and (r.start, r.length) == ("kept", 1.5)
        gone = {i for s, n, q in brute(words) for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert with_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        with_runs(docs.withColumnRenamed("start", "runs"))


def test_long_text(spark):
    words = [f"w{i}" for i in range(50_000)] + ["again", "and"] * 40_000 + [f"w{i % 7000}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (r,) = with_runs(docs).collect()
    assert [tuple(x) for x in r.runs] == [(50_000, 80_000, 2), (130_000, 50_000, 7000)]


def test_planted(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(400)] + [(None, "a b"), (30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, (r.text or "").split()) for r in planted(docs).collect()), key=str)
    assert got == sorted(((i, rewritten(i, (t or "").split())) for i, t in rows), key=str)


def test_query_on_folders(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(200)] + [(None, "x " * 9), (3, TEXTS[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op13_periodic(spark, str(tmp_path)).collect()), key=str) == sorted((expected(i, t) for i, t in rows), key=str)


def test_query_on_test_tables(spark):
    folder = "/root/testdata/sf0.01"
    try:
        rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    except duckdb.IOException:
        pytest.skip("no test tables")
    got = sorted(map(tuple, op13_periodic(spark, folder).collect()))
    assert got == sorted(expected(i, t) for i, t in rows) and sum(r[1] for r in got) > 30
