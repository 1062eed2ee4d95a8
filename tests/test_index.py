"""The index after changes against plain counting over the documents that are left."""

import math
import random

import pytest

from lakeloom.sources import index
from lakeloom.sources.store import written_bytes

CHANGE = "doc_id long, title string, body string, published date, current boolean, deleted boolean, seq int"


def words(rng, n):
    return " ".join(rng.choice(["the", "thing", "license", "a b", "zu", "Ing", "other", "é日本語"]) for _ in range(n))


def brute(docs, phrases, required=(), k=32):
    """Rows (doc_id, score) by counting in the texts of docs: {doc_id: (title, body, current)}."""
    low = {i: (t.lower(), b.lower(), c) for i, (t, b, c) in docs.items()}
    count = lambda text, p: sum(text.startswith(p, i) for i in range(len(text)))
    found = {i: [(count(t, p), count(b, p)) for p in phrases] for i, (t, b, _) in low.items()}
    size = {i: max(len(t) - 2, 0) + max(len(b) - 2, 0) for i, (t, b, _) in low.items()}
    average = sum(size.values()) / max(len(size), 1) or 1.0
    held = [sum(f[p][0] + f[p][1] > 0 for f in found.values()) for p in range(len(phrases))]
    out = []
    for i, f in found.items():
        t, b, current = low[i]
        if current and any(x + y for x, y in f) and all(r in f"{t} {b}" for r in required):
            score = 0.0
            for n, (x, y) in zip(held, f, strict=True):
                idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
                w = 5.0 * x + y
                score -= (idf if idf > 0 else 1e-6) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * size[i] / average))
            out.append((i, round(score, 9)))
    return sorted(out, key=lambda r: (r[1], -r[0]))[:k]


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, words(rng, 30), "en" if i % 4 else "de", "s1", 100) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), {i: (t[:80], t, lang == "en" and i not in (3, 5)) for i, t, lang, *_ in rows}


def change(spark, rows):
    import datetime

    return spark.createDataFrame([(i, t, b, datetime.date(2024, 1, 1), c, gone, seq) for seq, (i, t, b, c, gone) in enumerate(rows)], CHANGE)


def same(got, want):
    got = [tuple(r) for r in got.collect()]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-9) and {i for i, s in got if s < want[-1][1] - 1e-6} == {i for i, s in want if s < want[-1][1] - 1e-6}


def test_changes_equal_a_rebuilt_index(spark, folder):
    path, docs = folder
    rng = random.Random(2)
    state = index.build(spark, path)
    same(index.search(state, ("the", "license")), brute(docs, ("the", "license")))
    for step in range(6):
        rows = []
        for _ in range(5):
            i = rng.choice([*docs, 1000 + step, 2000 + step])
            gone = rng.random() < 0.35
            t = words(rng, 8)
            rows.append((i, t[:20], t, rng.random() < 0.8, gone))
        rows.append((9999, "", "", True, True))  # a deletion of what isn't there
        state = index.apply(state, change(spark, rows))
        for i, t, b, c, gone in rows:
            docs.pop(i, None)
            if not gone:
                docs[i] = (t, b, c)
        assert (state.documents, state.live().count()) == (len(docs), len(docs))
        assert state.total_dl == sum(max(len(t) - 2, 0) + max(len(b) - 2, 0) for t, b, _ in docs.values())
    same(index.search(state, ("the", "license", "ing")), brute(docs, ("the", "license", "ing")))
    same(index.search(state, ("the", "日本語"), required=("zu", "a")), brute(docs, ("the", "日本語"), ("zu", "a")))
    assert any(s.number > 6 for s in state.segments) and len(state.segments) < 6  # some were merged
    index.vacuum(state)
    same(index.search(index.opened(spark, state.root, path), ("other",)), brute(docs, ("other",)))


def test_bytes_follow_the_change(spark, folder):
    path, _ = folder
    state = index.build(spark, path)
    before = {k: written_bytes(spark, f"{state.root}/{k}") for k in ("documents", "postings")}
    after = index.apply(state, change(spark, [(7, "one", "one text", True, False)]))
    assert after.segments[0].number == 0 and after.segments[0].dead == 1
    assert written_bytes(spark, f"{state.root}/postings") - before["postings"] < before["postings"] / 3
    assert index.apply(after, change(spark, [(8, "x", "y", True, True)]), batch=3).batch == 3


def test_a_batch_counts_once_and_a_torn_one_not_at_all(spark, folder):
    path, docs = folder
    state = index.build(spark, path)
    rows = change(spark, [(7, "new words", "new words", True, False)])
    once = index.apply(state, rows, batch=0)
    again = index.apply(index.opened(spark, state.root, path), rows, batch=0)
    assert again.segments == once.segments and again.documents == len(docs)
    # a batch that failed before its manifest leaves files that nobody reads
    once.write(rows.select("doc_id", "title", "body", "published", "current", "deleted"), "texts", once.next)
    assert index.opened(spark, state.root, path).segments == once.segments
    assert index.search(index.opened(spark, state.root, path), ("new words",)).count() == 1


def test_short_phrases_are_refused_and_empty_index_finds_nothing(spark, folder, tmp_path):
    path, _ = folder
    state = index.build(spark, path)
    for bad in ((), ("zu",), ("the", "zu")):
        with pytest.raises(ValueError):
            index.search(state, bad)
    gone = index.apply(state, change(spark, [(i, None, None, True, True) for i in range(60)]))
    assert gone.documents == 0 and index.search(gone, ("the", "license")).collect() == []


def test_merges_are_of_one_size():
    s = index.Segment
    assert index._to_merge((s(0, 1000), s(1, 5), s(2, 6))) == []
    assert [x.number for x in index._to_merge((s(0, 1000), s(1, 5), s(2, 6), s(3, 7), s(4, 8)))] == [1, 2, 3, 4]
    assert [x.number for x in index._to_merge((s(0, 1000, 600), s(1, 5)))] == [0]


def test_built_follows_the_files(spark, folder):
    from lakeloom.operators import retrieval

    path, _ = folder
    first = retrieval.built(spark, path)
    assert retrieval.built(spark, path) is first
    spark.createDataFrame([(500, "zzz zzz", "en", "s1", 7)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(f"{path}/documents.parquet")
    assert index.search(retrieval.built(spark, path), ("zzz",)).count() == 1


def test_newest_change_without_grouping_texts(spark):
    """Texts meet their keys; only documents with several changes of the greatest number are grouped."""
    rows = [(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", 5), (2, "d", 5), (3, None, 1), (3, "e", 0)]
    got = index.newest(spark.createDataFrame(rows, "doc_id long, body string, seq int").selectExpr("doc_id", "body AS title", "body", "DATE'2024-01-01' AS published", "true AS current", "false AS deleted", "seq"))
    assert sorted((r.doc_id, r.body) for r in got.collect()) == [(1, "b"), (2, "d"), (3, None)]


def test_postings_are_sorted_runs_without_an_exchange(spark, folder):
    """Before, ranges of postings were sampled first, which counted all trigrams twice."""
    path, docs = folder
    plan = index.postings(spark.createDataFrame([(1, "ab", "xabcabc"), (2, None, "")], "doc_id long, title string, body string").coalesce(1))
    rows = [tuple(r) for r in plan.collect()]
    assert rows == sorted(rows) and (index.code("abc"), 1, 0, 2) in rows
    assert not hasattr(index, "_ranged") and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_followed_changes_keep_their_files(spark, tmp_path, monkeypatch):
    """A set of changes is one micro-batch of several files; before, one task wrote and read all of it."""
    from lakeloom.operators import retrieval

    roots = []
    monkeypatch.setattr(retrieval, "new_folder", lambda spark, name: roots.append(f"{tmp_path}/{name}") or roots[-1])
    many = [b.repartition(3) for b in retrieval.changes(spark, "/root/testdata/sf0.001")]
    monkeypatch.setattr(retrieval, "changes", lambda spark, d: many)
    assert retrieval.ST9_followed_search(spark, "/root/testdata/sf0.001").count() == 32
    assert len(list((tmp_path / "changes" / "part=0").glob("*.parquet"))) == 3
    assert index.opened(spark, f"{tmp_path}/index", "/root/testdata/sf0.001").batch == 2
