"""Grace hash deduplication against plain grouping."""

import hashlib
import random

import pytest

from lakeloom.llm import exact
from lakeloom.llm.exact import ContentTable, exact_groups, keep_one, op11_exact


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and the doc_ids that stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, stay = [], []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stay.append((keep, t))
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), sorted(stay, key=str)


def check(got, rows):
    want, stay = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(stay) and all(r.doc_id == r.keep_id for r in kept)


def some(n=600, seed=3):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "A", "a ", "é", "é", "x\x00y", "same " * 3000] + [f"text {k} " * rng.randint(1, 40) for k in range(120)]
    rows = [(i, "a third of all" if i % 3 == 0 else rng.choice(texts)) for i in range(n)]
    rng.shuffle(rows)
    return rows + rows[:5] + [(None, "a"), (None, "only null ids"), (None, "only null ids"), (-7, None)]


@pytest.mark.parametrize("sizes", [{}, {"flush": 2000, "flush_rows": 50}, {"flush": 1000, "bucket": 4000, "limit": 500}, {"bucket": 1 << 40, "limit": 1}])
def test_equals_grouping(spark, sizes):
    rows = some()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(exact_groups(docs, **sizes).collect(), rows)


def test_recursion_runs_until_all_fits(spark, monkeypatch):
    levels = []
    real = exact.settled
    monkeypatch.setattr(exact, "settled", lambda records, level, buckets, limit: levels.append((level, buckets)) or real(records, level, buckets, limit))
    rows = [(i, f"{i % 40} " * 50) for i in range(120)]
    check(exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), bucket=100_000, limit=700).collect(), rows)
    assert [x for x, _ in levels] == list(range(len(levels))) and len(levels) > 3 and levels[0][1] == 1


def test_table_compares_whole_contents():
    table = ContentTable(slots=2)
    for h in (5, -5, 1 << 62):  # all contents of one hash
        for k in range(50):
            content = b"x" * 1000 + f"{h}:{k}".encode()
            assert table.find(h, content) == -1
            assert table.find(h, content) == -1 and table.add(h, content) == table.find(h, content)
    assert len(table.contents) == 150 and table.find(5, b"x" * 1000) == -1


def test_hash_collisions_do_not_join_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = some(150)
    check(exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), limit=2000).collect(), rows)


def test_hot_text_is_a_record_a_task(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = exact.collapsed(docs).where("content IS NOT NULL AND content = cast('hot' AS binary)")
    assert found.count() == 4


def test_keep_one_keeps_columns_and_edges(spark):
    rows = [(1, "a", 10, "x"), (2, "a", 11, "y"), (2, "a", 11, "y"), (None, "a", 12, None), (3, None, 13, "n"), (4, "b", 14, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, record long, own string")
    got = sorted(map(tuple, keep_one(docs).collect()))
    assert got == [(2, "a", 11, "y"), (3, None, 13, "n"), (4, "b", 14, "z")]
    assert keep_one(docs.limit(0)).collect() == [] and exact_groups(docs.limit(0)).collect() == []


def test_long_text_over_every_limit(spark):
    long = "word " * 100_000
    rows = [(1, long), (2, long), (3, long + "x"), (4, "short"), (5, "short")]
    check(exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), flush=1000, limit=1000, bucket=400_000).collect(), rows)


def test_query_on_a_folder(spark, tmp_path):
    rows = some(200)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op11_exact(spark, str(tmp_path)).collect(), rows)
