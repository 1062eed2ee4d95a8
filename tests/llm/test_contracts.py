"""The numbered queries on the driver's smallest tables against brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from lakeloom.llm import pieces, queries
from tests.llm import test_neardup, test_pii, test_substrings

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op1_pii")}
    names = ("email", "ip", "card", "phone")
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        base = test_pii.brute(text or "")
        listed = [f"{names[k]}:{s}:{e}" for k, s, e in base]
        assert got[i].base_sha256 == sha(",".join(listed)) and set(listed) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{n}"] for n in names] == [sum(k == j for k, *_ in base) for j in range(4)]


def test_op2_and_op4(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = run(spark, "op2_onebit")
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(order) + 1))
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in own)
        hit, total = hit + len({ids[i] for i in order} & {r.vec_id for r in own}), total + len(order)
    assert hit / total >= 0.9


def test_op5(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op5_language")}
    known = {lang for i, _, lang, _ in docs if lang and zlib.crc32(str(i).encode()) % 5}
    right = total = 0
    for i, text, lang, _ in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in known | {"und"}
        if r.held_out and lang and len(text or "") > 50:
            right, total = right + (r.lang_pred == lang), total + 1
    assert total and right / total > 0.95


def test_op6(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    got = {r.doc_id: r for r in run(spark, "op6_pieces")}
    for i, text, *_ in docs:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(sp.decode(ids)))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_op7(spark, docs):
    want = test_substrings.brute([(i, t) for i, t, *_ in docs])
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op7_substrings")], key=str) == [(d, n, gone, sha(kept)) for d, n, gone, kept in want]


def test_op8_totals(spark):
    got = run(spark, "op8_mixing")
    size = {r.doc_id: r["size"] for r in got}
    by_source = {}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0
        by_source.setdefault(r.target, []).append(r.taken)
    assert abs(sum(r.taken for r in got) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())


def test_op9(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op9_toxicity")}
    assert len(got) == len(docs)
    for i, *_ in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
        assert got[i].predicted == (got[i].score >= 0.7)


def test_op10(spark, docs):
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, "op10_neardup")], key=str)
    assert got == test_neardup.brute([(i, t) for i, t, *_ in docs])
