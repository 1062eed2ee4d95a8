"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import pytest

from lakeloom.llm.middle import op12_middle, with_middles

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, seed="42", plain_from=50, spm_below=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = TOKEN.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < spm_below:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "\n\t ", "a", "one two three", " lead", "trail \r\n", "x<P>y", "x<S>y", "<M>", "<P", "a <", "< S> <P <M <S", "> > >", "é日本 🙂🙂 a\xa0b　c", "a\x00b c", "tab\tnew\nline\x0bv\x0cf\rr", "it's \"quoted\" \\ $1", "same text", "same text", "word " * 40000]


def rows():
    return [(i, TEXTS[i % len(TEXTS)]) for i in range(6 * len(TEXTS))] + [(None, "no key here"), (None, None), (5, TEXTS[5]), (-3, "below zero is an id")]


@pytest.mark.parametrize("how", [{}, {"seed": "other-1", "plain_from": 100, "spm_below": 50}, {"plain_from": 0}])
def test_equals_plain_python(spark, how):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = with_middles(docs, **how).collect()
    assert len(got) == len(rows())
    for r in got:
        want = brute(r.doc_id, r.text, **how)
        assert (r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) == want
        assert r.fim_restored == (r.text or "") and r.fim_restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.fim_output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
    if how.get("plain_from") == 100:
        assert {r.fim_form for r in got} == {"plain", "psm", "spm"}


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 7.0, 9)], "doc_id long, text string, form string, n double, row long")
    (r,) = with_middles(docs).collect()
    assert (r.form, r.n, r.row, r.fim_n) == ("x", 7.0, 9, 3)
    assert with_middles(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        with_middles(docs.withColumnRenamed("form", "fim_form"))
    with pytest.raises(ValueError):
        with_middles(docs, seed="'; drop")


def test_query_on_a_folder(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_middle(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows():
        n, form, p, m, out = brute(i, t)
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
