"""Golden values and brute force for what SQL doesn't cover: text forms, chunks, embeddings, facts, pages, matching."""

import datetime
import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions.text import back_off_windows, canonical_url, occurrences, query_terms
from lakeloom.operators import exploration, indexing, operations, parsing, retrieval


def test_back_off_windows():
    assert back_off_windows("abcdefghi") == ["abcde", "cdefg", "efghi"]
    assert back_off_windows("abcd ab") == [] and query_terms("The “Of” the") == ["the", "of"]


def test_channels_that_ask_the_same_are_one():
    found = retrieval.channels_of(["license", "license", "of license"])
    assert [(c.kind, c.phrases, c.short, c.variants) for c in found] == [("exact", ("license",), (), [0, 1, 2]), ("exact", ("oflicense",), (), [2]), ("token_and", ("license",), ("of",), [2])]


def test_overlapping_occurrences(spark):
    df = spark.createDataFrame([("aaaa abab",)], "t string")
    assert df.select(occurrences(F.col("t"), "aa"), occurrences(F.col("t"), "ab")).first()[:] == (3, 2)


def test_canonical_urls(spark):
    urls = [("HTTP://Ex.org:80?b=2&a=1%20x&utm_source=q&SPM=1#top", "http://ex.org/?a=1+x&b=2"), ("https://a.b/p/?spm_x=1&k", "https://a.b/p/?k=&spm_x=1")]
    df = spark.createDataFrame(urls, "u string, want string")
    assert all(r[0] == r[1] for r in df.select(canonical_url(F.col("u")), "want").collect())


def plain_normal(text):
    t = unicodedata.normalize("NFKC", text).replace("​", "")
    lines = []
    for c in t:
        if c in " \t\r\f\v":
            if not lines or lines[-1] != " ":
                lines.append(" ")
        else:
            lines.append(c)
    t = "".join(lines)
    t = "\n".join(x if k == 0 else x.lstrip(" \t") for k, x in enumerate(t.split("\n")))
    while "\n\n\n" in t:
        t = t.replace("\n\n\n", "\n\n")
    t = t.strip()
    han = lambda c: "㐀" <= c <= "鿿"
    return "".join(c for k, c in enumerate(t) if not (c == " " and 0 < k < len(t) - 1 and han(t[k - 1]) and han(t[k + 1])))


def test_normal_form(spark):
    texts = [" ａ​b  c \n\n\n\n d ", "中 文 a 文", "x\n\t  y", "", "\xa0 é ﬁ　", "㐀 㐁", "a\r\nb\f\vc", "\n\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k int, t string").select("k", indexing.normalized(F.col("t")).alias("n")).collect()
    got = {r.k: r.n for r in rows}
    assert got[99] is None
    for k, t in enumerate(texts):
        assert got[k] == plain_normal(t) == indexing.normal(t), repr(t)


def test_chunks(spark):
    lines = "\n".join(f"line {k} " + "x" * 90 for k in range(60))
    text = "开头。\n第一章 总则\n" + "内" * 950 + "。\n后文\n一、报名时间\n六月"
    long = "。".join("字" * 99 for _ in range(30)) + "。"
    docs = spark.createDataFrame([(1, "t", lines), (2, "标题", text), (3, "t", long), (4, "t", ""), (5, None, None), (6, "t", "x"), (7, "t", "\n\n"), (8, "t", "适用 第二条")], "doc_id long, title string, text string")
    found = {}
    for r in indexing.chunk_table(docs).orderBy("doc_id", "ordinal").collect():
        found.setdefault(r.doc_id, []).append(r)
    out = found[1]
    assert [r.ordinal for r in out] == list(range(len(out))) and all(len(r.content) <= 1450 for r in out) and "\n".join(r.content for r in out) == lines
    assert all(lines[r.start : r.end] == r.content for r in out)
    assert [(r.kind, r.heading) for r in found[2]] == [("section", ""), ("clause", "第一章总则"), ("clause", "第一章总则"), ("time", "一、报名时间")]
    split = found[3]
    assert "".join(r.content.replace("\n", "") for r in split) == long and all(900 <= len(r.content) <= 1450 for r in split[:-1])
    assert [(r.kind, r.heading, r.content, r.start, r.end) for r in found[4]] == [("summary", "t", "t", 0, 1)]
    assert [(r.kind, r.content) for k in (5, 6, 8) for r in found[k]] == [("summary", ""), ("section", "x"), ("audience", "适用第二条")]


def test_embedding_equals_brute_force():
    text = "选课通知 补选 ai-2 the the 校园"
    want = np.zeros(384)

    def put(feature, weight):
        raw = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        want[raw % 384] += -weight if raw >= 1 << 63 else weight

    for run in ("选课通知", "补选", "校园"):
        for n, w in ((2, 1.0), (3, 1.25), (4, 1.4)):
            for i in range(len(run) - n + 1):
                put(run[i : i + n], w)
    for word in ("ai-2", "the", "the"):
        put(word, 1.2)
    put("concept:course_selection", 2.6 + 0.35 * 2)
    want /= np.linalg.norm(want)
    assert np.allclose(indexing.embed(text), want, atol=1e-8) and not indexing.embed("a !").any()


def plain_time(text, labels, year, end_of_day):
    """The labelled time by finditer: (at, start, end) or None."""
    clock = r"(?:\s*(?P<p>上午|下午|晚上|晚|凌晨|中午))?(?:\s*(?P<h>[0-9]{1,2})\s*(?:[:：时点]\s*(?P<i>[0-9]{1,2}))?\s*分?)?"
    full = r"(?P<y>20[0-9]{2})\s*[年./-]\s*(?P<m>[0-9]{1,2})\s*[月./-]\s*(?P<d>[0-9]{1,2})\s*[日号]?" + clock
    short = r"(?<![0-9])(?P<y>)(?P<m>[0-9]{1,2})\s*月\s*(?P<d>[0-9]{1,2})\s*[日号]?" + clock
    best = None
    for k, label in enumerate(labels):
        for at in re.finditer(label, text):
            low = max(0, at.start() - 45)
            for pattern in (full, short):
                for m in re.finditer(pattern, text[low : at.end() + 130]):
                    h, i = int(m["h"] or (23 if end_of_day else 0)), int(m["i"] or (59 if end_of_day and not m["h"] else 0))
                    if m["h"]:
                        h = h + 12 if m["p"] in ("下午", "晚上", "晚") and h < 12 or m["p"] == "中午" and h < 11 else 0 if m["p"] == "凌晨" and h == 12 else h
                    try:
                        when = datetime.datetime(int(m["y"] or year), int(m["m"]), int(m["d"]), h, i) - datetime.timedelta(hours=8)
                    except ValueError:
                        continue
                    s, e = low + m.start(), low + m.end()
                    key = (min(abs(s - at.end()), abs(e - at.start())) + (20 if s < at.start() else 0), s, k)
                    best = min(best or (key, when, s, e), (key, when, s, e), key=lambda x: x[0])
    return best and best[1:]


def test_labelled_times_equal_a_plain_search(spark):
    rng = random.Random(4)
    bits = ["截止", "报名截止", "开始", "2024年3月5日", "3月5日下午3:30", "12月31日 中午11时", "2024-2-30", "2023.6.1 8点20分", "凌晨12:05", "月", "。", "\n", " 于 ", "x" * 20, "1月1日晚9时", "2024/13/1", "2月29日", "25:99", "截至", "5日"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), rng.choice([2023, 2024])) for k in range(300)] + [(900, "", 2024), (901, None, 2024), (902, "截止" * 300 + "2024年1月2日", 2024)]
    docs = spark.createDataFrame(rows, "k long, t string, y int")
    for labels, last in ((indexing.DEADLINE_LABELS, True), (("开始",), False)):
        for r in docs.select("*", indexing.labelled_time(F.col("t"), labels, F.col("y"), last).alias("x")).collect():
            want = plain_time(r.t or "", labels, r.y, last)
            assert (r.x and (r.x["at"], r.x.start, r.x.end)) == want, (r.t, r.x, want)


def test_facts(spark):
    rows = [
        (1, "关于报名的通知", "请2024级学生于2024年12月3日前提交材料,报名截止:12月3日下午5时。地点：一号楼报告厅， 。", "2024-01-01", None),
        (2, "奖学金管理办法", "废止《旧办法》。根据教高〔2023〕5号", "2024-01-01", None),
        (3, "plain", "nothing", "2024-01-01", None),
        (4, "讲座", "活动延期《原讲座安排》", "2024-01-01", "2024-09-01 10:00:00"),
        (5, "考试", "报名取消。结束时间 2024年5月1日", "2024-01-01", None),
        (6, "比赛", "开始时间：7月1日", "2024-01-01", None),
        (7, "条例", "细则", "2024-01-01", "2024-09-01 10:00:00"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, day string, f string").withColumn("day", F.to_date("day")).withColumn("effective_from", F.to_timestamp("f"))
    got = {r.doc_id: r for r in indexing.facts(docs, own_names=("x",)).collect()}
    assert got[1].kind == "notice" and got[1].audiences == ["2024级"] and got[1].places == ["一号楼报告厅"] and got[1].status == "open" and len(got[1].actions) == 1
    assert str(got[1].deadline_at) == "2024-12-03 09:00:00" and got[1].confidence == pytest.approx(0.52 + 4 * 0.055)
    assert (got[2].kind, got[2].relation, got[2].related_title, got[2].status, got[2].number) == ("policy", "superseded", "旧办法", "superseded", "教高〔2023〕5号")
    assert (got[3].kind, got[3].status, got[3].confidence) == ("document", "unknown", 0.52)
    assert (got[4].kind, got[4].status, got[4].related_title, str(got[4].starts_at)) == ("event", "postponed", "原讲座安排", "2024-09-01 10:00:00")
    assert (got[5].status, str(got[5].ends_at)) == ("cancelled", "2024-05-01 15:59:00")
    assert [(got[k].kind, got[k].status) for k in (6, 7)] == [("competition", "upcoming"), ("policy", "upcoming")]


def test_pages_and_blocks(spark):
    paged = "前言【PDF 第 1 页】一\n列  二【PDF 第 10 页】三十"
    rows = [(1, paged), (2, "x" * 4000 + "yz"), (3, ""), (4, None), (5, paged[2:])]
    got = sorted(exploration.units(spark.createDataFrame(rows, "doc_id long, body string")).collect())
    assert [(r.doc_id, r.locator, r.kind) for r in got] == [(1, 1, "page"), (1, 10, "page"), (2, 1, "block"), (2, 2, "block"), (5, 1, "page"), (5, 10, "page")]
    assert all(dict(rows)[r.doc_id][r.start : r.end] == r.content for r in got) and got[3].start == 4000
    text = "a" * 100 + "term" + "b" * 2000 + "Term other"
    assert [(p[0], p[3]) for p in exploration.passages(text, ["term", "other"], 300, 5)] == [(2104, 2), (100, 1)]


def test_rows_of_recognised_words(spark):
    words = [(1, t, x, y, 10.0, 10.0) for t, x, y in (("b", 50.0, 101.0), ("a", 0.0, 100.0), ("d", 50.0, 141.0), ("c", 0.0, 140.0))]
    got = parsing.ocr_rows(spark.createDataFrame(words, "page long, text string, x double, y double, width double, height double"))
    assert [(r.text, r.cells) for r in got.orderBy("row").collect()] == [("a | b", 2), ("c | d", 2)]
    # rows are in the order of their tops, though a low word of the first has the greater centre
    tilted = spark.createDataFrame([(1, "low", 0.0, 10.0, 5.0, 40.0), (1, "top", 0.0, 0.0, 5.0, 8.0), (1, "late", 0.0, 90.0, 5.0, 8.0)], "page long, text string, x double, y double, width double, height double")
    assert [r.text for r in parsing.ocr_rows(tilted).orderBy("row").collect()] == ["top", "low", "late"]


def test_page_texts(spark):
    box = lambda p, line, k, t, x, y: (p, line, k, t, x, y, 10.0, 10.0)
    rows = [box(1, 0, 0, "Name", 0.0, 0.0), box(1, 1, 0, "Value", 50.0, 1.0), box(1, 2, 0, "alone", 0.0, 40.0), box(1, 3, 1, "b", 9.0, 80.0), box(1, 3, 0, "a", 0.0, 80.0), box(1, 4, 0, " ", 0.0, 0.0), (2, 0, 0, "x", None, None, None, None), box(2, 0, 1, "y", 1.0, 1.0), (2, 1, 0, "z", None, 1.0, 1.0, 1.0)]
    got = parsing.ocr_text(spark.createDataFrame(rows, "page long, line int, k int, text string, x double, y double, width double, height double"))
    assert {r.page: r.text for r in got.collect()} == {1: "Name | Value\nName | Value\nalone\nab", 2: "xy\nz"}


def test_labels_match_one_title(spark):
    titles = spark.createDataFrame([(1, "u1", "Course selection rules"), (1, "u2", "Library hours"), (2, "u3", "Exam dates 2024"), (2, "u4", "Exam dates 2023")], "answer long, url string, title string")
    labels = spark.createDataFrame([(1, "course selection rules"), (1, "Unrelated words"), (2, "Exam dates")], "answer long, label string")
    assert [tuple(r) for r in parsing.match_labels(labels, titles).collect()] == [(1, "course selection rules", "u1")]


def test_admission_golden(spark):
    rows = [(k, "s", f"2024-01-01 10:00:{k:02d}") for k in range(1, 7)]
    df = spark.createDataFrame(rows, "event_id long, who string, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("s", F.lit(1))
    got = [r.reason for r in operations.admit(df, "s", 3600, 5, 100).orderBy("event_id").collect()]
    assert got == [None] * 5 + ["SUBJECT_RATE_LIMITED"]
    assert {r.reason for r in operations.admit(df, "s", 3600, 5, 100, enforce=False).collect()} == {None, "SUBJECT_RATE_LIMITED"}


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), np.round(rng.exponential(5, 3000), 1), strict=True)] + [(7, 1.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in operations.at_ranks(df, "g", "v", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "high": F.col("n") - 1}, cuts=5).collect()}
    for g in (0, 1, 2, 7):
        own = sorted(v for h, v in rows if h == g)
        assert (got[g].low, got[g].mid, got[g].high, got[g].n) == (own[0], own[len(own) // 2], own[-1], len(own))
    assert 8 not in got


def test_readers_by_kind(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert parsing.read(spark, "json", str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError, match="no reader"):
        parsing.read(spark, "fax", "x")


def test_registry_problems(spark):
    rows = [("a", "https://A.org/x", [" a.org "]), ("a", "https://a.org", ["a.org"]), ("b", "nonsense", ["b.org"]), ("c", "http://c.org", ["d.org"])]
    got = {tuple(r) for r in parsing.validated(spark.createDataFrame(rows, "id string, base_url string, allowed_hosts array<string>")).collect()}
    assert got == {("a", "duplicate_id"), ("b", "malformed_url"), ("c", "host_not_allowed")}


def test_facts_of_whole_texts(spark):
    """What stands far behind the beginning counts like what stands at it."""
    filler = "x. " * 20_000
    late = "报名截止:2024年12月3日下午5时。地点：一号楼报告厅。请2024级学生提交材料。教高〔2023〕5号。延期《原讲座安排》。"
    rows = [(1, "关于报名的通知", filler + late), (2, "plain", filler + "课程，两学分。"), (3, "通知", filler + "活动取消。")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    got = {r.doc_id: r for r in indexing.facts(docs).collect()}
    assert (got[1].number, got[1].relation, got[1].related_title, got[1].status) == ("教高〔2023〕5号", "postponed", "原讲座安排", "postponed")
    assert str(got[1].deadline_at) == "2024-12-03 09:00:00" and got[1].places == ["一号楼报告厅"] and "2024级" in got[1].audiences and got[1].actions
    assert [(got[k].kind, got[k].status) for k in (2, 3)] == [("course", "unknown"), ("notice", "cancelled")]


def test_labels_at_the_ends_of_pieces(spark):
    """Wherever a label and its date stand, also across the end of a piece, they are found as in a text of one piece."""
    at = [0, 1, 30, indexing.PIECE - 200, *range(indexing.PIECE - 140, indexing.PIECE + 60, 7), 2 * indexing.PIECE - 3]
    texts = [" " * k + t for k in at for t in ("截止时间：" + "-" * 100 + "2024年5月1日", "2024年5月1日" + "-" * 30 + "截止", "报名截止5月1日8时")]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "k long, t string")
    for r in docs.select("*", indexing.labelled_time(F.col("t"), indexing.DEADLINE_LABELS, F.lit(2024), True).alias("x")).collect():
        want = plain_time(r.t, indexing.DEADLINE_LABELS, 2024, True)
        assert want is not None and (r.x["at"], r.x.start, r.x.end) == want, (r.k, r.x, want)
