"""Imports, source states, networks, entity differences, crawls, waves and step batches on small hand-made tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.windows import running_total
from lakeloom.operators import crawl, evidence, indexing, intake, parsing, retrieval, versioning


def test_import_outcomes(spark):
    ok = "https://a.example/x"
    rows = [(1, "s", ok, 200, "b1", "t", "x", "p"), (2, "s", ok, 200, "b1", "t", "x", "p"), (3, "r", ok, 200, "b1", "t", "x", "p"), (4, "s", "HTTPS://a.example/x", 200, "b2", "t", "x", "p"), (5, "s", None, 200, "b2", "t", "x", "p"),
            (6, "s", ok, 404, "b2", "t", "x", "p"), (7, "s", ok, 200, "b2", " ", "x", "p"), (8, "s", ok, 200, "b2", "t", "x", ""), (9, "s", ok, None, None, "t", "x", "p"), (10, "s", ok, 200, "b3", "t", "x", "p")]
    files = spark.createDataFrame(rows, "id long, source string, uri string, status int, body string, text string, title string, publisher string")
    known = files.where("id = 10").select("source", F.sha2("body", 256).alias("digest"))
    got = {r.id: r.outcome for r in intake.imported(files, known).collect()}
    assert got == {1: "created", 2: "unchanged", 3: "created", 4: "rejected:uri_not_canonical", 5: "rejected:uri_not_canonical", 6: "rejected:status", 7: "rejected:no_text", 8: "rejected:no_publisher", 9: "created", 10: "unchanged"}
    assert intake.imported(files.limit(0), known).collect() == []


def test_source_states(spark):
    now = datetime.datetime(2024, 1, 2)
    back = lambda minutes: now - datetime.timedelta(minutes=minutes)
    sources = spark.createDataFrame([(s, s != "off", 600) for s in ("off", "new", "bad", "last", "bare", "old", "fine")], "source string, enabled boolean, poll_s int")
    runs = [("off", 1, back(1), "completed"), ("new", 1, back(1), "failed"), ("bare", 1, back(1), "completed"), ("old", 1, back(21), "completed"), ("fine", 1, back(19), "completed"), ("last", 1, back(3), "completed"), ("last", 2, back(2), "completed_with_errors")]
    runs += [("bad", 0, back(99), "completed")] + [("bad", k, back(50 - k), "failed") for k in range(1, 31)]
    runs = spark.createDataFrame(runs, "source string, run long, at timestamp, status string")
    held = spark.createDataFrame([(s, 1, "d", 2, datetime.date(2024, 1, 1)) for s in ("off", "new", "bad", "last", "old", "fine")], "source string, resource long, digest string, chunks int, day date")
    got = intake.statuses(sources, runs, held, F.lit(now))
    rows = {r.source: r for r in got.collect()}
    assert {s: r.state for s, r in rows.items()} == {"off": "disabled", "new": "waiting", "bad": "failing", "last": "degraded", "bare": "degraded", "old": "stale", "fine": "healthy"}
    assert rows["bad"].failures == 20 and rows["bare"].resources == 0 and rows["old"].fresh_until == back(1)
    assert [(r.source, r.severity) for r in intake.alerts(got).collect()] == [("bad", "critical"), ("bare", "warning"), ("last", "warning"), ("old", "warning"), ("new", "info")]


@pytest.mark.parametrize(("ip", "role", "want"), [("10.64.0.1", "visitor", "allowlist"), ("10.128.0.1", "visitor", "denied"), ("::ffff:10.127.255.255", "visitor", "allowlist"), ("10.300.1.1", "visitor", "denied"), ("10.64.0", "visitor", "denied"), (None, "visitor", "denied"), ("x", "admin", "admin_bypass"), (None, "contributor", "contributor_bypass"), ("9.9.9.9", None, "allowlist")])
def test_network_rule(spark, ip, role, want):
    row = spark.createDataFrame([(ip, role)], "ip string, role string")
    assert row.select(intake.network_rule(F.col("ip"), F.col("role"), ("10.64.0.0/10", "9.9.9.9")).alias("r")).first().r == want
    assert row.select(intake.network_rule(F.col("ip"), F.col("role"), (), enabled=False).alias("r")).first().r == "disabled"


def test_entity_diff_of_all_fields(spark):
    body = "报名截止:2024年3月1日。地点:一号楼。请2024级同学按时到现场完成报名。"
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, title string, body string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    one = indexing.facts(docs([(1, "通知", body), (2, "通知", body), (3, "通知", body)]))
    two = indexing.facts(docs([(1, "通知", body), (2, "办法", "取消《旧办法》"), (4, "通知", body)]))
    got = {r.doc_id: {c["name"]: (c["from"], c["to"]) for c in r.changes} for r in indexing.entity_diff(one, two, "doc_id").collect()}
    assert got[1] == {}
    assert set(got[2]) == {"kind", "status", "deadline_at", "audiences", "actions", "places", "relation", "related_title"} and got[2]["kind"] == ("notice", "policy")
    assert got[3]["deadline_at"] == ("2024-03-01 15:59:00", None) and got[4]["places"] == (None, '["一号楼"]')


def test_entity_diff_far_behind_the_beginning(spark):
    docs = lambda end: spark.createDataFrame([(1, "通知", "x. " * 10_000 + end)], "doc_id long, title string, body string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    found = indexing.entity_diff(indexing.facts(docs("地点:一号楼。")), indexing.facts(docs("地点:二号楼。修订《旧安排》")), "doc_id").first()
    assert {c["name"]: (c["from"], c["to"]) for c in found.changes} == {"places": ('["一号楼"]', '["二号楼"]'), "relation": (None, "revised"), "related_title": (None, "旧安排")}


def test_crawl_stops_at_details_cycles_and_old_pages(spark):
    pages = spark.createDataFrame([(1, "listing", None), (2, "listing", "2024-01-01"), (3, "detail", None), (4, "listing", "2020-01-01"), (5, "detail", None), (6, "detail", None), (7, "listing", None)], "page long, kind string, d string").withColumn("day", F.to_date("d"))
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (1, 4), (4, 5), (3, 6), (2, 2), (7, 6), (1, 3)], "source long, target long")
    seeds = spark.createDataFrame([(1,), (1,), (99,)], "page long")
    got = {r.page: (r.depth, r.parent) for r in crawl.crawl(pages, links, seeds, "2022-01-01").collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 1)}
    with pytest.raises(ValueError):
        crawl.crawl(pages, links, seeds, "2022-01-01", most=1)
    assert crawl.crawl(pages, links, seeds.limit(0), "2022-01-01").count() == 0


def test_link_repair(spark):
    answers = spark.createDataFrame([(1, "[Course rules](<PRIVATE_URL>) [Other](PRIVATE_URL) [a](http://e.example/1), [b](/local) [c](mailto:x) http://e.example/1. http://no.example/2 <PRIVATE_URL>"), (2, "no links"), (3, ""), (4, None), (5, "[Same](<PRIVATE_URL>)")], "answer long, markdown string")
    evidence_rows = [(1, "http://e.example/1", "Course rules"), (5, "u1", "Same"), (5, "u2", "Same")]
    got = {r.answer: r for r in evidence.repaired(answers, spark.createDataFrame(evidence_rows, "answer long, url string, title string")).collect()}
    assert got[1].markdown == "[Course rules](<http://e.example/1>) [Other](PRIVATE_URL) [a](http://e.example/1), b [c](mailto:x) http://e.example/1.  "
    assert (got[1].restored, got[1].stripped, got[1].removed) == (1, 1, 1)
    assert (got[2].markdown, got[3].markdown, got[4].markdown, got[5].markdown) == ("no links", "", None, "[Same]()")


def test_patches_and_batches(spark):
    claims = spark.createDataFrame([(1, "a", 1, "A"), (1, "b", 2, "B")], "answer long, claim string, place int, content string")
    steps = [(1, 1, "remove", "a", None), (1, 2, "remove", "a", None), (1, 3, "add", "c", "C"), (1, 4, "replace", "a", "A2"), (1, 5, "replace", "b", "B2"), (1, 6, "add", "d", None), (2, 1, "add", "z", "Z")]
    after, findings = evidence.patched(claims, spark.createDataFrame(steps, "answer long, seq int, action string, claim string, content string"))
    assert sorted((r.answer, r.place, r.claim, r.content) for r in after.collect()) == [(1, 1, "b", "B2"), (1, 2, "c", "C"), (1, 3, "a", "A2"), (2, 1, "z", "Z")]
    assert sorted((r.seq, r.severity) for r in findings.collect()) == [(2, "warning"), (6, "error")]
    plan = spark.createDataFrame([(1, k, 0, "t", {"q": str(k % 5), "n": "1"}) for k in range(12)], "plan long, step long, level long, tool string, arguments map<string,string>")
    assert [(r.batch, r.steps, r.calls) for r in parsing.batches(plan).orderBy("batch").collect()] == [(0, [0, 1, 2, 3, 5, 6, 7, 8, 10, 11], 4), (1, [4, 9], 1)]


def test_waves_stop_when_full(spark, tmp_path):
    rows = [(f"s{k:02d}", f"u{k}-{j}", j) for k in range(20) for j in range(3)]
    spark.createDataFrame(rows, "source string, url string, score int").write.partitionBy("source").parquet(f"{tmp_path}/t")
    table = spark.read.schema("url string, score int, source string").parquet(f"{tmp_path}/t")
    ranked = [f"s{k:02d}" for k in range(20)]
    found, asked = parsing.waves(table, ranked, 20)
    assert asked == 2 and found.count() == 20 and {r.wave for r in found.collect()} == {0, 1}
    assert parsing.waves(table, ranked, 1000)[1] == 4
    plan = table.where(F.col("source").isin(ranked[:6]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [source" in plan  # a wave reads its sources' folders only


def test_excerpt_prefers_rare_terms_then_the_last(spark):
    text = "common " * 300 + "rare common " + "x " * 900 + "common other"
    rows = [(1, text), (2, ""), (3, "short common"), (4, "é" * 3000 + " common")]
    got = {r.i: r.e for r in spark.createDataFrame(rows, "i int, t string").select("i", retrieval.rare_excerpt(F.col("t"), ("rare", "common", "none")).alias("e")).collect()}
    assert "rare" in got[1] and got[1].startswith("…") and got[1].endswith("…") and len(got[1]) == 1202
    assert (got[2], got[3]) == ("", "short common") and got[4].endswith(" common") and got[4].startswith("…é")


def test_running_total_with_nulls_and_spans(spark):
    rows = [("a", 1, 5), ("a", 2, 7), ("a", 9000, 1), (None, 1, 2), (None, 5000, 3), ("b", 3, 4)]
    frame = spark.createDataFrame(rows, "k string, t long, n long")
    got = {(r.k, r.t): r.before for r in running_total(frame, F.col("n"), F.floor(F.col("t") / 100), [F.col("t")], [F.col("k")]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 5, ("a", 9000): 12, (None, 1): 0, (None, 5000): 2, ("b", 3): 0}


def test_seeds_take_turns(spark):
    rows = [("g", 1, k, f"a{k:02d}", k == 9) for k in range(60)] + [("g", 2, 0, "b", False), ("g", 2, 1, "a09", False), ("h", 3, 0, "x", False), ("h", 3, 1, "x", True)]
    links = spark.createDataFrame(rows, "group string, seed long, at int, link string, hinted boolean")
    got = [(r.group, r.place, r.link, r.seed) for r in crawl.discovered(links, 4).orderBy("group", "place").collect()]
    assert got == [("g", 1, "a09", 1), ("g", 2, "b", 2), ("g", 3, "a00", 1), ("g", 4, "a01", 1), ("h", 1, "x", 3)]


def test_dash_variants():
    from lakeloom.functions.text import dash_variants

    assert dash_variants("plain") == ("plain",) and set(dash_variants("a—b-c")) == {"a-b-c", "a–b–c", "a—b—c", "a－b－c", "a—b-c"}


def test_messages_without_client_id_all_stay(spark):
    rows = [(1, 7, 3, "b"), (1, 7, 2, "a"), (1, None, 1, "x"), (1, None, 1, "x"), (2, 7, 9, "c")]
    got = versioning.once_by_client(spark.createDataFrame(rows, "conversation long, client_id long, at long, role string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 7, 2, "a"), (1, None, 1, "x"), (1, None, 1, "x"), (2, 7, 9, "c")], key=str)


def test_first_confirmed_value_of_a_visitor_stays(spark):
    rows = [(1, True, 5, "k", "confirmed"), (1, True, 4, "k", "confirmed"), (1, True, 3, "k", "dismissed"), (1, False, 9, "m", "confirmed"), (1, True, 1, "m", "confirmed"), (2, True, 2, "m", "confirmed"), (2, False, 8, "m", "suggested")]
    got = {r.id: (r.status, r.moved) for r in versioning.merged_attributes(spark.createDataFrame(rows, "owner long, visitor boolean, id long, key string, status string")).collect()}
    assert got == {5: ("suggested", True), 4: ("confirmed", True), 3: ("dismissed", True), 9: ("confirmed", False), 1: ("suggested", True), 2: ("confirmed", True), 8: ("suggested", False)}


def test_repaired_links_equal_sql_on_odd_titles_and_shared_addresses(spark, tmp_path):
    """Titles that a digest may hold or that wide spaces surround, and a page with the address of the next."""
    import duckdb

    titles = ["x", "a.", "y", "De.", "z", "ed", "a", "0", "b", "a", "c", "Anre.", "same", "other", "q", "", "\u00a0wide\u3000", "\u2003\u00a0wide", " \u202f "]
    rows = [(k + 1, "http://e.example/14" if k in (12, 13) else f"http://e.example/p{k}", f"<html><title>{t}</title></html>") for k, t in enumerate(titles)]
    rows += [(k, f"http://e.example/{k}", f"<title>{'abcdef0123456789'[k % 16]}</title>") for k in range(101, 133)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT answer, markdown, restored, stripped, removed FROM ({evidence.SQL['RT11_repaired_links']})").fetchall()
    got = evidence.QUERIES["RT11_repaired_links"](spark, str(tmp_path)).select("answer", "markdown", "restored", "stripped", "removed").collect()
    assert sorted(map(tuple, got)) == sorted(want)
