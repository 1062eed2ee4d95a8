"""Small forms of what only large tables show."""

import random
import re

from pyspark.sql import functions as F

from lakeloom.operators import admission, evidence, indexing, linkage, parsing, retrieval


def events(spark, folder, rows, schema="event_id long, user_id long"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_network_rule_of_users_past_two_parts(spark, tmp_path):
    """The third part of an address is past 255 from user 65,536 on; it must not reach the second."""
    got = {r.user_id: r.reason for r in linkage.FI16_network_rule(spark, events(spark, tmp_path, [(1, 5), (2, 65537), (3, 131073), (4, 131075), (5, 131078)])).collect()}
    assert got == {5: "ALLOWLIST", 65537: "ALLOWLIST", 131073: "ALLOWLIST", 131075: "DENIED", 131078: "DENIED"}


def test_admission_rounds_follow_days_not_limits(spark):
    """Common limits that bind all the time: before, a round settled little more than the next request."""
    rng = random.Random(5)
    hour = admission.HOUR
    requests = [(rng.randint(1, 40), i, rng.randint(0, 4 * 24 * 6) * hour // 6, rng.randint(5, 40) * hour // 10) for i in range(900)]
    limits = admission.Limits(queued=2, all_queued=3, window=6, window_us=8 * hour, daily=20, all_daily=60)
    from tests.test_admission import plain

    got = {r.event_id: (r.admitted, r.reason) for r in admission.admit(spark.createDataFrame(requests, "s long, event_id long, t long, w long"), limits, most=6).collect()}
    assert got == plain(requests, limits)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_answer_counts_need_one_exchange(spark):
    """Before, three, and tables of all pairs; nulls count in pairs only."""
    rng = random.Random(6)
    rows = [(rng.randint(1, 9), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2])) for _ in range(60)] + [(None, 1, 1), (None, 1, 1), (77, None, None)]
    got = evidence.answer_counts(spark.createDataFrame(rows, "answer_id long, claim_id long, evidence_id long"), 3)
    want = {a: (len({c for x, c, _ in rows if x == a} - {None}), len({e for x, _, e in rows if x == a} - {None}), len({(c, e) for x, c, e in rows if x == a})) for a, _, _ in rows}
    assert {r.answer_id: tuple(r)[1:] for r in got.collect()} == want
    assert plan_of(got).split("Initial Plan")[0].count("Exchange") <= 1 and "Expand" not in plan_of(got)


def test_ascii_texts_stay_out_of_python_and_batches_are_bounded(spark):
    seen = spark.createDataFrame([(None,), ("plain",), ("ﬁn ①",)], "t string").select(indexing.nfkc(F.col("t")).alias("n"))
    assert [r.n for r in seen.collect()] == [None, "plain", "fin 1"] and "RLIKE" in plan_of(seen)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    indexing.SF1_normalize_text(spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"


def test_facts_and_passages_are_computed_once(spark):
    """What the diff and the report are taken from is a table: no pattern of facts, no text is left in their plans."""
    d = "/root/testdata/sf0.001"
    assert "办理结束" not in plan_of(indexing.RT14_entity_diff(spark, d))
    assert "text" not in plan_of(retrieval.RT17_evaluation_report(spark, d))


def test_words_of_a_page_are_dealt_once(spark):
    plan = plan_of(parsing.SC25_page_text(spark, "/root/testdata/sf0.001")).split("Initial Plan")[0]
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, ", plan)) == {"page"} and "hashpartitioning(page#" in plan and not re.search(r"hashpartitioning\(page#\d+L?, line", plan)
