import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from provenant import schemas
from provenant.functions import distance
from provenant.operators import anchored, evaluation, logs
from workload import QUERIES

START = datetime(2024, 1, 1)


def brute_windows(events, seconds):
    out, opened, count = {}, {}, {}
    for event, key, at in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        if key not in opened or at >= opened[key] + timedelta(seconds=seconds):
            opened[key], count[key] = at, 0
        count[key] += 1
        out[event] = (opened[key], count[key])
    return out


@pytest.mark.parametrize("seconds,slab", [(60, 60), (60, 600), (7, 61), (3000, None)])
def test_anchored_windows_with_a_hot_key(spark, seconds, slab):
    """One key has a third of all events, dense and without a pause; slabs are cut small."""
    rng = random.Random(seconds)
    events = []
    for i in range(1500):
        hot = i % 3 == 0
        events.append((i, "hot" if hot else f"k{rng.randint(0, 20)}", START + timedelta(seconds=(i * 2 if hot else rng.randint(0, 9000)), microseconds=rng.choice([0, 0, 999_999]))))
    frame = spark.createDataFrame(events, "id int, k string, at timestamp")
    want = brute_windows(events, seconds)
    got = anchored.anchored_window(frame, "k", "at", seconds, 3, "id", slab).collect()
    assert {r.id: (r.window_start, r.n_in_window) for r in got} == want
    assert all(r.flagged == (r.n_in_window > 3) for r in got)
    replay = anchored.cache_replay(frame, "k", "at", "id", seconds, slab).collect()
    assert {r.id: r.hit for r in replay} == {i: n > 1 for i, (_, n) in want.items()}


def test_metrics_of_an_empty_log(spark):
    row = logs.metrics(spark.createDataFrame([], schemas.QUERIES), F.lit("2024-01-02").cast("timestamp")).collect()[0]
    assert (row.total, row.decline_rate, row.cache_hit_rate, row.p95_latency_ms, row.daily_spend_usd) == (0, 0.0, 0.0, None, 0.0)


def test_thread_page(spark):
    rows = [("1", "t1", "first", START, "bn"), ("2", "t1", "second", START + timedelta(1), "en"), ("3", "", "x", START, "en"), ("4", None, "y", START, "en"), ("5", "t2", "z", START + timedelta(2), "bn")]
    log = spark.createDataFrame(rows, "id string, correlation_id string, query_text string, created_at timestamp, detected_language string")
    page = logs.threads(log).collect()
    assert [(r.thread_id, r.first_question, r.message_count, r.detected_language) for r in page] == [("t2", "z", 1, "bn"), ("t1", "first", 2, "en")]
    assert [r.thread_id for r in logs.threads(log, 1, 1).collect()] == ["t1"] and logs.thread_count(log).collect()[0].total == 2
    ratings = spark.createDataFrame([("f", "1", "helpful", START), ("g", "1", "not_helpful", START + timedelta(1))], "id string, query_id string, rating string, created_at timestamp")
    assert [(r.id, r.feedback_rating) for r in logs.thread_messages(log, ratings, "t1", latest_only=True).collect()] == [("1", "not_helpful"), ("2", None)]
    assert logs.thread_messages(log, ratings, "t1").count() == 3


def pairs(spark, rows):
    return spark.createDataFrame(rows, "act_slug string, language string, expected_section string, should_decline boolean, reference_summary string, "
                                       "detected_language string, declined boolean, retrieved_sections array<string>, answer string")


def test_metrics_by_hand(spark):
    rows = [("a", "en", "1", False, "abcd", "en", False, ["1", "2"], "abcd"), ("a", "en", "5", False, None, "bn", True, ["1", "2", "3", "4", "5", "6"], ""),
            (None, "bn", "6", False, "abcd", "bn", False, ["1", "2", "3", "4", "5", "6"], "wxyz"), ("b", "bn", "1", True, "x", "bn", True, [], ""), ("b", "bn", None, False, None, "mixed", False, [], "x")]
    row = evaluation.metrics(pairs(spark, rows)).collect()[0]
    assert row.section_citation_accuracy == pytest.approx(1 / 3) and row.context_recall_at_5 == pytest.approx(2 / 3)
    assert row.language_routing_accuracy == pytest.approx(3 / 5) and row.decline_accuracy == pytest.approx(4 / 5)
    assert row.answer_edit_distance == pytest.approx(0.5) and row.n == 5
    slices = {(r.slice_by, r.slice): r.n for r in evaluation.breakdown(pairs(spark, rows)).collect()}
    assert slices == {("act", "a"): 2, ("act", "b"): 2, ("act", "__no_act__"): 1, ("language", "en"): 2, ("language", "bn"): 3, ("all", "all"): 5}
    empty = evaluation.metrics(pairs(spark, [])).collect()[0]
    assert (empty.section_citation_accuracy, empty.context_recall_at_5, empty.language_routing_accuracy, empty.decline_accuracy, empty.answer_edit_distance) == (1.0, 1.0, 1.0, 1.0, 0.0)


def test_gate(spark):
    measured = spark.createDataFrame([(0.85, 0.95)], "section_citation_accuracy double, language_routing_accuracy double")
    rows = {r.metric: (r.passed, r.all_passed) for r in evaluation.gate(measured).collect()}
    assert rows == {"section_citation_accuracy": (True, False), "language_routing_accuracy": (True, False), "decline_accuracy": (False, False)}


def test_percentiles_by_selection(spark):
    """A group holds most rows, a third of them equal; another has far outliers, one a single row, one only nulls."""
    rng = random.Random(4)
    rows = [("hot", float(rng.randint(0, 50_000)) if i % 3 else 777.0) for i in range(4000)] + [("far", 10.0 ** rng.randint(-6, 9)) for _ in range(300)] + \
        [("one", 5.5), ("none", None), ("two", -1.0), ("two", 4.0), (None, 2.0), (None, 3.0), (None, None)] + [("same", 1.25)] * 50
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5).withColumn("_n", F.lit("clash"))
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {r.g: r.p for r in frame.groupBy("g").agg(F.percentile("v", share).alias("p")).collect() if r.p is not None}
        for ranges, passes in ((1024, 2), (3, 1), (2, 4)):
            got = {r.g: r.percentile for r in logs.percentile(frame, "v", share, ["g"], ranges, passes).collect()}
            assert got == pytest.approx(want)
        whole = logs.percentile(frame, "v", share).collect()
        assert [r.percentile for r in whole] == pytest.approx([frame.agg(F.percentile("v", share)).first()[0]])
    assert logs.percentile(frame.limit(0), "v", 0.95).count() == 0
    assert "Percentile" not in logs.percentile(frame, "v", 0.95, ["g"])._jdf.queryExecution().toString().replace("percentile", "")


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abé日🎉", max_size=30), st.text(alphabet="abé日🎉", max_size=30), st.integers(0, 30), st.sampled_from([1, 2, 64]))
def test_distance_matches_the_table(a, b, keep, band):
    distance.FIRST_BAND = band
    try:
        for x, y in ((a, b), (a, a[:keep] + b + a[keep:]), (a + b * 3, b + a)):
            assert distance.distance(x, y) == distance.distance(y, x) == plain_distance(x, y)
    finally:
        distance.FIRST_BAND = 64


def test_distance_of_long_texts(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=60_000))
    rows = [(1, text, text[:100] + text[120:50_000] + "zz" + text[50_000:]), (2, text, None), (3, "", ""), (4, "abc", ""), (5, None, None)]
    found = spark.createDataFrame(rows, "id int, a string, b string").select("id", distance.edit_distance("a", "b").alias("d"), evaluation.similarity(F.col("a"), F.col("b")).alias("s"))
    got = {r.id: (r.d, r.s) for r in found.collect()}
    assert got[1][0] == 22 and got[2][0] is None and got[3] == (0, 1.0) and got[4] == (3, 0.0) and got[5][0] is None


def test_evaluation_queries_read_whole_texts(spark, tmp_path):
    texts = ["Same start, " * 30 + "and an end.", "short", None, "", "Ünï 123  code " * 9, "9"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.distance, r.ratio) for r in QUERIES["edit_ratios"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i][0] is None
            continue
        clean = re.sub(r"[0-9\s]+", " ", text.lower())
        d = plain_distance(text, clean)
        assert got[i] == (d, pytest.approx(1 - d / max(1, len(text), len(clean)), abs=1e-9))
    turns = [(c, t, role, f"turn {t} of {c}: " + "words and " * (c + t) + "more.") for c in range(5) for t, role in ((0, "system"), (1, "user"), (2, "assistant"), (3, "user"))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = QUERIES["evaluation_metrics"](spark, str(tmp_path)).collect()[0]
    own = [plain_distance(x, x[10:] + x[:10]) / len(x) for _, t, role, x in turns if t % 2 and role != "system" and len(x) % 4]
    assert row.answer_edit_distance == pytest.approx(sum(own) / len(own), abs=1e-9) and row.n == len(turns)
