"""Rankings, top items and frequencies."""

import math
from datetime import datetime

import numpy as np
import pytest
from phraselode.llm import borda, frequency, topk

RESULTS = "experiment string, topic string, result_id bigint, a double, b double, loaded_at timestamp, n_items string, points string, _g string"


def results(spark, rows):
    return spark.createDataFrame([(*r[:5], datetime(2024, 1, r[5]) if len(r) > 5 else datetime(2024, 1, 1), "x", "x", "x") for r in rows], RESULTS)


def points(spark, rows, **how):
    out = borda.borda_points(results(spark, rows), ["experiment", "topic"], "result_id", "loaded_at", ["a", "b"], **how)
    return {r.result_id: (r.n_items, round(r.points, 9)) for r in out.collect()}


def test_ties_missing_scores_and_redelivery(spark):
    rows = [
        ("e", "t", 1, 1e9, 0.3),
        ("e", "t", 2, 5.0, 0.3),
        ("e", "t", 3, None, 0.1),
        ("e", "t", 4, math.nan, 0.2),
        ("e", "t", 2, -5.0, 0.0),  # delivered again, earlier than below
        ("e", "t", 2, 5.0, 0.3, 2),
        ("e", "t", None, 5.0, 0.3),
        (None, None, 9, 1.0, None),
    ]
    got = points(spark, rows)
    assert got == {1: (4, 0.75 + 0.75), 2: (4, 0.25 + 0.75), 3: (4, 0.5 + 0.125), 4: (4, 0.5 + 0.375), 9: (1, 1.0)}
    assert points(spark, rows, weights={"a": 0.0})[1] == (4, 0.75)


def test_hot_groups_equal_ordinary_ones(spark):
    rng = np.random.default_rng(1)
    rows = [("e", "hot" if i % 3 else f"t{i % 7}", i, float(rng.integers(0, 90)), float(rng.normal())) for i in range(600)]
    assert points(spark, rows) == points(spark, rows, hot_rows=20)


def test_leaders(spark):
    rows = [("e", "t", i, float(i // 2), float(i // 2)) for i in range(10)]
    p = borda.borda_points(results(spark, rows), ["experiment", "topic"], "result_id", "loaded_at", ["a", "b"])
    assert [r.result_id for r in borda.borda_leaders(p, ["experiment", "topic"], "result_id", 3).orderBy("place").collect()] == [8, 9, 6]
    assert borda.borda_leaders(p, ["experiment", "topic"], "result_id", 3, least=11).count() == 0
    assert borda.borda_points(results(spark, []), ["experiment", "topic"], "result_id", "loaded_at", ["a", "b"]).count() == 0


def test_top_items(spark):
    schema = "id bigint, g string, item string, s double, at timestamp, place int, _row string"
    at = datetime(2024, 1, 1)
    rows = [(1, "x", "b", 2.0, at, 0, ""), (2, "x", "a", 2.0, at, 0, ""), (2, "x", "a", 2.0, datetime(2024, 2, 1), 0, ""), (3, "x", None, 2.0, at, 0, ""), (4, "x", "A", 2.0, at, 0, ""), (5, "x", "z", math.nan, at, 0, ""), (6, "x", "z", None, at, 0, ""), (7, None, "z", -1.0, at, 0, ""), (None, "x", "z", 9.0, at, 0, ""), (8, "x", "b", 2.0, at, 0, "")]
    df = spark.createDataFrame(rows, schema)
    got = topk.top_items(df, ["g"], "s", "item", "id", "at", 4).orderBy("g", "place").collect()
    assert [(r.g, r.id) for r in got] == [(None, 7), ("x", 4), ("x", 2), ("x", 1), ("x", 8)]
    assert topk.top_items(df.limit(0), ["g"], "s", "item", "id", "at", 4).count() == 0


def test_group_limit_prunes_before_the_shuffle(spark, sf):
    from phraselode.llm.queries import p4_found

    plan = p4_found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_term_counts(spark):
    schema = "topic string, doc string, candidate string, n int, term string, _t string, id int"
    rows = [("t", "d1", "a", 2), ("t", "d1", "a", 2), ("t", "d1", "a", 3), ("t", "d2", "a", 1), ("t", "d2", "A", 1), ("t", "d3", "a", 0), ("t", "d3", "b", None), ("t", "d3", None, 4), (None, None, "a", 7), (None, None, "a", 7), ("t", "d4", "", 1)]
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], schema)
    got = {r.term: (r.total, r.n_docs) for r in frequency.term_counts(df, "candidate", "n", ["topic", "doc"]).collect()}
    assert got == {"a": (5 + 1 + 7, 3), "A": (1, 1), "": (1, 1)}
    assert frequency.record_count(df, "candidate", "n", ["topic", "doc"]) == 4
    assert frequency.term_counts(df.limit(0), "candidate", "n", ["topic", "doc"]).count() == 0


def test_marks_can_both_hold(spark):
    counts = spark.createDataFrame([("a", 5, 3), ("b", 1, 1), ("c", 9, 40), ("d", 9, 2)], "term string, total bigint, n_docs bigint")
    got = sorted((r.term, r.mark) for r in frequency.marked(counts, 15).collect() if r.mark)
    assert got == [("a", "common"), ("b", "rare"), ("c", "common"), ("d", "common"), ("d", "rare")]


@pytest.mark.parametrize("ranges", [4, 64])
def test_many_terms_over_many_ranges(spark, ranges, monkeypatch):
    monkeypatch.setattr(frequency, "RANGE", ranges)
    monkeypatch.setattr(frequency, "HELD", 2)
    df = spark.range(3000).selectExpr("'t' AS topic", "cast(id % 50 AS string) AS doc", "cast(id % 701 AS string) AS candidate", "1 + cast(id % 3 AS int) AS n").repartition(5)
    got = {r.term: (r.total, r.n_docs) for r in frequency.term_counts(df, "candidate", "n", ["topic", "doc"]).collect()}
    p = df.toPandas().drop_duplicates()
    want = p.groupby("candidate").agg(total=("n", "sum"), n_docs=("doc", "nunique"))
    assert got == {t: (int(r.total), int(r.n_docs)) for t, r in want.iterrows()}
