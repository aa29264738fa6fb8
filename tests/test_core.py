"""The engine's operators: fixtures with known values, brute force, properties, and the two paths of matrix operators."""

import importlib
import math
import sys
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from phraselode.functions import stem, text, vectors
from phraselode.functions.geodesic import haversine_km, vincenty_km
from phraselode.functions.keys import dealt, hot_keys, lookup, null_safe_key, spread_lookup
from phraselode.operators import blocks, chunking, embedding, evaluate, far, geo, masking, nearby, rank_doc, rank_matrix, rank_topic
from phraselode.operators.ranking import count_above
from pyspark.sql import functions as F

BOSTON, NEW_YORK, LISBON, TOKYO = (42.3541165, -71.0693514), (40.7791472, -73.9680804), (38.7223, -9.1393), (35.6762, 139.6503)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Keys and counts.


def test_null_safe_key(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "-"), ("a-", ""), ("1:a", None), (None, None), ("a", "")], "x string, y string")
    assert df.select(null_safe_key("x", "y").alias("k")).distinct().count() == 7


def test_lookup_of_hot_keys_equals_a_join(spark):
    left = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    assert rows(lookup(left, groups, ["k"], "n", 50), "id") == rows(lookup(left, groups, ["k"], "n"), "id")
    assert lookup(left, groups, ["k"], "n", 50).count() == 500


def shuffled_rows(df) -> int:
    """How many rows all shuffles of a query write."""
    conf, names = df.sparkSession.conf, ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    kept = [conf.get(n) for n in names]
    for n, v in zip(names, ("false", "-1")):
        conf.set(n, v)
    try:
        df.collect()
        total, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return total
    finally:
        for n, v in zip(names, kept):
            conf.set(n, v)


def test_rows_of_hot_keys_do_not_go_through_the_shuffle(spark):
    left = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") < 39_000, 0).otherwise(F.col("id") % 400).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert shuffled_rows(lookup(left, groups, ["k"], "n", 1000)) < 5_000 < 39_000 < shuffled_rows(lookup(left, groups, ["k"], "n"))
    # Where the other side is too large to broadcast, a hot key's rows are dealt out.
    spread = spread_lookup(left, groups.withColumn("name", F.col("k")), ["k"], "n", 1000)
    assert rows(spread.select("k", "id"), "id") == rows(left, "id")
    turns = dealt(left, hot_keys(groups, ["k"], "n", 1000), ["k"]).groupBy("k", "_turn").count()
    assert turns.agg(F.max("count")).first()[0] <= 1100 and turns.filter("k = 0").count() == 40


@pytest.mark.parametrize("hot", [5, 100_000])
def test_count_above(spark, hot):
    rng = np.random.default_rng(0)
    data = [(f"g{i % 2}", float(v), int(c)) for i, (v, c) in enumerate(zip(rng.permutation(60), rng.integers(1, 5, 60)))]
    got = count_above(spark.createDataFrame(data, "g string, v double, c bigint"), "g", "v", "c", hot, 4)
    for g, v, _, above in rows(got.select("g", "v", "c", "above")):
        assert above == sum(c for h, w, c in data if h == g and w > v)


# Text.


def test_cleaning(spark):
    t = "A-b.c  (d)\n\te p f"
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    out = df.select(text.remove_punctuation(F.col("t")), text.remove_hyphens_and_dots(F.col("t")), text.remove_line_breaks(F.col("t")), text.squeeze(F.col("t")), text.truncate_words(F.col("t"), 2)).collect()
    assert tuple(out[0]) == ("A b c   d \n\te p f", "A bc  (d)\n\te p f", "A-b.c  (d) e p f", "A-b.c (d) e p f", "A-b.c (d)")
    assert tuple(out[1])[:4] == (None,) * 4 and tuple(out[2]) == ("",) * 5
    assert spark.range(1).select(text.squeeze(F.lit("a 　b"))).first()[0] == "a b"
    assert spark.range(1).select(text.unescape_brackets(F.lit("-LRB-x-RSB-"))).first()[0] == "(x]"
    phrases = spark.createDataFrame([("  The Fast-track.\n",), ("'",), (None,)], "p string")
    assert [r[0] for r in phrases.select(text.clean_phrase(F.col("p"))).collect()] == ["the fast track", None, None]
    assert spark.range(1).select(text.clean_phrase(F.lit("Farmers' tides"), lambda p: F.concat(p, F.lit("'s")))).first()[0] == "farmers tidess"
    free = spark.createDataFrame([("a , b",), ("a, b",), ("a",)], "p string").select(text.has_free_punctuation(F.col("p")))
    assert [r[0] for r in free.collect()] == [True, False, False]


def test_porter():
    pairs = "caresses caress ponies poni agreed agre plastered plaster motoring motor conflated conflat hopping hop filing file happy happi relational relat conditional condit digitizer digit vietnamization vietnam feudalism feudal triplicate triplic electricity electr hopeful hope revival reviv adjustable adjust replacement replac adoption adopt effective effect probate probat controll control"
    words = pairs.split()
    assert [stem.porter(w) for w in words[::2]] == words[1::2]
    assert stem.stem_phrase("Rising Tides", "xx") == "Rising Tides"


def test_replace_words_keeps_equal_rows(spark):
    df = spark.createDataFrame([("Mice ran",), ("Mice ran",), (None,), ("",)], "t string")
    table = spark.createDataFrame([("mice", "mouse"), ("ran", "run")], "word string, lemma string")
    got = [r[0] for r in stem.replace_words(df, "t", table).collect()]
    assert sorted(got, key=str) == ["", None, "mouse run", "mouse run"]


@given(st.lists(st.sampled_from(["NOUN", "PROPN", "ADJ", "VERB"]), max_size=12))
@settings(deadline=None, max_examples=12)
def test_runs_equal_the_grammar(spark, tags):
    import re

    letters = "".join({"NOUN": "N", "PROPN": "N", "ADJ": "A"}.get(t, "-") for t in tags)
    df = spark.createDataFrame([("t", "d", 0, [str(i) for i in range(len(tags))], tags)], "topic string, doc string, sent int, tokens array<string>, tags array<string>")
    assert [(r.start, r.n_tokens) for r in chunking.noun_phrases(df).orderBy("start").collect()] == [(m.start(), len(m.group())) for m in re.finditer("[NA]*N+A*(?:[NA]*N+A*)*", letters)]
    assert [(r.start, r.n_tokens) for r in chunking.prompt_phrases(df).orderBy("start").collect()] == [(m.start(), len(m.group())) for m in re.finditer("[NA]*N", letters)]


def test_candidates(spark):
    docs = spark.createDataFrame([("t", "d", "Big Storm hit. The big storm grew - fast."), ("t", "e", None), (None, "f", "")], "topic string, doc string, text string")
    got = chunking.candidates(chunking.noun_phrases(chunking.tagged(chunking.sentences(docs))), min_len=3)
    found = {r.candidate: r for r in got.collect()}
    assert found["big storm hit"].mentions == ["Big Storm hit"] and found["big storm grew"].first_sent == 1


def test_occurrences_and_masks(spark):
    one = spark.range(1)
    a = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one.select(chunking.occurrences(a(1, 1), a(1, 1, 1, 2, 1, 1))).first()[0] == [0, 1, 4]
    assert one.select(chunking.occurrences(a(1), F.array().cast("array<int>"))).first()[0] == []
    assert one.select(chunking.character_offsets(F.lit("a.b xx A.B a.b"), F.lit("a.b"))).first()[0] == [0, 7, 11]
    assert one.select(masking.mask_first(F.lit("x y x"), F.lit("x")), masking.mask_all(F.lit("x y x"), F.lit("x")), masking.mask_each(F.lit("x y x"), F.lit("x"))).first()[:] == ("<mask> y x", "<mask> y <mask>", ["<mask> y x", "x y <mask>"])


def test_uncovered_spans_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [("t", "d" if i % 3 else None, i, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 30, 80), rng.integers(1, 9, 80)))]
    got = {r.id for r in masking.uncovered_spans(spark.createDataFrame(data, "topic string, doc string, id int, start int, end int"), ["topic", "doc"], "id").collect()}
    known = [d for d in data if d[1]]
    assert got == {i for _, _, i, s, e in known if not any(a <= s and b >= e and b - a > e - s for _, _, _, a, b in known)}


# Vectors and rankings.


def test_pooling(spark):
    v = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-4.0)), F.array(F.lit(9.0), F.lit(9.0)))
    m = F.array(F.lit(1), F.lit(1), F.lit(0))
    assert spark.range(1).select(vectors.pooled(v, m), vectors.pooled(v, m, "max")).first()[:] == ([2.0, -1.0], [3.0, 2.0])


def test_position_bias(spark):
    at = spark.createDataFrame([(10,), (200,)], "s int").select(rank_doc.position_bias(F.lit(0.8), F.col("s"), F.lit(400)))
    assert [round(r[0], 10) for r in at.collect()] == [-0.4239727475, -0.5299659344]
    assert spark.range(1).select(rank_doc.position_bias(F.lit(0.0), F.lit(1), F.lit(400)), rank_doc.position_bias(F.lit(0.5), F.lit(1), F.lit(0))).first()[:] == (None, None)


def test_fusion_of_topics(spark):
    data = [("d1", "a", 0.9), ("d2", "a", 0.7), ("d1", "b", 0.5), ("d3", "b", 0.6), ("d1", "c", 0.1), ("d2", "c", 0.4), ("d3", "c", 0.2)]
    s = spark.createDataFrame([("t", *d) for d in data], "topic string, doc string, candidate string, score double")
    of = lambda df: {r.candidate: round(r.score, 8) for r in df.collect()}
    assert of(rank_topic.aggregate_scores(s, "mean")) == {"a": 0.8, "b": 0.55, "c": 0.23333333}
    assert of(rank_topic.aggregate_scores(s, "max")) == {"a": 0.9, "b": 0.6, "c": 0.4}
    assert of(rank_topic.mean_of_top_half(s)) == {"a": 0.9, "b": 0.6, "c": 0.3}
    assert of(rank_topic.reciprocal_rank_fusion(s)) == {"a": 0.0486599, "b": 0.04839549, "c": 0.04813108}
    assert [r[0] for r in rank_topic.missing_candidates(s, "d2").select("candidate").collect()] == ["b"]


def test_average_rank(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate((1.0, 2.0, 2.0, None, None))], "k string, i int, score double")
    assert [r[0] for r in df.withColumn("r", rank_topic.average_rank(df, ["k"])).orderBy("i").select("r").collect()] == [3, 1.5, 1.5, 4.5, 4.5]


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    data = [("big" if i % 3 else "small", i, [float(x) for x in rng.normal(0.4, 1, 6)]) for i in range(60)]
    return spark.createDataFrame(data, "topic string, id bigint, vec array<double>").cache()


def rounded(df, *order):
    return [tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows(df, *order)]


def _affinity(items, **how):
    return rank_matrix.affinity_ranking(items, **how)


def _eigen(items, **how):
    return rank_matrix.eigen_centrality(items, **how)


def _co_ranking(items, **how):
    docs = items.select("topic", "id", F.array(F.col("id") % 5, F.col("id") % 7 + 10).alias("docs"))
    return rank_matrix.co_ranking(items, docs, **how)


@pytest.mark.parametrize("rank", [_affinity, _eigen, _co_ranking])
def test_large_topics_rank_like_small_ones(items, rank):
    a, b = (sorted((r.topic, r.id, r.score) for r in rank(items, local=n, steps=2).collect()) for n in (2048, 25))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-9)
    assert math.isclose(sum(x[2] for x in a), 2, abs_tol=1e-6)


def test_affinity_equals_the_matrix():
    u = blocks.units(np.random.default_rng(3).normal(0.3, 1, (30, 5)))
    m = u @ u.T - np.eye(30)
    whole = sum(0.9 ** (t - 1) * np.linalg.matrix_power(m, t) for t in range(1, 6))
    q, c = rank_matrix.power_sum(u.T @ u, 0.9, 5)
    assert np.allclose(u @ q @ u.T + c * np.eye(30), whole)
    assert np.allclose(rank_matrix._row_scale(u, q, c, u.T @ u), 1 / np.linalg.norm(whole, axis=1))


def test_mmr_paths_agree(items):
    a, b = rank_matrix.mmr(items, 5), rank_matrix.mmr(items, 5, local=25)
    assert rounded(a.select("topic", "place", "id"), "topic", "place") == rounded(b.select("topic", "place", "id"), "topic", "place")


def test_whitening_paths_agree(items):
    a, b = (sorted((r.id, *np.round(r.vec, 6)) for r in rank_matrix.whitened(items, n).collect()) for n in (99, 25))
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-5)


@pytest.mark.parametrize("size", [7, 1024])
def test_blocks_equal_brute_force(items, size):
    got = {(r.topic, r.id): (r.mean, r.most) for r in rank_topic.similarity_to_documents(items, items).collect()}
    small = blocks.pairwise(items, None, "topic", "id", rank_topic._similarity(None), "id bigint, total double, most double, above bigint, n bigint", size=size)
    small = {(r.topic, r.id): (r.t / r.n, r.m) for r in small.groupBy("topic", "id").agg(F.sum("total").alias("t"), F.sum("n").alias("n"), F.max("most").alias("m")).collect()}
    data = items.collect()
    for r in data:
        cos = [np.dot(r.vec, o.vec) / np.linalg.norm(r.vec) / np.linalg.norm(o.vec) for o in data if o.topic == r.topic]
        for found in (got, small):
            assert np.allclose(found[r.topic, r.id], (np.mean(cos), max(cos)))


def test_least_alike():
    rng = np.random.default_rng(1)
    u = blocks.units(rng.normal(size=(9, 4)))
    exact, said = rank_matrix.least_alike(u @ u.T, 3)
    greedy, also = rank_matrix.least_alike(u @ u.T, 3, exact=5)
    cost = lambda c: (u @ u.T)[np.ix_(c, c)].sum()
    assert said and not also and cost(exact) <= cost(greedy) + 1e-12


def test_least_alike_is_exact_for_ten_of_thirty(spark):
    rng = np.random.default_rng(2)
    for m, n in ((9, 3), (14, 6), (22, 4)):
        u = blocks.units(rng.normal(size=(m, 4)))
        got, said = rank_matrix.least_alike(sim := u @ u.T, n)
        cost = lambda c: sim[np.ix_(c, c)].sum()
        assert said and abs(cost(got) - min(cost(c) for c in combinations(range(m), n))) < 1e-9
    data = [("t", i, [float(x) for x in rng.normal(0.3, 1, 8)]) for i in range(40)]
    got = rank_matrix.max_sum(spark.createDataFrame(data, "topic string, id bigint, vec array<double>")).collect()
    assert len(got) == 10 and all(r.exact for r in got)


def test_clusters(spark):
    sim = np.eye(6)
    for i, j in ((0, 1), (1, 2), (3, 4)):
        sim[i, j] = sim[j, i] = 0.9
    assert rank_matrix.density_clusters(sim, 0.5).tolist() == [0, 0, 0, 1, 1, -1]
    data = [("t", i, [1.0, 0.01 * i]) for i in range(8)] + [("t", 10 + i, [0.01 * i, 1.0]) for i in range(4)]
    df = spark.createDataFrame(data, "topic string, id bigint, vec array<double>")
    whole = rank_matrix.cluster_medoids(df, 0.5)
    assert sorted(r.n for r in whole.collect()) == [4, 8] and sum(r.n for r in rank_matrix.cluster_medoids(df, 0.5, most=10).collect()) == 12


def test_clusters_of_large_topics(spark, monkeypatch):
    monkeypatch.setattr(rank_matrix, "pairwise", partial(blocks.pairwise, size=16))
    rng = np.random.default_rng(4)
    centres = blocks.units(rng.normal(size=(4, 6)))
    points = [c + rng.normal(0, 0.12, 6) for k, c in enumerate(centres) for _ in range((40, 25, 9, 5)[k])] + list(rng.normal(size=(12, 6)))
    data = [("t", 1000 - 7 * i, [float(x) for x in p]) for i, p in enumerate(points)] + [("u", i, [1.0, i / 9, 0.0, 0.0, 0.0, 0.0]) for i in range(5)]
    df = spark.createDataFrame(data, "topic string, id bigint, vec array<double>")
    for args in ((0.9, 2, 0), (0.85, 4, 0), (0.999, 3, 2)):
        whole = sorted(rank_matrix.cluster_medoids(df, *args).collect())
        assert sorted(rank_matrix.cluster_medoids(df, *args, most=20).collect()) == whole and len(whole) > 3, args


def test_fusion_of_models(spark):
    schema = "topic string, doc string, candidate string, score double"
    a = spark.createDataFrame([("t", "d", "x", 3.0), ("t", "d", "y", 1.0), (None, "e", "z", 2.0)], schema)
    b = spark.createDataFrame([("t", "d", "x", 1.0), ("t", "d", "w", 0.0)], schema)
    got = {r.candidate: r.score for r in rank_doc.fuse_weighted([(a, 0.5), (b, 0.5)], ["topic", "doc"]).collect()}
    assert got == {"x": 0.375 + 0.5, "y": 0.125, "w": 0.0, "z": 0.5}
    assert [(r.candidate, r.score) for r in rank_doc.fuse_harmonic(a, b, ["topic", "doc"]).collect()] == [("x", 1.5)]


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "storm surge"), (2, "storm surges"), (3, "rail tunnel"), (4, None), (5, "")], "id int, t string")
    v = {r.id: r.v for r in docs.select("id", embedding.embed(F.col("t")).alias("v")).collect()}
    assert v[4] is None and len(v[5]) == 64 and np.dot(v[1], v[2]) > 0.7 > np.dot(v[1], v[3])
    attention = spark.range(1).select(embedding.global_attention(F.lit(5), F.array(F.lit(1)), 3)).first()[0]
    assert attention == [1, 1, 0, 1, 0]


def test_in_context_falls_back(spark):
    keys = ["topic", "doc"]
    tokens = spark.createDataFrame([("t", "d", i, [float(i), 1.0]) for i in range(4)], "topic string, doc string, tok int, vec array<double>")
    spans = spark.createDataFrame([("t", "d", "a", 0, 2), ("t", "d", "a", 2, 1)], "topic string, doc string, candidate string, start int, n int")
    out = spark.createDataFrame([("t", "d", "a", [9.0, 9.0]), ("t", "d", "b", [7.0, 7.0])], "topic string, doc string, candidate string, vec array<double>")
    assert {r.candidate: r.vec for r in embedding.embed_in_context(spans, tokens, keys, out).collect()} == {"a": [1.25, 1.0], "b": [7.0, 7.0]}
    edges = {r.candidate: r.vec for r in embedding.embed_in_context(spans, tokens, keys, out, edges=True).collect()}
    assert edges["a"] == [(4 / 4 + 5 / 3) / 2, 1.0]


# Places.


def test_distances():
    got = [float(vincenty_km(*a, *b)) for a, b in ((BOSTON, NEW_YORK), (BOSTON, LISBON), (NEW_YORK, LISBON), (BOSTON, TOKYO))]
    assert np.round(got, 6).tolist() == [298.396057, 5144.856457, 5429.929765, 10818.440795]
    assert np.isnan(vincenty_km(0.0, 0.0, 0.5, 179.7)) and vincenty_km(1.0, 2.0, 1.0, 2.0) == 0
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-80, 80, (2, 200)), rng.uniform(-180, 180, (2, 200))
    assert np.nanmax(np.abs(vincenty_km(a[0], b[0], a[1], b[1]) / haversine_km(a[0], b[0], a[1], b[1]) - 1)) < 0.006


def points(spark, scores, places=(BOSTON, NEW_YORK, LISBON)):
    return spark.createDataFrame([("t", "c", *p, x) for p, x in zip(places, scores)], "topic string, candidate string, lat double, lon double, x double")


def test_association(spark):
    r = geo.association(points(spark, (0.9, 0.8, 0.2))).first()
    assert np.allclose((r.moran_i, r.geary_c, r.getisord_g), (-0.13675614709891, 0.63675614709894, 0.40910890695201), atol=1e-9)
    assert math.isclose(geo.association(points(spark, (0.9, 0.8, 0.2)), decay="exp", a=1 / 1700).first().moran_i, -0.07322224354555, abs_tol=1e-9)
    r = geo.association(points(spark, (0.5, 0.5, 0.5))).first()
    assert (r.moran_i, r.geary_c) == (1.0, 0.0) and r.getisord_g is not None
    r = geo.association(points(spark, (0.5,))).first()
    assert r.n_points == 1 and r.moran_i is None and r.geary_c is None and r.getisord_g is None
    assert geo.association(points(spark, (math.nan, None, 0.5))).first().n_points == 1
    assert geo.association(points(spark, ())).count() == 0


def test_association_is_invariant(spark):
    rng = np.random.default_rng(2)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-60, 60, 30), rng.uniform(-170, 170, 30))]
    x = rng.normal(size=30)
    first = geo.association(points(spark, [float(v) for v in x], places), distance="haversine").first()
    moved = geo.association(points(spark, [float(3 * v + 7) for v in x], places[:], ), distance="haversine").first()
    scaled = geo.association(points(spark, [float(3 * v) for v in x], places), distance="haversine").first()
    assert np.allclose((first.moran_i, first.geary_c), (moved.moran_i, moved.geary_c)) and math.isclose(first.getisord_g, scaled.getisord_g)


def test_association_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-60, 60, 90), rng.uniform(-170, 170, 90))]
    df = points(spark, [float(v) for v in rng.normal(size=90)], places)
    whole = geo.association(df).first()
    real = blocks.pairwise
    monkeypatch.setattr(geo, "pairwise", lambda *a, **k: real(*a, **{**k, "size": 16}))
    assert np.allclose(whole[3:], geo.association(df).first()[3:])


def test_far_pairs_are_interpolated():
    """the sums of all pairs, with a third of their weights computed at most, and those near antipodes as they are."""
    rng = np.random.default_rng(6)
    n, computed = 16_000, []
    lat, lon, x = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), rng.gamma(2, 3, n)
    lat[:2000], lon[:2000] = rng.normal(48, 3, 2000), rng.normal(10, 3, 2000)
    lat[2000:2400], lon[2000:2400] = rng.normal(-48, 1, 400), rng.normal(-170, 1, 400)
    values = np.stack([np.ones(n), x, x * x], 1)

    def weight(*at):
        w = 1 / (500 + haversine_km(*at))
        computed.append(w.size)
        return w

    own, _ = far.weighted_sums((lat, lon, values), None, weight)
    assert sum(computed) < n * n / 3
    some = np.arange(0, n, 97)
    want = weight(lat[some, None], lon[some, None], lat, lon) @ values - values[some] / 500
    assert np.allclose(own[some], want, rtol=2e-7)
    parts = [(lat[k::2], lon[k::2], values[k::2]) for k in (0, 1)]
    a, b = far.weighted_sums(*parts, weight)
    for (to, got) in ((parts[0], a), (parts[1], b)):
        of = parts[1] if got is a else parts[0]
        assert np.allclose(got[:50], weight(to[0][:50, None], to[1][:50, None], of[0], of[1]) @ of[2], rtol=2e-7)
    few = (lat[:300], lon[:300], values[:300])
    w = np.nan_to_num(1 / (500 + vincenty_km(few[0][:, None], few[1][:, None], few[0], few[1])))
    assert np.allclose(far.weighted_sums(few, None, lambda *at: np.nan_to_num(1 / (500 + vincenty_km(*at))), include_self=True)[0], w @ few[2])


@pytest.mark.parametrize("how", [{}, {"include_self": True}, {"decay": "arccot", "a": 0.01}, {"decay": "exp", "a": 1 / 1700}])
def test_association_in_places(spark, monkeypatch, how):
    """blocks of points that lie together and groups of one block give what all pairs give."""
    rng = np.random.default_rng(7)
    places = [(float(a), float(b)) for a, b in zip(np.r_[rng.uniform(-85, 85, 150), rng.normal(50, 0.1, 150)], np.r_[rng.uniform(-180, 180, 150), rng.normal(10, 0.1, 150)])]
    x = rng.normal(size=300)
    df = points(spark, [float(v) for v in x], places)
    lat, lon = np.array(places).T
    w = np.nan_to_num(geo.DECAYS[how.get("decay", "inv")](vincenty_km(lat[:, None], lon[:, None], lat, lon), how.get("a", 500.0)))
    if not how.get("include_self"):
        np.fill_diagonal(w, 0)
    w /= w.sum(axis=1, keepdims=True)
    z = x - x.mean()
    want = (z @ w @ z / (z @ z), 299 * (w * (x[:, None] - x) ** 2).sum() / (2 * w.sum() * (z @ z)), x @ w @ x / x.sum() ** 2)
    for size in (geo.FAR_BLOCK, 40):
        monkeypatch.setattr(geo, "FAR_BLOCK", size)
        assert np.allclose(geo.association(df, **how).first()[3:], want, atol=1e-9)
    items = geo._by_place(df.select(F.lit("g").alias("_g"), F.xxhash64("lat", "lon", "x").alias("id"), "lat", "lon", "x"), 40)[1].collect()
    block = np.floor(np.array([r._order for r in items]) * 8)
    assert len(items) == 300 and block.min() == 0 and block.max() == 7 and np.bincount(block.astype(int)).max() < 60
    inside = [r for r in items if abs(r.lat - 50) < 1 and abs(r.lon - 10) < 1]
    assert len({int(r._order * 8) for r in inside}) <= 5


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([("t", i, *p) for i, p in enumerate((BOSTON, NEW_YORK, LISBON, TOKYO))], "topic string, id bigint, lat double, lon double")
    sums = geo.weight_table(df, ["topic"]).groupBy("i").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 4 and all(math.isclose(r.w, 1) for r in sums)


@pytest.mark.parametrize("how", [{"decay": "arccot", "a": 0.01}, {"decay": "exp", "a": 1 / 1700}, {"decay": "exp", "a": 1 / 500, "include_self": True}, {"a": 500.0}])
def test_weights_are_not_shuffled(spark, monkeypatch, how):
    """F1 to F4: points travel, the cells of their matrix don't, in one block or several and whatever is held back."""
    rng = np.random.default_rng(5)
    lat, lon = rng.uniform(-60, 60, 150), rng.uniform(-170, 170, 150)
    df = spark.createDataFrame([("t", i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "topic string, id bigint, lat double, lon double")
    w = geo.DECAYS[how.get("decay", "inv")](haversine_km(lat[:, None], lon[:, None], lat, lon), how["a"])
    if "include_self" not in how:
        np.fill_diagonal(w, 0)
    w = np.round(w / w.sum(axis=1, keepdims=True), 9)
    for size in (geo.TABLE_BLOCK, 40):
        monkeypatch.setattr(geo, "TABLE_BLOCK", size)
        table = geo.weight_table(df, ["topic"], places=9, **how)
        got = np.zeros((150, 150))
        for r in table.collect():
            assert r.w > 0
            got[r.i, r.j] += r.w
        assert np.allclose(got, w, rtol=0, atol=1.01e-9)
        assert shuffled_rows(table) < 150 * 20 < (w > 0).sum()


@pytest.mark.parametrize("how", [{"decay": "arccot", "a": 0.01}, {"decay": "exp", "a": 1 / 1700}])
def test_weights_are_written_in_few_bytes(spark, tmp_path, how):
    """cells that share a weight are written together, and are the same cells."""
    rng = np.random.default_rng(6)
    lat, lon = rng.uniform(-60, 60, 1500), rng.uniform(-170, 170, 1500)
    df = spark.createDataFrame([("t", i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "topic string, id bigint, lat double, lon double")
    geo.weight_table(df, ["topic"], places=8, keyed=False, **how).write.parquet(str(tmp_path / "w"))
    w = geo.DECAYS[how["decay"]](haversine_km(lat[:, None], lon[:, None], lat, lon), how["a"])
    np.fill_diagonal(w, 0)
    w = np.round(w / w.sum(axis=1, keepdims=True), 8)
    got = pq.read_table(tmp_path / "w")
    i, j, of = (got[c].to_numpy() for c in "ijw")
    assert len(i) == len(np.unique(i * 1500 + j)) and abs(len(i) - np.count_nonzero(w)) < 100
    assert np.allclose(w[i, j], of, rtol=0, atol=1.01e-8)
    assert sum(f.stat().st_size for f in (tmp_path / "w").glob("*.parquet")) < 6.5 * len(i)


@pytest.mark.parametrize("size, held", [(2048, 1 << 22), (600, 20_000)])
def test_common_weights_are_written_by_dictionary(spark, tmp_path, monkeypatch, size, held):
    """most weights take a dictionary's bits and their points next to nothing; cells held back, once or again and again, are all there."""
    monkeypatch.setattr(geo, "TABLE_BLOCK", size)
    monkeypatch.setattr(geo, "CELLS_HELD", held)
    rng = np.random.default_rng(7)
    lat, lon = rng.uniform(-60, 60, 1501), rng.uniform(-170, 170, 1501)
    df = spark.createDataFrame([("t", i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "topic string, id bigint, lat double, lon double")
    geo.weight_table(df, ["topic"], places=8, keyed=False, decay="exp", a=1 / 1200).write.parquet(str(tmp_path / "w"))
    w = np.exp(-haversine_km(lat[:, None], lon[:, None], lat, lon) / 1200)
    np.fill_diagonal(w, 0)
    w = w / w.sum(axis=1, keepdims=True)
    got = pq.read_table(tmp_path / "w")
    i, j, of = (got[c].to_numpy() for c in "ijw")
    assert len(np.unique(i * 1501 + j)) == len(i) and (i != j).all() and (of > 0).all()
    assert np.allclose(w[i, j], of, rtol=0, atol=0.51e-8)
    assert np.count_nonzero(w > 0.51e-8) <= len(i) <= np.count_nonzero(w > 0.49e-8)
    if size == 2048:
        assert sum(f.stat().st_size for f in (tmp_path / "w").glob("*.parquet")) < 3.7 * len(i)


@pytest.mark.parametrize("local", [2048, 16])
def test_hsic(spark, local):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(40, 2))
    y = p[:, 0] ** 2 + 0.1 * rng.normal(size=40)
    data = [("t", i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(p, y))] + [("t", 99, math.nan, 1.0, 1.0), ("t", 98, None, 1.0, 1.0)]
    r = geo.hsic(spark.createDataFrame(data, "topic string, id bigint, lat double, lon double, x double"), ["topic"], "id", ["lat", "lon"], ["x"], local).first()

    def kernel(v):
        d = geo._squares(v, v)
        return np.exp(-d / np.median(d[d > 0]))

    h = np.eye(40) - 1 / 40
    assert r.n == 40 and math.isclose(r.hsic, np.trace(h @ kernel(p) @ h @ h @ kernel(y[:, None]) @ h) / 1600, rel_tol=1e-9 if local > 40 else 1e-2)


def test_near_pairs(spark):
    data = [(1, 89.999, 0.0), (2, 89.999, 180.0), (3, 0.0, 179.9999), (4, 0.0, -179.9999), (5, 10.0, 10.0), (6, 10.0, 10.0), (5, 10.0, 10.0), (7, 10.0, 10.02), (None, 10.0, 10.0), (8, None, 1.0), (9, -90.0, 5.0), (10, -89.995, -170.0)]
    df = spark.createDataFrame(data, "loc_id bigint, lat double, lon double")
    got = sorted({(r.first_id, r.second_id) for r in nearby.near_pairs(df, "loc_id", 1.0).collect()})
    assert got == [(1, 2), (3, 4), (5, 6), (9, 10)]
    assert sorted({(r.first_id, r.second_id) for r in nearby.near_pairs(df, "loc_id", 1.0, hot_cell=1).collect()}) == got


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(8)
    for lat in (0, 60, 89.9, -89.95):
        data = [(i, float(np.clip(lat + a, -90, 90)), float((b + 180) % 360 - 180)) for i, (a, b) in enumerate(zip(rng.uniform(-0.03, 0.03, 150), 179.99 + rng.uniform(-0.03, 0.03, 150)))]
        got = {(r.first_id, r.second_id) for r in nearby.near_pairs(spark.createDataFrame(data, "loc_id bigint, lat double, lon double"), "loc_id", 1.0).collect()}
        assert got == {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and haversine_km(a[1], a[2], b[1], b[2]) <= 1}


def test_points_and_regions(spark):
    schema = "loc_id bigint, x double, y double, lat_long array<double>, geometry string"
    data = [
        (1, 3.0, 2.0, None, None), (2, None, None, [2.0, 3.0], None), (3, None, None, None, "SRID=4326;POINT (3.0 2)"), (4, None, None, None, ' {"type": "Point", "coordinates": [3, 2.0]}'),
        (5, 363.0, 2.0, None, None), (6, 3.0, None, None, None), (7, None, None, [2.0], None), (8, 3.0, 91.0, None, None), (9, math.nan, 2.0, None, None), (10, None, None, None, "POINT EMPTY"), (11, 183.0, 2.0, None, None), (12, None, None, [], "point(3.0   2.0)"), (13, None, None, None, "POINT (1e0 5.5)"),
    ]
    got = {r.loc_id: (r.lat, r.lon) for r in nearby.possible_points(spark.createDataFrame(data, schema), "loc_id").collect()}
    assert got == {1: (2, 3), 2: (2, 3), 3: (2, 3), 4: (2, 3), 5: (2, 3), 11: (2, -177), 12: (2, 3), 13: (5.5, 1)}
    regions = spark.createDataFrame([(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "MULTIPOLYGON (((20 0, 21 0, 21 1, 20 0)), ((-180 -5, -179 -5, -179 5, -180 5, -180 -5)))"), (3, None), (4, "nonsense (1)"), (None, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "area_id bigint, boundary string")
    at = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 0.2, 20.8), (4, 0.0, -179.5), (5, 50.0, 50.0)], "loc_id bigint, lat double, lon double")
    assert rows(nearby.containing(at, regions, "loc_id", "area_id", "boundary"), "point_id") == [(1, 1), (2, 3), (2, 4)]


# Metrics.


def test_metrics(spark):
    ranked = spark.createDataFrame([("t", p, i + 1) for i, p in enumerate("abcd")], "topic string, phrase string, rank bigint")
    gold = spark.createDataFrame([("t", p) for p in "bde"] + [("u", "x")], "topic string, phrase string")
    hits = evaluate.with_hits(ranked, gold, ["topic"])
    whole = {r.k: r for r in evaluate.by_ranking(hits, ["topic"]).collect()}[0]
    assert np.allclose((whole.precision, whole.recall, whole.f1), (0.5, 2 / 3, 4 / 7))
    order = evaluate.order_metrics(hits, ["topic"]).first()
    assert math.isclose(order.map, 1 / 3) and math.isclose(order.ndcg, 0.498189257466, abs_tol=1e-12)
    assert [(r.precision, r.recall) for r in evaluate.depth_curve(hits, ["topic"], 2).orderBy("rank").collect()] == [(0, 0), (0.5, 1 / 3)]
    again = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "a", 3), ("t", "c", 4)], "topic string, phrase string, rank bigint")
    assert [(r.phrase, r.rank) for r in evaluate.distinct_ranking(again, ["topic"]).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]


# Entry points.


def _names():
    import __spark_entry__ as e

    return sorted(n for n in e.queries() if not (n[0] == "p" and n[1].isdigit()))


@pytest.mark.parametrize("part", range(6))
def test_every_query_runs(spark, sf, part):
    """Each of the core's queries over the smallest tables; those of the training-data package are run in its own tests."""
    import __spark_entry__ as e

    queries = e.queries()
    for name in _names()[part::6]:
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()


def test_queries_and_their_sql_have_the_same_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_the_library_does_without_the_llm_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("phraselode.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    import phraselode

    monkeypatch.delattr(phraselode, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "phraselode.llm", None)
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "p5_found" in names and not any(n.startswith(("p1_", "p6_", "p10_")) for n in names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_regions_against_rays_through_all_edges(spark):
    rng = np.random.default_rng(7)
    regions, edges_of = [], {}
    for k in range(12):
        # Corners on whole degrees, so many lie on the cells' sides; some rings have long sides along them.
        angles = np.sort(rng.uniform(0, 2 * np.pi, 9))
        corners = [(int(x), int(y)) for x, y in zip(20 * k - 120 + np.round(rng.uniform(2, 9, 9) * np.cos(angles)), np.round(rng.uniform(2, 9, 9) * np.sin(angles)))]
        if k % 3 == 0:
            x = 20 * k - 120
            corners = [(x - 6, -4), (x + 6, -4), (x + 6, 4), (x, 4), (x, 2), (x - 6, 2)]
        regions.append((k, "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*corners, corners[0]]) + "))"))
        edges_of[k] = [(*p, *q) for p, q in zip(corners, [*corners[1:], corners[0]]) if p != q]
    # Latitudes of corners, and longitudes of cells' sides, are met; points on edges aren't.
    points = [(i, float(rng.integers(-9, 10)) + (0.25 if i % 2 else 0.0), float(rng.integers(-130, 120)) + (0.37 if i % 3 else 0.0)) for i in range(1500)]

    def meets(e, lat):
        return (e[2] - e[0]) * (lat - e[1]) / (e[3] - e[1]) + e[0]

    def on_edge(e, lat, lon):
        return min(e[0], e[2]) <= lon <= max(e[0], e[2]) and min(e[1], e[3]) <= lat <= max(e[1], e[3]) and abs((e[2] - e[0]) * (lat - e[1]) - (e[3] - e[1]) * (lon - e[0])) < 1e-9

    points = [p for p in points if not any(on_edge(e, p[1], p[2]) for es in edges_of.values() for e in es)]
    want = sorted((k, i) for i, lat, lon in points for k, es in edges_of.items() if sum((e[1] > lat) != (e[3] > lat) and lon < meets(e, lat) for e in es) % 2)
    at = spark.createDataFrame(points, "loc_id bigint, lat double, lon double")
    areas = spark.createDataFrame(regions, "area_id bigint, boundary string")
    assert len(want) > 100
    for how in ({}, {"step": 0.7}, {"broadcast_bytes": 0, "points_of_cell": 3}):
        assert sorted((r.region_id, r.point_id) for r in nearby.containing(at, areas, "loc_id", "area_id", "boundary", **how).collect()) == want
