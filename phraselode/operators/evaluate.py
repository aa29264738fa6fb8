"""Metrics of ranked phrases against gold phrases.

Rankings have keys, phrase and rank (from 1); gold has the keys it shares with them and phrase. Quotients with an
empty denominator are null, and means leave them out. Lists are short, so windows over one are small; everything
else is a grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .rank_doc import top

KS = (5, 10, 15)


def f1(p: Column, r: Column) -> Column:
    """The harmonic mean; 0 where both are 0."""
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.when(p.isNotNull() & r.isNotNull(), 0.0))


def distinct_ranking(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each phrase at its first place, places counted again."""
    first = rows.groupBy(*keys, "phrase").agg(F.min("rank").alias("_r"))
    return first.select(*keys, "phrase", F.row_number().over(Window.partitionBy(*keys).orderBy("_r")).alias("rank"))


def with_hits(ranked: DataFrame, gold: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Adds hit (0 or 1) and n_gold (distinct phrases); rankings without gold are left out."""
    g = gold.select(*shared, "phrase").distinct()
    sizes = g.groupBy(*shared).agg(F.count(F.lit(1)).alias("n_gold"))
    marked = ranked.join(g.withColumn("_hit", F.lit(1)), [*shared, "phrase"], "left")
    return marked.join(sizes, list(shared)).withColumn("hit", F.coalesce("_hit", F.lit(0))).drop("_hit")


def by_ranking(hits: DataFrame, keys: Sequence[str], ks: Sequence[int] = KS, clip: bool = False) -> DataFrame:
    """keys, k, precision, recall, f1 of each ranking at each depth, and at its whole length as k = 0.

    ``clip`` is for lists that may hold a phrase several times: quotients are at most 1.
    """
    depth = F.explode(F.array(F.lit(0), *(F.lit(k) for k in ks)))
    cut = hits.withColumn("k", depth).filter((F.col("k") == 0) | (F.col("rank") <= F.col("k")))
    sums = cut.groupBy(*keys, "k").agg(F.sum("hit").alias("_h"), F.count(F.lit(1)).alias("_n"), F.max("n_gold").alias("_g"))
    most = lambda c: F.least(F.lit(1.0), c) if clip else c
    p, r = most(F.try_divide("_h", "_n")), most(F.try_divide("_h", "_g"))
    return sums.select(*keys, "k", p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def mean_metrics(each: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("precision", "recall", "f1")) -> DataFrame:
    """Metrics averaged over rankings."""
    return each.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n"))


def order_metrics(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, map, ndcg: average precision over gold, and discounted gain over that of the gold's length."""
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("_so_far", F.sum("hit").over(so_far))
    gain = lambda r: F.log(F.lit(2.0)) / F.log(r + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), F.max("n_gold").cast("int")), F.lit(0.0), lambda s, i: s + gain(i))
    return rows.groupBy(*keys).agg(
        (F.sum(F.col("hit") * F.col("_so_far") / F.col("rank")) / F.max("n_gold")).alias("map"),
        (F.sum(F.col("hit") * gain(F.col("rank"))) / ideal).alias("ndcg"),
    )


def depth_curve(hits: DataFrame, keys: Sequence[str], deepest: int = 15) -> DataFrame:
    """keys, rank, precision, recall down to each rank."""
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    found = F.sum("hit").over(so_far)
    return hits.filter(F.col("rank") <= deepest).select(*keys, "rank", (found / F.col("rank")).alias("precision"), (found / F.col("n_gold")).alias("recall"))


def micro(hits: DataFrame, keys: Sequence[str], within: Sequence[str], ks: Sequence[int] = KS, most: int = 15) -> DataFrame:
    """within, k, precision, recall, f1 from counts over all rankings; k = 0 is the whole list, hits count down to ``most``."""
    gold = hits.select(*keys, "n_gold").distinct().groupBy(*within).agg(F.sum("n_gold").alias("_g"))
    depth = F.explode(F.array(F.lit(0), *(F.lit(k) for k in ks)))
    cut = hits.withColumn("k", depth).filter((F.col("k") == 0) | (F.col("rank") <= F.col("k")))
    sums = cut.groupBy(*within, "k").agg(F.sum(F.when(F.col("rank") <= most, F.col("hit")).otherwise(0)).alias("_h"), F.count(F.lit(1)).alias("_n"))
    out = sums.join(gold, list(within)).select(*within, "k", F.try_divide("_h", "_n").alias("precision"), F.try_divide("_h", "_g").alias("recall"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def compare_lists(rows: DataFrame, predicted: str, gold: str, within: Sequence[str]) -> DataFrame:
    """within, precision, recall, f1 of phrases separated by semicolons, compared exactly; rows with null gold are left out."""
    split = lambda c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    both = rows.filter(F.col(gold).isNotNull()).select(*within, split(F.coalesce(predicted, F.lit(""))).alias("_p"), split(F.col(gold)).alias("_g"))
    counted = both.select(*within, F.size("_p").alias("_e"), F.size("_g").alias("_s"), F.size(F.filter("_p", lambda x: F.array_contains("_g", x))).alias("_c"))
    sums = counted.groupBy(*within).agg(*(F.sum(c).alias(c) for c in ("_c", "_e", "_s")))
    return sums.select(*within, F.try_divide("_c", "_e").alias("precision"), F.try_divide("_c", "_s").alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


# Gold in clusters of variants: topic, cluster_no, variant_pos, phrase.


def first_clusters(gold: DataFrame, shared: Sequence[str], n: int = 20) -> DataFrame:
    """The gold of the first ``n`` clusters of each topic."""
    numbers = gold.select(*shared, "cluster_no").distinct()
    first = numbers.withColumn("_k", F.row_number().over(Window.partitionBy(*shared).orderBy("cluster_no"))).filter(F.col("_k") <= n).drop("_k")
    return gold.join(first, [*shared, "cluster_no"])


def _finish(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = counts.select(*keys, "k", F.try_divide("_c", "_e").alias("precision"), F.try_divide("_c", "_s").alias("recall"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _depths(ranked: DataFrame, ks: Sequence[int]) -> DataFrame:
    return ranked.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).filter(F.col("rank") <= F.col("k"))


def cluster_f1(ranked: DataFrame, gold: DataFrame, keys: Sequence[str], shared: Sequence[str], ks: Sequence[int] = KS) -> DataFrame:
    """keys, k, precision, recall, f1: clusters any of whose phrases is among the first k, over k's list and over all clusters."""
    sizes = gold.groupBy(*shared).agg(F.countDistinct("cluster_no").alias("_s"))
    cut = _depths(ranked, ks)
    found = cut.join(gold.select(*shared, "phrase", "cluster_no").distinct(), [*shared, "phrase"]).groupBy(*keys, "k").agg(F.countDistinct("cluster_no").alias("_c"))
    lengths = cut.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("_e")).join(sizes, list(shared))
    return _finish(lengths.join(found, [*keys, "k"], "left").withColumn("_c", F.coalesce("_c", F.lit(0))), keys)


def flat_f1(ranked: DataFrame, gold: DataFrame, keys: Sequence[str], shared: Sequence[str], ks: Sequence[int] = KS) -> DataFrame:
    """The same with one phrase a cluster: the one of the smallest position."""
    one = gold.groupBy(*shared, "cluster_no").agg(F.min_by("phrase", F.struct("variant_pos", "phrase")).alias("phrase")).select(*shared, "phrase").distinct()
    sizes = one.groupBy(*shared).agg(F.count(F.lit(1)).alias("_s"))
    cut = _depths(ranked, ks)
    found = cut.join(one, [*shared, "phrase"], "left_semi").groupBy(*keys, "k").agg(F.countDistinct("phrase").alias("_c"))
    lengths = cut.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("_e")).join(sizes, list(shared))
    return _finish(lengths.join(found, [*keys, "k"], "left").withColumn("_c", F.coalesce("_c", F.lit(0))), keys)


def unigram_f1(ranked: DataFrame, gold: DataFrame, keys: Sequence[str], shared: Sequence[str], ks: Sequence[int] = KS) -> DataFrame:
    """keys, k, precision, recall, f1 of the words of the first k phrases, as often as they come, against each cluster's distinct words."""
    own = _depths(ranked, ks).select(*keys, "k", F.explode(words(F.col("phrase"))).alias("_w")).groupBy(*keys, "k", "_w").agg(F.count(F.lit(1)).alias("_a"))
    theirs = gold.select(*shared, "cluster_no", F.explode(words(F.col("phrase"))).alias("_w")).distinct().groupBy(*shared, "_w").agg(F.count(F.lit(1)).alias("_b"))
    sizes = theirs.groupBy(*shared).agg(F.sum("_b").alias("_s"))
    met = own.join(theirs, [*shared, "_w"], "left").groupBy(*keys, "k").agg(F.sum(F.least("_a", F.coalesce("_b", F.lit(0)))).alias("_c"), F.sum("_a").alias("_e"))
    return _finish(met.join(sizes, list(shared)), keys)


# Reports.


def label_gold(rows: DataFrame, gold: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Adds is_gold: whether the phrase is gold."""
    g = gold.select(*shared, "phrase").distinct().withColumn("_g", F.lit(True))
    return rows.join(g, [*shared, "phrase"], "left").withColumn("is_gold", F.coalesce("_g", F.lit(False))).drop("_g")


def score_histogram(rows: DataFrame, score: str, hit: str, step: float = 0.01) -> DataFrame:
    """bin, n, hits on a grid from 0 to 1; scores outside, null or NaN are in no bin, and empty bins are there too."""
    n = round(1 / step)
    grid = rows.sparkSession.range(n + 1).select((F.col("id") / n).alias("bin"), F.col("id").alias("_b"))
    inside = rows.filter((F.col(score) >= 0) & (F.col(score) <= 1))
    counts = inside.groupBy(F.round(F.col(score) * n).cast("bigint").alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("int")).alias("hits"))
    return grid.join(counts, "_b", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))


def side_by_side(ranked: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, place, predicted, gold: both lists beside each other, the shorter one filled with nulls."""
    g = gold.select(*keys, F.col("phrase").alias("gold"), F.row_number().over(Window.partitionBy(*keys).orderBy("phrase")).cast("bigint").alias("place"))
    return ranked.select(*keys, F.col("rank").alias("place"), F.col("phrase").alias("predicted")).join(g, [*keys, "place"], "full_outer")


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r: Pearson's correlation of each pair of columns, all in one aggregate; null or NaN leaves a row out of a pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    one = rows.agg(*(F.corr(F.when(clean(b).isNotNull(), clean(a)), F.when(clean(a).isNotNull(), clean(b))).alias(f"_{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def sweep(rows: DataFrame, gold: DataFrame, keys: Sequence[str], shared: Sequence[str], parameters: Sequence[float], score, k: int = 15) -> DataFrame:
    """keys without shared, parameter, f1: mean F1 at k for every parameter, all trials in one job.

    ``score`` makes a column of a parameter's column; ``rows`` have keys and phrase.
    """
    trials = rows.withColumn("parameter", F.explode(F.array(*(F.lit(float(p)) for p in parameters)))).withColumn("_s", F.round(score(F.col("parameter")), 9))
    ranked = top(trials.filter("_s IS NOT NULL"), [*keys, "parameter"], "_s", ["phrase"], k)
    each = by_ranking(with_hits(ranked, gold, shared), [*keys, "parameter"], [k]).filter(F.col("k") == k)
    rest = [c for c in keys if c not in shared]
    return each.groupBy(*rest, "parameter").agg(F.avg("f1").alias("f1"))


def ranked_lists(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, phrases: each ranking as an array; cut it first, an array is one row."""
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
