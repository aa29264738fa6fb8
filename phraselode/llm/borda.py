"""One ranking from several scores on different scales.

Method: Borda count. Every score gives competition ranks with averaged ties; a missing score has the middle rank;
an item's points are the weighted sum, and equal points are settled by identifier. Only ranks enter, so neither
scale nor spread of a score matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import finite, lookup, null_safe_key
from ..operators.ranking import HOT_VALUES, count_above, hot_groups
from ..session import durable
from .topk import latest, top_n


def _points(shares: list[Column], weights: list[float]) -> Column:
    """Weighted sum of the shares of a group that an item is above of, ties counting half; a missing one is the middle."""
    return sum((F.coalesce(s, F.lit(0.5)) * w for s, w in zip(shares, weights)), F.lit(0.0))


def _windowed(items: DataFrame, groups: list[str], values: list[str], weights: list[float]) -> DataFrame:
    """Points of groups that a window can hold: one shuffle by group, one sort a score.

    With ties in the frame the running count is above + tied, and the rank is above + 1.
    """
    whole = Window.partitionBy(*groups)
    down = lambda v: whole.orderBy(F.col(v).desc_nulls_last())
    share = lambda v: F.when(F.col(v).isNotNull(), (F.col(f"_m{v}") - (F.rank().over(down(v)) - 1 + F.count(v).over(down(v))) / 2) / F.col(f"_m{v}"))
    sized = items.withColumns({"n_items": F.count(F.lit(1)).over(whole), **{f"_m{v}": F.count(v).over(whole) for v in values}})
    return sized.withColumn("points", _points([share(v) for v in values], weights))


def _counted(items: DataFrame, id_col: str, values: list[str], weights: list[float], hot_rows: int) -> DataFrame:
    """Points of hot groups (``_g``): values are counted first, and ranked over ranges of them in many tasks."""
    kinds = F.explode(F.array(*(F.struct(F.lit(v).alias("_kind"), F.col(v).alias("_v")) for v in values)))
    long = items.select(id_col, "_g", kinds.alias("_s")).select(id_col, "_g", "_s.*").filter(F.col("_v").isNotNull()).withColumn("_gk", F.concat("_kind", F.lit("|"), "_g"))
    counts = durable(long.groupBy("_gk", "_v").agg(F.count(F.lit(1)).alias("_c")))
    # One row a hot group and score: broadcast, so that no group comes together again.
    sizes = F.broadcast(counts.groupBy("_gk").agg(F.sum("_c").alias("_m")))
    ranks = count_above(counts, "_gk", "_v", "_c", hot_rows)
    shares = ranks.join(sizes, "_gk").select("_gk", "_v", "_c", ((F.col("_m") - F.col("above") - F.col("_c") / 2) / F.col("_m")).alias("_share"))
    known = lookup(long.select("_gk", "_v", id_col, "_kind"), shares, ["_gk", "_v"], "_c", hot_rows)
    by_item = known.groupBy(id_col).agg(*(F.max(F.when(F.col("_kind") == v, F.col("_share"))).alias(f"_p{v}") for v in values))
    n_items = F.broadcast(items.groupBy("_g").agg(F.count(F.lit(1)).alias("n_items")))
    return items.join(by_item, id_col, "left").join(n_items, "_g").withColumn("points", _points([F.col(f"_p{v}") for v in values], weights))


def borda_points(rows: DataFrame, groups: list[str], id_col: str, at: str, scores: list[str], weights: dict[str, float] | None = None, hot_rows: int = HOT_VALUES) -> DataFrame:
    """``groups``, ``id_col``, n_items, points: one row for each item, its latest delivery.

    For each score a rank r among the m items of the group that have it (ties share the mean of their ranks) gives
    (m - r + 1/2) / m points, between 0 and 1; an item whose score is null or NaN gets the middle, 1/2. ``points`` is
    the sum over the scores, times their weights (1 by default). Rows with a null ``id_col`` are no items; null
    groups are groups. n_items counts the items of the group. Groups of more than ``hot_rows`` deliveries, if there
    are any, are ranked in many tasks each; a first pass over the groups' names finds them.
    """
    of_score = [float((weights or {}).get(s, 1.0)) for s in scores]
    values = [f"_s{i}" for i in range(len(scores))]
    columns = [*groups, id_col, "n_items", "points"]
    hot = hot_groups(rows.select(null_safe_key(*groups).alias("_g")), "_g", hot_rows)
    items = latest(rows, id_col, at, [*groups, *scores]).select(*groups, id_col, *(finite(F.col(s).cast("double")).alias(v) for s, v in zip(scores, values)))
    if hot is None:
        return _windowed(items, groups, values, of_score).select(columns)
    items, hot = durable(items.withColumn("_g", null_safe_key(*groups))), F.broadcast(hot)
    cold = _windowed(items.join(hot, "_g", "left_anti"), groups, values, of_score)
    return cold.select(columns).unionByName(_counted(items.join(hot, "_g", "left_semi"), id_col, values, of_score, hot_rows).select(columns))


def borda_leaders(points: DataFrame, groups: list[str], id_col: str, n: int, least: int = 0) -> DataFrame:
    """The first ``n`` items of each group of at least ``least`` items; equal points: smaller ``id_col`` first."""
    return top_n(points.filter(F.col("n_items") >= least), groups, [F.col("points").desc(), F.col(id_col).asc()], n)
