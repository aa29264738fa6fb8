"""Vectors as arrays of doubles, in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector over its length; null where it has none."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def by_dimension(rows: DataFrame, keys: Sequence[str], vector: str, how: Sequence[tuple[str, str]]) -> DataFrame:
    """keys and arrays of aggregates (name, function) by dimension; every task first merges its own rows."""
    each = rows.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    sums = each.groupBy(*keys, "_i").agg(*(getattr(F, f)("_x").alias(n) for n, f in how))
    gathered = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", *(n for n, _ in how)))).alias("_a"))
    field = lambda n: F.transform("_a", lambda x: x[n]).alias(n)
    return gathered.select(*keys, *(field(n) for n, _ in how))


def mean_vectors(rows: DataFrame, keys: Sequence[str], vector: str = "vec", out: str = "vec") -> DataFrame:
    return by_dimension(rows, keys, vector, [(out, "avg")])


def max_vectors(rows: DataFrame, keys: Sequence[str], vector: str = "vec", out: str = "vec") -> DataFrame:
    return by_dimension(rows, keys, vector, [(out, "max")])


def pooled(tokens: Column, mask: Column, how: str = "mean") -> Column:
    """Token vectors (array of arrays) pooled where the mask is 1: the mean with at least 1e-9 as count, or the maximum."""
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    index = F.sequence(F.lit(0), F.size(tokens[0]) - 1)
    value = lambda t, m, d: m * F.get(t, d)
    if how == "max":
        return F.transform(index, lambda d: F.array_max(F.zip_with(tokens, mask, lambda t, m: F.when(m > 0, F.get(t, d)).otherwise(-1e9))))
    return F.transform(index, lambda d: F.aggregate(F.zip_with(tokens, mask, lambda t, m: value(t, m, d)), F.lit(0.0), lambda s, v: s + v) / F.greatest(n, F.lit(1e-9)))


def zscores(rows: DataFrame, keys: Sequence[str], vector: str = "vec") -> DataFrame:
    """The vectors standardised by the mean and the population deviation of their group, dimension by dimension."""
    stats = by_dimension(rows, keys, vector, [("_mean", "avg"), ("_dev", "stddev_pop")])
    z = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.col("_mean").alias("m"), F.col("_dev").alias("d")), lambda t: F.when(t["d"] > 0, (t["x"] - t["m"]) / t["d"]).otherwise(0.0))
    return rows.join(stats, list(keys)).withColumn(vector, z).drop("_mean", "_dev")
