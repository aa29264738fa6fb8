"""Keys that treat null as a value, and joins that survive hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_key(*cols: str | Column) -> Column:
    """One string for several columns: equal exactly when all are equal, null counting as a value.

    Each part is preceded by its length, so no value can imitate a separator.
    """
    parts = []
    for c in cols:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.length(s).cast("string"), F.lit(":"), s)))
    return F.concat(*parts)


def finite(c: str | Column) -> Column:
    """The number, or null where it is null or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, hot_rows: int = 200_000) -> DataFrame:
    """Inner join of rows with one row per key, where ``count`` says how many rows a key has.

    A key with more than ``hot_rows`` rows would put them all into one task of a shuffle join. Its row is broadcast
    instead and its rows stay where they are; what goes through the shuffle are the rows of the other keys alone.
    Null keys match nothing, as in any join. ``count`` itself is dropped.
    """
    hot = groups.filter(F.col(count) > hot_rows).drop(count)
    cold = groups.filter(F.col(count) <= hot_rows).drop(count)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def hot_keys(counts: DataFrame, keys: list[str], count: str, hot_rows: int) -> DataFrame:
    """keys, _parts of the keys with more than ``hot_rows`` rows: the number of tasks that these are dealt out to."""
    return counts.filter(F.col(count) > hot_rows).select(*keys, F.ceil(F.col(count) / hot_rows).cast("int").alias("_parts"))


def dealt(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with _turn: those of a hot key in turn 0 to _parts - 1, others 0. The hot keys are broadcast, without anything else."""
    turned = rows.withColumn("_turn", F.monotonically_increasing_id()).join(F.broadcast(hot), keys, "left")
    return turned.withColumn("_turn", F.pmod("_turn", F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def copied(groups: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, copied for every _turn of it."""
    return groups.join(F.broadcast(hot), keys, "left").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def spread_lookup(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, hot_rows: int = 200_000) -> DataFrame:
    """As :func:`lookup`, for rows of ``groups`` that are too large to broadcast.

    A hot key's rows go to ceil(count / hot_rows) tasks in turn, and its row of ``groups`` to each of these. Only the
    keys and numbers of tasks of hot keys are broadcast.
    """
    hot = hot_keys(groups, keys, count, hot_rows)
    return dealt(rows, hot, keys).join(copied(groups, hot, keys).drop(count), [*keys, "_turn"]).drop("_turn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
