"""Counts of greater values within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: Groups with more distinct values than this are spread over ranges of their values.
HOT_VALUES = 100_000


def hot_groups(values: DataFrame, group: str, most: int) -> DataFrame | None:
    """``group`` of the groups with more than ``most`` rows, None if there is none; at most (rows / most) of them."""
    hot = durable(values.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(group))
    return None if hot.isEmpty() else hot


def _running(group: str, weight: str):
    """Adds to a partition's rows, sorted by group, its number and the weight of the rows of the group before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, w = batch.column(batch.schema.get_field_index(group)), batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False)
            new = np.ones(len(w), bool)
            new[1:] = pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = keys[0].as_py() != last
            before = np.cumsum(w) - w
            begins = np.flatnonzero(new)
            base = np.zeros(len(w), before.dtype)
            if len(begins):
                base[begins[0] :] = np.repeat(before[begins], np.diff([*begins, len(w)]))
            base[: begins[0] if len(begins) else len(w)] = -carried
            above = before - base
            last, carried = keys[-1].as_py(), above[-1] + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(w), part, np.int32)), pa.array(above.astype(np.int64))], [*batch.schema.names, "_part", "above"])

    return run


def count_above(values: DataFrame, group: str, value: str, weight: str, hot_values: int = HOT_VALUES, ranges: int | None = None) -> DataFrame:
    """Adds ``above``: the total weight (an integer) of the greater values in a row's group.

    ``values`` has one row for each group and value, without nulls. An ordinary group is one window. The rows of
    groups with more than ``hot_values`` values are partitioned by ranges of (group, value) of about equal numbers
    of rows, ``ranges`` of them (the session's shuffle partitions by default), so a group has as many ranges as its
    size asks for; each range adds up its own weights, and the totals of the greater ranges are added to them. A
    range has at most one group that began in an earlier one, so these totals, a row a range at most, are broadcast.
    """
    greatest_first = Window.partitionBy(group).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    within = lambda df: df.withColumn("above", F.coalesce(F.sum(weight).over(greatest_first), F.lit(0)).cast("bigint"))
    hot = hot_groups(values, group, hot_values)
    if hot is None:
        return within(values)
    cold = within(values.join(F.broadcast(hot), group, "left_anti"))
    spark = values.sparkSession
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [F.col(group), F.col(value).desc()]
    # Written once: another run could draw other ranges.
    ranged = values.join(F.broadcast(hot), group, "left_semi").repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    ranged = durable(ranged.mapInArrow(_running(group, weight), f"{schema}, _part int, above bigint"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(group, "_part").agg(F.sum(weight).cast("bigint").alias("_w")).withColumn("_greater", F.sum("_w").over(earlier)).filter("_greater > 0").drop("_w")
    out = ranged.join(F.broadcast(totals), [group, "_part"], "left").withColumn("above", F.col("above") + F.coalesce("_greater", F.lit(0)))
    return cold.unionByName(out.select(*cold.columns))
