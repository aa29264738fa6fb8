"""The N best items of every group.

Method: a row_number window ordered by score and identifier with a filter on the rank. The optimiser turns the
filter into a group limit that prunes every task's rows to N a group before the shuffle and again behind it, so
a group of any size sends at most N rows from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def latest(rows: DataFrame, id_col: str, at: str, keep: list[str]) -> DataFrame:
    """One row for each id: its latest delivery. Rows without an id are no items and are left out.

    Deliveries at the same time are settled by the greatest values of ``keep``, in order.
    """
    best = F.max(F.struct(F.col(at), *keep))
    return rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(best.alias("_row")).select(id_col, *(F.col("_row")[k].alias(k) for k in keep))


def top_n(rows: DataFrame, groups: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their place from 1. Null group values form a group."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n)


def top_items(rows: DataFrame, groups: list[str], score: str, item: str, id_col: str, at: str, n: int) -> DataFrame:
    """The ``n`` highest scores of each group, one row an item.

    Null and NaN scores never rank. Equal scores: ``item`` ascending by code point, null items last, then ``id_col``.
    """
    items = latest(rows.filter(F.col(score).isNotNull() & ~F.isnan(score)), id_col, at, [*groups, item, score])
    return top_n(items, groups, [F.col(score).desc(), F.col(item).asc_nulls_last(), F.col(id_col).asc()], n)


__all__ = ["latest", "top_items", "top_n"]
