"""Masked texts, and spans that no longer span covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import once

MASK = "<mask>"


def mask_all(text: Column, phrase: Column, mask: str = MASK) -> Column:
    return F.replace(text, phrase, F.lit(mask))


def mask_first(text: Column, phrase: Column, mask: str = MASK) -> Column:
    """The text with the phrase's first occurrence masked, or as it is."""
    at = F.instr(text, phrase)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(mask), F.substring(text, at + F.length(phrase), F.length(text)))).otherwise(text)


def mask_each(text: Column, phrase: Column, mask: str = MASK) -> Column:
    """An array with a text for each occurrence, that one masked."""
    quoted = F.regexp_replace(phrase, r"([\\\[\](){}.*+?^$|])", r"\\$1")

    def masked(parts: Column) -> Column:
        several = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(several, lambda k: F.concat(_joined(F.slice(parts, F.lit(1), k), phrase), F.lit(mask), _joined(F.slice(parts, k + 1, F.size(parts)), phrase)))

    return once(F.split(text, quoted), masked)


def _joined(parts: Column, phrase: Column) -> Column:
    """The parts with the phrase between them; array_join takes only a literal."""
    return F.replace(F.array_join(parts, "\x02"), F.lit("\x02"), phrase)


def uncovered_spans(spans: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The spans (start, end) of a document that no strictly longer span of it contains.

    Sorted by start, longer ones first, a span is contained exactly if some earlier one ends no earlier: one window
    in place of a join of all spans. Equal spans don't cover each other. Rows with a null in keys or bounds are left out.
    """
    spans = spans.dropna(subset=[*keys, "start", "end"])
    distinct = spans.select(*keys, "start", "end").distinct()
    before = Window.partitionBy(*keys).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    free = distinct.withColumn("_reach", F.max("end").over(before)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("end")))
    return spans.join(free.drop("_reach"), [*keys, "start", "end"])
