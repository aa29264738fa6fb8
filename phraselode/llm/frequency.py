"""Frequency of every distinct term, and marks for the rare and the common ones.

Method: a global integer dictionary; encoded terms; count arrays for occurrences and for record presence,
accumulated block by block and summed by range of identifiers. Every Arrow batch is first dictionary-encoded by
itself and summed by local code, so a term reaches the global dictionary at most once a batch, however often it
occurs: no task gets a hot term's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Identifiers of a range; a count array has so many cells.
RANGE = 4096
#: Arrays that a task holds before it passes them on.
HELD = 256


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums each Arrow batch of (term, n) by term: term, n_sum, n_records."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n_sum = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(n_sum, codes, batch.column(1).to_numpy(zero_copy_only=False))
        records = np.bincount(codes, minlength=len(n_sum)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n_sum), pa.array(records)], ["term", "n_sum", "n_records"])


def _arrays(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(held) + 1, dtype=np.int32) * RANGE)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([a[i] for a in held.values()]))) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *lists], ["id_range", "n_sum", "n_records"])


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums a task's rows (id, n_sum, n_records) into two arrays for each range of identifiers that it meets."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, n_sum, records = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        where = ids // RANGE
        for r in np.unique(where):
            own = where == r
            a = held.setdefault(int(r), np.zeros((2, RANGE), np.int64))
            np.add.at(a[0], ids[own] % RANGE, n_sum[own])
            np.add.at(a[1], ids[own] % RANGE, records[own])
        if len(held) >= HELD:
            yield _arrays(held)
            held.clear()
    if held:
        yield _arrays(held)


def _sum_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the arrays of each range, which come sorted by range, and unfolds the cells that aren't 0."""
    at, total = -1, np.zeros((2, RANGE), np.int64)

    def cells() -> pa.RecordBatch:
        used = np.flatnonzero(total[1])
        return pa.RecordBatch.from_arrays([pa.array(at * RANGE + used), pa.array(total[0][used]), pa.array(total[1][used])], ["id", "total", "n_docs"])

    for batch in batches:
        flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, RANGE) for i in (1, 2)]
        for k, r in enumerate(batch.column(0).to_pylist()):
            if r != at:
                if at >= 0:
                    yield cells()
                at, total = r, np.zeros((2, RANGE), np.int64)
            total += [flat[0][k], flat[1][k]]
    if at >= 0:
        yield cells()


def occurrences(rows: DataFrame, term: str, n: str, record: list[str]) -> DataFrame:
    """_t, _n and the record's columns _r0, _r1 ... of the rows that count."""
    return rows.filter(F.col(term).isNotNull() & (F.col(n) >= 1)).select(F.col(term).cast("string").alias("_t"), F.col(n).cast("bigint").alias("_n"), *(F.col(c).alias(f"_r{i}") for i, c in enumerate(record)))


def term_counts(rows: DataFrame, term: str, n: str, record: list[str]) -> DataFrame:
    """term, total, n_docs: one row for each distinct term that occurs.

    Terms are compared exactly. Rows with a null term, or with ``n`` null or below 1, count for nothing; exact
    copies of a row count once; rows of one record and term with different ``n`` add up and are one presence. A
    null in ``record`` is a value like any other. If no row counts, none comes out.
    """
    of_record = [f"_r{i}" for i in range(len(record))]
    # One cell a record and term; copies merge already in the tasks that read them.
    cells = occurrences(rows, term, n, record).groupBy("_t", *of_record).agg(F.aggregate(F.collect_set("_n"), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("_n"))
    blocks = durable(cells.select("_t", "_n").mapInArrow(_sum_batches, "term string, n_sum bigint, n_records bigint"))
    # Sorted within hash partitions and written once: an identifier never changes, and those of a partition are dense.
    dictionary = durable(blocks.select("term").distinct().sortWithinPartitions("term").withColumn("id", F.monotonically_increasing_id()))
    counts = (
        blocks.join(dictionary, "term")
        .select("id", "n_sum", "n_records")
        .mapInArrow(_accumulate, "id_range bigint, n_sum array<bigint>, n_records array<bigint>")
        .repartition("id_range")
        .sortWithinPartitions("id_range")
        .mapInArrow(_sum_arrays, "id bigint, total bigint, n_docs bigint")
    )
    return counts.join(dictionary, "id").select("term", "total", "n_docs")


def record_count(rows: DataFrame, term: str, n: str, record: list[str]) -> int:
    """How many records have any occurrence."""
    return occurrences(rows, term, n, record).drop("_t", "_n").distinct().count()


def marked(counts: DataFrame, records: int, rare: int = 2, common: float = 0.1) -> DataFrame:
    """term, total, n_docs, mark: ``rare`` up to ``rare`` records, ``common`` above that share of all records, else null.

    Where both hold (fewer than rare / common records in all), the term has a row for each mark.
    """
    marks = F.array_compact(F.array(F.when(F.col("n_docs") <= rare, F.lit("rare")), F.when(F.col("n_docs") - common * records > 1e-9, F.lit("common"))))
    return counts.withColumn("mark", F.explode_outer(marks))
