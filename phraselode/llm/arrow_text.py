"""Texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401


def strings(column: pa.Array) -> list[str | None]:
    """The column's strings; bytes that are no UTF-8 become U+FFFD instead of an error."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary(), safe=False)
        return [None if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together have about ``most`` bytes, so that long texts don't add up."""
    arr = batch.column(batch.schema.get_field_index(column))
    sizes = [0 if n is None else n for n in pa.compute.binary_length(arr).to_pylist()]
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)
