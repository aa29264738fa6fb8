"""Records that differ only in formatting, collapsed to one each with their number of copies.

Method: dictionary encoding. Each Arrow batch's columns are dictionary-encoded; every distinct value is
canonicalised once and gets an integer identifier; a record becomes the sorted tuple of its (field, value)
integers, a JSON object one integer for each of its own fields and values; the compact tuples are grouped. The
identifier is a 128-bit digest of the canonical value, so all tasks give the same value the same integer without
exchanging a dictionary, and the tuple's key is a 128-bit digest: among 10^13 values two differing ones share one
with a probability of some 10^-13. Copies carry 24 bytes through the shuffle, whatever the record's size.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import lookup, union_all
from ..session import durable
from .arrow_text import strings

#: Values whose identifiers a task remembers.
REMEMBERED = 500_000
_WORDS = re.compile(r"[^\W_]+")
_NULL, _NO_CASE = 0, None


def words(text: str) -> str:
    """The maximal runs of letters and digits, in order, letter case ignored, joined by spaces."""
    return " ".join(_WORDS.findall(text)).upper().lower()


def _identifier(kind: bytes, value: str) -> int:
    return xxhash.xxh3_128_intdigest(kind + value.encode("utf-8", "surrogatepass")) | 1


class Dictionary:
    """Identifiers of a column's values: 0 for null, a sorted list for a value of several parts."""

    def __init__(self, canonical: Callable[[str], str | list[str] | None], kind: bytes):
        self.canonical, self.kind, self.known = canonical, kind, {}

    def __call__(self, value: str | None) -> int | list[int] | None:
        if value is None:
            return _NULL
        if value not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            canonical = self.canonical(value)
            parts = isinstance(canonical, list)
            self.known[value] = None if canonical is None else sorted(_identifier(self.kind, c) for c in canonical) if parts else _identifier(self.kind, canonical)
        return self.known[value]

    def column(self, arr: pa.Array) -> list[int | list[int] | None]:
        coded = arr.dictionary_encode()
        ids = [self(v) for v in strings(coded.dictionary)]
        return [_NULL if i is None else ids[i] for i in coded.indices.to_pylist()]


def canonical_json(text: str) -> str | None:
    """A JSON object with all names and values reduced to words, whatever the order of fields and list elements.

    None if the text is no JSON object. Numbers and literals are compared as they are written, null only equals null.
    """
    try:
        value = json.loads(text, parse_float=str, parse_int=str, parse_constant=_no_json)
    except (ValueError, RecursionError):
        return None
    return json.dumps(_canonical(value)) if isinstance(value, dict) else None


def canonical_fields(text: str) -> list[str] | None:
    """The same by the object's own fields: name and value of each."""
    whole = canonical_json(text)
    return None if whole is None else [json.dumps(pair) for pair in json.loads(whole)[1:]]


def _no_json(name: str):
    raise ValueError(name)


def _canonical(value):
    if isinstance(value, dict):
        return ["{", *sorted(([words(k), _canonical(v)] for k, v in value.items()), key=json.dumps)]
    if isinstance(value, list):
        return ["[", *sorted((_canonical(v) for v in value), key=json.dumps)]
    if value is None:
        return None
    return words(value if isinstance(value, str) else str(value))


def _encoder(exact: list[str], by_words: list[str], sets: list[str], json_fields: list[str], required: list[str]):
    """Turns rows into (id, k1, k2): the two halves of their tuples' digests. Rows that are no case are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_is = Dictionary(lambda v: v, b"=")
        wordy = Dictionary(words, b"w")
        objects = Dictionary(canonical_fields, b"j")
        no_words = _identifier(b"w", "")
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns))
            columns: dict[str, list] = {}
            for c in exact:
                columns[c] = as_is.column(at[c].cast(pa.string()))
            for c in by_words:
                columns[c] = wordy.column(at[c])
            for c in json_fields:
                columns[c] = objects.column(at[c])
            for c in sets:
                arr = at[c]
                ids = wordy.column(arr.flatten())
                bounds, out, begin = arr.value_lengths().to_pylist(), [], 0
                for n in bounds:
                    if n is None:
                        out.append(None)
                    else:
                        out.append(sorted(set(ids[begin : begin + n])))
                        begin += n
                columns[c] = out
            rows, k1, k2 = [], [], []
            order = [*exact, *by_words, *json_fields]
            ids = at["_id"].to_pylist()
            for i, key in enumerate(ids):
                if key is None or any(columns[c][i] in (_NULL, _NO_CASE, no_words) for c in required):
                    continue
                values = [columns[c][i] for c in order]
                tup = [(f, v) for f, x in enumerate(values) for v in (x if isinstance(x, list) else [x])]
                for f, c in enumerate(sets, len(order)):
                    tup += [(f, -1)] if columns[c][i] is None else [(f, v) for v in columns[c][i]]
                digest = xxhash.xxh3_128_digest(b"".join(struct.pack("<i", f) + (v % 2**128).to_bytes(16, "little") for f, v in sorted(tup)))
                a, b = struct.unpack("<qq", digest)
                rows.append(key), k1.append(a), k2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, k1, k2)], ["_id", "k1", "k2"])

    return run


def record_tuples(rows: DataFrame, id_col: str, exact: list[str] = (), by_words: list[str] = (), sets: list[str] = (), json_fields: list[str] = (), required: list[str] = ()) -> DataFrame:
    """_id, k1, k2 of every row that is a case; equal (k1, k2) means one record.

    ``exact`` columns are compared as they are, ``by_words`` by their words, ``sets`` (arrays of strings) as sets of
    values compared by words, ``json_fields`` as JSON objects. Null only equals null, also within an array. Rows with
    a null id are no cases, nor are those where a ``required`` column is null, has no word or is no JSON object.
    """
    cols = [*exact, *by_words, *sets, *json_fields]
    return rows.select(F.col(id_col).cast("bigint").alias("_id"), *cols).mapInArrow(_encoder(list(exact), list(by_words), list(sets), list(json_fields), list(required)), "_id bigint, k1 bigint, k2 bigint")


def copy_groups(tuples: DataFrame) -> DataFrame:
    """kind, k1, k2, first_id, copies: one row for each record; copies counts its rows, the first among them."""
    return tuples.groupBy("kind", "k1", "k2").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def copies(tuples: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """kind, first_id, copy_id: one row for each row of a record other than the one with the smallest id."""
    groups = copy_groups(tuples).filter(F.col("copies") > 1)
    found = lookup(tuples, groups, ["kind", "k1", "k2"], "copies", hot_rows)
    return found.filter(F.col("_id") > F.col("first_id")).select("kind", "first_id", F.col("_id").alias("copy_id"))


def tuples_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The tuples of several tables with the table's name as kind, computed once."""
    return durable(union_all([t.withColumn("kind", F.lit(name)) for name, t in tables.items()]))
