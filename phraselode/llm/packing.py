"""Filling containers of fixed capacity with items that are not split unless they exceed it.

Method: sum-of-squares packing. With N(g) open containers that have room g left, an item goes to the room for
which the sum of N(g) squared becomes smallest. A task packs its own items, in an order drawn by hash, and keeps a
bounded number of containers of each room open. Of what is open at the end, a bounded number of items goes on to
the fewer tasks of a next round, the rest stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import union_all
from ..session import durable

#: Open containers of one room that a task keeps: in a random order more are met only where nothing can fill them.
OPEN = 512
#: Items that a task passes on to the next round.
PASSED = 2048


class SumOfSquares:
    """Open containers by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.counts = np.zeros(capacity + 1, np.int64)
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """The number of the container that the item goes to, and the room left there; size is at most the capacity."""
        counts = self.counts
        if size == 0:
            # Nothing changes wherever it goes: the fullest open container takes it.
            for room in np.flatnonzero(counts)[:1]:
                return self.open[room][-1], int(room)
            self.open[self.capacity].append(self.made)
            counts[self.capacity] += 1
            self.made += 1
            return self.made - 1, self.capacity
        # Taking a container with room g turns N(g) into N(g) - 1 and N(g - size) into N(g - size) + 1: the sum of
        # squares changes by 2 (N(g - size) - N(g) + 1). A full one is no longer open, a new one wasn't before.
        after = counts[: self.capacity + 1 - size]
        change = 2 * (after - counts[size:]) + 2
        change[0] = 1 - 2 * counts[size]
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        if not counts[self.capacity]:
            change[-1] = 2 * after[-1] + 1 if self.capacity > size else 0
        left = int(np.argmin(change))
        room = left + size
        if self.open[room]:
            number = self.open[room].pop()
            counts[room] -= 1
        else:
            number, self.made = self.made, self.made + 1
        if left:
            self.open[left].append(number)
            counts[left] += 1
        return number, left

    def close_oldest(self, room: int) -> int:
        """Takes the container that has had this room longest out of the open ones."""
        self.counts[room] -= 1
        return self.open[room].pop(0)


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, in the order given."""
    bins = SumOfSquares(capacity)
    return [bins.put(s)[0] for s in sizes]


class Task:
    """Packs one task's rows and gives each out with its container as soon as that closes."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.bins, self.most_open = SumOfSquares(capacity), most_open
        self.held: dict[int, list[tuple]] = {}
        self.full: int | None = None  # the last container closed: rows without size go there
        self.empty: list[tuple] = []

    def put(self, row: tuple, size: int) -> list[tuple]:
        """The rows, with their container, of a container that this one closes."""
        if not size:
            if self.full is not None:
                return [(*row, self.full)]
            self.empty.append(row)
            return []
        number, left = self.bins.put(size)
        self.held.setdefault(number, []).append(row)
        if left and len(self.bins.open[left]) > self.most_open:
            number, left = self.bins.close_oldest(left), 0
        return [] if left else self._close(number)

    def _close(self, number: int) -> list[tuple]:
        self.full = number
        rows = [*self.held.pop(number, ()), *self.empty]
        self.empty = []
        return [(*r, number) for r in rows]

    def finish(self, spare: int, passed: int) -> list[tuple]:
        """The rows left, with the container or, for up to ``passed`` rows of those with most room, None: they go on."""
        out: list[tuple] = []
        left = [(room, n) for room in range(self.bins.capacity, 0, -1) for n in self.bins.open[room]]
        for room, n in left:
            passed -= len(self.held.get(n, ()))
            if room <= spare or passed < 0:
                out += self._close(n)
            else:
                out += [(*r, None) for r in self.held.pop(n)]
        if self.empty:  # nothing closed: they have a container of their own
            out += self._close(self.bins.made)
        return out


def _columns(rows: list[tuple], kind: pa.DataType, base: int) -> pa.RecordBatch:
    parts = zip(*rows) if rows else ([],) * 5
    kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64())
    columns = [list(x) for x in parts]
    columns[4] = [None if n is None else base | n for n in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["_id", "part", "tok_start", "n_tokens", "container"])


def _round(capacity: int, number: int, last: bool, spare: int, most_open: int, passed: int):
    """Packs a task's rows (_id, part, tok_start, n_tokens); container is null for the rows that go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, task, kind = (number << 56) | (TaskContext.get().partitionId() << 32), Task(capacity, most_open), None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                done += task.put(row, row[3])
            yield _columns(done, kind, base)
        if kind is not None:
            yield _columns(task.finish(spare, 0 if last else passed), kind, base)

    return run


def fill_containers(sizes: DataFrame, id_col: str, size_col: str, capacity: int, spare: int | None = None, narrowing: int = 16, most_open: int = OPEN, passed: int = PASSED) -> DataFrame:
    """``id_col``, part, tok_start, n_tokens, container: every row of ``sizes`` is in a container of ``capacity``.

    A row above the capacity is split: parts of exactly the capacity, each alone in a container, and the rest as an
    item. Others are part 0. Null and zero sizes take no room and share a container with others. Ids may be null
    or repeated. A task keeps up to ``most_open`` containers of each room open; a container with at most ``spare``
    left (capacity / 200 by default) isn't opened again in a later round. A round has a ``narrowing``-th of the tasks
    of the one before, each of which passes on at most ``passed`` items: no task of a later round, the last with one
    task included, gets more than narrowing x passed rows, whether or not the items fit together. Which items share
    a container depends on how the input is partitioned.
    """
    spare = capacity // 200 if spare is None else spare
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(size / capacity), F.lit(1)).cast("int") - 1)
    rows = sizes.select(F.col(id_col).alias("_id"), size.alias("_size"), F.explode(parts).alias("part"))
    start = F.col("part").cast("bigint") * capacity
    items = rows.select("_id", "part", start.alias("tok_start"), F.least(F.lit(capacity), F.col("_size") - start).cast("bigint").alias("n_tokens"))
    schema = T.StructType([*items.schema.fields, T.StructField("container", T.LongType())])
    # The method's bounds hold for sizes in random order; this one is the same in a rerun, and nothing leaves its task.
    items = items.sortWithinPartitions(F.xxhash64("_id", "part", "n_tokens"))
    out, number, tasks = [], 0, None
    while True:
        packed = durable(items.mapInArrow(_round(capacity, number, tasks == 1, spare, most_open, passed), schema))
        out.append(packed.filter(F.col("container").isNotNull()))
        if tasks == 1:
            break
        tasks = max(1, -(-packed.rdd.getNumPartitions() // narrowing))
        number += 1
        # Big items first leaves the small ones to close what is open; the order also makes a round repeatable. The
        # rows that go on are read from neighbouring parts of what was written, without a shuffle.
        items = packed.filter(F.col("container").isNull()).drop("container").coalesce(tasks).sortWithinPartitions(F.desc("n_tokens"), "_id", "part")
    return union_all(out).withColumnRenamed("_id", id_col)
