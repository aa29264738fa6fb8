"""All-against-all within groups, in blocks of bounded size.

A group's items are hashed into blocks of about ``size``; tasks get pairs of blocks, compute in NumPy, and return
sums by item. No row for a pair of items is ever made, and a group of any size is spread over many tasks. What is
shuffled are blocks, each once for every block it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import lookup

SIZE = 1024

#: Gets the two blocks as dicts of arrays, and whether they are the same block; returns columns of rows, or parts of these one after another.
Kernel = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], bool], dict[str, np.ndarray | Sequence] | Iterator[dict[str, np.ndarray | Sequence]]]

#: Gets items as a dict of arrays and the pairs to compute as two arrays of places; returns columns with a row an item.
FlatKernel = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], dict[str, np.ndarray | Sequence]]


def block_counts(items: DataFrame, group: str, size: int) -> DataFrame:
    """group, _n, _blocks."""
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.withColumn("_blocks", F.ceil(F.col("_n") / size).cast("int"))


def in_blocks(items: DataFrame, counts: DataFrame, group: str, id_col: str, order: str | None = None) -> DataFrame:
    """group, _block, _blocks, items: arrays sorted by id."""
    placed = lookup(items, counts.withColumn("_k", F.col("_n")), [group], "_k")
    block = F.least(F.floor(F.col(order) * F.col("_blocks")), F.col("_blocks") - 1) if order else F.pmod(F.xxhash64(F.lit(7), id_col), F.col("_blocks"))
    placed = placed.withColumn("_block", block.cast("int"))
    rest = [c for c in items.columns if c not in (group, id_col, order)]
    # A number of partitions of its own: these are few bytes, but each may be much work, so they aren't to be merged.
    placed = placed.repartition(_tasks(items), group, "_block")
    return placed.groupBy(group, "_block").agg(F.first("_blocks").alias("_blocks"), F.array_sort(F.collect_list(F.struct(id_col, *rest))).alias("items"))


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _numpy(items: pa.Array) -> dict[str, np.ndarray]:
    """A struct array's fields; arrays of numbers of equal length become matrices."""
    out = {}
    for k, f in enumerate(items.type):
        column = items.field(k)
        if pa.types.is_list(f.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            out[f.name] = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
        elif pa.types.is_string(f.type):
            out[f.name] = np.array(column.to_pylist(), object)
        else:
            out[f.name] = column.to_numpy(zero_copy_only=False)
    return out


#: Rows of a kernel that are held before they go on.
HELD = 1 << 16


def _run(kernel: Kernel | Callable[[], tuple[Kernel, Callable[[], Iterator[dict]]]], group: str, names: Sequence[str], keyed: bool = True, staged: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_pair, rest = kernel() if staged else (kernel, lambda: iter(()))
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            left, right, same = (batch.column(at[n]) for n in ("left_items", "right_items", "same"))

            def parts() -> Iterator[tuple[int, dict]]:
                for i in range(batch.num_rows):
                    got = of_pair(_numpy(left[i].values), _numpy(right[i].values), same[i].as_py())
                    yield from ((i, part) for part in ([got] if isinstance(got, dict) else got))

            held, n = [], 0
            for i, part in parts():
                held.append((i, part))
                n += len(part[names[0]])
                if n >= HELD:
                    yield _whole(batch.column(at[group]), held, group, names, keyed)
                    held, n = [], 0
            if held:
                yield _whole(batch.column(at[group]), held, group, names, keyed)
        for part in rest():
            yield _whole(None, [(0, part)], group, names, False)

    return run


def _whole(keys: pa.Array | None, held: list[tuple[int, dict]], group: str, names: Sequence[str], keyed: bool) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate([np.asarray(part[n]) for _, part in held])) for n in names]
    if not keyed:
        return pa.RecordBatch.from_arrays(columns, [*names])
    owner = np.repeat([i for i, _ in held], [len(part[names[0]]) for _, part in held])
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), *columns], [group, *names])


#: Pairs of items that the many small groups of a batch are computed with at once.
FLAT = 1_000_000


def _run_flat(flat: FlatKernel, group: str, names: Sequence[str]):
    """Groups of one block, many at once: their items end to end, and the pairs within each group as two arrays of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = (batch.column(batch.schema.get_field_index(n)) for n in (group, "left_items"))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = 0
            while begin < len(sizes):
                pairs = np.cumsum(sizes[begin:] ** 2)
                end = begin + max(1, int(np.searchsorted(pairs, FLAT, "right")))
                n = sizes[begin:end]
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                items = _numpy(lists.slice(begin, end - begin).flatten())
                left = np.repeat(np.arange(n.sum()), np.repeat(n, n))
                opening = np.concatenate([[0], np.cumsum(np.repeat(n, n))[:-1]])
                right = np.arange(len(left)) - np.repeat(opening, np.repeat(n, n)) + np.repeat(np.repeat(first, n), np.repeat(n, n))
                got = flat(items, left, right)
                owner = pa.array(np.repeat(np.arange(begin, end), n))
                yield pa.RecordBatch.from_arrays([keys.take(owner), *(pa.array(np.asarray(got[c])) for c in names)], [group, *names])
                begin = end

    return run


def one_block(items: DataFrame, group: str, id_col: str, flat: FlatKernel, out: str) -> DataFrame:
    """As :func:`pairwise`, for groups that are known to be of one block: one shuffle, and none to count them."""
    kind = items.schema[group].dataType.simpleString()
    rest = [c for c in items.columns if c not in (group, id_col)]
    whole = items.repartition(_tasks(items), group).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(id_col, *rest))).alias("left_items"))
    return whole.mapInArrow(_run_flat(flat, group, [c.strip().split()[0] for c in out.split(",")]), f"{group} {kind}, {out}")


def pairwise(left: DataFrame, right: DataFrame | None, group: str, id_col: str, kernel: Kernel, out: str, size: int = SIZE, half: bool = False, flat: FlatKernel | None = None, keyed: bool = True, order: str | None = None, staged: bool = False) -> DataFrame:
    """group and the kernel's columns (``out`` is their schema) for every pair of blocks of a group.

    ``right`` None stands for ``left`` itself; ``half`` then gives each pair of blocks once. Items with a null group
    are left out; ids must be unique within a group and vectors of equal length. A group of one block meets itself
    where it is, without another shuffle; with ``flat`` (a row an item) many such groups are computed at once.
    Without ``keyed`` the rows don't repeat their group, which is much where a pair is a row; that is for kernels without ``flat``.
    ``order`` names a column, evenly spread over 0 to 1 within a group, along which items are put into blocks instead of by hash.
    With ``staged`` (and without ``keyed``), ``kernel()`` is called once in a task and returns its kernel and a function
    that gives, after all pairs of the task, the parts that the kernel held back.
    """
    kind = left.schema[group].dataType.simpleString()
    names = [c.strip().split()[0] for c in out.split(",")]
    run = lambda met: met.select(group, "same", "left_items", "right_items").mapInArrow(_run(kernel, group, names, keyed, staged), f"{group} {kind}, {out}" if keyed else out)
    left = left.filter(F.col(group).isNotNull())
    counts = block_counts(left, group, size)
    a = in_blocks(left, counts, group, id_col, order)
    if right is None:
        others, b = counts, a
    else:
        right = right.filter(F.col(group).isNotNull())
        others = block_counts(right, group, size)
        b = in_blocks(right, others, group, id_col, order)
    many = F.lit(True) if right is not None else F.col("_blocks") > 1
    to = lambda k: F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias(k)
    lefts = a.filter(many).join(others.select(group, F.col("_blocks").alias("_m")), group).select(group, F.col("_block").alias("_i"), to("_j"), F.col("items").alias("left_items"))
    rights = b.filter(many).join(counts.select(group, F.col("_blocks").alias("_m")), group).select(group, F.col("_block").alias("_j"), to("_i"), F.col("items").alias("right_items"))
    if half:
        lefts, rights = lefts.filter("_i <= _j"), rights.filter("_i <= _j")
    spread = lambda df: df.repartition(_tasks(left), group, "_i", "_j")
    met = spread(lefts).join(spread(rights), [group, "_i", "_j"])
    found = run(met.withColumn("same", (F.col("_i") == F.col("_j")) & F.lit(right is None)))
    if right is None:
        alone = a.filter(F.col("_blocks") == 1)
        if flat:
            few = F.size("items") <= min(size, SIZE)
            found = found.unionByName(alone.filter(few).select(group, F.col("items").alias("left_items")).mapInArrow(_run_flat(flat, group, names), f"{group} {kind}, {out}"))
            alone = alone.filter(~few)
        if not flat or size > SIZE:
            found = found.unionByName(run(alone.select(group, F.lit(True).alias("same"), F.col("items").alias("left_items"), F.col("items").alias("right_items"))))
    return found


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths; rows without length stay 0."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
