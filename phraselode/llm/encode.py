"""Encoding of a corpus with a public byte-level tokenizer.

Method: overlapping chunk encoding. A long text is cut into chunks that overlap; every chunk is pre-tokenised
by itself, in parallel; two neighbours are stitched at the first pre-token boundary that both have in their
overlap and where the pre-tokeniser resynchronises: where a run of letters, digits or other marks ends, every parse
has a boundary, wherever it began. Then the pieces between the stitches are encoded. A text that fits into one chunk
is one piece and needs no stitch. Chunks whose overlap has no such boundary (a run of one kind of character longer
than the overlap) are one piece together, so the ids are exact in every case. Copies of a chunk merge where they are
read, before anything is pre-tokenised.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import spread_lookup
from ..session import durable
from .arrow_text import slices, strings

#: Where the vocabulary files of public tokenizers lie, on every executor.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that this public vocabulary's pre-tokeniser uses.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# No alternative of the pattern goes on behind letters but with letters, behind digits but with digits, or from other
# marks to white space: such a place is a boundary of every parse.
RESYNC = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=\s)"

CHUNK, OVERLAP = 8192, 512
#: Copies of one long text whose rows a task gets.
COPIES = 1000

_loaded: dict[str, object] = {}


def tokenizer(path: str = BYTE_BPE_50K):
    """The encoder of a rank file, loaded once a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("phraselode", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encode(text: str | None, path: str = BYTE_BPE_50K) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    return np.asarray(tokenizer(path).encode_to_numpy(text, disallowed_special=()), dtype=np.int32)


def decode(ids, path: str = BYTE_BPE_50K) -> str:
    """Concatenates the raw bytes of the ids."""
    return tokenizer(path).decode_bytes([int(i) for i in ids]).decode("utf-8", "replace")


def _compiled(pattern: str):
    if pattern not in _loaded:
        import regex

        _loaded[pattern] = regex.compile(pattern)
    return _loaded[pattern]


def boundaries(text: str) -> list[int]:
    """Where the text's pre-tokens begin."""
    return [m.start() for m in _compiled(PATTERN).finditer(text)]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def _with_ids(path: str, keep: list[str]):
    """Replaces the text of each row by its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [encode(t, path) for t in strings(batch.column(batch.schema.get_field_index("text")))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), _lists(ids)], [*keep, "ids"])

    return run


def _chunks(chunk: int, overlap: int):
    """Cuts each text into overlapping chunks: key, number, offset, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                for few in itertools.batched(enumerate(range(0, len(text), chunk)), 64):
                    columns = [pa.array([key] * len(few), pa.binary()), pa.array([k for k, _ in few], pa.int32()), pa.array([s for _, s in few], pa.int64()), pa.array([text[s : s + chunk + overlap] for _, s in few])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "chunk", "begin", "text"])

    return run


def _seams(chunk: int, overlap: int):
    """Pre-tokenises each chunk; keeps the resynchronising boundaries in its first and last ``overlap`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            heads, tails = [], []
            for begin, text in zip(at["begin"].to_pylist(), strings(at["text"])):
                own = set(boundaries(text))
                found = lambda low, high: [begin + m.start() for m in _compiled(RESYNC).finditer(text, low, min(high + 1, len(text))) if m.start() in own and m.start() < high]  # noqa: B023, E731
                heads.append(found(0, overlap)), tails.append(found(chunk - 1, chunk + overlap))
            yield pa.RecordBatch.from_arrays([at["key"], at["chunk"], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["key", "chunk", "head", "tail"])

    return run


def _encode_parts(path: str):
    """Cuts each chunk's text to its own part, from the stitch behind it to the one before it, or where the next chunk
    begins. A part that is a piece is encoded, others keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                at = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
                own = [t[f - b : e - b] for t, b, f, e in zip(strings(at["text"]), *(at[n].to_pylist() for n in ("begin", "cut_from", "cut_to")))]
                alone = [n == 1 for n in at["in_piece"].to_pylist()]
                ids = _lists([encode(t if x else None, path) for t, x in zip(own, alone)])
                yield pa.RecordBatch.from_arrays([at["key"], at["n"], at["piece"], at["chunk"], ids, pa.array([None if x else t for t, x in zip(own, alone)], pa.string())], ["key", "n", "piece", "chunk", "ids", "text"])

    return run


def _assemble(path: str):
    """The ids of each text from its parts in order; parts of one piece that have texts are joined and encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lists = [], batch.column(2)
            for i in range(batch.num_rows):
                parts = lists[i].values
                pieces, ids, texts, done = parts.field("piece").to_pylist(), parts.field("ids"), strings(parts.field("text")), []
                begin = 0
                for end in range(1, len(pieces) + 1):
                    if end == len(pieces) or pieces[end] != pieces[begin]:
                        done.append(ids[begin].values.to_numpy() if texts[begin] is None else encode("".join(texts[begin:end]), path))
                        begin = end
                out.append(np.concatenate(done))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(out)], ["key", "n", "ids"])

    return run


def _long_texts(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """key, ids, n for rows of key, text; a key may come ``n`` times, always with the same text."""
    cut_up = rows.mapInArrow(_chunks(chunk, overlap), "key binary, chunk int, begin bigint, text string").filter("key IS NOT NULL AND chunk IS NOT NULL")
    # Read twice, shuffled once: both readers take all columns, so that the second reuses the exchange.
    chunks = cut_up.groupBy("key", "chunk").agg(F.first("begin").alias("begin"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    seams = chunks.mapInArrow(_seams(chunk, overlap), "key binary, chunk int, head array<bigint>, tail array<bigint>")
    by_doc = Window.partitionBy("key").orderBy("chunk")
    cuts = (
        seams.withColumn("stitch", F.array_min(F.array_intersect("tail", F.lead("head").over(by_doc))))
        .withColumn("before", F.lag("stitch").over(by_doc))
        .withColumn("piece", F.count("before").over(by_doc))
        .withColumn("in_piece", F.count(F.lit(1)).over(Window.partitionBy("key", "piece")))
        .select("key", "chunk", "piece", "in_piece", F.coalesce("before", F.col("chunk").cast("bigint") * chunk).alias("cut_from"), F.coalesce("stitch", (F.col("chunk").cast("bigint") + 1) * chunk).alias("cut_to"))
    )
    parts = chunks.join(cuts, ["key", "chunk"]).mapInArrow(_encode_parts(path), "key binary, n bigint, piece bigint, chunk int, ids array<int>, text string")
    # Parts of pieces of several chunks are rare, and the only texts that are shuffled again.
    gathered = parts.groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", "piece", "ids", "text"))).alias("parts"))
    return gathered.mapInArrow(_assemble(path), "key binary, n bigint, ids array<int>")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K, chunk: int = CHUNK, overlap: int = OVERLAP, copies: int = COPIES) -> DataFrame:
    """``id_col``, ids: one row for every row of ``docs``, in no order.

    Null and empty texts have the empty list. Null and repeated ids stay as they are. Other columns of ``docs``
    are not read. No special tokens; their strings in a text are ordinary text. Copies of a text longer than
    ``chunk`` are encoded once; a task puts the ids to at most about ``copies`` of its rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    of_type = rows.schema["_id"].dataType.simpleString()
    is_long: Column = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(_with_ids(path, ["_id"]), f"_id {of_type}, ids array<int>")
    # A long text is known by its digest: its rows join the result again.
    long = rows.filter(is_long).withColumn("key", F.unhex(F.sha2("text", 256)))
    # Written once: both the join and the search for texts with many copies read it.
    encoded = durable(_long_texts(long.select("key", "text"), path, chunk, overlap))
    out = short.unionByName(spread_lookup(long.select("_id", "key"), encoded, ["key"], "n", copies).select("_id", "ids"))
    return out.select(F.col("_id").alias(id_col), "ids")


__all__ = ["BYTE_BPE_50K", "PATTERN", "boundaries", "decode", "encode", "encode_documents"]
