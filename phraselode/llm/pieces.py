"""Oversized texts cut at natural boundaries, with overlap.

Method: sorted arrays of the begins and ends of a text's parts and a prefix sum of sizes. From a piece's begin, a
binary search finds the last part that ends under the limit; the next piece begins after it, a step back by the
overlap, at the begin of a word. Where no boundary is near enough, the cut is a hard one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encode as tokens
from .sentences import Corpus, document_units, paragraphs, with_statistics

LIMIT, OVERLAP = 2000, 200
LEVELS = ("paragraph", "sentence", "word", "none")
_WORD = re.compile(r"\S+")

Spans = list[tuple[int, int]]


def char_prefix(text: str) -> Sequence[int]:
    """Sizes up to each offset, in code points."""
    return range(len(text) + 1)


def token_prefix(text: str, path: str = tokens.BYTE_BPE_50K) -> list[int]:
    """Sizes up to each offset, in tokens that begin before it."""
    sizes, at = [0] * (len(text) + 1), 0
    begins = [0]
    for begin, end in zip(b := [*tokens.boundaries(text), len(text)], b[1:]):
        begins.append(begins[-1] + len(tokens.encode(text[begin:end], path)))
        for i in range(begin, end):
            sizes[i] = begins[-2] if i == begin else begins[-1]
        at = begins[-1]
    sizes[len(text)] = at
    return sizes


def spans_at(text: str, level: str, corpus: Corpus | dict[str, int], prefix: Sequence[int], limit: int, overlap: int = 0) -> Spans:
    """The parts of a text at a level. At ``none`` they are the stretches without white space, those above the limit
    cut so that a piece has room for the overlap and the next part."""
    if level == "paragraph":
        return paragraphs(text)
    if level == "sentence":
        return document_units(text, corpus.said if isinstance(corpus, Corpus) else corpus)
    words = [m.span() for m in _WORD.finditer(text)]
    if level == "word":
        return words
    out = []
    for begin, end in words:
        if prefix[end] - prefix[begin] > limit:
            while prefix[end] - prefix[begin] > limit - overlap:
                at = max(begin + 1, min(bisect_right(prefix, prefix[begin] + limit - overlap, begin, end) - 1, end - 1))
                out.append((begin, at))
                begin = at
        out.append((begin, end))
    return out


def coarsest(text: str, corpus: Corpus | dict[str, int], prefix: Sequence[int], limit: int, overlap: int) -> tuple[str, Spans]:
    """The coarsest level at which every part is within the limit, and its parts."""
    for level in LEVELS[:-1]:
        spans = spans_at(text, level, corpus, prefix, limit)
        if all(prefix[b] - prefix[a] <= limit for a, b in spans):
            return level, spans
    return "none", spans_at(text, "none", corpus, prefix, limit, overlap)


def cut(text: str, spans: Spans, prefix: Sequence[int], limit: int, overlap: int) -> Spans:
    """Begin and end of the pieces: each within the limit, each after the first repeating up to ``overlap``.

    Every part is whole in the piece that ends behind it; a repeated stretch begins with a word or, in a stretch
    without white space, anywhere.
    """
    out: Spans = []
    if not spans:
        return out
    ends = [b for _, b in spans]
    word_begins = [m.start() for m in _WORD.finditer(text)]
    begin, k = spans[0][0], 0
    while True:
        last = bisect_right(ends, limit, lo=k, key=lambda e: prefix[e] - prefix[begin]) - 1
        last = max(last, k)
        out.append((begin, ends[last]))
        k = last + 1
        if k == len(spans):
            return out
        after, end = spans[k]
        # Back by the overlap, but not so far that the next part no longer fits.
        floor = max(prefix[ends[last]] - overlap, prefix[end] - limit)
        back = bisect_left(prefix, floor, 0, after)
        at = bisect_left(word_begins, back)
        natural = word_begins[at] if at < len(word_begins) else after
        begin = min(natural, after)
        if begin == after and spans[last][1] == after:
            begin = back  # within a stretch without white space
        begin = max(begin, out[-1][0] + 1) if begin < after else after


def _pieces(limit: int, overlap: int, measure):
    def pieces(text: str, said: dict[str, int]) -> list[tuple]:
        prefix = measure(text)
        if prefix[len(text)] <= limit:
            return []
        level, spans = coarsest(text, said, prefix, limit, overlap)
        return [(k, a, b, level) for k, (a, b) in enumerate(cut(text, spans, prefix, limit, overlap) or [(0, 0)])]

    return pieces


def split_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, measure=char_prefix, corpus: Corpus | None = None) -> DataFrame:
    """``id_col``, part, piece_start, piece_end, boundary: the pieces of every text above the limit.

    Offsets are in code points, the end excluded; ``measure`` says what the limit and the overlap count. Pieces are
    at most ``limit`` long and together hold every character that is no white space between parts. ``boundary`` is
    the coarsest of paragraph, sentence and word at which alone every part fits, or none. Null, empty and short texts
    give no rows; a long text of white space gives one empty piece. Null and repeated ids stay as they are.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    whole = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # No measure counts more than four units for a code point.
    rows = whole.filter(F.length("text") > (limit if measure is char_prefix else limit // 4))
    kinds = {"part": pa.int32(), "piece_start": pa.int64(), "piece_end": pa.int64(), "boundary": pa.string()}
    return with_statistics(rows, whole, corpus, _pieces(limit, overlap, measure), kinds).withColumnRenamed("_id", id_col)
