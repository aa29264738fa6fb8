"""Repetition inside a single document.

Method: n-gram perplexity under a modified Kneser-Ney model, here of the document itself: each letter or digit is
predicted from the ``run`` - 1 before it by what followed them elsewhere in the document, interpolated with the
uniform distribution over all letters and digits. The discounts are estimated for each language from counts of counts
that Spark sums over all documents; contexts and n-grams are 64-bit hashes in sorted arrays. Text that repeats itself
is predicted well, so a lower band of the language rejects its document: the band's limit is what a document with a
third of its characters repeated reaches at least. An exact count of the repeated characters of what is rejected
follows, since a perplexity can't say which characters repeat earlier ones.

The texts of an Arrow batch are laid end to end as code points; polynomial hashes come from prefix sums, seeded by the
document; one sort finds the contexts that occur twice, and only what follows those is sorted again. Every repeated
run is compared with its first occurrence character by character.
:mod:`.perplexity` has the same model over words, of the corpus instead of the document.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .arrow_text import slices, strings
from .perplexity import language

RUN = 30
_ODD = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _lower_alnum() -> np.ndarray:
    """For each code point its lower case, or 0 if that is no letter or digit."""
    if "lower" not in _tables:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            low = chr(i).lower()
            if low[0].isalnum():
                table[i] = ord(low[0])
        _tables["lower"] = table
    return _tables["lower"]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, and behind them those of its inverse."""
    if "powers" not in _tables or _tables["powers"].shape[1] < n:
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _tables["powers"] = np.stack([np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x)])) for x in (_ODD, inverse)])
    return _tables["powers"]


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each value of a sorted array, and the groups' sizes."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.cumsum(new) - 1, np.diff([*np.flatnonzero(new), len(ordered)])


class Runs:
    """The texts of a batch, and the runs of ``run`` letters and digits whose first ``run`` - 1 occur twice in a text."""

    def __init__(self, texts: list[str | None], run: int):
        self.n_texts, self.run = len(texts), run
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = _lower_alnum()[points]
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        kept = chars != 0
        self.chars, self.doc = chars[kept], doc[kept]
        self.total = np.bincount(self.doc, minlength=len(texts))
        self.starts = np.zeros(0, np.int64)
        n = len(self.chars)
        if n < run:
            self.n_runs = np.zeros(len(texts), np.int64)
            return
        starts = np.flatnonzero(self.doc[run - 1 :] == self.doc[: n - run + 1])
        self.n_runs = np.bincount(self.doc[starts], minlength=len(texts))
        with np.errstate(over="ignore"):
            power, inverse = _powers(n + 1)[:, : n + 1]
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.chars.astype(np.uint64) * power[:n], out=sums[1:])

            def hashes(at: np.ndarray, length: int) -> np.ndarray:
                h = (sums[at + length] - sums[at]) * inverse[at]
                h ^= h >> np.uint64(29)
                return (h + self.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)

            contexts = hashes(starts, run - 1)
            order = np.argsort(contexts, kind="stable")
            group, size = _groups(contexts[order])
            again = size[group] > 1
            # Sorted by text position, as the stable sorts below rely on it.
            self.starts = np.sort(starts[order[again]])
            self.contexts, self.grams = hashes(self.starts, run - 1), hashes(self.starts, run)

    def repeated(self) -> np.ndarray:
        """For each text the number of characters in a run that occurred before."""
        none = np.zeros(self.n_texts, np.int64)
        if not len(self.starts):
            return none
        chars, doc, run, n = self.chars, self.doc, self.run, len(self.chars)
        order = np.argsort(self.grams, kind="stable")
        group, size = _groups(self.grams[order])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])[group]
        again = np.arange(len(order)) != first
        if not again.any():
            return none
        at, before = self.starts[order[again]], self.starts[order[first[again]]]
        same = doc[at] == doc[before]
        for k in range(run):
            same &= chars[at + k] == chars[before + k]
        if not same.all():  # different runs with one hash
            return np.array([_plain(chars[doc == d], run) for d in range(self.n_texts)], np.int64)
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + run, -1)
        return np.bincount(doc[np.cumsum(marks[:n]) > 0], minlength=self.n_texts)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text, how many different runs occur 1, 2, 3 and 4 times. And what predicts characters, the character
        itself left out: rows of text, r (times that it follows its context), m (times that anything does), k1, k2, k3
        (characters that follow once, twice, more often); with the number of characters of each row."""
        times = np.stack([self.n_runs, *[np.zeros(self.n_texts, np.int64)] * 3])
        if not len(self.starts):
            return times, np.zeros((0, 6), np.int64), np.zeros(0, np.int64)
        order = np.lexsort((self.grams, self.contexts))
        context, m = _groups(self.contexts[order])
        change = np.ones(len(order), bool)
        change[1:] = (self.grams[order][1:] != self.grams[order][:-1]) | (context[1:] != context[:-1])
        gram, r = np.cumsum(change) - 1, np.diff([*np.flatnonzero(change), len(order)])
        of_gram, owner = context[change], self.doc[self.starts[order]]
        times[0] -= np.bincount(owner, minlength=self.n_texts)
        for k in range(4):
            times[k] += np.bincount(owner[change][r == k + 1], minlength=self.n_texts)
        of = [np.bincount(of_gram[r == k if k < 3 else r >= 3], minlength=len(m)) for k in (1, 2, 3)]
        own = r[gram]
        rows = np.stack([owner, own - 1, m[context] - 1, *(of[k - 1][context] - (own == k if k < 3 else own >= 3) + (own - 1 == k if k < 3 else own - 1 >= 3) for k in (1, 2, 3))], axis=1).astype(np.int64)
        cells, n = np.unique(rows, axis=0, return_counts=True)
        return times, cells, n


def repeated_counts(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its letters and digits, and of those that lie in a run that occurred before."""
    runs = Runs(texts, run)
    return runs.total, runs.repeated()


def _plain(chars: np.ndarray, run: int) -> int:
    """Repeated characters of one document, without hashes."""
    seen: set[bytes] = set()
    marks = np.zeros(len(chars), bool)
    for i in range(len(chars) - run + 1):
        key = chars[i : i + run].tobytes()
        if key in seen:
            marks[i : i + run] = True
        seen.add(key)
    return int(marks.sum())


def _measure(run: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                total, repeated = repeated_counts(strings(batch.column(1)), run)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(repeated, pa.int64())], ["_id", "n_kept", "n_repeated"])

    return measure


def repeated_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``id_col``, n_kept, n_repeated, share: one row for every row of ``docs``.

    n_kept counts the letters and digits; n_repeated those in a run of ``run`` of them, in lower case, that already
    occurred starting earlier in the text, overlap allowed. share is n_repeated / n_kept, and 0 for texts that are
    null or have no letter or digit. Ids may be null or repeated. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_measure(run), f"_id {kind}, n_kept bigint, n_repeated bigint")
    return out.select(F.col("_id").alias(id_col), "n_kept", "n_repeated", F.when(F.col("n_kept") > 0, F.col("n_repeated") / F.col("n_kept")).otherwise(0.0).alias("share"))


_CELL = "struct<r:bigint,m:bigint,k1:bigint,k2:bigint,k3:bigint,n:bigint>"


def _model(run: int):
    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                runs = Runs(strings(batch.column(1)), run)
                times, cells, n = runs.cells()
                offsets = np.searchsorted(cells[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
                fields = [*(pa.array(cells[:, k]) for k in range(1, 6)), pa.array(n.astype(np.int64))]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["r", "m", "k1", "k2", "k3", "n"]))
                counts = [pa.array(x, pa.int64()) for x in (runs.total, runs.repeated(), *times)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *counts, lists], ["_id", "lang", "n_kept", "n_repeated", "n1", "n2", "n3", "n4", "cells"])

    return model


def language_discounts(documents: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: modified Kneser-Ney discounts from how many runs occur 1 to 4 times in their document.

    They stay within (0.75 and 0.95) of 1, (0.75 and 1.75) of 2 and (0.75 and 2.5) of 3: what was met before keeps an
    advantage in every language. Languages are two letters, so there are at most 677 rows.
    """
    n1, n2, n3, n4 = (F.sum(f"n{k}") for k in (1, 2, 3, 4))
    y = F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(1.0))
    raw = [1 - 2 * y * F.try_divide(n2, n1), 2 - 3 * y * F.try_divide(n3, n2), 3 - 4 * y * F.try_divide(n4, n3)]
    of = [F.least(F.greatest(F.coalesce(d, F.lit(0.75)), F.lit(0.75)), F.lit(most)).alias(f"d{k}") for k, d, most in zip((1, 2, 3), raw, (0.95, 1.75, 2.5))]
    return documents.groupBy("lang").agg(*of)


def self_perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", run: int = RUN, share: float = 1 / 3) -> DataFrame:
    """``id_col``, lang, n_kept, n_repeated, share, perplexity, band: one row for every row of ``docs``.

    The perplexity of a text's letters and digits under the model of the text itself, each character left out of the
    counts that predict it. A text with no repeated context has the number V of all letters and digits. band is
    ``low`` up to the language's limit, else ``kept``. A text in which the part ``share`` is repeated has at least
    share / run characters per character that follow a context as they did elsewhere, each predicted with at least
    1 - d1, and the limit is half of what these lower the logarithm by: room for contexts that go on otherwise, of
    which ordinary repetition has one or two for each stretch. n_repeated and its share are as in
    :func:`repeated_share`. Texts that are null or have no letter or digit have a null perplexity and the band
    ``none``. Ids may be null or repeated; a null or unreadable language is ``und``. The text is read once; what is
    written and summed by language are numbers.
    """
    lang = language(F.col(lang_col)) if lang_col else F.lit("und")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    kind = rows.schema["_id"].dataType.simpleString()
    counts = ", ".join(f"{n} bigint" for n in ("n_kept", "n_repeated", "n1", "n2", "n3", "n4"))
    documents = durable(rows.mapInArrow(_model(run), f"_id {kind}, lang string, {counts}, cells array<{_CELL}>"))
    v = float(len(np.unique(_lower_alnum())) - 1)
    known = documents.join(F.broadcast(language_discounts(documents)), "lang")

    def log_p(total: Column, c: Column) -> Column:
        discount = F.when(c["r"] == 1, F.col("d1")).when(c["r"] == 2, F.col("d2")).otherwise(F.col("d3"))
        left = F.col("d1") * c["k1"] + F.col("d2") * c["k2"] + F.col("d3") * c["k3"]
        return total + c["n"] * F.log((F.when(c["r"] > 0, c["r"] - discount).otherwise(0.0) + left / v) / c["m"])

    predicted = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + c["n"])
    out = known.withColumn("_log", (F.aggregate("cells", F.lit(0.0), log_p) - (F.col("n_kept") - predicted) * math.log(v)) / -F.nullif("n_kept", F.lit(0)))
    limit = math.log(v) - F.log(v * (1 - F.col("d1"))) * (share / run / 2)
    band = F.when(F.col("_log").isNull(), "none").when(F.col("_log") <= limit, "low").otherwise("kept")
    part = F.when(F.col("n_kept") > 0, F.col("n_repeated") / F.col("n_kept")).otherwise(0.0)
    return out.select(F.col("_id").alias(id_col), "lang", "n_kept", "n_repeated", part.alias("share"), F.exp("_log").alias("perplexity"), band.alias("band"))
