"""Embedders of texts, and vectors of candidates from those of tokens and mentions.

Models are plugged in as functions from texts to vectors. The default hashes character n-grams: it needs no weights,
is the same everywhere, and near spellings get near vectors; it stands in for a trained model, it doesn't equal one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_vectors
from .blocks import units

Embedder = Callable[[Sequence[str]], np.ndarray]


def hash_embedder(dimensions: int = 64, n: int = 3) -> Embedder:
    """Signed counts of hashed character n-grams, of unit length."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        # All texts end to end, with spaces around each; n-grams that reach into the next text are left out.
        padded = [f" {t.lower()} ".ljust(n) for t in texts]
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(p) for p in padded], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        count = len(points) - n + 1
        if count < 1:
            return np.zeros((len(texts), dimensions))
        h = np.zeros(count, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ points[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        whole = owner[:count] == owner[n - 1 : n - 1 + count]
        h, at = h[whole], owner[:count][whole]
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        cells = at * dimensions + ((h >> np.uint64(7)) % np.uint64(dimensions)).astype(np.int64)
        return units(np.bincount(cells, sign, minlength=len(texts) * dimensions).reshape(len(texts), dimensions))

    return embed


def embed(text: Column, embedder: Embedder | None = None, batch: int = 256) -> Column:
    """The vectors of a column of texts; null for null. Within a task texts go to the model by length, ``batch`` at a time."""
    model = embedder or hash_embedder()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = [None] * len(texts)
            order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: -len(texts.iloc[i]))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                for i, v in zip(part, model([texts.iloc[i] for i in part])):
                    out[i] = v
            yield pd.Series(out)

    return run(text)


def embed_mean(forms: Column, embedder: Embedder | None = None) -> Column:
    """The mean vector of an array of texts; null for a null array or one without texts. Each distinct text of a batch is embedded once."""
    model = embedder or hash_embedder()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            texts = [[] if x is None else [t for t in x if t is not None] for x in lists]
            known = {t: k for k, t in enumerate(dict.fromkeys(t for x in texts for t in x))}
            if not known:
                yield pd.Series([None] * len(lists))
                continue
            names = sorted(known, key=len)
            vectors = np.concatenate([model(names[k : k + 256]) for k in range(0, len(names), 256)])
            place = {t: k for k, t in enumerate(names)}
            yield pd.Series([vectors[[place[t] for t in x]].mean(axis=0) if x else None for x in texts])

    return run(forms)


def embed_mentions(candidates: DataFrame, keys: Sequence[str], embedder: Embedder | None = None) -> DataFrame:
    """keys, candidate, vec: the mean vector of a candidate's distinct surface forms; candidates without one are left out."""
    forms = candidates.groupBy(*keys, "candidate").agg(F.array_distinct(F.flatten(F.collect_set("mentions"))).alias("_forms"))
    return forms.select(*keys, "candidate", embed_mean(F.col("_forms"), embedder).alias("vec")).filter("vec IS NOT NULL")


def embed_in_context(spans: DataFrame, token_vectors: DataFrame, keys: Sequence[str], out_of_context: DataFrame, edges: bool = False) -> DataFrame:
    """keys, candidate, vec: the mean over a candidate's occurrences of the mean of their tokens' vectors.

    ``spans`` has keys, candidate, start and n (tokens); ``token_vectors`` keys, tok and vec; a candidate without an
    occurrence has its vector from ``out_of_context`` (keys, candidate, vec). ``edges`` adds the document's first and
    last token to every occurrence.
    """
    tokens = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("tok")
    places = spans.filter("n > 0").select(*keys, "candidate", F.col("start").alias("_at"), tokens)
    if edges:
        ends = token_vectors.groupBy(*keys).agg(F.min("tok").alias("_first"), F.max("tok").alias("_last"))
        each = spans.filter("n > 0").join(ends, list(keys))
        places = places.unionByName(each.select(*keys, "candidate", F.col("start").alias("_at"), F.explode(F.array("_first", "_last")).alias("tok")))
    found = mean_vectors(places.join(token_vectors, [*keys, "tok"]), [*keys, "candidate", "_at"])
    inside = mean_vectors(found, [*keys, "candidate"])
    return out_of_context.withColumnRenamed("vec", "_out").join(inside, [*keys, "candidate"], "left").select(*keys, "candidate", F.coalesce("vec", "_out").alias("vec"))


def in_and_out_of_context(inside: DataFrame, outside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, candidate, vec: the mean of both vectors, or the one there is."""
    return mean_vectors(inside.select(*keys, "candidate", "vec").unionByName(outside.select(*keys, "candidate", "vec")), [*keys, "candidate"])


def global_attention(n_tokens: Column, mentions: Column, every: int | None = None) -> Column:
    """An array of 0 and 1 for each token: 1 at the tokens of mentions, and at every so many tokens."""
    index = F.sequence(F.lit(0), n_tokens - 1)
    on = lambda i: F.array_contains(mentions, i) | (F.pmod(i, F.lit(every)) == 0 if every else F.lit(False))
    return F.when(n_tokens > 0, F.transform(index, lambda i: on(i).cast("int"))).otherwise(F.array().cast("array<int>"))
