"""Rankings of one document's candidates, and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import null_safe_key
from ..functions.vectors import cosine
from ..session import durable
from .blocks import pairwise

#: The factor of the position bias.
POSITION_FACTOR = 1.2e8


def top(rows: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], n: int = -1, rank: str = "rank") -> DataFrame:
    """Rank from 1 within keys by score, greatest first and nulls last, then ``tie``; the first ``n``, or all for -1."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in tie))
    ranked = rows.withColumn(rank, F.row_number().over(w))
    # The cast comes behind the filter, which the optimiser has to see beside the window to prune early.
    return (ranked if n < 0 else ranked.filter(F.col(rank) <= n)).withColumn(rank, F.col(rank).cast("bigint"))


def embed_rank(candidates: DataFrame, docs: DataFrame, keys: Sequence[str], tie: Sequence[str], n: int = -1) -> DataFrame:
    """Candidates by cosine with their document; ``candidates`` and ``docs`` have vec."""
    both = candidates.join(docs.select(*keys, F.col("vec").alias("_doc")), list(keys))
    return top(both.withColumn("score", cosine(F.col("vec"), F.col("_doc"))).drop("_doc"), keys, "score", tie, n)


def position_factor(start: Column, doc_len: Column) -> Column:
    return F.try_divide(start, doc_len) + F.try_divide(F.lit(POSITION_FACTOR), F.pow(doc_len, 3))


def position_bias(score: Column, start: Column, doc_len: Column) -> Column:
    """(start / length + 1.2e8 / length^3) ln|score|; null for a score of 0 or an empty document."""
    return position_factor(start, doc_len) * F.ln(F.nullif(F.abs(score), F.lit(0.0)))


def first_start_or_end(start: Column, doc_len: Column) -> Column:
    """The first position, or the document's length where a candidate doesn't occur."""
    return F.coalesce(start, doc_len)


def mask_score(similarity: Column) -> Column:
    """How much a document changes when a candidate is masked."""
    return 1 - similarity


def prompt_score(log_p: Column, n_tokens: Column, template: int, start: Column, doc_len: Column) -> Column:
    """A sequence's log likelihood, normalised by its length beyond the template, with the position bias."""
    return log_p / F.pow(n_tokens - template, 0.6) * position_factor(start, doc_len)


def best_by_candidate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The greatest score of each candidate of a document."""
    return rows.groupBy(*keys, "candidate").agg(F.max("score").alias("score"))


def constant_scores(rows: DataFrame, keys: Sequence[str], value: float = 0.5) -> DataFrame:
    """Every distinct candidate with one score, to measure extraction alone."""
    return rows.select(*keys, "candidate").distinct().withColumn("score", F.lit(value))


def fuse_weighted(models: Sequence[tuple[DataFrame, float]], keys: Sequence[str]) -> DataFrame:
    """keys, candidate, score: the weighted sum of scores over the sum of their model and document.

    Candidates of any model take part; null where a model's scores of a document sum to 0.
    """
    rows = None
    for k, (df, weight) in enumerate(models):
        one = df.select(*keys, "candidate", "score", F.lit(k).alias("_m"), F.lit(float(weight)).alias("_w"))
        rows = one if rows is None else rows.unionByName(one)
    totals = rows.groupBy(*keys, "_m").agg(F.sum("score").alias("_sum"))
    safe = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*keys, "_m")]
    shared = rows.alias("r").join(totals.alias("t"), safe).select(*(F.col(f"r.{k}").alias(k) for k in keys), "r.candidate", (F.col("_w") * F.try_divide(F.col("score"), F.col("_sum"))).alias("score"))
    return shared.groupBy(*keys, "candidate").agg(F.sum("score").alias("score"))


def fuse_harmonic(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, candidate, score: the harmonic mean for candidates that both models have; null where the sum is 0."""
    both = a.select(*keys, "candidate", F.col("score").alias("_a")).join(b.select(*keys, "candidate", F.col("score").alias("_b")), [*keys, "candidate"])
    return both.select(*keys, "candidate", F.try_divide(2 * F.col("_a") * F.col("_b"), F.col("_a") + F.col("_b")).alias("score"))


# A document's graph: edges between candidates of different clusters, weighted by nearness of their positions.


def _nearness(left: dict, right: dict) -> np.ndarray:
    gap = np.abs(left["position"][:, None].astype(float) - right["position"][None, :])
    weight = 1 / np.maximum(1, gap)
    return np.where(left["cluster"][:, None] != right["cluster"][None, :], weight, 0.0)


def _edges(left: dict, right: dict, same: bool) -> dict:
    w = _nearness(left, right)
    w = np.where(left["id"][:, None] < right["id"][None, :], w, 0.0)
    i, j = np.nonzero(w)
    return {"a": left["id"][i], "b": right["id"][j], "w": w[i, j]}


def _degrees(left: dict, right: dict, same: bool) -> dict:
    w = _nearness(left, right)
    return {"id": left["id"], "degree": w.sum(axis=1), "neighbours": (w * right["prior"][None, :] / np.maximum(right["degree"], 1e-300)[None, :]).sum(axis=1) if "degree" in right else np.zeros(len(w))}


def _flat_degrees(at: dict, i: np.ndarray, j: np.ndarray) -> dict:
    w = np.where(at["cluster"][i] != at["cluster"][j], 1 / np.maximum(1, np.abs(at["position"][i] - at["position"][j])), 0.0)
    total = lambda v: np.bincount(i, v, minlength=len(at["id"]))
    passed = total(w * at["prior"][j] / np.maximum(at["degree"][j], 1e-300)) if "degree" in at else np.zeros(len(at["id"]))
    return {"id": at["id"], "degree": total(w), "neighbours": passed}


def graph_edges(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """_g, a, b, w for the pairs of positions of a document's different clusters, a before b by id.

    ``positions`` has keys, id (of the position), cluster (an integer) and position.
    """
    items = positions.select(null_safe_key(*keys).alias("_g"), "id", F.col("cluster").cast("bigint").alias("cluster"), F.col("position").cast("bigint").alias("position"))
    return pairwise(items, None, "_g", "id", _edges, "a bigint, b bigint, w double")


def graph_scores(nodes: DataFrame, keys: Sequence[str], damping: float = 0.85, compat: bool = False) -> DataFrame:
    """keys, id, degree, prior, score of a document's candidates.

    ``nodes`` has keys, id, cluster, position and similarity. The prior is (1 - damping) similarity over the document's
    sum of them. A node gains damping times what its neighbours pass on: their priors shared out by edge weight; in
    ``compat`` mode its own prior, if it has an edge.
    """
    g = null_safe_key(*keys).alias("_g")
    items = nodes.select(*keys, g, "id", F.col("cluster").cast("bigint").alias("cluster"), F.col("position").cast("bigint").alias("position"), "similarity")
    total = items.groupBy("_g").agg(F.sum("similarity").alias("_total"))
    items = items.join(total, "_g").withColumn("prior", F.coalesce((1 - damping) * F.try_divide(F.col("similarity"), F.col("_total")), F.lit(0.0)))
    items = durable(items)
    plain = items.select("_g", "id", "cluster", "position", "prior")
    degree = durable(pairwise(plain, None, "_g", "id", _degrees, "id bigint, degree double, neighbours double", flat=_flat_degrees).groupBy("_g", "id").agg(F.sum("degree").alias("degree")))
    known = plain.join(degree, ["_g", "id"])
    if compat:
        post = known.select("_g", "id", "degree", F.when(F.col("degree") > 0, F.col("prior")).otherwise(0.0).alias("_post"))
    else:
        passed = pairwise(durable(known), None, "_g", "id", _degrees, "id bigint, degree double, neighbours double", flat=_flat_degrees).groupBy("_g", "id").agg(F.sum("neighbours").alias("_post"))
        post = degree.join(passed, ["_g", "id"])
    out = items.join(post, ["_g", "id"])
    return out.select(*keys, "id", "degree", "prior", (F.col("prior") + damping * F.col("_post")).alias("score"))


def graph_rebalance(nodes: DataFrame, keys: Sequence[str], alpha: float = 1.1) -> DataFrame:
    """keys, id, gain: what the first candidate of a cluster of several gains on its incoming edges.

    ``nodes`` has keys, id, cluster, position and degree: alpha e^(1 / max(1, position)) times the degrees of the others.
    """
    first = F.min(F.struct("position", "id"))
    clusters = nodes.groupBy(*keys, "cluster").agg(first.alias("_f"), F.sum("degree").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min_by("degree", F.struct("position", "id")).alias("_own"))
    gain = alpha * F.exp(1 / F.greatest(F.lit(1), F.col("_f.position"))) * (F.col("_sum") - F.col("_own"))
    return clusters.filter("_n > 1").select(*keys, F.col("_f.id").alias("id"), gain.alias("gain"))
