"""Rankings of a topic's candidates from those of its documents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import null_safe_key
from ..session import durable
from .blocks import pairwise, units
from .rank_doc import POSITION_FACTOR
from .ranking import HOT_VALUES, count_above, hot_groups

#: ``k`` of reciprocal rank fusion.
RRF_K = 60
#: Length in tokens that a document counts as where a candidate doesn't occur in it.
MISSING_LENGTH = 256


def aggregate_scores(scores: DataFrame, how: str) -> DataFrame:
    """topic, candidate, score, n_docs: the mean or maximum over the documents that have the candidate."""
    of = {"mean": F.avg, "max": F.max}[how]
    return scores.groupBy("topic", "candidate").agg(of("score").alias("score"), F.count("score").alias("n_docs"))


def mean_of_top_half(scores: DataFrame, hot_rows: int = HOT_VALUES) -> DataFrame:
    """topic, candidate, score, n_docs: the mean of the scores that reach the candidate's median.

    The median lies between the middle values where their number is even. A candidate with more than ``hot_rows``
    scores has it from counts of greater values, so no task holds all of its scores.
    """
    rows = scores.filter(F.col("score").isNotNull()).select("topic", "candidate", "score").withColumn("_g", null_safe_key("topic", "candidate"))
    hot = hot_groups(rows, "_g", hot_rows)
    whole = Window.partitionBy("topic", "candidate")
    cold = rows if hot is None else rows.join(F.broadcast(hot), "_g", "left_anti")
    upper = cold.withColumn("_median", F.expr("percentile(score, 0.5)").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    out = upper.groupBy("topic", "candidate").agg(F.avg(F.when(F.col("score") >= F.col("_median"), F.col("score"))).alias("score"), F.max("_n").alias("n_docs"))
    if hot is None:
        return out
    counts = durable(rows.join(F.broadcast(hot), "_g", "left_semi").groupBy("topic", "candidate", "_g", "score").agg(F.count(F.lit(1)).alias("_c")))
    above = count_above(counts, "_g", "score", "_c", hot_rows)
    # One row for each hot candidate from here on: they are broadcast.
    sizes = F.broadcast(counts.groupBy("_g").agg(F.sum("_c").alias("_n")))
    covers = lambda p: (F.col("above") <= p) & (p < F.col("above") + F.col("_c"))
    middle = lambda p: F.max(F.when(covers(p), F.col("score")))
    medians = above.join(sizes, "_g").groupBy("_g").agg(((middle(F.floor((F.col("_n") - 1) / 2)) + middle(F.floor(F.col("_n") / 2))) / 2).alias("_median"), F.max("_n").alias("_n"))
    upper = counts.join(F.broadcast(medians), "_g").filter(F.col("score") >= F.col("_median"))
    return out.unionByName(upper.groupBy("topic", "candidate").agg((F.sum(F.col("score") * F.col("_c")) / F.sum("_c")).alias("score"), F.max("_n").alias("n_docs")))


def average_rank(scores: DataFrame, keys: Sequence[str], score: str = "score") -> Column:
    """Rank by score, greatest first, ties sharing their mean and nulls last and tied."""
    by_score = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last())
    return F.rank().over(by_score) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, score)) - 1) / 2


def reciprocal_rank_fusion(scores: DataFrame, k: int = RRF_K) -> DataFrame:
    """topic, candidate, score: the sum of 1 / (k + rank) over all documents of the topic.

    A document's ranks go on to the topic's candidates it doesn't have: these share the mean of the last ranks. That
    mean depends on the document alone, so it is summed over the topic once and corrected for the documents that have
    the candidate; the candidates aren't crossed with the documents.
    """
    ranked = scores.withColumn("_rank", average_rank(scores, ["topic", "doc"]))
    n = scores.groupBy("topic").agg(F.countDistinct("candidate").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    docs = scores.groupBy("topic", "doc").agg(F.count(F.lit(1)).alias("_has"))
    safe = docs.join(n.select("topic", "_all"), "topic")
    last = F.lit(1.0) / (k + F.col("_has") + (F.col("_all") - F.col("_has") + 1) / 2)
    safe = safe.withColumn("_last", F.when(F.col("_all") > F.col("_has"), last).otherwise(0.0))
    topics = safe.groupBy("topic").agg(F.sum("_last").alias("_everywhere"))
    own = ranked.join(safe.select("topic", "doc", "_last"), ["topic", "doc"]).groupBy("topic", "candidate").agg(F.sum(F.lit(1.0) / (k + F.col("_rank")) - F.col("_last")).alias("_own"))
    return own.join(topics, "topic").select("topic", "candidate", (F.col("_own") + F.col("_everywhere")).alias("score"))


def incidence(candidates: DataFrame, by_mentions: bool = False) -> DataFrame:
    """topic, candidate, n: the number of documents that list the candidate, or the number of its mentions."""
    n = F.sum("n_mentions") if by_mentions else F.countDistinct("doc")
    return candidates.groupBy("topic", "candidate").agg(n.cast("bigint").alias("n"))


def missing_candidates(scores: DataFrame, doc: str) -> DataFrame:
    """topic, candidate: the topic's candidates that one document doesn't have."""
    own = scores.filter(F.col("doc") == doc).select("topic", "candidate").distinct()
    every = scores.select("topic", "candidate").distinct().join(own.select("topic").distinct(), "topic", "left_semi")
    return every.join(own, ["topic", "candidate"], "left_anti")


# Vectors: items have topic, id and vec.


def _similarity(least: float | None):
    def kernel(left: dict, right: dict, same: bool) -> dict:
        sim = units(left["vec"]) @ units(right["vec"]).T
        above = (sim > least).sum(axis=1) if least is not None else np.zeros(len(sim), np.int64)
        return {"id": left["id"], "total": sim.sum(axis=1), "most": sim.max(axis=1), "above": above.astype(np.int64), "n": np.full(len(sim), sim.shape[1], np.int64)}

    return kernel


def similarity_to_documents(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """topic, id, mean, most: of the cosines of a candidate with every document of its topic."""
    found = pairwise(candidates, docs, "topic", "id", _similarity(None), "id bigint, total double, most double, above bigint, n bigint")
    return found.groupBy("topic", "id").agg((F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"))


def _representative(least: float):
    def kernel(left: dict, right: dict, same: bool) -> dict:
        sim = units(left["vec"]) @ units(right["vec"]).T
        if same:
            np.fill_diagonal(sim, 0.0)
        return {"id": left["id"], "above": (sim > least).sum(axis=1).astype(np.int64), "n": np.full(len(sim), sim.shape[1], np.int64)}

    return kernel


def _diversity(left: dict, right: dict, same: bool) -> dict:
    sim = units(left["vec"]) @ units(right["vec"]).T
    if same:
        np.fill_diagonal(sim, 0.0)
    denser = right["rep"][None, :] > left["rep"][:, None]
    return {"id": left["id"], "most": np.where(denser, sim, -np.inf).max(axis=1), "least": sim.min(axis=1)}


def density_diversity(items: DataFrame, least: float = 0.22) -> DataFrame:
    """topic, id, rep, div, score: density is the share of similarities above ``least``, an item's own counting as 0.

    Diversity is 1 less the greatest similarity to a denser item (at least 0), or 1 less the smallest similarity where
    none is denser; 0 becomes 1e-10. The score is ln density + ln diversity, null where the density is 0.
    """
    rep = durable(pairwise(items, None, "topic", "id", _representative(least), "id bigint, above bigint, n bigint").groupBy("topic", "id").agg((F.sum("above") / F.sum("n")).alias("rep")))
    known = items.join(rep, ["topic", "id"])
    found = pairwise(known, None, "topic", "id", _diversity, "id bigint, most double, least double").groupBy("topic", "id").agg(F.max("most").alias("_most"), F.min("least").alias("_least"))
    div = F.when(F.col("_most") > float("-inf"), 1 - F.greatest(F.col("_most"), F.lit(0.0))).otherwise(1 - F.col("_least"))
    out = rep.join(found, ["topic", "id"]).withColumn("div", F.when(F.abs(div) < 1e-12, 1e-10).otherwise(div))
    return out.select("topic", "id", "rep", "div", (F.ln(F.nullif("rep", F.lit(0.0))) + F.ln("div")).alias("score"))


def _logs(left: dict, right: dict, same: bool) -> dict:
    sim = np.abs(units(left["vec"]) @ units(right["vec"]).T)
    logs = np.log(np.where(sim > 0, sim, 1.0))
    return {"id": left["id"], "total": logs.sum(axis=1), "n": np.full(len(sim), sim.shape[1], np.int64)}


def filled_mean(candidates: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """topic, id, score, n_docs: the mean score over all documents of the topic.

    A document without the candidate counts (1 + 1.2e8 / 256^3) ln|cosine|. The sum of that over all documents comes
    from blocks; the documents that have the candidate (``scores``: topic, id, doc_id, score) then replace their part.
    """
    from ..functions.vectors import cosine

    factor = 1 + POSITION_FACTOR / MISSING_LENGTH**3
    every = pairwise(candidates, docs, "topic", "id", _logs, "id bigint, total double, n bigint").groupBy("topic", "id").agg(F.sum("total").alias("_total"), F.sum("n").alias("n_docs"))
    have = scores.join(candidates.select("topic", "id", F.col("vec").alias("_c")), ["topic", "id"]).join(docs.select("topic", F.col("id").alias("doc_id"), F.col("vec").alias("_d")), ["topic", "doc_id"])
    replaced = F.coalesce(F.ln(F.nullif(F.abs(cosine(F.col("_c"), F.col("_d"))), F.lit(0.0))), F.lit(0.0))
    fixed = have.groupBy("topic", "id").agg(F.sum(F.col("score") - factor * replaced).alias("_fix"))
    out = every.join(fixed, ["topic", "id"], "left")
    return out.select("topic", "id", ((factor * F.col("_total") + F.coalesce("_fix", F.lit(0.0))) / F.col("n_docs")).alias("score"), "n_docs")
