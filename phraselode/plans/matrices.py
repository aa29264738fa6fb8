"""Queries on similarity matrices and embedders. Iterations and greedy choices have no SQL; tests hold them against NumPy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import embedding, rank_doc, rank_matrix
from ..session import spread
from .tables import r6, table, vectors


def topic_mmr_rank(spark: SparkSession, folder: str) -> DataFrame:
    return rank_matrix.mmr(vectors(spark, folder), 10).withColumn("score", r6("score"))


def topic_mmr_scores_rank(spark: SparkSession, folder: str) -> DataFrame:
    """MMR with a relevance from document scores."""
    rows = vectors(spark, folder)
    scores = rows.select("topic", "id", (-F.abs(F.element_at("vec", 1))).alias("score"))
    return rank_matrix.mmr_by_scores(rows, scores, 10).withColumn("score", r6("score"))


def topic_maxsum(spark: SparkSession, folder: str) -> DataFrame:
    return rank_matrix.max_sum(vectors(spark, folder)).withColumn("score", r6("score"))


def topic_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return rank_matrix.affinity_ranking(vectors(spark, folder)).withColumn("score", r6("score"))


def topic_eigen(spark: SparkSession, folder: str) -> DataFrame:
    return rank_matrix.eigen_centrality(vectors(spark, folder)).withColumn("score", r6("score"))


def topic_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity and common documents together; a vector's documents are its two largest dimensions."""
    rows = vectors(spark, folder)
    places = F.slice(F.sort_array(F.transform("vec", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), False), 1, 2)
    incidence = rows.select("topic", "id", F.array_sort(F.transform(places, lambda s: s["i"])).alias("docs"))
    return rank_matrix.co_ranking(rows, incidence).withColumn("score", r6("score"))


def topic_cluster_medoid(spark: SparkSession, folder: str) -> DataFrame:
    return rank_matrix.cluster_medoids(vectors(spark, folder))


def topic_component_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters among two principal components."""
    return rank_matrix.cluster_medoids(vectors(spark, folder), 0.95, components=2)


def whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return rank_matrix.whitened(vectors(spark, folder)).select("topic", "id", F.transform("vec", r6).alias("vec"))


def embedrank_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by the cosine of their mentions' mean vector with their document's."""
    docs = spread(table(spark, folder, "documents").select("topic", "doc", "text").filter("text IS NOT NULL")).select("topic", "doc", embedding.embed(F.col("text")).alias("vec"))
    rows = table(spark, folder, "candidates").filter("candidate IS NOT NULL").select("topic", "doc", "candidate", "mentions")
    ranked = rank_doc.embed_rank(embedding.embed_mentions(rows, ["topic", "doc"]), docs, ["topic", "doc"], ["candidate"], 15)
    return ranked.select("topic", "doc", "candidate", r6("score").alias("score"), "rank")


def mask_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by how much their document changes when they are masked."""
    from ..operators.masking import mask_all

    docs = table(spark, folder, "documents").select("topic", "doc", F.lower("text").alias("text")).filter("text IS NOT NULL")
    rows = table(spark, folder, "candidates").select("topic", "doc", F.lower(F.trim("candidate")).alias("candidate")).filter("length(candidate) > 2").distinct().join(docs, ["topic", "doc"]).filter(F.contains("text", F.col("candidate")))
    masked = rows.withColumn("vec", embedding.embed(mask_all(F.col("text"), F.col("candidate"))))
    whole = docs.withColumn("_doc", embedding.embed(F.col("text"))).drop("text")
    scored = masked.join(whole, ["topic", "doc"]).withColumn("score", rank_doc.mask_score(vec.cosine(F.col("vec"), F.col("_doc"))))
    return rank_doc.top(scored, ["topic", "doc"], "score", ["candidate"], 15).select("topic", "doc", "candidate", r6("score").alias("score"), "rank")


def mask_highest(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by the occurrence whose masking changes the document most."""
    from ..operators.masking import mask_each

    docs = table(spark, folder, "documents").select("topic", "doc", F.lower("text").alias("text")).filter("text IS NOT NULL")
    rows = table(spark, folder, "candidates").select("topic", "doc", F.lower(F.trim("candidate")).alias("candidate")).filter("length(candidate) > 2").distinct().join(docs, ["topic", "doc"]).filter(F.contains("text", F.col("candidate")))
    each = rows.select("topic", "doc", "candidate", F.explode(mask_each(F.col("text"), F.col("candidate"))).alias("text"))
    whole = docs.withColumn("_doc", embedding.embed(F.col("text"))).drop("text")
    masked = each.withColumn("vec", embedding.embed(F.col("text"))).join(whole, ["topic", "doc"])
    least = masked.groupBy("topic", "doc", "candidate").agg(F.min(vec.cosine(F.col("vec"), F.col("_doc"))).alias("_s"))
    scored = least.withColumn("score", rank_doc.mask_score(F.col("_s")))
    return rank_doc.top(scored, ["topic", "doc"], "score", ["candidate"], 15).select("topic", "doc", "candidate", r6("score").alias("score"), "rank")


def embedding_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How the vectors of candidates and of their mentions agree: the number and the spread of cosines by topic."""
    rows = table(spark, folder, "candidates").filter("candidate IS NOT NULL AND size(mentions) > 0").select("topic", "doc", "candidate", "mentions")
    inside = embedding.embed_mentions(rows, ["topic", "doc"])
    outside = rows.select("candidate").distinct().withColumn("_out", embedding.embed(F.col("candidate")))
    cosines = inside.join(outside, "candidate").select("topic", vec.cosine(F.col("vec"), F.col("_out")).alias("c"))
    return cosines.groupBy("topic").agg(F.count("c").alias("n"), r6(F.min("c")).alias("least"), r6(F.avg("c")).alias("mean"), r6(F.max("c")).alias("most"))


_ALL = (topic_mmr_rank, topic_mmr_scores_rank, topic_maxsum, topic_pagerank, topic_affinity, topic_eigen, topic_cluster_medoid, topic_component_clusters, whitened_vectors, embedrank_mentions, mask_rank, mask_highest, embedding_agreement)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {}
