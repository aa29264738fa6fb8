"""Tables as the queries use them, and the SQL pieces that mean the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import finite


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(c: str | Column, places: int = 6) -> Column:
    """Rounded; NaN and infinities become null; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < float("inf"), F.round(c, places) + 0.0)


def r6(c: str | Column) -> Column:
    return rounded(c)


def sql6(x: str, places: int = 6) -> str:
    return f"(CASE WHEN isfinite({x}) THEN round({x}, {places}) + 0.0 END)"


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """topic, doc, candidate, score: the greatest finite score of each; deliveries of one row merge."""
    rows = table(spark, folder, "scores").select("topic", "doc", "candidate", finite("score").alias("score"))
    return rows.filter(F.col("score").isNotNull()).groupBy("topic", "doc", "candidate").agg(F.max("score").alias("score"))


SCORES = "scores_ AS (SELECT topic, doc, candidate, max(score) AS score FROM scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """topic, cluster_no, variant_pos, phrase in lower case; the gold phrases of whole topics and of documents."""
    return table(spark, folder, "gold").select("topic", "doc", "cluster_no", "variant_pos", F.lower(F.trim("phrase")).alias("phrase")).filter(F.col("phrase").isNotNull())


GOLD = "gold_ AS (SELECT topic, doc, cluster_no, variant_pos, lower(trim(phrase)) AS phrase FROM gold WHERE phrase IS NOT NULL)"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """topic, id, vec: every vector is a document and a candidate of its topic."""
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("label").alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


VECTORS = "v AS (SELECT label AS topic, vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
