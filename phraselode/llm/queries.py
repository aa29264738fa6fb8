"""The queries of this package, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import borda, copies, encode, frequency, packing, perplexity, pieces, repetition, sentences, topk


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _record_tuples(spark: SparkSession, folder: str) -> DataFrame:
    return copies.tuples_of(
        {
            "candidates": copies.record_tuples(_table(spark, folder, "candidates"), "cand_id", exact=["topic", "doc", "first_start", "first_end", "n_mentions"], by_words=["candidate"], sets=["mentions"], required=["candidate"]),
            "gold": copies.record_tuples(_table(spark, folder, "gold"), "gold_id", exact=["topic", "doc"], by_words=["phrase"], required=["phrase"]),
            "topic_runs": copies.record_tuples(_table(spark, folder, "topic_runs"), "run_id", json_fields=["payload"], required=["payload"]),
        }
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(_record_tuples(spark, folder))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_groups(_record_tuples(spark, folder)).select("kind", "first_id", "copies")


_SCORES = ["semantic_score", "moran_i", "getisord_g", "n"]


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return borda.borda_points(_table(spark, folder, "results"), ["experiment", "topic"], "result_id", "loaded_at", _SCORES)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return borda.borda_leaders(_points(spark, folder), ["experiment", "topic"], "result_id", 5, least=40).select("experiment", "topic", "result_id")


def p2_points(spark: SparkSession, folder: str) -> DataFrame:
    return _points(spark, folder).withColumn("points", F.round("points", 9))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, what = _table(spark, folder, "incidence"), ("candidate", "n", ["topic", "doc"])
    counts = frequency.marked(frequency.term_counts(rows, *what), frequency.record_count(rows, *what))
    return counts.filter(F.col("mark").isNotNull()).select("term", "mark")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_counts(_table(spark, folder, "incidence"), "candidate", "n", ["topic", "doc"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    results = topk.top_items(_table(spark, folder, "results"), ["experiment", "topic"], "semantic_score", "candidate", "result_id", "loaded_at", 10)
    scores = topk.top_items(_table(spark, folder, "scores"), ["topic", "doc"], "score", "candidate", "score_id", "loaded_at", 3)
    return results.select(F.lit("results").alias("kind"), "topic", F.col("experiment").alias("grp"), F.col("result_id").alias("item_id")).unionByName(
        scores.select(F.lit("scores").alias("kind"), "topic", F.col("doc").alias("grp"), F.col("score_id").alias("item_id"))
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(_table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_texts(_table(spark, folder, "documents")).filter("part = 0").select("doc_id", "boundary")


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_texts(_table(spark, folder, "documents"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_documents(_table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = encode.encode_documents(_table(spark, folder, "documents")).select("doc_id", F.size("ids").alias("n_tokens"))
    return packing.fill_containers(sizes, "doc_id", "n_tokens", 2048)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """What the language's lower band of perplexity rejects, and then has a third of its characters repeated by exact count."""
    judged = repetition.self_perplexity(_table(spark, folder, "documents"), share=1 / 3)
    return judged.filter((F.col("band") == "low") & (F.col("share") >= 1 / 3)).select("doc_id")


def p10_share(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repeated_share(_table(spark, folder, "documents"))


def p10_bands(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.self_perplexity(_table(spark, folder, "documents")).withColumns({c: F.round(c, 6) for c in ("share", "perplexity")})


def p10_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.document_perplexity(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_points, p3_found, p3_counts, p4_found, p6_found, p7_found, p7_pieces, p8_ids, p9_containers, p10_found, p10_share, p10_bands, p10_perplexity)}

_CELLS = "(SELECT topic, doc, candidate AS term, sum(n) AS n FROM (SELECT DISTINCT topic, doc, candidate, n FROM incidence WHERE candidate IS NOT NULL AND n >= 1) GROUP BY 1, 2, 3)"

_BEST = """SELECT '{t}' AS kind, topic, {g} AS grp, item_id FROM (
  SELECT topic, {g}, {i} AS item_id, row_number() OVER (PARTITION BY topic, {g} ORDER BY {s} DESC, candidate, {i}) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY {i} ORDER BY loaded_at DESC) AS newest FROM {t} WHERE {s} IS NOT NULL AND NOT isnan({s})) WHERE newest = 1) WHERE place <= {n}"""

_ITEMS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) AS newest FROM results) WHERE newest = 1)"


def _share(score: str) -> str:
    v = f"CASE WHEN isnan(CAST({score} AS DOUBLE)) THEN NULL ELSE CAST({score} AS DOUBLE) END"
    w = f"PARTITION BY experiment, topic, ({v}) IS NULL ORDER BY {v} DESC"
    m = f"count({v}) OVER (PARTITION BY experiment, topic)"
    c = f"count(*) OVER (PARTITION BY experiment, topic, {v})"
    return f"CASE WHEN ({v}) IS NULL THEN 0.5 ELSE ({m} - rank() OVER ({w}) + 1 - {c} / 2.0) / {m} END"


_POINTS = f"SELECT experiment, topic, result_id, count(*) OVER (PARTITION BY experiment, topic) AS n_items, {' + '.join(_share(s) for s in _SCORES)} AS points FROM {_ITEMS}"

_KEPT = r"""k AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, i, substring(t, i, 30) AS s FROM (SELECT doc_id, t, CAST(unnest(range(1, length(t) - 28)) AS BIGINT) AS i FROM k)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, CAST(sum(least(30, coalesce(next - i, 30))) AS BIGINT) AS n_repeated FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM r) GROUP BY doc_id),
f AS (SELECT doc_id, length(t) AS n_kept, coalesce(n_repeated, 0) AS n_repeated, CASE WHEN length(t) > 0 THEN coalesce(n_repeated, 0) / length(t) ELSE 0.0 END AS share FROM k LEFT JOIN c USING (doc_id))"""

ORACLES = {
    "p10_share": f"WITH {_KEPT} SELECT doc_id, n_kept, n_repeated, share FROM f",
    "p10_found": f"WITH {_KEPT} SELECT doc_id FROM f WHERE share >= 1 / 3",
    "p2_points": f"SELECT experiment, topic, result_id, n_items, round(points, 9) AS points FROM ({_POINTS})",
    "p2_found": f"SELECT experiment, topic, result_id FROM (SELECT *, row_number() OVER (PARTITION BY experiment, topic ORDER BY round(points, 12) DESC, result_id) AS place FROM ({_POINTS}) WHERE n_items >= 40) WHERE place <= 5",
    "p3_counts": f"SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_docs FROM {_CELLS} GROUP BY 1",
    "p3_found": f"""WITH c AS (SELECT * FROM {_CELLS}), d AS (SELECT count(*) AS k FROM (SELECT DISTINCT topic, doc FROM c)), f AS (SELECT term, count(*) AS n FROM c GROUP BY 1)
SELECT term, 'rare' AS mark FROM f WHERE n <= 2 UNION ALL SELECT term, 'common' AS mark FROM f, d WHERE n > 0.1 * k""",
    "p4_found": _BEST.format(t="results", g="experiment", i="result_id", s="semantic_score", n=10) + " UNION ALL " + _BEST.format(t="scores", g="doc", i="score_id", s="score", n=3),
}
