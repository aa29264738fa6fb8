"""Queries that rank candidates of documents and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.text import words
from ..operators import rank_doc, rank_topic
from .tables import SCORES, VECTORS, r6, rounded, scores, sql6, table, vectors

Q: dict = {}
O: dict[str, str] = {}

_COS = "list_cosine_similarity"
_TOP = 15


def _topic_rank(name: str, how, sql: str) -> None:
    """A query of the 15 best candidates of every topic, and its SQL over (topic, candidate, score, n_docs)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ranked = rank_doc.top(how(scores(spark, folder)).withColumn("score", F.round("score", 9)), ["topic"], "score", ["candidate"], _TOP)
        return ranked.select("topic", "candidate", r6("score").alias("score"), "n_docs", "rank")

    Q[name] = run
    O[name] = f"WITH {SCORES}, a AS ({sql}), b AS (SELECT topic, candidate, round(score, 9) AS score, n_docs FROM a) SELECT topic, candidate, {sql6('score')} AS score, n_docs, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, candidate) AS rank FROM b) WHERE rank <= {_TOP}"


_topic_rank("topic_mean_rank", lambda s: rank_topic.aggregate_scores(s, "mean"), "SELECT topic, candidate, avg(score) AS score, count(*) AS n_docs FROM scores_ GROUP BY ALL")
_topic_rank("topic_max_rank", lambda s: rank_topic.aggregate_scores(s, "max"), "SELECT topic, candidate, max(score) AS score, count(*) AS n_docs FROM scores_ GROUP BY ALL")
_topic_rank(
    "topic_meantopmax_rank",
    rank_topic.mean_of_top_half,
    "SELECT s.topic, s.candidate, avg(s.score) AS score, any_value(m.n) AS n_docs FROM scores_ s JOIN (SELECT topic, candidate, quantile_cont(score, 0.5) AS q, count(*) AS n FROM scores_ GROUP BY ALL) m ON s.topic = m.topic AND s.candidate IS NOT DISTINCT FROM m.candidate WHERE s.score >= m.q GROUP BY s.topic, s.candidate",
)


def topic_rrf_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The 15 best candidates of every topic by reciprocal rank fusion."""
    rows = scores(spark, folder).filter("topic IS NOT NULL AND doc IS NOT NULL AND candidate IS NOT NULL")
    fused = rank_topic.reciprocal_rank_fusion(rows).withColumn("score", F.round("score", 9))
    return rank_doc.top(fused, ["topic"], "score", ["candidate"], _TOP).select("topic", "candidate", r6("score").alias("score"), "rank")


O["topic_rrf_rank"] = f"""WITH {SCORES}, s AS (SELECT * FROM scores_ WHERE topic IS NOT NULL AND doc IS NOT NULL AND candidate IS NOT NULL),
c AS (SELECT DISTINCT topic, candidate FROM s), d AS (SELECT DISTINCT topic, doc FROM s),
m AS (SELECT c.topic, d.doc, c.candidate, s.score FROM c JOIN d USING (topic) LEFT JOIN s ON s.topic = c.topic AND s.doc = d.doc AND s.candidate = c.candidate),
r AS (SELECT *, rank() OVER (PARTITION BY topic, doc ORDER BY score DESC NULLS LAST) + (count(*) OVER (PARTITION BY topic, doc, score) - 1) / 2.0 AS rank FROM m),
f AS (SELECT topic, candidate, round(sum(1 / (60 + rank)), 9) AS score FROM r GROUP BY ALL)
SELECT topic, candidate, {sql6('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, candidate) AS rank FROM f) WHERE rank <= {_TOP}"""


def candidate_incidence(spark: SparkSession, folder: str) -> DataFrame:
    return rank_topic.incidence(table(spark, folder, "candidates"))


def mention_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rank_topic.incidence(table(spark, folder, "candidates"), by_mentions=True)


O["candidate_incidence"] = "SELECT topic, candidate, count(DISTINCT doc) AS n FROM candidates GROUP BY ALL"
O["mention_counts"] = "SELECT topic, candidate, CAST(sum(n_mentions) AS BIGINT) AS n FROM candidates GROUP BY ALL"


# Vectors.


def centroid_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """The cosine of every vector with its topic's mean."""
    rows = vectors(spark, folder)
    centre = vec.mean_vectors(rows, ["topic"], out="centre")
    return rows.join(centre, "topic").select("id", r6(vec.cosine(F.col("vec"), F.col("centre"))).alias("similarity"))


_CENTRE = "e AS (SELECT topic, id, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM v), c AS (SELECT topic, list(x ORDER BY i) AS centre FROM (SELECT topic, i, avg(x) AS x FROM e GROUP BY ALL) GROUP BY topic)"
O["centroid_similarity"] = f"WITH {VECTORS}, {_CENTRE} SELECT id, {sql6(_COS + '(vec, centre)')} AS similarity FROM v JOIN c USING (topic)"


def doc_embedrank_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 15 vectors of each topic nearest to its mean, as a document's candidates."""
    rows = vectors(spark, folder)
    ranked = rank_doc.embed_rank(rows, vec.mean_vectors(rows, ["topic"]), ["topic"], ["id"], _TOP)
    return ranked.select("topic", "id", r6("score").alias("score"), "rank")


O["doc_embedrank_topk"] = f"WITH {VECTORS}, {_CENTRE} SELECT topic, id, {sql6('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM (SELECT topic, id, {_COS}(vec, centre) AS score FROM v JOIN c USING (topic))) WHERE rank <= {_TOP}"


def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select("id", F.transform(vec.unit(F.col("vec")), r6).alias("vec"))


O["l2_normalize"] = f"WITH {VECTORS} SELECT id, list_transform(vec, lambda x: round(x / sqrt(list_sum(list_transform(vec, lambda y: y * y))), 6) + 0.0) AS vec FROM v"


def zscore_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vec.zscores(vectors(spark, folder), ["topic"]).select("id", F.transform("vec", r6).alias("vec"))


O["zscore_vectors"] = f"WITH {VECTORS}, e AS (SELECT topic, id, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM v), z AS (SELECT id, i, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM e WINDOW w AS (PARTITION BY topic, i)) SELECT id, list(round(z, 6) + 0.0 ORDER BY i) AS vec FROM z GROUP BY id"


def vector_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """The element-wise maximum of every topic's vectors."""
    return vec.max_vectors(vectors(spark, folder), ["topic"]).select("topic", F.transform("vec", r6).alias("vec"))


O["vector_extremes"] = f"WITH {VECTORS}, e AS (SELECT topic, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM v) SELECT topic, list(round(x, 6) + 0.0 ORDER BY i) AS vec FROM (SELECT topic, i, max(x) AS x FROM e GROUP BY ALL) GROUP BY topic"


def topic_cross_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The mean and greatest cosine of every vector with all vectors of its topic."""
    rows = vectors(spark, folder)
    return rank_topic.similarity_to_documents(rows, rows).select("topic", "id", r6("mean").alias("mean_score"), r6("most").alias("max_score"))


O["topic_cross_rank"] = f"WITH {VECTORS} SELECT a.topic, a.id, {sql6(f'avg({_COS}(a.vec, b.vec))')} AS mean_score, {sql6(f'max({_COS}(a.vec, b.vec))')} AS max_score FROM v a JOIN v b USING (topic) GROUP BY a.topic, a.id"


def topic_maxmax_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Topics as candidates: the greatest cosine of their element-wise maximum with any vector of the collection."""
    rows = vectors(spark, folder)
    candidates = vec.max_vectors(rows, ["topic"]).select(F.lit(1).alias("topic"), F.col("topic").cast("bigint").alias("id"), "vec")
    return rank_topic.similarity_to_documents(candidates, rows.withColumn("topic", F.lit(1))).select(F.col("id").alias("candidate"), r6("most").alias("score"))


O["topic_maxmax_rank"] = f"WITH {VECTORS}, e AS (SELECT topic, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM v), m AS (SELECT topic, list(x ORDER BY i) AS top FROM (SELECT topic, i, max(x) AS x FROM e GROUP BY ALL) GROUP BY topic) SELECT CAST(m.topic AS BIGINT) AS candidate, {sql6(f'max({_COS}(top, vec))')} AS score FROM m, v GROUP BY m.topic"


def topic_dpsc_rank(spark: SparkSession, folder: str) -> DataFrame:
    out = rank_topic.density_diversity(vectors(spark, folder))
    return out.select("topic", "id", r6("rep").alias("rep"), r6("div").alias("div"), r6("score").alias("score"))


_SIM = f"p AS (SELECT a.topic, a.id, b.id AS other, CASE WHEN a.id = b.id THEN 0.0 ELSE {_COS}(a.vec, b.vec) END AS sim FROM v a JOIN v b USING (topic))"
O["topic_dpsc_rank"] = f"""WITH {VECTORS}, {_SIM}, r AS (SELECT topic, id, count(*) FILTER (sim > 0.22) / count(*) AS rep FROM p GROUP BY ALL),
d AS (SELECT p.topic, p.id, any_value(a.rep) AS rep, max(CASE WHEN b.rep > a.rep THEN sim END) AS most, min(sim) AS least FROM p JOIN r a ON a.topic = p.topic AND a.id = p.id JOIN r b ON b.topic = p.topic AND b.id = p.other GROUP BY p.topic, p.id),
e AS (SELECT *, CASE WHEN most IS NOT NULL THEN 1 - greatest(most, 0.0) ELSE 1 - least END AS d0 FROM d), f AS (SELECT topic, id, rep, CASE WHEN abs(d0) < 1e-12 THEN 1e-10 ELSE d0 END AS div FROM e)
SELECT topic, id, round(rep, 6) AS rep, round(div, 6) AS div, CASE WHEN rep > 0 THEN round(ln(rep) + ln(div), 6) + 0.0 END AS score FROM f"""


def crossdoc_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores over all documents of a topic, a vector's own document scoring 1 and the others filled in."""
    rows = vectors(spark, folder)
    have = rows.select("topic", "id", F.col("id").alias("doc_id"), F.lit(1.0).alias("score"))
    return rank_topic.filled_mean(rows, rows, have).select("topic", "id", r6("score").alias("score"), "n_docs")


O["crossdoc_fill"] = f"WITH {VECTORS} SELECT a.topic, a.id, {sql6(f'avg(CASE WHEN a.id = b.id THEN 1.0 ELSE (1 + 1.2e8 / 256 ** 3) * ln(abs({_COS}(a.vec, b.vec))) END)')} AS score, count(*) AS n_docs FROM v a JOIN v b USING (topic) GROUP BY a.topic, a.id"


# Documents.


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    """topic, doc, candidate, score, start, doc_len of the scored candidates."""
    first = table(spark, folder, "candidates").groupBy("topic", "doc", "candidate").agg(F.min("first_start").alias("start"))
    lengths = table(spark, folder, "documents").select("topic", "doc", F.size(words(F.col("text"))).alias("doc_len")).filter("doc_len IS NOT NULL")
    known = scores(spark, folder).join(first, ["topic", "doc", "candidate"], "left").join(lengths, ["topic", "doc"])
    return known.withColumn("start", rank_doc.first_start_or_end(F.col("start"), F.col("doc_len")))


def doc_position_bias(spark: SparkSession, folder: str) -> DataFrame:
    """Scores weighted by the candidate's first position; a candidate that doesn't occur stands at the end."""
    return _positions(spark, folder).select("topic", "doc", "candidate", rounded(rank_doc.position_bias(F.col("score"), F.col("start"), F.col("doc_len")), 2).alias("score"))


_W = "len(list_filter(string_split_regex(text, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> ''))"
_BIAS = f"f AS (SELECT topic, doc, candidate, min(first_start) AS start FROM candidates GROUP BY ALL), l AS (SELECT topic, doc, {_W} AS doc_len FROM documents WHERE text IS NOT NULL), b AS (SELECT s.topic, s.doc, s.candidate, score, coalesce(start, doc_len) AS start, doc_len FROM scores_ s JOIN l USING (topic, doc) LEFT JOIN f ON f.topic = s.topic AND f.doc = s.doc AND f.candidate = s.candidate)"
_FACTOR = "(CASE WHEN doc_len > 0 THEN start / doc_len + 1.2e8 / doc_len ** 3 END)"
O["doc_position_bias"] = f"WITH {SCORES}, {_BIAS} SELECT topic, doc, candidate, CASE WHEN score <> 0 THEN {sql6(f'{_FACTOR} * ln(abs(nullif(score, 0)))', 2)} END AS score FROM b"


def doc_prompt_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Scores as log likelihoods of a sequence as long as the candidate, with the position bias; the best of each candidate."""
    rows = _positions(spark, folder).withColumn("n", F.size(words(F.col("candidate"))) + 3)
    rows = rows.withColumn("score", rank_doc.prompt_score(-F.abs("score"), F.col("n"), 2, F.col("start"), F.col("doc_len")))
    return rank_doc.best_by_candidate(rows, ["topic", "doc"]).withColumn("score", rounded("score", 2))


O["doc_prompt_rank"] = f"WITH {SCORES}, {_BIAS} SELECT topic, doc, candidate, {sql6(f'max(-abs(score) / (n - 2) ** 0.6 * {_FACTOR})', 2)} AS score FROM (SELECT *, {_W.replace('(text,', '(candidate,')} + 3 AS n FROM b) GROUP BY topic, doc, candidate"


def extraction_only(spark: SparkSession, folder: str) -> DataFrame:
    return rank_doc.constant_scores(table(spark, folder, "candidates"), ["topic", "doc"])


O["extraction_only"] = "SELECT DISTINCT topic, doc, candidate, CAST(0.5 AS DOUBLE) AS score FROM candidates"


def _two_models(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    counts = table(spark, folder, "incidence").filter("n > 0 AND candidate IS NOT NULL").groupBy("topic", "doc", "candidate").agg(F.max("n").cast("double").alias("score"))
    return scores(spark, folder).withColumn("score", F.abs("score")), counts


def fusion_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and mention counts fused with weights 0.7 and 0.3."""
    a, b = _two_models(spark, folder)
    return rank_doc.fuse_weighted([(a, 0.7), (b, 0.3)], ["topic", "doc"]).withColumn("score", r6("score"))


def fusion_harmonic(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _two_models(spark, folder)
    return rank_doc.fuse_harmonic(a, b, ["topic", "doc"]).withColumn("score", r6("score"))


_MODELS = "a AS (SELECT topic, doc, candidate, abs(score) AS score FROM scores_), b AS (SELECT topic, doc, candidate, CAST(max(n) AS DOUBLE) AS score FROM incidence WHERE n > 0 AND candidate IS NOT NULL GROUP BY ALL)"
O["fusion_weighted"] = f"WITH {SCORES}, {_MODELS}, u AS (SELECT *, 1 AS m, 0.7 AS w FROM a UNION ALL SELECT *, 2 AS m, 0.3 AS w FROM b), n AS (SELECT topic, doc, candidate, w * score / nullif(sum(score) OVER (PARTITION BY topic, doc, m), 0) AS score FROM u) SELECT topic, doc, candidate, {sql6('sum(score)')} AS score FROM n GROUP BY topic, doc, candidate"
O["fusion_harmonic"] = f"WITH {SCORES}, {_MODELS} SELECT topic, doc, candidate, {sql6('2 * a.score * b.score / nullif(a.score + b.score, 0)')} AS score FROM a JOIN b USING (topic, doc, candidate)"


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates as nodes: their last word's length is the cluster, their number of mentions the similarity."""
    rows = table(spark, folder, "candidates").filter("candidate IS NOT NULL AND first_start IS NOT NULL AND topic IS NOT NULL AND doc IS NOT NULL")
    cluster = F.length(F.regexp_extract("candidate", r"(\w+)\W*$", 1))
    return rows.select("topic", "doc", F.col("cand_id").alias("id"), cluster.alias("cluster"), F.col("first_start").alias("position"), F.coalesce("n_mentions", F.lit(0)).cast("double").alias("similarity"))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between a document's candidates of different clusters."""
    return rank_doc.graph_edges(_nodes(spark, folder), ["topic", "doc"]).select("a", "b", r6("w").alias("w"))


def graph_scores(spark: SparkSession, folder: str) -> DataFrame:
    out = rank_doc.graph_scores(_nodes(spark, folder), ["topic", "doc"])
    return out.select("id", rounded("degree", 9).alias("degree"), rounded("prior", 9).alias("prior"), rounded("score", 9).alias("score"))


def graph_rebalance(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _nodes(spark, folder)
    degrees = rank_doc.graph_scores(nodes, ["topic", "doc"], compat=True).select("id", "degree")
    return rank_doc.graph_rebalance(nodes.join(degrees, "id"), ["topic", "doc"]).select("id", r6("gain").alias("gain"))


_NODES = "n AS (SELECT topic, doc, cand_id AS id, length(regexp_extract(candidate, '(\\w+)\\W*$', 1)) AS cluster, first_start AS pos, CAST(coalesce(n_mentions, 0) AS DOUBLE) AS similarity FROM candidates WHERE candidate IS NOT NULL AND first_start IS NOT NULL AND topic IS NOT NULL AND doc IS NOT NULL), w AS (SELECT a.topic, a.doc, a.id AS a, b.id AS b, 1 / greatest(1, abs(a.pos - b.pos)) AS w FROM n a JOIN n b USING (topic, doc) WHERE a.cluster <> b.cluster), d AS (SELECT a AS id, sum(w) AS degree FROM w GROUP BY a)"
_PRIOR = "q AS (SELECT n.*, coalesce(degree, 0) AS degree, coalesce(0.15 * similarity / nullif(sum(similarity) OVER (PARTITION BY topic, doc), 0), 0) AS prior FROM n LEFT JOIN d USING (id))"
O["graph_edges"] = f"WITH {_NODES} SELECT a, b, round(w, 6) AS w FROM w WHERE a < b"
O["graph_scores"] = f"WITH {_NODES}, {_PRIOR} SELECT q.id, round(any_value(q.degree), 9) + 0.0 AS degree, round(any_value(q.prior), 9) + 0.0 AS prior, round(any_value(q.prior) + 0.85 * coalesce(sum(w.w * o.prior / o.degree), 0), 9) + 0.0 AS score FROM q LEFT JOIN w ON w.a = q.id LEFT JOIN q o ON o.id = w.b GROUP BY q.id"
O["graph_rebalance"] = f"WITH {_NODES}, {_PRIOR}, k AS (SELECT *, row_number() OVER c AS place, count(*) OVER (PARTITION BY topic, doc, cluster) AS many, sum(degree) OVER (PARTITION BY topic, doc, cluster) AS total FROM q WINDOW c AS (PARTITION BY topic, doc, cluster ORDER BY pos, id)) SELECT id, round(1.1 * exp(1 / greatest(1, pos)) * (total - degree), 6) + 0.0 AS gain FROM k WHERE place = 1 AND many > 1"

for _f in (topic_rrf_rank, candidate_incidence, mention_counts, centroid_similarity, doc_embedrank_topk, l2_normalize, zscore_vectors, vector_extremes, topic_cross_rank, topic_maxmax_rank, topic_dpsc_rank, crossdoc_fill, doc_position_bias, doc_prompt_rank, extraction_only, fusion_weighted, fusion_harmonic, graph_edges, graph_scores, graph_rebalance):
    Q[_f.__name__] = _f

QUERIES, ORACLES = Q, O
