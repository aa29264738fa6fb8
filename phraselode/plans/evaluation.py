"""Queries that evaluate rankings: each experiment's candidates by semantic score against the topics' gold phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import finite
from ..operators import evaluate as ev
from ..operators import rank_doc
from .tables import r6, table

Q: dict = {}
O: dict[str, str] = {}
KEYS = ["experiment", "topic"]


def _phrases(spark: SparkSession, folder: str) -> DataFrame:
    """experiment, topic, phrase, score, n: the best result of each phrase."""
    rows = table(spark, folder, "results").select(*KEYS, F.lower(F.trim("candidate")).alias("phrase"), finite("semantic_score").alias("score"), "n").filter("phrase IS NOT NULL AND score IS NOT NULL AND experiment IS NOT NULL AND topic IS NOT NULL")
    return rows.groupBy(*KEYS, "phrase").agg(F.max("score").alias("score"), F.max("n").alias("n"))


def _ranked(spark: SparkSession, folder: str, n: int = -1) -> DataFrame:
    return rank_doc.top(_phrases(spark, folder), KEYS, "score", ["phrase"], n)


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold").select("topic", "cluster_no", "variant_pos", F.lower(F.trim("phrase")).alias("phrase")).filter("phrase IS NOT NULL AND topic IS NOT NULL")


def _hits(spark: SparkSession, folder: str, n: int = -1) -> DataFrame:
    return ev.with_hits(_ranked(spark, folder, n), _gold(spark, folder), ["topic"])


_PRED = "q AS (SELECT experiment, topic, lower(trim(candidate, ' ')) AS phrase, max(semantic_score) AS score, max(n) AS n FROM results WHERE candidate IS NOT NULL AND semantic_score IS NOT NULL AND NOT isnan(semantic_score) AND experiment IS NOT NULL AND topic IS NOT NULL GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY experiment, topic ORDER BY score DESC, phrase) AS rank FROM q)"
_GOLD = "g AS (SELECT topic, cluster_no, variant_pos, lower(trim(phrase, ' ')) AS phrase FROM gold WHERE phrase IS NOT NULL AND topic IS NOT NULL), gd AS (SELECT DISTINCT topic, phrase FROM g), gn AS (SELECT topic, count(*) AS n_gold FROM gd GROUP BY topic)"
_HITS = f"{_PRED}, {_GOLD}, h AS (SELECT p.*, gn.n_gold, CASE WHEN gd.phrase IS NOT NULL THEN 1 ELSE 0 END AS hit FROM p JOIN gn USING (topic) LEFT JOIN gd ON gd.topic = p.topic AND gd.phrase = p.phrase)"
_KS = "(VALUES (0), (5), (10), (15)) AS t(k)"
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(r6(c).alias(c) if c in names else c for c in df.columns))


def eval_set_prf(spark: SparkSession, folder: str) -> DataFrame:
    """Mean precision, recall and F1 of each experiment at 5, 10, 15 and over whole lists (k = 0)."""
    return _rounded(ev.mean_metrics(ev.by_ranking(_hits(spark, folder), KEYS), ["experiment", "k"]), "precision", "recall", "f1")


_MEANS = "round(avg(precision), 6) + 0.0 AS precision, round(avg(recall), 6) + 0.0 AS recall, round(avg(f1), 6) + 0.0 AS f1, count(*) AS n"
O["eval_set_prf"] = f"WITH {_HITS}, e AS (SELECT experiment, topic, k, sum(hit) / count(*) AS precision, sum(hit) / any_value(n_gold) AS recall FROM h, {_KS} WHERE k = 0 OR rank <= k GROUP BY ALL), f AS (SELECT *, {_F1} FROM e) SELECT experiment, k, {_MEANS} FROM f GROUP BY ALL"


def eval_list_prf(spark: SparkSession, folder: str) -> DataFrame:
    """The same over lists as delivered, in which a phrase may come several times."""
    rows = table(spark, folder, "results").select(*KEYS, "result_id", "loaded_at", F.lower(F.trim("candidate")).alias("phrase"), finite("semantic_score").alias("score")).filter("phrase IS NOT NULL AND score IS NOT NULL AND experiment IS NOT NULL AND topic IS NOT NULL")
    ranked = rank_doc.top(rows, KEYS, "score", ["phrase", "result_id", "loaded_at"])
    return _rounded(ev.mean_metrics(ev.by_ranking(ev.with_hits(ranked, _gold(spark, folder), ["topic"]), KEYS, clip=True), ["experiment", "k"]), "precision", "recall", "f1")


O["eval_list_prf"] = f"WITH {_GOLD}, p AS (SELECT experiment, topic, lower(trim(candidate, ' ')) AS phrase, row_number() OVER (PARTITION BY experiment, topic ORDER BY semantic_score DESC, lower(trim(candidate, ' ')), result_id, loaded_at) AS rank FROM results WHERE candidate IS NOT NULL AND semantic_score IS NOT NULL AND NOT isnan(semantic_score) AND experiment IS NOT NULL AND topic IS NOT NULL), h AS (SELECT p.*, gn.n_gold, CASE WHEN gd.phrase IS NOT NULL THEN 1 ELSE 0 END AS hit FROM p JOIN gn USING (topic) LEFT JOIN gd ON gd.topic = p.topic AND gd.phrase = p.phrase), e AS (SELECT experiment, topic, k, least(1, sum(hit) / count(*)) AS precision, least(1, sum(hit) / any_value(n_gold)) AS recall FROM h, {_KS} WHERE k = 0 OR rank <= k GROUP BY ALL), f AS (SELECT *, {_F1} FROM e) SELECT experiment, k, {_MEANS} FROM f GROUP BY ALL"


def eval_map_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.order_metrics(_hits(spark, folder), KEYS), "map", "ndcg")


_ORDER = f"WITH {_HITS}, w AS (SELECT *, sum(hit) OVER (PARTITION BY experiment, topic ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM h), o AS (SELECT experiment, topic, sum(hit * so_far / rank) / any_value(n_gold) AS map, sum(hit / log2(rank + 1)) / any_value(list_sum(list_transform(range(1, n_gold + 1), lambda i: 1 / log2(i + 1)))) AS ndcg FROM w GROUP BY ALL)"
O["eval_map_ndcg"] = f"{_ORDER} SELECT experiment, topic, round(map, 6) + 0.0 AS map, round(ndcg, 6) + 0.0 AS ndcg FROM o"


def eval_map(spark: SparkSession, folder: str) -> DataFrame:
    return ev.order_metrics(_hits(spark, folder), KEYS).groupBy("experiment").agg(r6(F.avg("map")).alias("map"))


def eval_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    return ev.order_metrics(_hits(spark, folder), KEYS).groupBy("experiment").agg(r6(F.avg("ndcg")).alias("ndcg"))


O["eval_map"] = f"{_ORDER} SELECT experiment, round(avg(map), 6) + 0.0 AS map FROM o GROUP BY experiment"
O["eval_ndcg"] = f"{_ORDER} SELECT experiment, round(avg(ndcg), 6) + 0.0 AS ndcg FROM o GROUP BY experiment"


def eval_depth_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.depth_curve(_hits(spark, folder, 15), KEYS), "precision", "recall")


O["eval_depth_curve"] = f"WITH {_HITS}, w AS (SELECT *, sum(hit) OVER (PARTITION BY experiment, topic ORDER BY rank ROWS UNBOUNDED PRECEDING) AS s FROM h WHERE rank <= 15) SELECT experiment, topic, rank, round(s / rank, 6) + 0.0 AS precision, round(s / n_gold, 6) + 0.0 AS recall FROM w"


def eval_micro_prf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.micro(_hits(spark, folder), KEYS, ["experiment"]), "precision", "recall", "f1")


O["eval_micro_prf"] = f"WITH {_HITS}, n AS (SELECT experiment, sum(n_gold) AS s FROM (SELECT DISTINCT experiment, topic, n_gold FROM h) GROUP BY experiment), e AS (SELECT experiment, k, sum(CASE WHEN rank <= 15 THEN hit ELSE 0 END) AS c, count(*) AS e FROM h, {_KS} WHERE k = 0 OR rank <= k GROUP BY ALL), f AS (SELECT experiment, k, c / e AS precision, c / s AS recall FROM e JOIN n USING (experiment)) SELECT experiment, k, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) + 0.0 AS f1 FROM f"


def eval_fuzzy_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of phrases as text, separated by semicolons."""
    predicted = ev.ranked_lists(_ranked(spark, folder, 15), KEYS).select(*KEYS, F.array_join("phrases", ";").alias("predicted"))
    gold = _gold(spark, folder).select("topic", "phrase").distinct().groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("phrase")), ";").alias("gold"))
    return _rounded(ev.compare_lists(predicted.join(gold, "topic", "left"), "predicted", "gold", ["experiment"]), "precision", "recall", "f1")


O["eval_fuzzy_exact"] = f"WITH {_PRED}, {_GOLD}, l AS (SELECT experiment, topic, string_agg(phrase, ';' ORDER BY rank) AS predicted FROM p WHERE rank <= 15 GROUP BY ALL), d AS (SELECT topic, string_agg(phrase, ';' ORDER BY phrase) AS gold FROM gd GROUP BY topic), b AS (SELECT experiment, list_filter(list_transform(string_split(predicted, ';'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p, list_filter(list_transform(string_split(gold, ';'), lambda x: trim(x, ' ')), lambda x: x <> '') AS g FROM l JOIN d USING (topic)), f AS (SELECT experiment, sum(len(list_filter(p, lambda x: list_contains(g, x)))) / sum(len(p)) AS precision, sum(len(list_filter(p, lambda x: list_contains(g, x)))) / sum(len(g)) AS recall FROM b GROUP BY experiment) SELECT experiment, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) + 0.0 AS f1 FROM f"


def _clusters(name: str, metric, body: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        gold = ev.first_clusters(_gold(spark, folder), ["topic"])
        each = metric(_ranked(spark, folder, 15), gold, KEYS, ["topic"])
        return _rounded(ev.mean_metrics(each, ["experiment", "k"]), "precision", "recall", "f1")

    Q[name] = run
    O[name] = f"WITH {_PRED}, {_GOLD}, cn AS (SELECT topic, cluster_no, row_number() OVER (PARTITION BY topic ORDER BY cluster_no) AS place FROM (SELECT DISTINCT topic, cluster_no FROM g)), c AS (SELECT g.* FROM g JOIN cn ON cn.topic = g.topic AND cn.cluster_no IS NOT DISTINCT FROM g.cluster_no WHERE place <= 20), d AS (SELECT experiment, topic, k, phrase FROM p, (VALUES (5), (10), (15)) AS t(k) WHERE rank <= k), {body}, f AS (SELECT *, {_F1} FROM e) SELECT experiment, k, {_MEANS} FROM f GROUP BY ALL"


_clusters("eval_cluster_f1", ev.cluster_f1, "s AS (SELECT topic, count(DISTINCT cluster_no) AS s FROM c GROUP BY topic), m AS (SELECT experiment, topic, k, count(DISTINCT cluster_no) AS c FROM d JOIN c USING (topic, phrase) GROUP BY ALL), n AS (SELECT experiment, topic, k, count(*) AS e FROM d GROUP BY ALL), e AS (SELECT experiment, topic, k, coalesce(c, 0) / e AS precision, coalesce(c, 0) / s AS recall FROM n JOIN s USING (topic) LEFT JOIN m USING (experiment, topic, k))")
_clusters("eval_flat_f1", ev.flat_f1, "o AS (SELECT DISTINCT topic, phrase FROM (SELECT *, row_number() OVER (PARTITION BY topic, cluster_no ORDER BY variant_pos, phrase) AS v FROM c) WHERE v = 1), s AS (SELECT topic, count(*) AS s FROM o GROUP BY topic), m AS (SELECT experiment, topic, k, count(DISTINCT phrase) AS c FROM d JOIN o USING (topic, phrase) GROUP BY ALL), n AS (SELECT experiment, topic, k, count(*) AS e FROM d GROUP BY ALL), e AS (SELECT experiment, topic, k, coalesce(c, 0) / e AS precision, coalesce(c, 0) / s AS recall FROM n JOIN s USING (topic) LEFT JOIN m USING (experiment, topic, k))")
_WORDS = "unnest(list_filter(string_split_regex(phrase, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> ''))"
_clusters("eval_unigram_f1", ev.unigram_f1, f"a AS (SELECT experiment, topic, k, w, count(*) AS a FROM (SELECT experiment, topic, k, {_WORDS} AS w FROM d) GROUP BY ALL), b AS (SELECT topic, w, count(*) AS b FROM (SELECT DISTINCT topic, cluster_no, w FROM (SELECT topic, cluster_no, {_WORDS} AS w FROM c)) GROUP BY ALL), s AS (SELECT topic, sum(b) AS s FROM b GROUP BY topic), e AS (SELECT experiment, topic, k, sum(least(a, coalesce(b, 0))) / sum(a) AS precision, sum(least(a, coalesce(b, 0))) / any_value(s) AS recall FROM a JOIN s USING (topic) LEFT JOIN b USING (topic, w) GROUP BY ALL)")


def gold_label_join(spark: SparkSession, folder: str) -> DataFrame:
    return ev.label_gold(_phrases(spark, folder), _gold(spark, folder), ["topic"]).select(*KEYS, "phrase", "is_gold")


O["gold_label_join"] = f"WITH {_PRED}, {_GOLD} SELECT q.experiment, q.topic, q.phrase, gd.phrase IS NOT NULL AS is_gold FROM q LEFT JOIN gd ON gd.topic = q.topic AND gd.phrase = q.phrase"


def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = ev.label_gold(_phrases(spark, folder), _gold(spark, folder), ["topic"])
    return _rounded(ev.score_histogram(rows, "score", "is_gold"), "bin")


O["score_histogram"] = f"WITH {_PRED}, {_GOLD}, c AS (SELECT CAST(round(q.score * 100) AS BIGINT) AS b, count(*) AS n, sum(CASE WHEN gd.phrase IS NOT NULL THEN 1 ELSE 0 END) AS hits FROM q LEFT JOIN gd ON gd.topic = q.topic AND gd.phrase = q.phrase WHERE q.score BETWEEN 0 AND 1 GROUP BY 1) SELECT round(i / 100, 6) + 0.0 AS bin, coalesce(n, 0) AS n, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM range(101) t(i) LEFT JOIN c ON c.b = i"


def side_by_side(spark: SparkSession, folder: str) -> DataFrame:
    """Every topic's candidates of its best scores, over all experiments, beside its gold."""
    best = _phrases(spark, folder).groupBy("topic", "phrase").agg(F.max("score").alias("score"))
    return ev.side_by_side(rank_doc.top(best, ["topic"], "score", ["phrase"], 15), _gold(spark, folder).select("topic", "phrase").distinct(), ["topic"])


O["side_by_side"] = f"WITH {_PRED}, {_GOLD}, b AS (SELECT topic, phrase, row_number() OVER (PARTITION BY topic ORDER BY max(score) DESC, phrase) AS place FROM q GROUP BY topic, phrase), r AS (SELECT topic, place, phrase AS predicted FROM b WHERE place <= 15), w AS (SELECT topic, phrase AS gold, row_number() OVER (PARTITION BY topic ORDER BY phrase) AS place FROM gd) SELECT topic, place, predicted, gold FROM r FULL OUTER JOIN w USING (topic, place)"


def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "results").dropDuplicates(["result_id"]).withColumn("in_gold", F.col("in_gold").cast("int"))
    return ev.correlations(rows, ["in_gold", "semantic_score", "n", "moran_i", "getisord_g"]).withColumn("r", r6("r"))


_V = lambda c: f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
_CC = ["in_gold", "semantic_score", "n", "moran_i", "getisord_g"]
O["corr_matrix"] = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({_V(a)}, {_V(b)}), 6) + 0.0 AS r FROM (SELECT DISTINCT ON (result_id) * REPLACE (CAST(in_gold AS INTEGER) AS in_gold) FROM results)" for i, a in enumerate(_CC) for b in _CC[i + 1 :])


def metric_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """F1 in percent, an experiment a row and a depth a column."""
    each = ev.mean_metrics(ev.by_ranking(_hits(spark, folder), KEYS), ["experiment", "k"])
    return _rounded(each.groupBy("experiment").pivot("k", [5, 10, 15]).agg(F.first(F.col("f1") * 100)).toDF("experiment", "f1_5", "f1_10", "f1_15"), "f1_5", "f1_10", "f1_15")


O["metric_pivot"] = f"WITH {_HITS}, e AS (SELECT experiment, topic, k, sum(hit) / count(*) AS precision, sum(hit) / any_value(n_gold) AS recall FROM h, {_KS} WHERE rank <= k GROUP BY ALL), f AS (SELECT experiment, k, avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END) * 100 AS f FROM e GROUP BY ALL) SELECT experiment, round(max(CASE WHEN k = 5 THEN f END), 6) + 0.0 AS f1_5, round(max(CASE WHEN k = 10 THEN f END), 6) + 0.0 AS f1_10, round(max(CASE WHEN k = 15 THEN f END), 6) + 0.0 AS f1_15 FROM f GROUP BY experiment"

_ALPHAS = (0.0, 0.05, 0.11, 0.118, 0.13, 0.5)


def param_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Mean F1 at 15 of score + alpha ln n for several alphas, in one job."""
    rows = _phrases(spark, folder).filter("n > 0")
    out = ev.sweep(rows, _gold(spark, folder), KEYS, ["topic"], _ALPHAS, lambda a: F.col("score") + a * F.ln("n"))
    return _rounded(out, "f1")


O["param_sweep"] = f"WITH {_PRED}, {_GOLD}, t AS (SELECT q.experiment, q.topic, q.phrase, a AS parameter, row_number() OVER (PARTITION BY experiment, topic, a ORDER BY round(score + a * ln(n), 9) DESC, phrase) AS rank FROM q, (VALUES {', '.join(f'(CAST({a} AS DOUBLE))' for a in _ALPHAS)}) AS v(a) WHERE n > 0), h AS (SELECT t.*, n_gold, CASE WHEN gd.phrase IS NOT NULL THEN 1 ELSE 0 END AS hit FROM t JOIN gn USING (topic) LEFT JOIN gd ON gd.topic = t.topic AND gd.phrase = t.phrase WHERE rank <= 15), e AS (SELECT experiment, topic, parameter, sum(hit) / count(*) AS precision, sum(hit) / any_value(n_gold) AS recall FROM h GROUP BY ALL), f AS (SELECT *, {_F1} FROM e) SELECT experiment, parameter, round(avg(f1), 6) + 0.0 AS f1 FROM f GROUP BY ALL"


def ranked_lists(spark: SparkSession, folder: str) -> DataFrame:
    return ev.ranked_lists(_ranked(spark, folder, 15), KEYS)


O["ranked_lists"] = f"WITH {_PRED} SELECT experiment, topic, list(phrase ORDER BY rank) AS phrases FROM p WHERE rank <= 15 GROUP BY ALL"

for _f in (eval_set_prf, eval_list_prf, eval_map_ndcg, eval_map, eval_ndcg, eval_depth_curve, eval_micro_prf, eval_fuzzy_exact, gold_label_join, score_histogram, side_by_side, corr_matrix, metric_pivot, param_sweep, ranked_lists):
    Q[_f.__name__] = _f

QUERIES, ORACLES = Q, O
