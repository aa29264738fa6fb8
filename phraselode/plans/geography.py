"""Queries on distances, weights and spatial association. Those with SQL use distances on the sphere, which SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geodesic import distance_column
from ..functions.keys import finite
from ..operators import geo, nearby
from .tables import SCORES, r6, rounded, scores, sql6, table

Q: dict = {}
O: dict[str, str] = {}


def places(spark: SparkSession, folder: str) -> DataFrame:
    """loc_id, topic, doc, lat, lon of the possible points."""
    rows = table(spark, folder, "topic_doc_coordinates").withColumnRenamed("topic_id", "topic")
    return nearby.possible_points(rows, "loc_id", keep=["topic", "doc"])


_N = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?"
_POINT = rf"^\s*(?:srid\s*=\s*\d+\s*;\s*)?(?:point\s*\(|\{{.*\[)\s*({_N})\s*[\s,]\s*({_N})\s*[)\]]"
_XY = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"
_LL = "len(lat_long) = 2 AND lat_long[1] IS NOT NULL AND lat_long[2] IS NOT NULL AND NOT isnan(lat_long[1]) AND NOT isnan(lat_long[2])"
_GEO = lambda k: f"TRY_CAST(regexp_extract(lower(geometry), '{_POINT}', {k}) AS DOUBLE)"
PLACES = f"""raw_ AS (SELECT loc_id, topic_id AS topic, doc, CASE WHEN {_XY} THEN y WHEN {_LL} THEN lat_long[1] ELSE {_GEO(2)} END AS lat, CASE WHEN {_XY} THEN x WHEN {_LL} THEN lat_long[2] ELSE {_GEO(1)} END AS lon0 FROM topic_doc_coordinates),
places_ AS (SELECT loc_id, topic, doc, lat, CASE WHEN lon0 >= 180 THEN lon0 - 360 WHEN lon0 < -180 THEN lon0 + 360 ELSE lon0 END AS lon FROM raw_ WHERE abs(lat) <= 90 AND abs(lon0) <= 540)"""


def km(a: str, b: str) -> str:
    return f"(2 * 6371.0088 * asin(least(1, sqrt(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2))))"


def valid_points(spark: SparkSession, folder: str) -> DataFrame:
    return places(spark, folder)


O["valid_points"] = f"WITH {PLACES} SELECT loc_id, topic, doc, lat, lon FROM places_"


def geo_point_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Points and distinct points of every topic and document."""
    return places(spark, folder).groupBy("topic", "doc").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lat", "lon").alias("n_distinct"))


O["geo_point_statistics"] = f"WITH {PLACES} SELECT topic, doc, count(*) AS n, count(DISTINCT (lat, lon)) AS n_distinct FROM places_ GROUP BY ALL"


def _legs(spark: SparkSession, folder: str) -> DataFrame:
    """Each place of a document with the one before it."""
    w = Window.partitionBy("topic", "doc").orderBy("loc_id")
    return places(spark, folder).withColumn("lat0", F.lag("lat").over(w)).withColumn("lon0", F.lag("lon").over(w)).filter("lat0 IS NOT NULL")


_LEGS = "legs_ AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM places_ WINDOW w AS (PARTITION BY topic, doc ORDER BY loc_id))"


def geo_distance_vincenty(spark: SparkSession, folder: str) -> DataFrame:
    """Kilometres on the ellipsoid between successive places of a document."""
    return _legs(spark, folder).select("loc_id", r6(distance_column(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))).alias("km"))


def geo_distance_haversine(spark: SparkSession, folder: str) -> DataFrame:
    return _legs(spark, folder).select("loc_id", r6(distance_column(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"), "haversine")).alias("km"))


O["geo_distance_haversine"] = f"WITH {PLACES}, {_LEGS} SELECT loc_id, round(2 * 6371.0088 * asin(least(1, sqrt(sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2))), 6) + 0.0 AS km FROM legs_ WHERE lat0 IS NOT NULL"

_F, _A = "(1 / 298.257223563)", "6378.137"
_B = f"({_A} * (1 - {_F}))"
O["geo_distance_vincenty"] = f"""WITH RECURSIVE {PLACES}, {_LEGS},
u AS (SELECT loc_id, sin(atan((1 - {_F}) * tan(radians(lat0)))) AS s1, cos(atan((1 - {_F}) * tan(radians(lat0)))) AS c1, sin(atan((1 - {_F}) * tan(radians(lat)))) AS s2, cos(atan((1 - {_F}) * tan(radians(lat)))) AS c2, radians(lon - lon0) AS span FROM legs_ WHERE lat0 IS NOT NULL),
t AS (SELECT loc_id, s1, c1, s2, c2, span, span AS lam, CAST(NULL AS DOUBLE) AS before, 0 AS k FROM u
 UNION ALL SELECT loc_id, s1, c1, s2, c2, span, span + (1 - c) * {_F} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))), lam, k + 1 FROM (
  SELECT *, {_F} / 16 * ca * (4 + {_F} * (4 - 3 * ca)) AS c FROM (SELECT *, CASE WHEN ca > 0 THEN cs - 2 * s1 * s2 / ca ELSE 0 END AS cm FROM (SELECT *, 1 - sa * sa AS ca, atan2(ss, cs) AS sg FROM (
   SELECT *, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM (SELECT *, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM t WHERE k < 20)))))),
e AS (SELECT loc_id, before IS NULL OR abs(lam - before) < 1e-12 AS done, ss, cs, sg, CASE WHEN 1 - sa * sa > 0 THEN cs - 2 * s1 * s2 / (1 - sa * sa) ELSE 0 END AS cm, (1 - sa * sa) * ({_A} ** 2 - {_B} ** 2) / {_B} ** 2 AS k2 FROM (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM (SELECT *, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM t WHERE k = 20))),
f AS (SELECT *, 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))) AS aa, k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2))) AS bb FROM e)
SELECT loc_id, CASE WHEN done THEN round({_B} * aa * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 6) + 0.0 END AS km FROM f"""

_DECAY = {"inv": "1 / (500 + km)", "exp": "exp(-km / 1700)", "arccot": "atan(1 / (0.01 * greatest(km, 1e-20)))", "orig": "exp(-km)", "band": "CASE WHEN km <= 3000 THEN 1 / (500 + km) ELSE 0 END"}
_HOW = {"inv": {"a": 500.0}, "exp": {"decay": "exp", "a": 1 / 1700}, "arccot": {"decay": "arccot", "a": 0.01}, "orig": {"decay": "orig"}, "band": {"a": 500.0, "band": 3000.0}}


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """topic, id, lat, lon: the distinct points of each topic, known by their smallest loc_id."""
    return places(spark, folder).groupBy("topic", "lat", "lon").agg(F.min("loc_id").alias("id"))


def _weights(name: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return geo.weight_table(_points(spark, folder), ["topic"], places=9, keyed=False, **_HOW[name])

    Q[f"geo_weights_{name}"] = run
    O[f"geo_weights_{name}"] = f"WITH {PLACES}, p AS (SELECT topic, lat, lon, min(loc_id) AS id FROM places_ GROUP BY ALL), d AS (SELECT a.id AS i, b.id AS j, {km('a', 'b')} AS km FROM p a JOIN p b ON a.topic IS NOT DISTINCT FROM b.topic AND a.id <> b.id), w AS (SELECT i, j, {_DECAY[name]} AS w FROM d), n AS (SELECT i, j, round(w / nullif(sum(w) OVER (PARTITION BY i), 0), 9) AS w FROM w) SELECT * FROM n WHERE w > 0"


for _n in _DECAY:
    _weights(_n)


def _pairs_of(self_too: bool) -> str:
    return f"p AS (SELECT topic, lat, lon, min(loc_id) AS id FROM places_ GROUP BY ALL), d AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0 ELSE {km('a', 'b')} END AS km FROM p a JOIN p b ON a.topic IS NOT DISTINCT FROM b.topic{'' if self_too else ' AND a.id <> b.id'})"


def geo_weights_self(spark: SparkSession, folder: str) -> DataFrame:
    """Weights that count a point as its own neighbour."""
    return geo.weight_table(_points(spark, folder), ["topic"], decay="exp", a=1 / 500, include_self=True, places=9, keyed=False)


def geo_weights_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Weights that aren't standardised."""
    return geo.weight_table(_points(spark, folder), ["topic"], decay="exp", a=1 / 500, standardise=False, places=9, keyed=False)


O["geo_weights_self"] = f"WITH {PLACES}, {_pairs_of(True)}, w AS (SELECT i, j, exp(-km / 500) AS w FROM d), n AS (SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 9) AS w FROM w) SELECT * FROM n WHERE w > 0"
O["geo_weights_raw"] = f"WITH {PLACES}, {_pairs_of(False)}, n AS (SELECT i, j, round(exp(-km / 500), 9) AS w FROM d) SELECT * FROM n WHERE w > 0"


def geo_incidence_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The mean score of a candidate at its points, of the documents that mention it only."""
    mentioned = table(spark, folder, "incidence").filter("n >= 1").select("topic", "doc", "candidate").distinct()
    own = scores(spark, folder).join(mentioned, ["topic", "doc", "candidate"], "left_semi")
    return geo.point_scores(own, places(spark, folder)).select("topic", "candidate", "lat", "lon", r6("x").alias("x"))


O["geo_incidence_mean"] = f"WITH {SCORES}, {PLACES}, m_ AS (SELECT * FROM scores_ s WHERE EXISTS (SELECT 1 FROM incidence i WHERE i.topic = s.topic AND i.doc = s.doc AND i.candidate = s.candidate AND i.n >= 1)), x_ AS (SELECT s.topic, s.candidate, p.lat, p.lon, avg(s.score) AS x FROM m_ s JOIN (SELECT DISTINCT topic, doc, lat, lon FROM places_) p ON s.topic = p.topic AND s.doc = p.doc GROUP BY ALL) SELECT topic, candidate, lat, lon, round(x, 6) + 0.0 AS x FROM x_"


def geo_point_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The mean score of every candidate at every point of its documents."""
    return geo.point_scores(scores(spark, folder), places(spark, folder)).select("topic", "candidate", "lat", "lon", r6("x").alias("x"))


_X = "x_ AS (SELECT s.topic, s.candidate, p.lat, p.lon, avg(s.score) AS x FROM scores_ s JOIN (SELECT DISTINCT topic, doc, lat, lon FROM places_) p ON s.topic = p.topic AND s.doc = p.doc WHERE s.candidate IS NOT NULL GROUP BY ALL)"
O["geo_point_mean"] = f"WITH {SCORES}, {PLACES}, {_X} SELECT topic, candidate, lat, lon, round(x, 6) + 0.0 AS x FROM x_"


def geo_complete_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The best results of an experiment's topics that have gold and other candidates alike."""
    rows = table(spark, folder, "results").select(F.col("experiment").alias("topic"), F.col("topic").alias("doc"), F.col("in_gold").cast("string").alias("candidate"), finite("semantic_score").alias("score"))
    return geo.complete_cases(rows.dropna().groupBy("topic", "doc", "candidate").agg(F.max("score").alias("score")))


O["geo_complete_cases"] = "WITH s AS (SELECT experiment AS topic, topic AS doc, CAST(in_gold AS VARCHAR) AS candidate, max(semantic_score) AS score FROM results WHERE semantic_score IS NOT NULL AND NOT isnan(semantic_score) AND experiment IS NOT NULL AND topic IS NOT NULL AND in_gold IS NOT NULL GROUP BY ALL), n AS (SELECT topic, count(DISTINCT candidate) AS k FROM s GROUP BY topic), d AS (SELECT topic, doc FROM s JOIN n USING (topic) GROUP BY topic, doc, k HAVING count(DISTINCT candidate) = k) SELECT s.topic, s.doc, s.candidate, s.score FROM s JOIN d USING (topic, doc)"


def _indices(spark: SparkSession, folder: str) -> DataFrame:
    x = geo.point_scores(scores(spark, folder), places(spark, folder))
    return geo.association(x, decay="inv", a=500.0, distance="haversine")


def geo_indices_all(spark: SparkSession, folder: str) -> DataFrame:
    """I, C and G of every candidate over the points of its documents."""
    return _indices(spark, folder).select("topic", "candidate", "n_points", r6("moran_i").alias("moran_i"), r6("geary_c").alias("geary_c"), r6("getisord_g").alias("getisord_g"))


def geo_indices_vincenty(spark: SparkSession, folder: str) -> DataFrame:
    """The same with distances on the ellipsoid."""
    out = geo.association(geo.point_scores(scores(spark, folder), places(spark, folder)))
    return out.select("topic", "candidate", "n_points", *(r6(c).alias(c) for c in ("moran_i", "geary_c", "getisord_g")))


def geo_topic_association(spark: SparkSession, folder: str) -> DataFrame:
    """I, C and G of all places of a topic, the number of mentions being the score."""
    rows = places(spark, folder).join(table(spark, folder, "topic_doc_coordinates").select("loc_id", F.col("n").cast("double").alias("x")), "loc_id")
    at = rows.filter("x IS NOT NULL").groupBy("topic", "lat", "lon").agg(F.avg("x").alias("x"))
    return geo.association(at, ["topic"], distance="haversine").select("topic", "n_points", *(r6(c).alias(c) for c in ("moran_i", "geary_c", "getisord_g")))


def _index_sql(x: str, keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""p_ AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY lat, lon) AS id, avg(x) OVER g AS m, count(*) OVER g AS n, var_pop(x) OVER g AS v, sum(x) OVER g AS sx FROM {x} WINDOW g AS (PARTITION BY {keys})),
w_ AS (SELECT {', '.join(f'a.{k}' for k in keys.split(', '))}, a.id, a.x AS xi, b.x AS xj, a.m, a.n, a.v, a.sx, 1 / (500 + {km('a', 'b')}) AS w FROM p_ a JOIN p_ b ON {on} AND a.id <> b.id),
s_ AS (SELECT *, w / sum(w) OVER (PARTITION BY {keys}, id) AS r FROM w_),
i_ AS (SELECT {keys}, sum(r * (xi - m) * (xj - m)) AS zz, sum(r * (xi - xj) ** 2) AS gap, sum(r) AS w, sum(r * xi * xj) AS xx FROM s_ GROUP BY ALL),
k_ AS (SELECT {keys}, any_value(n) AS n, any_value(v) AS v, any_value(m) AS m, any_value(sx) AS sx FROM p_ GROUP BY {keys}),
o_ AS (SELECT k_.*, CASE WHEN n >= 2 THEN CASE WHEN v <= 1e-18 * greatest(1, m * m) THEN 1 ELSE zz / (n * v) END END AS moran_i, CASE WHEN n >= 2 THEN CASE WHEN v <= 1e-18 * greatest(1, m * m) THEN 0 ELSE (n - 1) * gap / (2 * i_.w * n * v) END END AS geary_c, CASE WHEN n >= 2 THEN xx / nullif(sx * sx, 0) END AS getisord_g FROM k_ LEFT JOIN i_ USING ({keys}))"""


_IND = f"WITH {SCORES}, {PLACES}, {_X}, {_index_sql('x_', 'topic, candidate')}"
_COLS = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("moran_i", "geary_c", "getisord_g"))
O["geo_indices_all"] = f"{_IND} SELECT topic, candidate, CAST(n AS INTEGER) AS n_points, {_COLS} FROM o_"
O["geo_topic_association"] = f"WITH {PLACES}, y_ AS (SELECT p.topic, lat, lon, avg(CAST(c.n AS DOUBLE)) AS x FROM places_ p JOIN topic_doc_coordinates c USING (loc_id) WHERE c.n IS NOT NULL AND p.topic IS NOT NULL GROUP BY ALL), {_index_sql('y_', 'topic')} SELECT topic, CAST(n AS INTEGER) AS n_points, {_COLS} FROM o_"


def _one(name: str, column: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _indices(spark, folder).select("topic", "candidate", r6(column).alias(column))

    Q[name] = run
    O[name] = f"{_IND} SELECT topic, candidate, round({column}, 6) + 0.0 AS {column} FROM o_"


_one("geo_moran", "moran_i")
_one("geo_geary", "geary_c")
_one("geo_getis", "getisord_g")


def geo_all_places(spark: SparkSession, folder: str) -> DataFrame:
    """I, C and G of all places as one group, with distances on the ellipsoid: the matrix a single process can't hold."""
    rows = places(spark, folder).join(table(spark, folder, "topic_doc_coordinates").select("loc_id", F.col("n").cast("double").alias("x")), "loc_id")
    at = rows.filter("x IS NOT NULL").groupBy("lat", "lon").agg(F.avg("x").alias("x")).withColumn("all", F.lit("all"))
    return geo.association(at, ["all"]).select("n_points", *(r6(c).alias(c) for c in ("moran_i", "geary_c", "getisord_g")))


def geo_moran_permuted(spark: SparkSession, folder: str) -> DataFrame:
    """I of every topic's places with the share of 19 permutations that reach it."""
    rows = places(spark, folder).join(table(spark, folder, "topic_doc_coordinates").select("loc_id", F.col("n").cast("double").alias("x")), "loc_id")
    at = rows.filter("x IS NOT NULL").groupBy("topic", "lat", "lon").agg(F.avg("x").alias("x"))
    return geo.permuted(at, ["topic"], 19, distance="haversine").select("topic", r6("moran_i").alias("moran_i"), r6("p_value").alias("p_value"))


# Combined scores of the stored results.


def _results(name: str, out, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "results").dropDuplicates(["result_id"]).withColumn("n", F.col("n").cast("double"))
        return rows.select("result_id", rounded(out(F.col("semantic_score"), F.col("n")), 9).alias("score"))

    Q[name] = run
    O[name] = f"SELECT result_id, {sql6(sql, 9)} AS score FROM (SELECT DISTINCT ON (result_id) * FROM results)"


_results("geo_score_i", lambda s, n: geo.score_moran(s, n, F.col("moran_i"), 0.5, 0.25), "semantic_score * 0.5 * (n - n * 0.25 * moran_i)")
_results("geo_score_c", lambda s, n: geo.score_geary(s, n, F.col("moran_i") + 1, 0.5, 0.25), "semantic_score * 0.5 * n / nullif(0.25 * (moran_i + 1), 0)")
_results("geo_score_g", lambda s, n: geo.score_getis(s, n, F.col("getisord_g"), 0.5, 0.25), "semantic_score * 0.5 * n * 0.25 * getisord_g")
_results("geo_score_logn", lambda s, n: geo.score_log_n(s, n, 0.118), "semantic_score + 0.118 * ln(nullif(n, 0))")
_results("geo_rerank_power", lambda s, n: geo.rerank_power(s, F.col("getisord_g"), -0.5), "semantic_score * CASE WHEN getisord_g > 0 THEN getisord_g ** -0.5 END")


_results("geo_score_plus_i", lambda s, n: geo.score_plus(s, F.col("moran_i"), 0.118), "semantic_score + 0.118 * moran_i")
_results("geo_score_plus_log", lambda s, n: geo.score_plus_log(s, F.col("getisord_g"), 0.118), "semantic_score + 0.118 * CASE WHEN getisord_g > 0 THEN ln(getisord_g) END")
_results("geo_score_filled", lambda s, n: geo.fill_missing(s, finite("moran_i")), "CASE WHEN semantic_score IS NULL OR isnan(semantic_score) THEN (1 + 1.2e8 / 16777216) * ln(nullif(abs(CASE WHEN NOT isnan(moran_i) THEN moran_i END), 0)) ELSE semantic_score END")


def geo_share_of_most(spark: SparkSession, folder: str) -> DataFrame:
    """n of each result over the greatest n of its experiment and topic."""
    rows = table(spark, folder, "results").select("result_id", "experiment", "topic", "n").distinct()
    return rows.select("result_id", "experiment", "topic", rounded(geo.share_of_most(F.col("n"), "experiment", "topic"), 9).alias("share"))


O["geo_share_of_most"] = f"SELECT result_id, experiment, topic, {sql6('n / nullif(max(n) OVER (PARTITION BY experiment, topic), 0)', 9)} AS share FROM (SELECT DISTINCT result_id, experiment, topic, n FROM results)"


def geo_index_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Results within the ranges of association; the filter reaches the scan."""
    rows = table(spark, folder, "results").filter("moran_i > -0.07 AND moran_i < 0.89 AND getisord_g > 0 AND getisord_g < 0.07 AND n > 1")
    return rows.select("result_id").distinct()


O["geo_index_filter"] = "SELECT DISTINCT result_id FROM results WHERE moran_i > -0.07 AND moran_i < 0.89 AND getisord_g > 0 AND getisord_g < 0.07 AND n > 1"


def geo_softmax(spark: SparkSession, folder: str) -> DataFrame:
    """Semantic score plus 0.86 times the softmax of n in its experiment and topic."""
    rows = table(spark, folder, "results").dropDuplicates(["result_id"]).filter("n IS NOT NULL AND semantic_score IS NOT NULL AND NOT isnan(semantic_score)")
    return rows.select("result_id", r6(F.col("semantic_score") + 0.86 * geo.softmax(F.col("n").cast("double"), "experiment", "topic")).alias("score"))


O["geo_softmax"] = "WITH r AS (SELECT DISTINCT ON (result_id) * FROM results WHERE n IS NOT NULL AND semantic_score IS NOT NULL AND NOT isnan(semantic_score)), e AS (SELECT *, exp(n - max(n) OVER (PARTITION BY experiment, topic)) AS e FROM r) SELECT result_id, round(semantic_score + 0.86 * e / sum(e) OVER (PARTITION BY experiment, topic), 6) + 0.0 AS score FROM e"


def geo_hsic(spark: SparkSession, folder: str) -> DataFrame:
    """How far the places of a topic and their numbers of mentions depend on each other."""
    rows = places(spark, folder).join(table(spark, folder, "topic_doc_coordinates").select("loc_id", F.col("n").alias("x")), "loc_id")
    return geo.hsic(rows, ["topic"], "loc_id", ["lat", "lon"], ["x"]).select("topic", "n", rounded("hsic", 7).alias("hsic"))


O["geo_hsic"] = f"""WITH {PLACES}, q AS (SELECT p.topic, p.loc_id AS id, p.lat, p.lon, CAST(c.n AS DOUBLE) AS x FROM places_ p JOIN topic_doc_coordinates c USING (loc_id) WHERE c.n IS NOT NULL),
d AS (SELECT a.topic, a.id, (a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2 AS dx, (a.x - b.x) ** 2 AS dy FROM q a JOIN q b ON a.topic IS NOT DISTINCT FROM b.topic),
w AS (SELECT topic, coalesce(quantile_cont(dx, 0.5) FILTER (dx > 0) / 2, 2.0 ** -104) AS wx, coalesce(quantile_cont(dy, 0.5) FILTER (dy > 0) / 2, 2.0 ** -104) AS wy FROM d GROUP BY topic),
k AS (SELECT d.topic, d.id, sum(exp(-dx / (2 * wx))) AS k, sum(exp(-dy / (2 * wy))) AS l, sum(exp(-dx / (2 * wx)) * exp(-dy / (2 * wy))) AS kl FROM d JOIN w ON d.topic IS NOT DISTINCT FROM w.topic GROUP BY d.topic, d.id),
g AS (SELECT topic, count(*) AS n, sum(kl) AS kl, sum(k) AS k, sum(l) AS l, sum(k * l) AS kxl FROM k GROUP BY topic)
SELECT topic, n, round((kl - 2 / n * kxl + k * l / (n * n)) / (n * n), 7) + 0.0 AS hsic FROM g"""

for _f in (geo_weights_self, geo_weights_raw, geo_incidence_mean, geo_share_of_most, valid_points, geo_point_statistics, geo_distance_vincenty, geo_distance_haversine, geo_point_mean, geo_complete_cases, geo_indices_all, geo_indices_vincenty, geo_topic_association, geo_all_places, geo_moran_permuted, geo_index_filter, geo_softmax, geo_hsic):
    Q[_f.__name__] = _f

QUERIES, ORACLES = Q, O
