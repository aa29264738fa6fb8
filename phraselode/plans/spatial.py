"""Queries on places and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nearby
from ..session import durable
from .geography import PLACES, km


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of places at most 1 km apart, and the area that contains each place."""
    # Read four times below; the notations are parsed once.
    places = durable(nearby.possible_points(spark.read.parquet(f"{folder}/topic_doc_coordinates.parquet"), "loc_id"))
    near = nearby.near_pairs(places, "loc_id", 1.0)
    inside = nearby.containing(places, spark.read.parquet(f"{folder}/areas.parquet"), "loc_id", "area_id", "boundary")
    return near.select(F.lit("near").alias("kind"), "first_id", "second_id").unionByName(
        inside.select(F.lit("inside").alias("kind"), F.col("region_id").alias("first_id"), F.col("point_id").alias("second_id"))
    )


QUERIES = {"p5_found": p5_found}
ORACLES = {
    "p5_found": f"""WITH {PLACES}, r AS (SELECT area_id, unnest(regexp_extract_all(boundary, '\\(([^()]+)\\)', 1)) AS ring FROM areas),
v AS (SELECT area_id, list_transform(string_split(ring, ','), lambda p: list_transform(string_split(trim(p, ' '), ' '), lambda z: CAST(z AS DOUBLE))) AS pts FROM r),
e AS (SELECT area_id, pts[i][1] AS x1, pts[i][2] AS y1, pts[i % len(pts) + 1][1] AS x2, pts[i % len(pts) + 1][2] AS y2 FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM v))
SELECT 'near' AS kind, a.loc_id AS first_id, b.loc_id AS second_id FROM places_ a JOIN places_ b ON a.loc_id < b.loc_id AND abs(a.lat - b.lat) < 0.01 WHERE {km('a', 'b')} <= 1
UNION ALL SELECT 'inside' AS kind, area_id AS first_id, loc_id AS second_id FROM places_ JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY area_id, loc_id HAVING count(*) % 2 = 1"""
}
