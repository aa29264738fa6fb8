"""Points near other points, and the regions that contain them.

Points are hashed to grid cells: rows of equal latitude, each cut into columns of about the same width on the
ground. A point lies in one cell and asks all cells that its circle can touch, usually one to four; distances
decide in the end. Columns wrap around at 180 degrees and close around the poles. Regions are cut into cells too; a
cell keeps whether its south-west corner is inside and the boundary's edges that reach it, so that a point is settled
by the edges between it and the corner.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import copied, dealt, hot_keys
from ..session import durable

EARTH_KM = 6371.0088
#: Points of a cell that one task compares with those that ask for the cell.
HOT_CELL = 20_000
#: Degrees of a region's cells, the most bytes of these that are broadcast, and the points of a cell that one task gets otherwise.
REGION_CELL = 2.0
BROADCAST_BYTES = 64_000_000
POINTS = 200_000

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def possible_points(places: DataFrame, id_col: str, x: str = "x", y: str = "y", lat_long: str = "lat_long", geometry: str = "geometry", keep: Sequence[str] = ()) -> DataFrame:
    """``id_col``, ``keep``, lat, lon of the rows with a complete, possible point.

    The point is taken from x (longitude) and y (latitude), else from the array lat_long, else from the text
    geometry (WKT with or without SRID, in any letter case and spacing, or GeoJSON, longitude first). Null, NaN and
    half points are incomplete. Longitudes are brought into [-180, 180); a latitude beyond 90 or a longitude beyond
    540 is impossible. Null ids stay.
    """

    def pair(lat: Column, lon: Column) -> Column:
        return F.when(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon), F.struct(lat.alias("lat"), lon.alias("lon")))

    text = rf"^\s*(?:srid\s*=\s*\d+\s*;\s*)?(?:point\s*\(|\{{.*\[)\s*({_NUMBER})\s*[\s,]\s*({_NUMBER})\s*[)\]]"
    number = lambda k: F.regexp_extract(F.lower(geometry), text, k).try_cast("double")
    point = F.coalesce(
        pair(F.col(y).cast("double"), F.col(x).cast("double")),
        F.when(F.size(lat_long) == 2, pair(F.element_at(F.col(lat_long), 1).cast("double"), F.element_at(F.col(lat_long), 2).cast("double"))),
        pair(number(2), number(1)),
    )
    found = places.select(id_col, *keep, point.alias("_p")).select(id_col, *keep, "_p.lat", "_p.lon").filter("abs(lat) <= 90 AND abs(lon) <= 540")
    return found.withColumn("lon", F.expr("CASE WHEN lon >= 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END"))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a sphere of the Earth's mean radius."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _columns_of(row: Column, step: float) -> Column:
    """How many cells a row of latitude has."""
    return F.greatest(F.lit(1), F.floor(F.lit(360 / step) * F.cos(F.radians((row + 0.5) * step - 90)))).cast("bigint")


def _row_of(lat: Column, step: float) -> Column:
    return F.floor((F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0)) + 90) / step)


def _column_of(lon: Column, columns: Column) -> Column:
    return F.floor((lon + 180) / 360 * columns)


def _cell(row: Column, column: Column) -> Column:
    return row * F.lit(1 << 32) + column


def near_pairs(points: DataFrame, id_col: str, km: float, hot_cell: int = HOT_CELL) -> DataFrame:
    """first_id, second_id, km: every two ids at most ``km`` apart, the smaller id first.

    ``points`` has ``id_col``, lat, lon. Rows with a null id or place are in no pair; rows with the same id are one
    another's no pair. A cell with more than ``hot_cell`` points is split: each part meets the points that ask for
    the cell in a task of its own. There are at most (points / hot_cell) such cells, which are broadcast.
    """
    reach = math.degrees(km / EARTH_KM) * 1.000001
    step = 2 * reach
    at = points.filter(F.col(id_col).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(id_col).alias("_id"), "lat", "lon")
    row = _row_of(F.col("lat"), step)
    columns = _columns_of(row, step)
    homes = at.withColumn("_cell", _cell(row, F.pmod(_column_of(F.col("lon"), columns), columns)))

    # A circle around latitude p spans asin(sin r / cos p) of longitude, or all of it where it holds a pole.
    ratio = F.sin(F.lit(math.radians(reach))) / F.cos(F.radians("lat"))
    width = F.when(F.abs("lat") + reach >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))

    def cells(r: Column) -> Column:
        n = _columns_of(r, step)
        low, high = _column_of(F.col("lon") - F.col("_w"), n), _column_of(F.col("lon") + F.col("_w"), n)
        return F.transform(F.sequence(low, F.least(high, low + n - 1)), lambda c: _cell(r, F.pmod(c, n)))

    rows = F.sequence(_row_of(F.col("lat") - reach, step), _row_of(F.col("lat") + reach, step))
    asks = at.withColumn("_w", width).withColumn("_cell", F.explode(F.array_distinct(F.flatten(F.transform(rows, cells))))).drop("_w")

    hot = homes.groupBy("_cell").count().filter(F.col("count") > hot_cell).select("_cell", F.ceil(F.col("count") / hot_cell).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    homes = homes.join(F.broadcast(hot), "_cell", "left").withColumn("_part", F.pmod(F.hash("_id"), parts)).drop("_parts")
    asks = asks.join(F.broadcast(hot), "_cell", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    a, b = asks.alias("a"), homes.alias("b")
    both = a.join(b, (F.col("a._cell") == F.col("b._cell")) & (F.col("a._part") == F.col("b._part")) & (F.col("a._id") < F.col("b._id")) & (F.abs(F.col("a.lat") - F.col("b.lat")) <= reach))
    # Equal points, such as places found again and again, need no trigonometry.
    equal = (F.col("a.lat") == F.col("b.lat")) & (F.col("a.lon") == F.col("b.lon"))
    apart = F.when(equal, 0.0).otherwise(great_circle_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")))
    return both.select(F.col("a._id").alias("first_id"), F.col("b._id").alias("second_id"), apart.alias("km")).filter(F.col("km") <= km)


_RING = re.compile(r"\(([^()]+)\)")


def _edges(boundary: str | None) -> list[tuple[float, float, float, float]]:
    """The edges of all rings of a WKT polygon or multipolygon; none if it is no such text."""
    out = []
    try:
        for ring in _RING.findall(boundary or ""):
            at = [tuple(map(float, p.split()[:2])) for p in ring.split(",")]
            out += [(*p, *q) for p, q in zip(at, [*at[1:], at[0]]) if p != q]
    except (ValueError, TypeError):
        return []
    return out


_EDGE = ("x1", "y1", "x2", "y2")


def region_cells(edges: list[tuple[float, float, float, float]], step: float) -> Iterator[tuple[int, int, bool, list[dict]]]:
    """row, column, whether the south-west corner is inside, and the edges that reach the cell; cells outside are left out."""
    lows = [(min(e[0], e[2]), min(e[1], e[3])) for e in edges]
    highs = [(max(e[0], e[2]), max(e[1], e[3])) for e in edges]
    west, east = math.floor(min(x for x, _ in lows) / step), math.floor(max(x for x, _ in highs) / step)
    reached: dict[tuple[int, int], list[dict]] = {}
    for e, low, high in zip(edges, lows, highs):
        edge = dict(zip(_EDGE, e))
        # Cells are closed here: an edge along a side belongs to both.
        for r in range(math.ceil(low[1] / step) - 1, math.floor(high[1] / step) + 1):
            for c in range(math.ceil(low[0] / step) - 1, math.floor(high[0] / step) + 1):
                reached.setdefault((r, c), []).append(edge)
    for r in range(math.floor(min(y for _, y in lows) / step), math.floor(max(y for _, y in highs) / step) + 1):
        y = r * step
        meets = sorted(x1 if y == y1 else x2 if y == y2 else (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges if (y1 > y) != (y2 > y))
        for c in range(west, east + 1):
            inside, own = (len(meets) - bisect_right(meets, c * step)) % 2 == 1, reached.get((r, c), [])
            if inside or own:
                yield r, c, inside, own


def _cells_of(step: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.float64()) for n in _EDGE]))
        for batch in batches:
            for key, boundary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if edges := _edges(boundary):
                    rows, columns, inside, kept = zip(*region_cells(edges, step))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(inside), pa.array(kept, kind)], ["region_id", "_row", "_column", "inside", "edges"])

    return run


def containing(points: DataFrame, regions: DataFrame, id_col: str, region_id: str, boundary: str, step: float = REGION_CELL, broadcast_bytes: int = BROADCAST_BYTES, points_of_cell: int = POINTS) -> DataFrame:
    """region_id, point_id for every point within a region; its boundary's edges are straight in degrees.

    ``boundary`` is WKT, longitude first. Holes are outside, pieces of a multipolygon inside. A null or unreadable
    boundary contains nothing; neither do regions with a null id. An edge is kept once for each cell that it reaches.
    The cells are counted in bytes and broadcast up to ``broadcast_bytes``; beyond, points meet them by a shuffle in
    which a task gets at most about ``points_of_cell`` points of a cell.
    """
    named = regions.filter(F.col(region_id).isNotNull()).select(F.col(region_id).cast("bigint").alias("_k"), F.col(boundary).cast("string").alias("_b"))
    cells = durable(named.mapInArrow(_cells_of(step), "region_id bigint, _row int, _column int, inside boolean, edges array<struct<x1: double, y1: double, x2: double, y2: double>>"))
    size = cells.agg(F.sum(F.size("edges") * 40 + 64)).first()[0] or 0
    at = points.select(F.col(id_col).alias("point_id"), "lat", "lon", F.floor(F.col("lat") / step).cast("int").alias("_row"), F.floor(F.col("lon") / step).cast("int").alias("_column"))
    keys = ["_row", "_column"]
    if size <= broadcast_bytes:
        met = at.join(F.broadcast(cells), keys)
    else:
        hot = hot_keys(at.groupBy(*keys).count(), keys, "count", points_of_cell)
        met = dealt(at, hot, keys).join(copied(cells, hot, keys), [*keys, "_turn"])
    west, south = F.col("_column") * step, F.col("_row") * step

    def between(at: Column, a: Column, b: Column, p: Column, q: Column) -> Column:
        """Where the edge from (a, p) to (b, q) has the coordinate ``at``; exact at its ends."""
        return F.when(at == a, p).when(at == b, q).otherwise((q - p) * (at - a) / F.nullif(b - a, F.lit(0.0)) + p)

    def crossed(inside: Column, e: Column) -> Column:
        """From the corner along the west side to the point's latitude, then east to the point. The path runs a touch east
        of the side and, by less than that, north of corner and point: so an edge through the corner is above it if it rises."""
        x_meets, y_meets = between(F.col("lat"), e["y1"], e["y2"], e["x1"], e["x2"]), between(west, e["x1"], e["x2"], e["y1"], e["y2"])
        rises = (e["y2"] > e["y1"]) == (e["x2"] > e["x1"])
        above = lambda y: (y_meets > y) | ((y_meets == y) & rises & (e["y1"] != e["y2"]))
        eastward = ((e["y1"] > F.col("lat")) != (e["y2"] > F.col("lat"))) & (x_meets > west) & (x_meets <= F.col("lon"))
        northward = ((e["x1"] > west) != (e["x2"] > west)) & (above(south) != above(F.col("lat")))
        return inside != (F.coalesce(eastward, F.lit(False)) != F.coalesce(northward, F.lit(False)))

    return met.filter(F.aggregate("edges", F.col("inside"), crossed)).select("region_id", "point_id")
