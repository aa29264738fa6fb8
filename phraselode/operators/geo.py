"""Spatial association of scores: how alike the scores of near points are.

Moran's I, Geary's C and Getis-Ord G of a group's points need, of each point, only the sums of its weights and of
its neighbours' weighted scores and squares. Those come from blocks of points against blocks of points, in NumPy, so
a group's distance matrix never exists as rows and may be larger than any task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesic import DECAYS, DISTANCES
from ..functions.keys import finite, lookup, null_safe_key
from ..session import durable
from .blocks import HELD, SIZE, Kernel, one_block, pairwise
from .far import weighted_sums


#: Pairs of points whose weights are computed at once: their arrays stay in a core's cache.
SLAB = 1 << 14


def _weights(left: dict, right: dict, same: bool, decay: str, a: float, distance: str, band: float | None, include_self: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """The weights of the points of two blocks, a few rows of the left block after another."""
    step = max(1, SLAB // max(1, len(right["lat"])))
    for begin in range(0, len(left["lat"]), step):
        at = slice(begin, begin + step)
        d = DISTANCES[distance](left["lat"][at, None], left["lon"][at, None], right["lat"][None, :], right["lon"][None, :])
        w = np.nan_to_num(DECAYS[decay](d, a))
        if band is not None:
            w = np.where(d <= band, w, 0.0)
        if same and not include_self:
            row = np.arange(len(w))
            w[row, begin + row] = 0.0
        yield at, w


def point_scores(scores: DataFrame, places: DataFrame, keys: Sequence[str] = ("topic", "candidate")) -> DataFrame:
    """keys, lat, lon, x: a candidate's mean score at each distinct point of its documents.

    ``scores`` has topic, doc, candidate and score, ``places`` topic, doc, lat and lon; rows with a null are left out.
    """
    s = scores.select("topic", "doc", "candidate", finite("score").alias("score")).dropna()
    p = places.select("topic", "doc", "lat", "lon").dropna().distinct()
    return s.join(p, ["topic", "doc"]).groupBy(*keys, "lat", "lon").agg(F.avg("score").alias("x"))


def complete_cases(scores: DataFrame) -> DataFrame:
    """The rows of the documents that have every candidate of their topic."""
    rows = scores.select("topic", "doc", "candidate", finite("score").alias("score")).dropna()
    n = rows.groupBy("topic").agg(F.countDistinct("candidate").alias("_all"))
    whole = rows.groupBy("topic", "doc").agg(F.countDistinct("candidate").alias("_has")).join(n, "topic").filter("_has = _all")
    return rows.join(whole.select("topic", "doc"), ["topic", "doc"], "left_semi")


#: Points of a block where the matrix itself is the result: fewer copies of blocks than elsewhere, since its cells leave in slabs.
TABLE_BLOCK = 2048
#: Different weights from which cells are better written by weight than by row: files keep a dictionary of fewer.
KINDS = 1 << 16


def _to_write(w: np.ndarray) -> Iterator[np.ndarray]:
    """The places of the weights that aren't 0, some after others, in the order that files of them are smallest in.

    Those are by row, where points repeat; or by weight, if there are too many different ones for a dictionary and each
    is met several times. A weight is then written once for all its cells, and the two points take a few bits each.
    """
    at = np.flatnonzero(w)
    if len(at) > 3 * KINDS:
        found = w[at]
        order = np.argsort(found)
        found = found[order]
        kinds = 1 + np.count_nonzero(found[1:] != found[:-1])
        if KINDS < kinds < len(at) / 3:
            at = at[order]
    yield from (at[k : k + HELD] for k in range(0, len(at), HELD))


#: Cells of more different weights than a file's dictionary has are held until a task has no others, or that many are.
CELLS_HELD = 1 << 22
#: Different weights of a file's dictionary (1 MB of doubles, and some room), and rows of its first page, which decides whether it is kept.
DICTIONARY, PAGE = 130_000, 20_000
#: Columns of a tile, in which the cells of a row follow those of the row before; and cells that stay together, so that their columns' bits fill bytes.
TILE, OCTET = 256, 8


def _along(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """The order of points along a curve through cells (Z-order)."""
    cell = lambda v, low, span, n: np.clip(np.nan_to_num((v - low) / span * n), 0, n - 1).astype(np.int64)
    y, x = cell(lat, -90, 180, CELL_ROWS), cell(lon, -180, 360, 2 * CELL_ROWS)
    return np.argsort(sum(((y >> k & 1) << 2 * k) + ((x >> k & 1) << 2 * k + 1) for k in range((2 * CELL_ROWS).bit_length())), kind="stable")


def _common(w: np.ndarray, below: float) -> np.ndarray:
    """Which cells have weights above 0 and under ``below``, whole octets of a row only."""
    few = (w > 0) & (w < below)
    whole = w.shape[1] // OCTET * OCTET
    few[:, whole:] = False
    octets = few[:, :whole].reshape(len(w), -1, OCTET)
    octets &= octets.all(axis=2, keepdims=True)
    return few


def _suits(w: np.ndarray, few: np.ndarray) -> bool:
    """Whether a dictionary is worth it: the cells are many, most of them in ``few``, and two thirds of the pages smaller with a dictionary of their own."""
    if w.size <= 3 * KINDS or 4 * np.count_nonzero(few) < 3 * w.size:
        return False
    smaller = []
    for begin in range(0, w.shape[1], TILE):
        cells = w[:, begin : begin + TILE][few[:, begin : begin + TILE]]
        for k in np.linspace(0, max(0, len(cells) - PAGE), 4).astype(int):
            page = cells[k : k + PAGE]
            kinds = len(np.unique(page))
            smaller.append(8 * kinds + len(page) * kinds.bit_length() / 8 < 8 * len(page))
    return 3 * sum(smaller) > 2 * len(smaller)


def _opening(w: np.ndarray, few: np.ndarray) -> np.ndarray:
    """The octets of two pages that have the smallest weights, which are alike: a file keeps a dictionary if its first page is smaller for it."""
    whole = w.shape[1] // OCTET * OCTET
    most = np.where(few, w, np.inf)[:, :whole].reshape(-1, OCTET).max(axis=1)
    at = np.argpartition(most, 2 * PAGE // OCTET)[: 2 * PAGE // OCTET]
    first = np.zeros((len(w), whole // OCTET), bool)
    first.ravel()[at] = True
    out = np.zeros_like(few)
    out[:, :whole] = np.repeat(first, OCTET, axis=1)
    return out & few


def weight_table(points: DataFrame, keys: Sequence[str], decay: str = "inv", a: float = 500.0, distance: str = "haversine", band: float | None = None, include_self: bool = False, standardise: bool = True, places: int | None = None, keyed: bool = True) -> DataFrame:
    """_g (if ``keyed``), i, j, w: the weights of a group's points (keys, id, lat, lon) that aren't 0, row-standardised or as they are.

    For groups whose matrix is wanted itself; the indices below don't make it. With ``places``, weights are rounded to
    these before those of 0 are left out, and cells leave in the order that files of them are smallest in: if most weights
    fit into a file's dictionary, row by row in tiles, and the others of a task after them; else as :func:`_to_write` has them.
    """
    items = points.select(null_safe_key(*keys).alias("_g"), "id", "lat", "lon")
    how = (decay, a, distance, band, include_self)
    apart = places is not None and not keyed
    if standardise:
        items = durable(items)

        def totals(left: dict, right: dict, same: bool) -> dict:
            rows, columns = np.zeros(len(left["id"])), np.zeros(len(right["id"]))
            for at, w in _weights(left, right, same, *how):
                rows[at] = w.sum(axis=1)
                columns += w.sum(axis=0)
            return {"id": left["id"], "total": rows} if same else {"id": np.concatenate([left["id"], right["id"]]), "total": np.concatenate([rows, columns])}

        # The distances are computed again for the cells: cells that wait for their row's sum would all be shuffled, points are few.
        by_row = pairwise(items, None, "_g", "id", totals, "id bigint, total double", TABLE_BLOCK, half=True)
        items = durable(items.join(by_row.groupBy("_g", "id").agg(F.sum("total").alias("total")), ["_g", "id"]))

    def cells() -> tuple[Kernel, Callable[[], Iterator[dict]]]:
        held: list[dict] = []
        tiled: bool | None = None  # by the first pair of a task: its cells share a file

        def rest() -> Iterator[dict]:
            if held:
                i, j, w = (np.concatenate([part[c] for part in held]) for c in "ijw")
                held.clear()
                yield from ({"i": i[at], "j": j[at], "w": w[at]} for at in _to_write(w))

        def of_pair(left: dict, right: dict, same: bool) -> Iterator[dict]:
            nonlocal tiled
            if apart:
                left, right = ({k: v[at] for k, v in block.items()} for block in (left, right) for at in [_along(block["lat"], block["lon"])])
            found = np.empty((len(left["id"]), len(right["id"])))
            for at, w in _weights(left, right, same, *how):
                if standardise:
                    total = left["total"][at, None]
                    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
                found[at] = w if places is None else np.round(w, places)
            part = lambda i, j: {"i": left["id"][i], "j": right["id"][j], "w": found[i, j]}
            others = found != 0
            if apart and tiled is not False:
                few = _common(found, DICTIONARY / 10**places)
                if tiled is None and (tiled := _suits(found, few)):
                    opening = _opening(found, few)
                    yield part(*np.nonzero(opening))
                    few &= ~opening
                    others &= ~opening
            if not tiled:
                yield from (part(*np.divmod(at, len(right["id"]))) for at in _to_write(found.ravel()))
                return
            for begin in range(0, few.shape[1], TILE):
                i, j = np.nonzero(few[:, begin : begin + TILE])
                yield from (part(i[k : k + HELD], begin + j[k : k + HELD]) for k in range(0, len(i), HELD))
            held.append(part(*np.nonzero(others & ~few)))
            if sum(len(p["w"]) for p in held) >= CELLS_HELD:
                yield from rest()

        return of_pair, rest

    return pairwise(items, None, "_g", "id", cells, "i bigint, j bigint, w double", TABLE_BLOCK, keyed=keyed, staged=True)


#: Weights that :mod:`.far` can interpolate: smooth wherever points are apart, in proportion to how far they are.
SMOOTH = ("inv", "arccot")
#: Points of a block of such weights, and rows of latitude (half of the columns of longitude) of the cells that blocks are made of.
FAR_BLOCK, CELL_ROWS = 2048, 32


def _by_place(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """The items of groups of up to ``size``, and of larger ones with _order: about the share of points before this one along a curve through cells.

    The curve is in Z-order, so that blocks of successive points lie together. Points of one cell are in no order.
    """
    counts = items.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)
    if counts.isEmpty():
        return items, None
    big = F.broadcast(counts)  # at most a row for each ``size`` points
    cell = lambda c, low, span, n: F.least(F.greatest(F.floor((F.col(c) - low) / span * n), F.lit(0)), F.lit(n - 1)).cast("int")
    y, x = cell("lat", -90, 180, CELL_ROWS), cell("lon", -180, 360, 2 * CELL_ROWS)
    bit = lambda v, k, to: F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), to)
    z = sum((bit(y, k, 2 * k) + bit(x, k, 2 * k + 1) for k in range((2 * CELL_ROWS).bit_length())), F.lit(0))
    celled = items.join(big.select("_g"), "_g", "left_semi").withColumn("_z", z)
    cells = celled.groupBy("_g", "_z").agg(F.count(F.lit(1)).alias("_k")).join(big, "_g")
    up = Window.partitionBy("_g").orderBy("_z").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_g", "_z", "_k", (F.coalesce(F.sum("_k").over(up), F.lit(0)) / F.col("_n")).alias("_from"), (F.col("_k") / F.col("_n")).alias("_share"))
    within = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) / (1 << 20)
    placed = lookup(celled, cells, ["_g", "_z"], "_k").withColumn("_order", F.col("_from") + F.col("_share") * within)
    return items.join(big.select("_g"), "_g", "left_anti"), durable(placed.select(*items.columns, "_order"))


def association(points: DataFrame, keys: Sequence[str] = ("topic", "candidate"), decay: str = "inv", a: float = 500.0, distance: str = "vincenty", band: float | None = None, include_self: bool = False) -> DataFrame:
    """keys, n_points, moran_i, geary_c, getisord_g of each group of points (keys, lat, lon, x).

    Weights decay with distance (``DECAYS``), are 0 beyond ``band`` km and on the diagonal (unless ``include_self``, as
    older data have it), and each point's sum to 1. One point: all null. Equal scores: I = 1 and C = 0. Points with a
    null or NaN are left out; points at one place are points of their own. A point without neighbours adds nothing.
    Smooth weights of groups above ``blocks.SIZE`` points are interpolated between boxes far apart (see :mod:`.far`).
    """
    rows = points.select(*keys, "lat", "lon", finite("x").alias("x")).filter("lat IS NOT NULL AND lon IS NOT NULL AND x IS NOT NULL")
    # Counting the groups, blocking their points and naming the results all read the points: written once.
    items = durable(rows).withColumn("_g", null_safe_key(*keys)).withColumn("id", F.xxhash64("lat", "lon", "x"))
    names = items.groupBy("_g").agg(*(F.first(k).alias(k) for k in keys))

    def sums(left: dict, right: dict, same: bool) -> dict:
        # Distances are symmetric: a pair of blocks gives both blocks' sums.
        x, z = right["x"], left["x"]
        of_x, of_z = (np.stack([np.ones(len(v)), v, v * v], 1) for v in (x, z))
        if smooth:
            weight = lambda *at: np.nan_to_num(DECAYS[decay](DISTANCES[distance](*at), a))
            rows, columns = weighted_sums((left["lat"], left["lon"], of_z), None if same else (right["lat"], right["lon"], of_x), weight, include_self)
        else:
            rows, columns = np.zeros((len(z), 3)), np.zeros((len(x), 3))
            for at, w in _weights(left, right, same, decay, a, distance, band, include_self):
                rows[at] = w @ of_x
                if not same:
                    columns += w.T @ of_z[at]
        i, xi = left["id"], z
        if not same:
            i, xi, rows = np.concatenate([i, right["id"]]), np.concatenate([z, x]), np.concatenate([rows, columns])
        return {"i": i, "xi": xi, "w": rows[:, 0], "wx": rows[:, 1], "wxx": rows[:, 2]}

    def flat(at: dict, i: np.ndarray, j: np.ndarray) -> dict:
        own = np.arange(len(at["x"]))
        i, j = i[i < j], j[i < j]  # symmetric, too
        w = []
        for begin in range(0, len(i), SLAB):
            p, q = i[begin : begin + SLAB], j[begin : begin + SLAB]
            d = DISTANCES[distance](at["lat"][p], at["lon"][p], at["lat"][q], at["lon"][q])
            w.append(np.nan_to_num(DECAYS[decay](d, a)))
            if band is not None:
                w[-1] = np.where(d <= band, w[-1], 0.0)
        if include_self:
            i, j = np.concatenate([i, own]), np.concatenate([j, own])
            w.append(np.full(len(own), np.nan_to_num(DECAYS[decay](0.0, a))))
        w = np.concatenate([np.zeros(0), *w])
        other = i != j
        x = at["x"]
        count = lambda at, v: np.bincount(at, v, minlength=len(own)).astype(float)  # noqa: E731  of nothing it counts in integers
        total = lambda v: count(i, w * v[j]) + count(j[other], (w * v[i])[other])
        return {"i": at["id"], "xi": x, "w": total(np.ones(len(own))), "wx": total(x), "wxx": total(x * x)}

    smooth = decay in SMOOTH and a >= 0 and band is None
    own = items.select("_g", "id", "lat", "lon", "x")
    out = "i bigint, xi double, w double, wx double, wxx double"
    whole = lambda parts: parts.groupBy("_g", "i", "xi").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"), F.sum("wxx").alias("wxx"))
    if smooth:
        small, large = _by_place(own, min(SIZE, FAR_BLOCK))
        by_point = one_block(small, "_g", "id", flat, out)  # already a row a point
        if large is not None:
            by_point = by_point.unionByName(whole(pairwise(large, None, "_g", "id", sums, out, FAR_BLOCK, half=True, order="_order")))
    else:
        by_point = whole(pairwise(own, None, "_g", "id", sums, out, half=True, flat=flat))
    # Standardised rows: y = sum of w x / sum of w, and likewise for the squares.
    y, yy = F.try_divide("wx", "w"), F.try_divide("wxx", "w")
    linked = F.when(F.col("w") > 0, 1.0).otherwise(0.0)
    g = by_point.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("xi").alias("mean"),
        F.sum("xi").alias("sx"),
        F.var_pop("xi").alias("variance"),
        F.sum(F.col("xi") * y).alias("xwx"),
        F.sum(y).alias("wx"),
        F.sum(F.col("xi") * linked).alias("lx"),
        F.sum(linked * F.col("xi") * F.col("xi") - 2 * F.col("xi") * F.coalesce(y, F.lit(0.0)) + F.coalesce(yy, F.lit(0.0))).alias("gap"),
        F.sum(linked).alias("w"),
    )
    m = F.col("mean")
    zwz = F.col("xwx") - m * F.col("wx") - m * F.col("lx") + m * m * F.col("w")
    squares = F.col("n") * F.col("variance")
    flat = F.col("variance") <= 1e-18 * F.greatest(F.lit(1.0), m * m)
    several = F.col("n") >= 2
    out = g.select(
        "_g",
        F.col("n").cast("int").alias("n_points"),
        F.when(several, F.when(flat, 1.0).otherwise(F.try_divide(zwz, squares))).alias("moran_i"),
        F.when(several, F.when(flat, 0.0).otherwise(F.try_divide((F.col("n") - 1) * F.col("gap"), 2 * F.col("w") * squares))).alias("geary_c"),
        F.when(several, F.try_divide("xwx", F.col("sx") * F.col("sx"))).alias("getisord_g"),
    )
    return out.join(names, "_g").select(*keys, "n_points", "moran_i", "geary_c", "getisord_g")


def permuted(points: DataFrame, keys: Sequence[str], times: int, seed: int = 1, **how) -> DataFrame:
    """keys, moran_i, p_value: the share of permutations of a group's scores over its points whose I is at least as great.

    The observed arrangement counts as one of them. Permutations follow a hash of the seed, so they can be repeated.
    """
    rows = points.select(*keys, "lat", "lon", "x").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times))))
    at = Window.partitionBy(*keys, "_r")
    numbered = rows.withColumn("_a", F.row_number().over(at.orderBy("lat", "lon", "x"))).withColumn("_b", F.row_number().over(at.orderBy(F.when(F.col("_r") > 0, F.xxhash64("lat", "lon", "x", "_r", F.lit(seed))), "lat", "lon", "x")))
    safe = lambda l, r: [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in (*keys, "_r")]
    a, b = numbered.alias("a"), numbered.select(*keys, "_r", "_b", F.col("x").alias("_x")).alias("b")
    shuffled = a.join(b, [*safe("a", "b"), F.col("a._a") == F.col("b._b")]).select(*(F.col(f"a.{k}").alias(k) for k in (*keys, "_r")), "lat", "lon", F.col("_x").alias("x"))
    found = association(shuffled, [*keys, "_r"], **how)
    own = F.max(F.when(F.col("_r") == 0, F.col("moran_i")))
    values = F.collect_list("moran_i")  # times + 1 numbers
    return found.groupBy(*keys).agg(own.alias("moran_i"), values.alias("_v")).select(*keys, "moran_i", (F.size(F.filter("_v", lambda v: v >= F.col("moran_i") - 1e-12)) / F.lit(times + 1)).alias("p_value"))


# Rankings by score and association.


def rerank_power(score: Column, index: Column, alpha: float) -> Column:
    """score * index ^ alpha; null where the power is undefined."""
    return finite(score * F.pow(index, alpha))


def score_moran(score: Column, n: Column, i: Column, lam: float, gamma: float) -> Column:
    return score * lam * (n - n * gamma * i)


def score_geary(score: Column, n: Column, c: Column, lam: float, gamma: float) -> Column:
    return F.try_divide(score * lam * n, gamma * c)


def score_getis(score: Column, n: Column, g: Column, lam: float, gamma: float) -> Column:
    return score * lam * (n * gamma) * g


#: Combined scores by name, of score, n, index, lambda and gamma.
COMBINED = {"moran": score_moran, "geary": score_geary, "getis": score_getis}


def score_log_n(score: Column, n: Column, alpha: float) -> Column:
    """score + alpha ln n; null for n of 0."""
    return score + alpha * F.ln(F.nullif(n, F.lit(0)))


def score_plus(score: Column, index: Column, alpha: float) -> Column:
    """score + alpha index."""
    return score + alpha * index


def score_plus_log(score: Column, index: Column, alpha: float) -> Column:
    """score + alpha ln index; null for an index of 0 or less."""
    return score + alpha * F.ln(F.when(index > 0, index))


def share_of_most(n: Column, *keys: str) -> Column:
    """n over the greatest n of its group; null where that is 0."""
    return F.try_divide(n, F.max(n).over(Window.partitionBy(*keys)))


def fill_missing(score: Column, cosine: Column) -> Column:
    """The score, or (1 + 1.2e8 / 256^3) ln|cosine| where it is null or NaN."""
    from .rank_topic import MISSING_LENGTH, POSITION_FACTOR

    return F.coalesce(finite(score), (1 + POSITION_FACTOR / MISSING_LENGTH**3) * F.ln(F.nullif(F.abs(cosine), F.lit(0.0))))


def softmax(n: Column, *keys: str) -> Column:
    """e^n over the sum of its group, from the greatest so that nothing overflows."""
    w = Window.partitionBy(*keys)
    e = F.exp(n - F.max(n).over(w))
    return e / F.sum(e).over(w)


# Dependence of places and scores.

#: Groups up to this size get the exact median of their distances in one task; bins for larger groups.
HSIC_LOCAL, BINS = 2048, 4096


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, without an array of all differences at once; those of equal rows are exactly 0."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def _widths(items: DataFrame, column: str, size: int) -> DataFrame:
    """_g, w: half the median of the squared distances that aren't 0; exact in groups of one block.

    In larger groups the distances are counted in bins, and then the bin of the median in bins of its own, so the
    median is known within a 16 millionth of the greatest distance.
    """
    half = lambda m: F.coalesce(m / 2, F.lit(2.0**-104)).alias("w")  # noqa: E731  the square of a double's precision, where all are 0
    counts = items.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    small = items.join(counts.filter(F.col("_n") <= size), "_g")
    large = durable(items.join(counts.filter(F.col("_n") > size).select("_g"), "_g", "left_semi"))

    def exact(left: dict, right: dict, same: bool) -> dict:
        d = _squares(left[column], left[column])
        d = d[d > 0]
        return {"m": [float(np.median(d)) if len(d) else None]}

    known = pairwise(small.select("_g", "id", column), None, "_g", "id", exact, "m double", size=1 << 30).select("_g", half(F.col("m")))
    if large.isEmpty():
        return known
    spans = large.select("_g", F.posexplode(column).alias("_i", "_v")).groupBy("_g", "_i").agg((F.max("_v") - F.min("_v")).alias("_s")).groupBy("_g").agg((F.sum(F.col("_s") * F.col("_s")) * 1.000001).alias("hi")).withColumn("lo", F.lit(0.0)).withColumn("under", F.lit(0.0))
    for _ in range(2):
        ranged = large.select("_g", "id", column).join(spans, "_g")

        def count(left: dict, right: dict, same: bool) -> dict:
            d = _squares(left[column], right[column])
            lo, hi = left["lo"][0], left["hi"][0]
            d = d[(d > 0) & (d >= lo) & (d < hi)]
            n = np.bincount(((d - lo) / (hi - lo) * BINS).astype(int).clip(0, BINS - 1), minlength=BINS)
            at = np.flatnonzero(n)
            return {"bin": at.astype(np.int64), "n": n[at].astype(np.int64)}

        bins = durable(pairwise(ranged, None, "_g", "id", count, "bin bigint, n bigint").groupBy("_g", "bin").agg(F.sum("n").alias("n")))
        total = bins.groupBy("_g").agg(F.sum("n").alias("_all")).join(spans, "_g")
        # In the second round the bins hold a part of the distances: those below it are in "under", the whole in "all".
        total = total.withColumn("all", F.col("all") if "all" in spans.columns else F.col("_all"))
        from pyspark.sql import Window

        up = Window.partitionBy("_g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        placed = bins.withColumn("_up", F.sum("n").over(up)).join(total.drop("_all"), "_g").filter(F.col("under") + F.col("_up") >= F.col("all") / 2)
        first = placed.groupBy("_g").agg(F.min(F.struct("bin", "n", "_up", "lo", "hi", "under", "all")).alias("f"))
        step = (F.col("f.hi") - F.col("f.lo")) / BINS
        low = F.col("f.lo") + F.col("f.bin") * step
        spans = durable(first.select("_g", low.alias("lo"), (low + step).alias("hi"), (F.col("f.under") + F.col("f._up") - F.col("f.n")).alias("under"), F.col("f.all").alias("all")))
    return known.unionByName(spans.select("_g", half((F.col("lo") + F.col("hi")) / 2)))


def hsic(rows: DataFrame, keys: Sequence[str], id_col: str, places: Sequence[str], scores: Sequence[str], local: int = HSIC_LOCAL) -> DataFrame:
    """keys, n, hsic: the Hilbert-Schmidt independence criterion of two sets of columns within a group.

    Kernels are Gaussian, exp(-d / 2w) of squared distances d, where w is half the median of the distances that aren't
    0. With centred kernels the criterion is the trace of their product over n squared, and that needs row sums alone:
    sum KL - 2 / n sum of the products of row sums + product of the totals / n squared. Rows with a null or NaN are
    left out; ids are unique within a group.
    """
    vector = lambda cols: F.array(*(finite(F.col(c).cast("double")) for c in cols))
    items = rows.select(null_safe_key(*keys).alias("_g"), *keys, F.col(id_col).alias("id"), vector(places).alias("x"), vector(scores).alias("y"))
    items = durable(items.filter(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull())))
    names = items.groupBy("_g").agg(*(F.first(k).alias(k) for k in keys))
    wx, wy = (_widths(items, c, local).withColumnRenamed("w", f"w{c}") for c in ("x", "y"))
    known = items.select("_g", "id", "x", "y").join(wx, "_g").join(wy, "_g")

    def sums(left: dict, right: dict, same: bool) -> dict:
        k = np.exp(-_squares(left["x"], right["x"]) / (2 * left["wx"][0]))
        m = np.exp(-_squares(left["y"], right["y"]) / (2 * left["wy"][0]))
        return {"i": left["id"], "k": k.sum(axis=1), "l": m.sum(axis=1), "kl": (k * m).sum(axis=1)}

    by_row = pairwise(durable(known), None, "_g", "id", sums, "i bigint, k double, l double, kl double").groupBy("_g", "i").agg(F.sum("k").alias("k"), F.sum("l").alias("l"), F.sum("kl").alias("kl"))
    g = by_row.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.sum("l").alias("l"), F.sum("kl").alias("kl"), F.sum(F.col("k") * F.col("l")).alias("cross"))
    n = F.col("n")
    trace = F.col("kl") - 2 / n * F.col("cross") + F.col("k") * F.col("l") / (n * n)
    return g.select("_g", "n", (trace / (n * n)).alias("hsic")).join(names, "_g").select(*keys, "n", "hsic")
