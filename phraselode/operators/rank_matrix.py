"""Rankings of a topic's vectors that need its similarity matrix.

A topic of up to ``local`` items is one task's matrix. Larger topics never come into one task: products with a matrix
are summed from blocks or from sums over vectors, and greedy choices take one pass over the items for each choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import lookup
from ..functions.vectors import cosine, dot, mean_vectors, unit
from ..session import durable
from .blocks import pairwise, units
from .rank_doc import top

#: Items of a topic that one task takes as a matrix.
LOCAL = 2048
#: Fixed points: the change below which iterating ends, and the most steps.
EPSILON, STEPS = 1e-5, 100


def split_by_size(items: DataFrame, local: int) -> tuple[DataFrame, DataFrame]:
    """The items of topics of up to ``local`` items, and of larger ones."""
    sizes = items.groupBy("topic").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.col("_n"))
    sized = lookup(items, sizes, ["topic"], "_k")
    return sized.filter(F.col("_n") <= local).drop("_n"), sized.filter(F.col("_n") > local).drop("_n")


def _per_topic(items: DataFrame, function: Callable[[np.ndarray, np.ndarray, pd.DataFrame], dict], out: str) -> DataFrame:
    """The function of (ids, vectors, rows) of each topic, rows sorted by id."""
    kind = items.schema["topic"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        got = function(rows["id"].to_numpy(), np.stack(rows["vec"].to_numpy()).astype(float), rows)
        return pd.DataFrame({"topic": rows["topic"].iloc[0], **got})

    return items.groupBy("topic").applyInPandas(run, f"topic {kind}, {out}")


# Greedy choice by relevance and novelty.


def greedy(relevance: np.ndarray, unit: np.ndarray, diversity: float, n: int) -> tuple[list[int], list[float]]:
    """Indices in the order chosen, and the value each was chosen for; ties go to the smaller index."""
    chosen: list[int] = []
    values: list[float] = []
    most = np.full(len(relevance), -np.inf)
    free = np.ones(len(relevance), bool)
    for _ in range(min(n, len(relevance))):
        value = (1 - diversity) * relevance - (diversity * most if chosen else 0)
        best = int(np.argmax(np.where(free, np.round(value, 12), -np.inf)))
        chosen.append(best)
        values.append(float(value[best]))
        free[best] = False
        most = np.maximum(most, unit @ unit[best])
    return chosen, values


def _with_relevance(items: DataFrame) -> DataFrame:
    centre = mean_vectors(items, ["topic"], out="_centre")
    return items.join(centre, "topic").withColumn("relevance", cosine(F.col("vec"), F.col("_centre"))).drop("_centre")


def mmr(items: DataFrame, n: int, diversity: float = 0.5, local: int = LOCAL) -> DataFrame:
    """topic, id, place, score: the first ``n`` items of each topic by maximal marginal relevance.

    The query is the topic's mean vector, unless ``items`` has a column relevance. Each choice maximises (1 - diversity)
    relevance - diversity times the greatest similarity to an item chosen before; ties go to the smaller id.
    """
    known = items if "relevance" in items.columns else _with_relevance(items)
    known = known.select("topic", "id", "vec", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))
    small, large = split_by_size(known, local)

    def choose(ids: np.ndarray, vectors: np.ndarray, rows: pd.DataFrame) -> dict:
        chosen, values = greedy(rows["relevance"].to_numpy(), units(vectors), diversity, n)
        return {"id": ids[chosen], "place": np.arange(1, len(chosen) + 1), "score": values}

    out = _per_topic(small, choose, "id bigint, place int, score double")
    large = durable(large.withColumn("most", F.lit(None).cast("double")))
    if large.isEmpty():
        return out
    picked = []
    for place in range(1, n + 1):
        value = (1 - diversity) * F.col("relevance") - diversity * F.coalesce("most", F.lit(0.0))
        best = top(large.withColumn("score", F.round(value, 12)), ["topic"], "score", ["id"], 1).select("topic", "id", F.lit(place).alias("place"), "score", F.col("vec").alias("_v"))
        best = durable(best)
        picked.append(best.drop("_v"))
        # One row a large topic: their number is at most items / local.
        last = F.broadcast(best.select("topic", F.col("id").alias("_id"), "_v"))
        large = large.join(last, "topic").filter("id <> _id").withColumn("most", F.greatest("most", cosine(F.col("vec"), F.col("_v")))).drop("_v", "_id")
        large = durable(large)
    for p in picked:
        out = out.unionByName(p)
    return out


def mmr_by_scores(items: DataFrame, doc_scores: DataFrame, n: int, diversity: float = 0.5, local: int = LOCAL) -> DataFrame:
    """The same with the greatest e^score over the documents (topic, id, score) as relevance."""
    relevance = doc_scores.groupBy("topic", "id").agg(F.max(F.exp("score")).alias("relevance"))
    return mmr(items.join(relevance, ["topic", "id"]), n, diversity, local)


# Choosing a set that is least alike.


def least_alike(sim: np.ndarray, n: int, exact: int = 30) -> tuple[list[int], bool]:
    """The ``n`` indices with the smallest sum of similarities, the first such set in order; greedy, and said so, beyond ``exact`` items."""
    m = len(sim)
    if m <= n:
        return list(range(m)), True
    chosen = _least_alike_greedy(sim, n)
    if m > exact:
        return chosen, False
    return _branch_and_bound(sim, n), True


def _least_alike_greedy(sim: np.ndarray, n: int) -> list[int]:
    if n < 2:
        return list(range(n))
    i, j = np.unravel_index(np.argmin(sim + np.eye(len(sim)) * 9), sim.shape)
    chosen = sorted((int(i), int(j)))
    while len(chosen) < n:
        cost = sim[:, chosen].sum(axis=1)
        cost[chosen] = np.inf
        chosen.append(int(np.argmin(cost)))
    return chosen


def _branch_and_bound(sim: np.ndarray, n: int) -> list[int]:
    """Sets are grown in order of their indices. One with r items to come costs at least what it costs so far, and r of
    the items left with, each, their similarities to the set and half of their r - 1 smallest ones among those left."""
    m = len(sim)
    pair = sim * (1 - np.eye(m))
    free = pair + np.diag(np.full(m, np.inf))
    # least[k][r]: for each item, half of the sum of the r smallest similarities to items from k on.
    least = [np.cumsum(np.hstack([np.zeros((m, 1)), np.sort(free[:, k:], axis=1)]), axis=1).T / 2 for k in range(m + 1)]
    best = sorted(_least_alike_greedy(sim, n))
    # As good sets as the greedy one may come before it.
    total = pair[np.ix_(best, best)].sum() / 2 + 1e-9

    def grow(chosen: list[int], k: int, cost: float, to: np.ndarray) -> None:
        nonlocal best, total
        r = n - len(chosen)
        if r == 1:
            i = k + int(np.argmin(to[k:]))
            if cost + to[i] < total - 1e-12:
                best, total = [*chosen, i], cost + to[i]
            return
        for i in range(k, m - r + 1):
            rest = to[i:] + least[i][r - 1][i:]
            if cost + np.partition(rest, r - 1)[:r].sum() >= total - 1e-12:
                return
            grow([*chosen, i], i + 1, cost + to[i], to + pair[i])

    grow([], 0, 0.0, np.zeros(m))
    return best


def max_sum(items: DataFrame, n: int = 10, nearest: int = 30) -> DataFrame:
    """topic, id, score, exact: of the ``nearest`` items to the topic's mean, the ``n`` least alike.

    Only these few items of a topic come together, whatever its size.
    """
    near = top(_with_relevance(items), ["topic"], "relevance", ["id"], nearest).select("topic", "id", "vec", "relevance")

    def choose(ids: np.ndarray, vectors: np.ndarray, rows: pd.DataFrame) -> dict:
        chosen, exact = least_alike((u := units(vectors)) @ u.T, n)
        return {"id": ids[chosen], "score": rows["relevance"].to_numpy()[chosen], "exact": exact}

    return _per_topic(near, choose, "id bigint, score double, exact boolean")


# Centrality.


def _adjacent(left: dict, right: dict, same: bool, least: float) -> np.ndarray:
    sim = units(left["vec"]) @ units(right["vec"]).T
    if same:
        np.fill_diagonal(sim, 0.0)
    return np.where(sim >= least, sim, 0.0)


def _product(least: float):
    def kernel(left: dict, right: dict, same: bool) -> dict:
        return {"id": left["id"], "y": _adjacent(left, right, same, least) @ right["x"]}

    return kernel


def fixed_point(times: Callable[[np.ndarray], np.ndarray], n: int, steps: int) -> np.ndarray:
    """Repeats ``times`` from uniform values, their sum kept at 1, until the change is at most EPSILON or for so many steps.

    Where the product is 0 everywhere, the values stay as they are.
    """
    x = np.full(n, 1 / n)
    for _ in range(steps):
        y = times(x)
        if not y.sum():
            break
        y = y / y.sum()
        moved, x = np.abs(y - x).sum(), y
        if moved <= EPSILON:
            break
    return x


def _iterate(items: DataFrame, times: Callable[[DataFrame], DataFrame], steps: int) -> DataFrame:
    """The same for topics too large for a task: ``times`` takes topic, id, x and gives topic, id, y."""
    sizes = items.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))
    x = durable(items.join(F.broadcast(sizes), "topic").select("topic", "id", (1 / F.col("_n")).alias("x")))
    for _ in range(steps):
        y = durable(times(x))
        totals = y.groupBy("topic").agg(F.sum("y").alias("_sum")).filter("_sum <> 0")
        new = durable(y.join(F.broadcast(totals), "topic").select("topic", "id", (F.col("y") / F.col("_sum")).alias("x")))
        moved = new.join(x.withColumnRenamed("x", "_x"), ["topic", "id"]).groupBy("topic").agg(F.sum(F.abs(F.col("x") - F.col("_x"))).alias("d")).agg(F.max("d")).first()[0]
        x = new
        if moved is None or moved <= EPSILON:
            break
    return x.withColumnRenamed("x", "score")


def _by_size(items: DataFrame, local: int, small: Callable[[np.ndarray, pd.DataFrame], np.ndarray], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    few, many = split_by_size(items, local)
    found = _per_topic(few, lambda ids, vectors, rows: {"id": ids, "score": small(vectors, rows)}, "id bigint, score double")
    many = durable(many)
    return found if many.isEmpty() else found.unionByName(large(many))


def eigen_centrality(items: DataFrame, least: float = 0.3, local: int = LOCAL, steps: int = STEPS) -> DataFrame:
    """topic, id, score: the first eigenvector of the similarities of at least ``least``, with the identity added."""

    def small(vectors: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        a = _adjacent(block := {"vec": vectors}, block, True, least)
        return fixed_point(lambda x: a @ x + x, len(a), steps)

    def large(many: DataFrame) -> DataFrame:
        def times(x: DataFrame) -> DataFrame:
            y = pairwise(many.join(x, ["topic", "id"]), None, "topic", "id", _product(least), "id bigint, y double").groupBy("topic", "id").agg(F.sum("y").alias("_y"))
            return y.join(x, ["topic", "id"]).select("topic", "id", (F.col("_y") + F.col("x")).alias("y"))

        return _iterate(many, times, steps)

    return _by_size(items.select("topic", "id", "vec"), local, small, large)


def co_ranking(items: DataFrame, incidence: DataFrame, least: float = 0.3, weight: float = 0.6, local: int = LOCAL, steps: int = STEPS) -> DataFrame:
    """topic, id, score: a fixed point of ``weight`` A + (1 - ``weight``) B B'.

    A has the similarities of at least ``least``, its diagonal empty. B is the incidence of items and documents, each
    row of unit length. ``incidence`` has topic, id and docs, the distinct documents that list the item. Topics above
    ``local`` items take products with A from blocks, and those with B document by document.
    """

    def small(vectors: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        a = _adjacent(block := {"vec": vectors}, block, True, least)
        names = {d: k for k, d in enumerate(sorted({d for r in rows["docs"] for d in r}))}
        b = np.zeros((len(rows), len(names)))
        for i, r in enumerate(rows["docs"]):
            for d in r:
                b[i, names[d]] = 1 / np.sqrt(len(r))
        return fixed_point(lambda x: weight * (a @ x) + (1 - weight) * (b @ (b.T @ x)), len(a), steps)

    def large(many: DataFrame) -> DataFrame:
        cells = durable(many.select("topic", "id", F.explode("docs").alias("doc"), (1 / F.sqrt(F.size("docs"))).alias("b")))
        vectors = many.select("topic", "id", "vec")

        def times(x: DataFrame) -> DataFrame:
            near = pairwise(vectors.join(x, ["topic", "id"]), None, "topic", "id", _product(least), "id bigint, y double").select("topic", "id", (weight * F.col("y")).alias("y"))
            by_doc = cells.join(x, ["topic", "id"]).groupBy("topic", "doc").agg(F.sum(F.col("b") * F.col("x")).alias("_s"))
            common = cells.join(by_doc, ["topic", "doc"]).select("topic", "id", ((1 - weight) * F.col("b") * F.col("_s")).alias("y"))
            return near.unionByName(common).groupBy("topic", "id").agg(F.sum("y").alias("y"))

        return _iterate(vectors, times, steps)

    return _by_size(items.select("topic", "id", "vec").join(incidence, ["topic", "id"]), local, small, large)


def power_sum(gram: np.ndarray, decay: float, powers: int) -> tuple[np.ndarray, float]:
    """q, c with sum of decay^(t - 1) M^t = U q U' + c I, for t up to ``powers`` and M = U U' - I, from U' U alone.

    The similarities of unit vectors are such an M, so their powers need no matrix of items: if M^t = U p U' + s I,
    then M^(t + 1) = U (p G - p + s I) U' - s I, where G is the Gram matrix U' U.
    """
    eye = np.eye(len(gram))
    p, s = eye.copy(), -1.0
    q, c = p.copy(), s
    for t in range(1, powers):
        p, s = p @ gram - p + s * eye, -s
        q, c = q + decay**t * p, c + decay**t * s
    return q, c


def affinity_ranking(items: DataFrame, damping: float = 0.85, decay: float = 0.9, powers: int = 5, local: int = LOCAL, steps: int = STEPS) -> DataFrame:
    """topic, id, score: a fixed point of ``damping`` M + (1 - ``damping``) M M'.

    M is the sum of decay^(t - 1) times the t-th power of the similarities (their diagonal empty), its rows of unit
    length. It is never made: see :func:`power_sum`. Vectors without length are left out.
    """
    known = items.select("topic", "id", unit(F.col("vec")).alias("vec")).filter("vec IS NOT NULL")

    def small(vectors: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        q, c = power_sum(vectors.T @ vectors, decay, powers)
        scale = _row_scale(vectors, q, c, vectors.T @ vectors)
        times = lambda x: vectors @ (q @ (vectors.T @ x)) + c * x
        m = lambda x: scale * times(x)
        return fixed_point(lambda x: damping * m(x) + (1 - damping) * m(times(scale * x)), len(vectors), steps)

    def large(many: DataFrame) -> DataFrame:
        kind = many.schema["topic"].dataType.simpleString()
        sizes = many.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))

        def powered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                made = [power_sum(g.reshape(int(len(g) ** 0.5), -1), decay, powers) for g in b["_s"]]
                yield pd.DataFrame({"topic": b["topic"], "_n": b["_n"], "gram": b["_s"], "q": [q.ravel() for q, _ in made], "c": [c for _, c in made]})

        # One row a large topic; a topic's matrices go to a task once for each slab of its rows.
        grams = _sums(many.withColumn("x", F.lit(1.0)), kind, lambda v, x: (v.T @ v).ravel())
        maps = durable(grams.join(sizes, "topic").mapInPandas(powered, f"topic {kind}, _n bigint, gram array<double>, q array<double>, c double"))

        def scaled(rows: pd.DataFrame, of: pd.Series) -> pd.DataFrame:
            v = np.stack(rows["vec"].to_numpy())
            d = v.shape[1]
            return pd.DataFrame({"topic": rows["topic"], "id": rows["id"], "vec": rows["vec"], "scale": _row_scale(v, of["q"].reshape(d, d), of["c"], of["gram"].reshape(d, d))})

        state = durable(_by_slab(many, maps, scaled, f"topic {kind}, id bigint, vec array<double>, scale double"))

        def times(x: DataFrame) -> DataFrame:
            """topic, id, y = (U q U' + c I) x: q meets the vector U' x once a topic, the rows only a vector."""
            both = state.join(x, ["topic", "id"])

            def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield pd.DataFrame({"topic": b["topic"], "_n": b["_n"], "_t": [q.reshape(len(t), -1) @ t for q, t in zip(b["q"], b["_s"])], "_c": b["c"]})

            s = _sums(both.select("topic", "vec", "x"), kind, lambda v, w: v.T @ w)
            to = maps.drop("gram").join(s, "topic").mapInPandas(turned, f"topic {kind}, _n bigint, _t array<double>, _c double")
            return lookup(both, to, ["topic"], "_n").select("topic", "id", (dot(F.col("vec"), F.col("_t")) + F.col("_c") * F.col("x")).alias("y"))

        scales = state.select("topic", "id", "scale")

        def step(x: DataFrame) -> DataFrame:
            own = times(x).join(scales, ["topic", "id"]).select("topic", "id", (damping * F.col("scale") * F.col("y")).alias("y"))
            back = durable(times(x.join(scales, ["topic", "id"]).select("topic", "id", (F.col("scale") * F.col("x")).alias("x")))).withColumnRenamed("y", "x")
            far = times(back).join(scales, ["topic", "id"]).select("topic", "id", ((1 - damping) * F.col("scale") * F.col("y")).alias("y"))
            return own.unionByName(far).groupBy("topic", "id").agg(F.sum("y").alias("y"))

        return _iterate(many, step, steps)

    return _by_size(known, local, small, large)


def _row_scale(vectors: np.ndarray, q: np.ndarray, c: float, gram: np.ndarray) -> np.ndarray:
    """1 over the lengths of the rows of U q U' + c I."""
    own = np.einsum("ij,jk,ik->i", vectors, q, vectors)
    squares = np.einsum("ij,jk,ik->i", vectors, q @ gram @ q.T, vectors) + 2 * c * own + c * c
    return 1 / np.sqrt(np.maximum(squares, 1e-300))


#: Rows of a topic that are computed with its matrix at once.
SLAB = 1024


def _by_slab(rows: DataFrame, maps: DataFrame, function: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], out: str, slab: int | None = None) -> DataFrame:
    """The function of every slab of a topic's rows and the topic's row of ``maps`` (with _n, its number of rows).

    Rows are hashed into slabs by id; a matrix travels once for each of them, not with every row, and nothing is broadcast
    but the names of hot topics.
    """
    slabs = F.ceil(F.col("_n") / (slab or SLAB)).cast("int")
    placed = lookup(rows, maps.select("topic", "_n", slabs.alias("_slabs")), ["topic"], "_n").withColumn("_slab", F.pmod(F.xxhash64("id"), F.col("_slabs")).cast("int")).drop("_slabs")
    copies = maps.withColumn("_slab", F.explode(F.sequence(F.lit(0), slabs - 1)))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return function(left, right.iloc[0]) if len(left) and len(right) else pd.DataFrame(columns=[c.strip().split()[0] for c in out.split(",")])

    return placed.groupBy("topic", "_slab").cogroup(copies.groupBy("topic", "_slab")).applyInPandas(both, out)


def _sums(rows: DataFrame, kind: str, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """topic, _s: the sum over a topic's vectors of an array, first within each batch."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for topic, own in b.groupby("topic", dropna=False):
                yield pd.DataFrame({"topic": [topic], "_p": [of(np.stack(own["vec"].to_numpy()), own["x"].to_numpy())]})

    partial = rows.select("topic", "vec", "x").mapInPandas(parts, f"topic {kind}, _p array<double>")
    each = partial.select("topic", F.posexplode("_p").alias("_i", "_x")).groupBy("topic", "_i").agg(F.sum("_x").alias("_x"))
    return each.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda t: t["_x"]).alias("_s"))


# Clusters.


def density_clusters(sim: np.ndarray, least: float, min_samples: int = 2) -> np.ndarray:
    """Cluster numbers by density: items with ``min_samples`` items (their own included) at similarity ``least`` or more
    link their clusters; the rest joins the nearest such item in reach, or is noise, -1."""
    near = sim >= least
    core = near.sum(axis=1) >= min_samples
    label = np.full(len(sim), -1)
    number = 0
    for seed in np.flatnonzero(core):
        if label[seed] >= 0:
            continue
        frontier = [seed]
        label[seed] = number
        while frontier:
            i = frontier.pop()
            for j in np.flatnonzero(near[i] & core & (label < 0)):
                label[j] = number
                frontier.append(j)
        number += 1
    for i in np.flatnonzero(~core):
        reach = np.where(near[i] & core, sim[i], -np.inf)
        if np.isfinite(reach.max(initial=-np.inf)):
            label[i] = label[int(np.argmax(reach))]
    return label


def principal_components(vectors: np.ndarray, n: int) -> np.ndarray:
    """The first principal components; each one's greatest loading is positive, so the result has one sign."""
    centred = vectors - vectors.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:n] * np.sign(axes[:n][np.arange(min(n, len(axes))), np.abs(axes[:n]).argmax(axis=1)])[:, None]
    return centred @ axes.T


def whiten(vectors: np.ndarray, normalise: bool = True) -> np.ndarray:
    """Vectors with the covariance removed."""
    centred = vectors - vectors.mean(axis=0)
    u, s, _ = np.linalg.svd(centred.T @ centred / len(vectors))
    out = centred @ (u / np.sqrt(np.maximum(s, 1e-12)))
    return units(out) if normalise else out


def whitened(items: DataFrame, local: int = LOCAL) -> DataFrame:
    """topic, id, vec: the vectors of each topic of up to ``local`` items, whitened; those of larger topics by the
    covariance that Spark sums."""
    small, large = split_by_size(items, local)
    found = _per_topic(small, lambda ids, v, _: {"id": ids, "vec": list(whiten(v))}, "id bigint, vec array<double>")
    large = durable(large)
    if large.isEmpty():
        return found

    def moments(batches):
        sums: dict = {}
        for b in batches:
            for topic, rows in b.groupby("topic"):
                v = np.stack(rows["vec"].to_numpy())
                n, s, q = sums.get(topic, (0, 0.0, 0.0))
                sums[topic] = (n + len(v), s + v.sum(axis=0), q + v.T @ v)
        for topic, (n, s, q) in sums.items():
            yield pd.DataFrame({"topic": [topic], "n": [n], "s": [s], "q": [q.ravel()]})

    kind = items.schema["topic"].dataType.simpleString()
    parts = large.mapInPandas(moments, f"topic {kind}, n bigint, s array<double>, q array<double>")

    def axes(rows: pd.DataFrame) -> pd.DataFrame:
        n, s, q = rows["n"].sum(), np.sum(np.stack(rows["s"].to_numpy()), axis=0), np.sum(np.stack(rows["q"].to_numpy()), axis=0)
        mean = s / n
        u, d, _ = np.linalg.svd(q.reshape(len(s), -1) / n - np.outer(mean, mean))
        return pd.DataFrame({"topic": [rows["topic"].iloc[0]], "_n": [n], "mean": [mean], "axes": [(u / np.sqrt(np.maximum(d, 1e-12))).ravel()]})

    maps = durable(parts.groupBy("topic").applyInPandas(axes, f"topic {kind}, _n bigint, mean array<double>, axes array<double>"))

    def project(rows: pd.DataFrame, of: pd.Series) -> pd.DataFrame:
        v = units((np.stack(rows["vec"].to_numpy()) - of["mean"]) @ of["axes"].reshape(len(of["mean"]), -1))
        return pd.DataFrame({"topic": rows["topic"], "id": rows["id"], "vec": list(v)})

    return found.unionByName(_by_slab(large.select("topic", "id", "vec"), maps, project, f"topic {kind}, id bigint, vec array<double>"))


def _components(near: np.ndarray) -> np.ndarray:
    """For each item the first item of its connected component."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _reach(least: float):
    """Items in reach of each, its own included."""

    def kernel(left: dict, right: dict, same: bool) -> dict:
        return {"id": left["id"], "n": (units(left["vec"]) @ units(right["vec"]).T >= least).sum(axis=1)}

    return kernel


def _links(least: float):
    """Links of two blocks' items: each but the first of a component to that, so no more than there are items."""

    def kernel(left: dict, right: dict, same: bool) -> dict:
        u, ids = np.concatenate([units(left["vec"]), units(right["vec"])]), np.concatenate([left["id"], right["id"]])
        if same:
            u, ids = u[: len(left["id"])], left["id"]
        root = _components(u @ u.T >= least)
        far = np.flatnonzero(root != np.arange(len(root)))
        return {"a": ids[far], "b": ids[root[far]]}

    return kernel


def _nearest(least: float):
    """The nearest item of the other side in reach, the smaller id of equals."""

    def kernel(left: dict, right: dict, same: bool) -> dict:
        sim = units(left["vec"]) @ units(right["vec"]).T
        best = np.round(sim, 12).argmax(axis=1)
        most = sim[np.arange(len(sim)), best]
        found = np.flatnonzero(most >= least)
        return {"id": left["id"][found], "core": right["id"][best[found]], "s": np.round(most[found], 12)}

    return kernel


def _labels(space: DataFrame, least: float, min_samples: int) -> DataFrame:
    """topic, id, label of clustered items as :func:`density_clusters` has them, by blocks of any number of items."""
    space = durable(space)
    counts = pairwise(space, None, "topic", "id", _reach(least), "id bigint, n bigint").groupBy("topic", "id").agg(F.sum("n").alias("n"))
    dense = durable(counts.select("topic", "id", (F.col("n") >= min_samples).alias("_core")))
    marked = durable(space.join(dense, ["topic", "id"]))
    core, rest = marked.filter("_core").drop("_core"), marked.filter("NOT _core").drop("_core")
    links = pairwise(core, None, "topic", "id", _links(least), "a bigint, b bigint", half=True)
    links = durable(links.unionByName(links.select("topic", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = durable(core.select("topic", "id", F.col("id").alias("label")))
    while True:
        met = links.join(label.select("topic", F.col("id").alias("b"), F.col("label").alias("_l")), ["topic", "b"]).groupBy("topic", F.col("a").alias("id")).agg(F.min("_l").alias("_l"))
        new = label.join(met, ["topic", "id"], "left").select("topic", "id", "label", F.least("label", F.coalesce("_l", "label")).alias("_new"))
        ahead = label.select("topic", F.col("id").alias("_new"), F.col("label").alias("_to"))
        new = durable(new.join(ahead, ["topic", "_new"]).select("topic", "id", F.col("label").alias("_old"), F.least("_new", "_to").alias("label")))
        still = new.filter("label <> _old").isEmpty()
        label = new.drop("_old")
        if still:
            break
    border = pairwise(rest, core, "topic", "id", _nearest(least), "id bigint, core bigint, s double").groupBy("topic", "id").agg(F.max_by("core", F.struct("s", -F.col("core"))).alias("_c"))
    joined = border.join(label.select("topic", F.col("id").alias("_c"), "label"), ["topic", "_c"]).select("topic", "id", "label")
    return label.unionByName(joined)


def _projected(items: DataFrame, n: int) -> DataFrame:
    """The vectors among ``n`` principal components of their topic, from sums by topic; signs as in :func:`principal_components`."""
    kind = items.schema["topic"].dataType.simpleString()
    sums = _sums(items.withColumn("x", F.lit(1.0)), kind, lambda v, x: np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()]))

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maps, means, sizes = [], [], []
            for s in b["_s"]:
                d = int((np.sqrt(4 * len(s) - 3) - 1) / 2)
                mean = s[1 : d + 1] / s[0]
                _, found = np.linalg.eigh(s[d + 1 :].reshape(d, d) / s[0] - np.outer(mean, mean))
                found = found[:, ::-1][:, :n]
                maps.append((found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])).ravel())
                means.append(mean), sizes.append(int(s[0]))
            yield pd.DataFrame({"topic": b["topic"], "_n": sizes, "mean": means, "axes": maps})

    def project(rows: pd.DataFrame, of: pd.Series) -> pd.DataFrame:
        v = (np.stack(rows["vec"].to_numpy()) - of["mean"]) @ of["axes"].reshape(len(of["mean"]), -1)
        return pd.DataFrame({"topic": rows["topic"], "id": rows["id"], "vec": list(v)})

    maps = durable(sums.mapInPandas(axes, f"topic {kind}, _n bigint, mean array<double>, axes array<double>"))
    return _by_slab(items.select("topic", "id", "vec"), maps, project, f"topic {kind}, id bigint, vec array<double>")


def cluster_medoids(items: DataFrame, least: float = 0.3, min_samples: int = 2, components: int = 0, most: int = LOCAL) -> DataFrame:
    """topic, id, cluster, n: of each density cluster the item nearest to its centre, clusters in order of their ids' mean.

    With ``components`` the clusters are sought among that many principal components. Noise belongs to no cluster.
    Topics of up to ``most`` items are one task's matrix; larger ones are clustered by blocks, with equal results.
    """
    small, large = split_by_size(items.select("topic", "id", "vec"), most)

    def medoids(ids: np.ndarray, vectors: np.ndarray, rows: pd.DataFrame) -> dict:
        u = units(vectors)
        space = units(principal_components(u, components)) if components else u
        label = density_clusters(space @ space.T, least, min_samples)
        found = []
        for c in range(label.max() + 1):
            own = np.flatnonzero(label == c)
            centre = u[own].mean(axis=0)
            found.append((float(ids[own].mean()), ids[own[np.argmax(np.round(u[own] @ centre, 12))]], len(own)))
        found.sort()
        return {"id": [f[1] for f in found], "cluster": range(len(found)), "n": [f[2] for f in found]}

    out = _per_topic(small, medoids, "id bigint, cluster int, n bigint")
    large = durable(large.withColumn("vec", F.coalesce(unit(F.col("vec")), F.transform("vec", lambda x: F.lit(0.0)))))
    if large.isEmpty():
        return out
    label = durable(_labels(_projected(large, components) if components else large, least, min_samples))
    own = large.join(label, ["topic", "id"])
    centres = mean_vectors(own, ["topic", "label"], out="_centre")
    near = F.round(dot(F.col("vec"), F.col("_centre")), 12)
    # A large topic's clusters are sorted in one task: a row each.
    found = own.join(centres, ["topic", "label"]).groupBy("topic", "label").agg(F.max_by("id", F.struct(near, -F.col("id"))).alias("id"), F.avg("id").alias("_at"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("topic").orderBy("_at", "id")
    return out.unionByName(found.select("topic", "id", (F.row_number().over(order) - 1).alias("cluster"), "n"))
