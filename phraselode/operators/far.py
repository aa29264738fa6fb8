"""Sums over all pairs of two sets of points of a weight that is smooth but at one place and at its antipodes.

The points of either set are halved again and again into boxes of latitude and longitude. Of two boxes far from each
other, and from each other's antipodes, the weight is interpolated from ORDER x ORDER Chebyshev points in each: their
pairs stand for all pairs. Of all others the pairs themselves are computed. What is computed grows about as the points do.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Chebyshev points along a side, points of a box that isn't halved, and how far apart boxes are, in radii of the larger, to be interpolated.
ORDER, LEAF, APART = 8, 64, 1.5
#: Radians around a box's antipodes in which no weight is smooth, and half of the longest span of longitudes that is interpolated.
ANTIPODES, SPAN = 0.035, 0.5
#: Pairs of boxes whose Chebyshev points are computed at once.
AT_ONCE = 4

_ROOTS = np.cos((np.arange(ORDER) + 0.5) * np.pi / ORDER)
_BASIS = np.polynomial.chebyshev.chebvander(_ROOTS, ORDER - 1).T * (np.where(np.arange(ORDER) > 0, 2.0, 1.0) / ORDER)[:, None]

#: Weights of points by latitude and longitude in degrees, broadcast.
Weight = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Boxes:
    """Points sorted by box; of each box its range, centre, halves of its sides, radius and two parts."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, values: np.ndarray):
        order, todo = np.arange(len(lat)), [(0, len(lat))]
        self.range, self.box, self.at, self.radius, self.parts = [], [], [], [], []
        parents: list[tuple[int, int] | None] = [None]
        while todo:
            (begin, end), parent = todo.pop(), parents.pop()
            own = order[begin:end]
            y, x = lat[own], lon[own]
            south, north, west, east = y.min(), y.max(), x.min(), x.max()
            high, wide, mid = (north - south) / 2, (east - west) / 2, math.radians((north + south) / 2)
            flat = 1.0 if south <= 0 <= north else math.cos(math.radians(min(abs(south), abs(north))))
            if parent:
                self.parts[parent[0]][parent[1]] = len(self.range)
            here, l = len(self.range), math.radians((east + west) / 2)
            self.range.append((begin, end))
            self.box.append(((north + south) / 2, (east + west) / 2, max(high, 1e-9), max(wide, 1e-9)))
            self.at.append((math.cos(mid) * math.cos(l), math.cos(mid) * math.sin(l), math.sin(mid)))
            self.radius.append(math.radians(math.hypot(high, wide * flat)))
            self.parts.append([-1, -1])
            if end - begin > LEAF:
                half = (end - begin) // 2
                along = x if math.radians(wide) > SPAN or wide * flat > high else y
                order[begin:end] = own[np.argpartition(along, half)]
                todo += [(begin, begin + half), (begin + half, end)]
                parents += [(here, 0), (here, 1)]
        self.order, self.lat, self.lon, self.values = order, lat[order], lon[order], values[order]
        self.out = np.zeros_like(self.values)
        self._moments: dict[int, np.ndarray] = {}
        self._met: dict[int, np.ndarray] = {}

    def basis(self, k: int) -> np.ndarray:
        """Of each point of a box, how much each of the box's Chebyshev points counts."""
        (begin, end), (lat, lon, high, wide) = self.range[k], self.box[k]
        of = lambda v: np.polynomial.chebyshev.chebvander(np.clip(v, -1, 1), ORDER - 1) @ _BASIS
        rows, columns = of((self.lat[begin:end] - lat) / high), of((self.lon[begin:end] - lon) / wide)
        return (rows[:, :, None] * columns[:, None, :]).reshape(end - begin, -1)

    def moments(self, k: int) -> np.ndarray:
        if k not in self._moments:
            self._moments[k] = self.basis(k).T @ self.values[slice(*self.range[k])]
        return self._moments[k]

    def meets(self, k: int, sums: np.ndarray) -> None:
        self._met[k] = self._met[k] + sums if k in self._met else sums

    def nodes(self, ks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        lat, lon, high, wide = np.array([self.box[k] for k in ks]).T[:, :, None]
        return np.repeat(lat + high * _ROOTS, ORDER, axis=1), np.tile(lon + wide * _ROOTS, ORDER)

    def sums(self) -> np.ndarray:
        for k, met in self._met.items():
            self.out[slice(*self.range[k])] += self.basis(k) @ met
        out = np.empty_like(self.out)
        out[self.order] = self.out
        return out


def _pairs(a: Boxes, b: Boxes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of boxes to interpolate, and pairs to compute."""
    far, near, todo = [], [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        own = b is a and i == j
        n, m = a.range[i][1] - a.range[i][0], b.range[j][1] - b.range[j][0]
        if n * m <= ORDER**4:
            near.append((i, j))
            continue
        if own:  # of a set with itself each pair of boxes comes once
            todo += [(a.parts[i][0], a.parts[i][0]), (a.parts[i][1], a.parts[i][1]), (a.parts[i][0], a.parts[i][1])]
            continue
        p, q, r, s = a.at[i], b.at[j], a.radius[i], b.radius[j]
        apart = math.acos(max(-1.0, min(1.0, p[0] * q[0] + p[1] * q[1] + p[2] * q[2])))
        gap = APART * max(r, s)
        if apart - r - s > gap and math.pi - apart - r - s > max(gap, ANTIPODES) and math.radians(max(a.box[i][3], b.box[j][3])) <= SPAN:
            far.append((i, j))
        elif n > LEAF and (r >= s or m <= LEAF):
            todo += [(k, j) for k in a.parts[i]]
        else:
            todo += [(i, k) for k in b.parts[j]]
    return far, near


def weighted_sums(left: tuple, right: tuple | None, weight: Weight, include_self: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Of each point of ``left`` the sums over ``right`` of weight times each column of values, and the other way round.

    Sets are (lat, lon, values). ``right`` None stands for ``left`` itself, whose points don't meet themselves unless ``include_self``.
    """
    a = Boxes(*left)
    b = a if right is None else Boxes(*right)
    far, near = _pairs(a, b)
    for i, j in near:
        x, y = slice(*a.range[i]), slice(*b.range[j])
        w = weight(a.lat[x, None], a.lon[x, None], b.lat[None, y], b.lon[None, y])
        own = b is a and i == j
        if own and not include_self:
            np.fill_diagonal(w, 0.0)
        a.out[x] += w @ b.values[y]
        if not own:
            b.out[y] += w.T @ a.values[x]
    for begin in range(0, len(far), AT_ONCE):
        some = far[begin : begin + AT_ONCE]
        (lat, lon), (lat_, lon_) = a.nodes([i for i, _ in some]), b.nodes([j for _, j in some])
        for (i, j), w in zip(some, weight(lat[:, :, None], lon[:, :, None], lat_[:, None, :], lon_[:, None, :])):
            a.meets(i, w @ b.moments(j))
            b.meets(j, w.T @ a.moments(i))
    return a.sums(), None if right is None else b.sums()
