"""Sums and counts over all pairs of a frame, and nearest neighbours, worked out in arrays without a row for each pair.

Both sets of a key are dealt to tiles, and a pair of tiles is one group of a
grouped Arrow function. There the atoms are put into leaves of a k-d tree; bounds
between two leaves tell what all their pairs have in common, and only the
other pairs of leaves are worked out, in doubles and in the order of
operations of the Column functions. Counts are thus those of all pairs.

Rows with a null coordinate have no distance and take no part. The box is that of a group's first row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..schema import BOX, XYZ

#: Atoms of a tile of one frame's pairs, and of a tile where frames meet frames or most pairs are not worked out.
TILE, WIDE_TILE = 32_768, 131_072
#: Partitions that pairs of tiles are dealt to; the number is given, as pairs of tiles are little data and much work.
PARTITIONS = 96
#: Atoms of a leaf for counts and sums, for neighbours, and queries that are searched together; leaves whose pairs of leaves are bounded at a time.
LEAF, NEAR_LEAF, NEAR_QUERIES, STRIP = 64, 64, 32, 256
#: Numbers of a work array, about.
BLOCK = 1 << 17
SLACK = 1e-12
#: Points of a set that spheres are worth their while against, of it at a time, and in one product of matrices (small, so that its values stay in a core's cache).
MANY, HELD, SHELL = 1 << 14, 1 << 14, 512
#: Places of a sphere's table of squared distances.
PLACES = 1 << 12


@dataclass(frozen=True)
class Distance:
    """The squared distance of a pair, through nearest images if ``box``."""

    box: bool = True


@dataclass(frozen=True)
class Product:
    """The scalar product of a pair's positions."""


@dataclass(frozen=True)
class Sinc:
    """sin(qd) / (qd) of a pair's nearest-image distance."""

    q: float


def least(holds: Callable[[float], bool], near: float) -> float:
    """The smallest double for which a condition that is monotone holds, close to ``near``."""
    low, high = near - abs(near) * 1e-9 - 1e-300, near + abs(near) * 1e-9 + 1e-300
    while (middle := low + (high - low) / 2) not in (low, high):
        low, high = (low, middle) if holds(middle) else (middle, high)
    return low if holds(low) else high


def squared_edges(edges: Sequence[float]) -> list[float]:
    """Bounds of ``edge_bin`` for squared distances; the last is beyond the last bin."""
    held = [least(lambda u, e=e: math.sqrt(max(u, 0.0)) >= e, e * e) for e in edges[:-1]]
    return [*held, least(lambda u: math.sqrt(max(u, 0.0)) > edges[-1], edges[-1] ** 2)]


def squared_fast_edges(dx: float, n: int) -> list[float]:
    """Bounds of ``fast_bin`` for squared distances."""

    def place(u: float) -> int:
        d = math.sqrt(max(u, 0.0))
        return round((d - math.fmod(d, dx)) / dx)

    return [least(lambda u, k=k: place(u) >= k, (k * dx) ** 2) for k in range(n + 1)]


def equal_edges(lowest: float, highest: float, n: int) -> list[float]:
    """Bounds of n equal bins of [lowest, highest)."""
    width = (highest - lowest) / n
    held = [least(lambda h, k=k: math.floor((h - lowest) / width) >= k, lowest + k * width) for k in range(1, n)]
    return [lowest, *held, highest]


def _dealt(df: DataFrame, own: str, other: str, key: Sequence[str], columns: Sequence[str], side: int) -> DataFrame:
    placed = df.withColumn(own, F.pmod(F.xxhash64("atom"), F.col(f"n_{own}")).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).select(*key, "ta", "tb", F.lit(side).alias("side"), *columns)


def tile_pairs(a: DataFrame, b: DataFrame | None, key: Sequence[str], tiles: tuple[int, int], columns: Sequence[str]) -> DataFrame:
    """Rows of pairs of tiles: key, ta, tb, side (0: of a, 1: of b) and ``columns``; without ``b`` pairs of tiles ta <= tb of one set, side 1 only where they differ."""
    a = a.where(" AND ".join(f"{c} IS NOT NULL" for c in XYZ))
    sizes = a.groupBy(*key).agg(F.ceil(F.count("*") / tiles[0]).cast("int").alias("n_ta"))
    if b is None:
        placed = a.join(sizes.withColumn("n_tb", F.col("n_ta")), list(key)).withColumn("t", F.pmod(F.xxhash64("atom"), F.col("n_ta")).cast("int"))
        placed = placed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n_ta") - 1)))
        return placed.select(*key, F.least("t", "u").alias("ta"), F.greatest("t", "u").alias("tb"), (F.col("t") > F.col("u")).cast("int").alias("side"), *columns)
    b = b.where(" AND ".join(f"{c} IS NOT NULL" for c in XYZ))
    sizes = sizes.join(b.groupBy(*key).agg(F.ceil(F.count("*") / tiles[1]).cast("int").alias("n_tb")), list(key))
    return _dealt(a.join(sizes, list(key)), "ta", "tb", key, columns, 0).unionByName(_dealt(b.join(sizes, list(key)), "tb", "ta", key, columns, 1))


def kd_leaves(points: np.ndarray, leaf: int) -> np.ndarray:
    """Numbers of the points, leaf by leaf; all leaves but the last have ``leaf`` points."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        held = stack.pop()
        if len(held) <= leaf:
            out.append(held)
            continue
        axis = int(np.ptp(points[held], axis=0).argmax())
        half = -(-len(held) // leaf) // 2 * leaf
        held = held[np.argpartition(points[held, axis], half)]
        stack += [held[half:], held[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Leaves:
    """Points in leaves, the last one filled with NaN."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.order = kd_leaves(points, leaf)
        n = -(-len(points) // leaf)
        self.sizes = np.full(n, leaf)
        self.sizes[-1] = len(points) - (n - 1) * leaf
        held = np.full((n * leaf, 3), np.nan)
        held[: len(points)] = points[self.order]
        held = held.reshape(n, leaf, 3)
        self.low, self.high = np.nanmin(held, axis=1), np.nanmax(held, axis=1)
        self.at = [np.ascontiguousarray(held[:, :, c]) for c in range(3)]
        self.points, self.leaf = points[self.order], leaf

    def strips(self) -> Iterator[tuple[int, Leaves]]:
        """Runs of leaves with their first number, so that bounds of pairs of leaves stay small."""
        for first in range(0, len(self.sizes), STRIP):
            part = copy(self)
            at = slice(first, first + STRIP)
            part.sizes, part.low, part.high, part.at = self.sizes[at], self.low[at], self.high[at], [x[at] for x in self.at]
            part.points = self.points[first * self.leaf : (first + STRIP) * self.leaf]
            yield first, part


def _steps(a: Leaves, b: Leaves, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of component c of b - a for all pairs of leaves."""
    return b.low[None, :, c] - a.high[:, None, c], b.high[None, :, c] - a.low[:, None, c]


def distance_bounds(a: Leaves, b: Leaves, box: Sequence[float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest squared distance for all pairs of leaves, and whether an image other than the original one can be nearest."""
    least_, most, moved = 0.0, 0.0, np.zeros((len(a.sizes), len(b.sizes)), bool)
    for c in range(3):
        low, high = _steps(a, b, c)
        if box is None:
            near, far = np.maximum(np.maximum(low, -high), 0), np.maximum(np.abs(low), np.abs(high))
        else:
            low, high = low / box[c], high / box[c]
            moved |= (low < -0.5 + 1e-9) | (high > 0.5 - 1e-9)
            one, two = np.abs(low - np.rint(low)), np.abs(high - np.rint(high))
            near = np.where(np.floor(high) >= np.ceil(low), 0.0, np.minimum(one, two)) * box[c]
            far = np.where(np.floor(high - 0.5 + 1e-9) >= np.ceil(low - 0.5 - 1e-9), 0.5, np.maximum(one, two)) * box[c]
        least_, most = least_ + near * near, most + far * far
    return least_ * (1 - SLACK) - 1e-15, most * (1 + SLACK) + 1e-15, moved


def product_bounds(a: Leaves, b: Leaves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    least_, most = 0.0, 0.0
    for c in range(3):
        ends = [x[:, None, c] * y[None, :, c] for x in (a.low, a.high) for y in (b.low, b.high)]
        least_, most = least_ + np.minimum.reduce(ends), most + np.maximum.reduce(ends)
    return least_ - 1e-12 * (1 + np.abs(least_)), most + 1e-12 * (1 + np.abs(most)), np.zeros(least_.shape, bool)


def _values(a: Leaves, b: Leaves, i: np.ndarray, j: np.ndarray, value: Distance | Product, box: Sequence[float] | None, work: np.ndarray) -> np.ndarray:
    """Squared distances or products for pairs of leaves (i, j), with the operations of the Column functions in their order."""
    total, one, two = (w[: len(i) * a.leaf * b.leaf].reshape(len(i), a.leaf, b.leaf) for w in work)
    for c in range(3):
        x, y = a.at[c][i][:, :, None], b.at[c][j][:, None, :]
        out = one if c else total
        if isinstance(value, Product):
            np.multiply(x, y, out=out)
        else:
            np.subtract(y, x, out=out)
            if box is not None:
                if box[c] != 1:
                    out /= box[c]
                np.rint(out, out=two)
                out -= two
                if box[c] != 1:
                    out *= box[c]
            out *= out
        if c:
            total += one
    return total


def _batches(i: np.ndarray, j: np.ndarray, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    size = max(1, BLOCK // (leaf * leaf))
    for first in range(0, len(i), size):
        at = slice(first, first + size)
        yield i[at], j[at], at


def same_atoms(ids: np.ndarray | None, points: np.ndarray, value: Distance | Product, box: Sequence[float] | None) -> np.ndarray:
    """Values of the pairs of rows of one atom, where a key has it more than once."""
    if ids is None or len(np.unique(ids)) == len(ids):
        return np.zeros(0)
    order, out = np.argsort(ids, kind="stable"), []
    for held in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
        if len(held) > 1:
            i, j = np.triu_indices(len(held), 1)
            one = Leaves.__new__(Leaves)
            one.leaf, one.at = 1, [points[held, c][:, None] for c in range(3)]
            out.append(_values(one, one, i, j, value, box, np.empty((3, len(i)))).ravel())
    return np.concatenate(out)


def _shells(radius: float, bounds: np.ndarray, most: float) -> np.ndarray | None:
    """Of squared distances from a sphere's middle, by places up to ``most``: twice the bounds that all of the sphere is beyond, and one more in the shell of the next bound; None where shells meet."""
    limits = np.sqrt(np.maximum(bounds, 0))
    inner = np.where(bounds > 0, np.maximum(limits - radius, 0) ** 2 - 1e-300, -1.0)
    outer = np.where(bounds > 0, (limits + radius) ** 2, -1.0)
    lower = np.arange(PLACES) * (most / PLACES)
    passed = np.searchsorted(outer, lower * (1 - 1e-9), "right")
    reached = np.searchsorted(inner, (lower + most / PLACES) * (1 + 1e-9), "right")
    return None if (reached > passed + 1).any() else (passed + reached).astype(np.uint8)


def _sphere(a: np.ndarray, b: Sequence[tuple[list[np.ndarray], np.ndarray, np.ndarray]], bounds: np.ndarray, box: Sequence[float] | None, size: float) -> np.ndarray | None:
    """Number of pairs of a leaf's points and others, given by components and their least and greatest ones, at or beyond each bound; None if the leaf is too wide for the bounds.

    The pairs of a point farther from the middle than a bound and the radius, or nearer than their difference, are all on one side of the bound.
    In its shell |d - p|^2 - u is (|d|^2 - u) - 2 d p + |p|^2, a product of matrices in single precision, whose terms are no greater than the
    shell is wide; pairs too close to 0 there, and those of points whose nearest image is not one for all of the leaf, are worked out
    in doubles as elsewhere. ``size`` bounds the differences of coordinates and the box.
    """
    middle, half = (a.min(axis=0) + a.max(axis=0)) / 2, np.ptp(a, axis=0) / 2 + 1e-9 * size
    inner = a - middle
    squares = (inner * inner).sum(axis=1)
    radius = math.sqrt(squares.max()) * 1.001 + 1e-8 * size
    most = 3 * (1.001 * size) ** 2 if box is None else sum((x / 2 + 1e-6 * size) ** 2 for x in box)
    codes = _shells(radius, bounds, most)
    if codes is None or box is not None and any(4 * h > x for h, x in zip(half, box, strict=True)):
        return None
    far = math.sqrt(most) + 2 * radius
    left = np.concatenate([inner.T / radius, np.ones((1, len(a))), squares[None] / (radius * far)]).astype(np.float32)
    # a sum of five products of numbers rounded to 24 bits is off by less than 8 * 2**-24 of its terms' sum, which 4 radius (limit + radius) bounds; doubles by less than 2**-48 size far
    close = [np.float32((2e-6 * radius * (math.sqrt(max(x, 0.0)) + radius) + 2.0**-46 * size * far) / (radius * far)) for x in bounds]
    u, sure, maybe = np.empty((SHELL, len(a)), np.float32), np.empty((SHELL, len(a)), bool), np.empty((SHELL, len(a)), bool)
    over, passed = np.zeros(len(bounds), np.int64), np.zeros(2 * len(bounds) + 2, np.int64)
    exact = Leaves.__new__(Leaves), Leaves.__new__(Leaves)
    # points with more than one nearest image are about half a box away
    sure_of_mixed = 0 if box is None else int(np.searchsorted(bounds, (min(x / 2 - 2 * h for x, h in zip(box, half, strict=True))) ** 2 * (1 - 1e-9), "right"))
    exact[0].leaf, exact[0].at = len(a), [x[None, :] for x in a.T]
    for points, low, high in b:
        steps = [x - m for x, m in zip(points, middle, strict=True)]
        if box is not None:
            mixed = np.zeros(len(points[0]), bool)
            for c, d in enumerate(steps):
                limit = box[c] / 2 - half[c]
                if -limit < low[c] - middle[c] and high[c] - middle[c] < limit:
                    continue
                d -= np.rint(d) if box[c] == 1 else box[c] * np.rint(d / box[c])
                mixed |= np.abs(d) > limit
            at = np.flatnonzero(mixed)
            if len(at):
                exact[1].leaf, exact[1].at = 1, [x[at][:, None] for x in points]
                for start in range(0, len(at), per := max(1, BLOCK // len(a))):
                    j = np.arange(start, min(start + per, len(at)))
                    found = _values(*exact, np.zeros_like(j), j, Distance(), box, np.empty((3, len(j) * len(a))))
                    over[:sure_of_mixed] += found.size
                    over[sure_of_mixed:] += [np.count_nonzero(found >= bound) for bound in bounds[sure_of_mixed:]]
        x, y, z = steps
        r2 = x * x
        r2 += y * y
        r2 += z * z
        code = codes[(r2 * (PLACES / most)).astype(np.int32)]
        if box is not None and len(at):
            code[at] = len(passed) - 1
        numbers = np.bincount(code, minlength=len(passed))
        passed += numbers
        shells = np.flatnonzero(numbers[1:-1:2])
        if not len(shells):
            continue
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(numbers)
        spans = [(k, int(ends[2 * k]), int(ends[2 * k + 1])) for k in shells]
        at = np.concatenate([order[p:q] for _, p, q in spans])
        right = np.empty((5, len(at)), np.float32)
        for c, d in enumerate(steps):
            np.multiply(d[at], -2 / far, out=right[c], casting="same_kind")
        np.multiply(r2[at] - np.repeat([bounds[k] for k, _, _ in spans], [q - p for _, p, q in spans]), 1 / (radius * far), out=right[3], casting="same_kind")
        right[4] = 1
        start, near = 0, []
        for k, p, q in spans:
            stop = start + q - p
            for here in range(start, stop, SHELL):
                n = min(SHELL, stop - here)
                np.matmul(right[:, here : here + n].T, left, out=u[:n])
                beyond = np.count_nonzero(np.greater_equal(u[:n], close[k], out=sure[:n]))
                over[k] += beyond
                if beyond != np.count_nonzero(np.greater_equal(u[:n], -close[k], out=maybe[:n])):
                    j, i = np.divmod(np.flatnonzero(sure[:n] != maybe[:n]), len(a))
                    near.append((i, at[here + j], np.full(len(i), k)))
            start = stop
        if near:
            i, j, k = (np.concatenate(x) for x in zip(*near, strict=True))
            over += np.bincount(k[_one_by_one(a[i], [x[j] for x in points], box) >= bounds[k]], minlength=len(over))
    # beyond a bound are all pairs of the points whose code is past it; the last code is that of mixed ones
    return over + len(a) * (passed[:-1].sum() - np.cumsum(passed[:-1])[1::2])


def _one_by_one(a: np.ndarray, b: Sequence[np.ndarray], box: Sequence[float] | None) -> np.ndarray:
    """Squared distances of each point and the other of the same place, given by its components."""
    one, two, n = Leaves.__new__(Leaves), Leaves.__new__(Leaves), np.arange(len(a))
    one.leaf, two.leaf, one.at, two.at = 1, 1, [x[:, None] for x in a.T], [x[:, None] for x in b]
    return _values(one, two, n, n, Distance(), box, np.empty((3, len(n)))).ravel()


def count_spheres(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, box: Sequence[float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Number of pairs below the first bound, between bounds and beyond the last one for those leaves of a that are small against the distances of bounds; the points of the others."""
    size = max(float(np.ptp(np.concatenate(x))) for x in zip(a.T, b.T, strict=True)) + (max(box) if box else 0.0)
    order, found, rest = kd_leaves(a, LEAF), np.zeros(len(bounds) + 1, np.int64), []
    others = b[kd_leaves(b, HELD)]
    held = [([np.ascontiguousarray(x) for x in y.T], y.min(axis=0), y.max(axis=0)) for y in (others[first : first + HELD] for first in range(0, len(b), HELD))]
    for first in range(0, len(a), LEAF):
        points = a[order[first : first + LEAF]]
        over = _sphere(points, held, bounds, box, size)
        if over is None:
            rest.append(points)
        else:
            found -= np.diff(over, prepend=len(points) * len(b), append=0)
    return found, np.concatenate(rest) if rest else a[:0]


def count(a: np.ndarray, b: np.ndarray | None, value: Distance | Product, bounds: Sequence[float], box: Sequence[float] | None, ids: np.ndarray | None = None) -> np.ndarray:
    """Number of pairs in each bin [bounds[k], bounds[k + 1]); without ``b`` pairs of different points of one set, once, and not of one atom's rows by ``ids``."""
    bounds, same = np.asarray(bounds), b is None
    found, work = np.zeros(len(bounds) + 1, np.int64), np.empty((3, max(BLOCK, LEAF**2)))
    images = box if isinstance(value, Distance) and value.box else None
    if isinstance(value, Distance) and not same:
        # leaves of either set that are small enough against the other one, then what is left of both
        for _ in range(2):
            if len(b) >= MANY:
                n, a = count_spheres(a, b, bounds, images)
                found += n
                if not len(a):
                    return found[1:-1]
            a, b = b, a
    whole = Leaves(a, LEAF)
    right = whole if same else Leaves(b, LEAF)

    def add(left: Leaves, i: np.ndarray, j: np.ndarray, all_: int, first: int, last: int, shifted: Sequence[float] | None, into: np.ndarray) -> None:
        u = _values(left, right, i, j, value, shifted, work)
        rest = all_
        for k in range(first, last):
            over = int(np.count_nonzero(u >= bounds[k]))
            into[k] += rest - over
            rest = over
        into[last] += rest

    for start, left in whole.strips():
        lowest, highest, moved = distance_bounds(left, right, images) if isinstance(value, Distance) else product_bounds(left, right)
        lowest, highest = np.searchsorted(bounds, lowest, "right"), np.searchsorted(bounds, highest, "right")
        numbers = left.sizes[:, None] * right.sizes[None, :]
        wanted = np.arange(len(right.sizes))[None, :] > np.arange(start, start + len(left.sizes))[:, None] if same else np.ones(lowest.shape, bool)
        plain = wanted & (lowest == highest)
        found += np.bincount(lowest[plain], weights=numbers[plain], minlength=len(found)).astype(np.int64)
        for shifted in (False, True):
            i, j = np.nonzero(wanted & ~plain & (moved == shifted))
            by = np.lexsort((highest[i, j], lowest[i, j]))
            for p, q, _ in _batches(i[by], j[by], LEAF):
                add(left, p, q, int(numbers[p, q].sum()), int(lowest[p, q].min()), int(highest[p, q].max()), images if shifted else None, found)
    if same:
        twice, own = np.zeros_like(found), np.arange(len(whole.sizes))
        for i, j, _ in _batches(own, own, LEAF):
            add(whole, i, j, int((whole.sizes[i] ** 2).sum()), 0, len(bounds), images, twice)
        selves = np.zeros(len(a)) if isinstance(value, Distance) else a[:, 0] * a[:, 0] + a[:, 1] * a[:, 1] + a[:, 2] * a[:, 2]
        found += (twice - np.bincount(np.searchsorted(bounds, selves, "right"), minlength=len(found))) // 2
        found -= np.bincount(np.searchsorted(bounds, same_atoms(ids, a, value, images), "right"), minlength=len(found))
    return found[1:-1]


def near_sums(a: np.ndarray, b: np.ndarray | None, cutoff: float, box: Sequence[float], ids: np.ndarray | None = None) -> tuple[int, float]:
    """Number of pairs no farther apart than ``cutoff``, and the sum of their distances; pairs as in ``count``."""
    whole = Leaves(a, LEAF)
    right = whole if b is None else Leaves(b, LEAF)
    limit, work = least(lambda u: math.sqrt(max(u, 0.0)) > cutoff, cutoff * cutoff), np.empty((3, max(BLOCK, LEAF**2)))
    n, totals, lower = 0, [], np.tri(LEAF, dtype=bool)
    for start, left in whole.strips():
        lowest, _, moved = distance_bounds(left, right, box)
        near = lowest < limit
        if b is None:
            near &= np.arange(len(right.sizes))[None, :] >= np.arange(start, start + len(left.sizes))[:, None]
        for shifted in (False, True):
            for p, q, _ in _batches(*np.nonzero(near & (moved == shifted)), LEAF):
                u = _values(left, right, p, q, Distance(), box if shifted else None, work)
                if b is None and (own := p + start == q).any():
                    # each pair of a leaf with itself once
                    u[own] = np.where(lower, np.inf, u[own])
                held = u[u < limit]
                n += len(held)
                totals.append(float(np.sqrt(held).sum()))
    if b is None:
        u = same_atoms(ids, a, Distance(), box)
        u = u[u < limit]
        n -= len(u)
        totals.append(-float(np.sqrt(u).sum()))
    return n, math.fsum(totals)


def directions(q: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Half of the wave vectors of length q, and weights, whose plane waves average to sin(qd) / (qd) for d up to ``reach``, to rounding."""
    n = math.ceil((q * reach + 30) / 2) + 1
    cos, weights = np.polynomial.legendre.leggauss(n)
    phi = np.arange(n) * (math.pi / n)
    sin = np.sqrt(1 - cos * cos)
    k = q * np.stack([np.outer(sin, np.cos(phi)), np.outer(sin, np.sin(phi)), np.outer(cos, np.ones(n))], axis=-1).reshape(-1, 3)
    return k, np.repeat(weights / 2 / n, n)


def _waves(leaves: Leaves, k: np.ndarray) -> np.ndarray:
    """Sums of the plane waves over each leaf's points."""
    out = np.empty((len(leaves.sizes), len(k)), complex)
    per = 16
    for first in range(0, len(out), per):
        points = leaves.points[first * leaves.leaf : (first + per) * leaves.leaf]
        phase = points @ k.T
        starts = np.arange(0, len(points), leaves.leaf)
        out[first : first + per] = np.add.reduceat(np.cos(phase), starts, axis=0) + 1j * np.add.reduceat(np.sin(phase), starts, axis=0)
    return out


def sinc_sum(a: np.ndarray, b: np.ndarray, q: float, box: Sequence[float]) -> float:
    """Sum of sin(qd) / (qd) over all pairs of a point of a and one of b.

    The function is the mean of the plane waves of length q over all directions. Pairs of leaves all of whose pairs
    have the same nearest image are summed as products of the leaves' waves (Debye), the others pair by pair.
    """
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return math.nan
    whole, right = Leaves(a, LEAF), Leaves(b, LEAF)
    k, weights = directions(q, math.sqrt(sum(x * x for x in box)) / 2)
    # waves cost each point as much as so many pairs
    waves, totals = len(k) * 8 < len(a) * len(b) / (len(a) + len(b)), []
    theirs, work = _waves(right, k) if waves else None, np.empty((3, max(BLOCK, LEAF**2)))
    for _, left in whole.strips():
        one, shifts = np.full((len(left.sizes), len(right.sizes)), waves), []
        for c in range(3):
            low, high = (x / box[c] for x in _steps(left, right, c))
            one &= (np.rint(low - 1e-9) == np.rint(high + 1e-9)) & (high - low < 1)
            shifts.append(np.rint(low))
        if one.any():
            mine, moves = _waves(left, k), np.stack(shifts, axis=-1)
            for move in np.unique(moves[one], axis=0):
                held = (one & (moves == move).all(axis=-1)).astype(float)
                turned = np.exp(-1j * (k @ (move * np.asarray(box))))
                both = held @ theirs.real + 1j * (held @ theirs.imag)
                totals.append(float(((mine.conj() * both * turned).real @ weights).sum()))
        for p, r, _ in _batches(*np.nonzero(~one), LEAF):
            d = np.sqrt(_values(left, right, p, r, Distance(), box, work))
            d *= q
            zero = d == 0
            totals.append(float(np.nansum(np.where(zero, 1.0, np.sin(d) / np.where(zero, 1.0, d)))))
    return math.fsum(totals)


def nearest_of(a: np.ndarray, b: np.ndarray, n: int, box: Sequence[float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in a and b, and distances, of each point's n nearest ones; ``b`` is in the order in which ties are taken."""
    left, right = Leaves(a, NEAR_QUERIES), Leaves(b, NEAR_LEAF)
    found, none = [], np.inf
    for block in range(len(left.sizes)):
        mine = left.order[block * NEAR_QUERIES : (block + 1) * NEAR_QUERIES]
        if box is None:
            gap = np.maximum(np.maximum(right.low - left.high[block], left.low[block] - right.high), 0)
            gaps = (gap * gap).sum(axis=1) * (1 - SLACK)
        else:
            gaps = np.zeros(len(right.sizes))
        by, taken = np.argsort(gaps, kind="stable"), max(2, -(-n // NEAR_LEAF) + 1)
        while True:
            leaves = by[:taken]
            places = np.sort(np.concatenate([right.order[x * NEAR_LEAF : (x + 1) * NEAR_LEAF] for x in leaves]))
            u = 0.0
            for c in range(3):
                d = b[places, c][None, :] - a[mine, c][:, None]
                if box is not None:
                    d = d / box[c]
                    d = box[c] * (d - np.rint(d))
                u = u + d * d
            u = np.where(np.isnan(u), none, u)
            full = len(places) >= n
            last = np.partition(u, n - 1, axis=1)[:, n - 1] if full else np.full(len(mine), none)
            need = int(np.searchsorted(gaps[by], last.max() * (1 + 1e-9), "right"))
            if need <= taken or taken >= len(by):
                break
            taken = need if full else min(len(by), 2 * taken)
        d = np.sqrt(u)
        least_ = np.sqrt(last)[:, None]
        nearer, level = d < least_, d == least_
        many = level.sum(axis=1) > n
        if many.any():
            # of equal distances the first ones
            level[many] &= np.cumsum(level[many], axis=1) <= n
        rows, columns = np.nonzero(nearer | level)
        values = d[rows, columns]
        by_d = np.lexsort((columns, values, rows))
        rows, columns, values = rows[by_d], columns[by_d], values[by_d]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < n
        found.append((mine[rows[keep]], places[columns[keep]], values[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _points(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in XYZ], axis=1).astype(np.float64)


def _finite(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Points that have distances, and their atoms."""
    points = _points(table)
    held = np.isfinite(points).all(axis=1)
    return points[held], table["atom"].to_numpy()[held]


def _grouped(pairs: DataFrame, key: Sequence[str], work: Callable[[pa.Table, pa.Table | None], dict], columns: str, one_set: bool, partitions: int = PARTITIONS) -> DataFrame:
    """The columns that ``work`` makes of the rows of both sides, with their key; of one set's tile with itself the second side is None."""
    schema = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in key) + f", {columns}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def apply(group: tuple, table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        a, b = (table.filter(pa.array(side == s)) for s in (0, 1))
        own = one_set and group[-2].as_py() == group[-1].as_py()
        if not len(a) or not own and not len(b):
            return arrow.empty_table()
        out = work(a, None if own else b)
        n = len(next(iter(out.values())))
        held = {c: pa.array([v.as_py()] * n, v.type) for c, v in zip(key, group, strict=False)}
        return pa.table(held | {c: pa.array(v) for c, v in out.items()}).cast(arrow)

    return pairs.repartition(partitions, *key, "ta", "tb").groupBy(*key, "ta", "tb").applyInArrow(apply, schema)


def _box(table: pa.Table) -> tuple[float, ...]:
    return tuple(float(table[c][0].as_py()) for c in BOX)


def pair_counts(a: DataFrame, b: DataFrame | None, value: Distance | Product, bounds: Sequence[float], key: Sequence[str] = ("frame",), tile: int = TILE, partitions: int = PARTITIONS) -> DataFrame:
    """key, bin, n: pairs by the bins between ``bounds`` that hold any; without ``b`` each pair of different atoms of one set once."""
    boxed = isinstance(value, Distance) and value.box

    def work(one: pa.Table, two: pa.Table | None) -> dict:
        (p, ids), (q, _) = _finite(one), (None, None) if two is None else _finite(two)
        if not len(p) or q is not None and not len(q):
            return {"bin": [], "n": []}
        n = count(p, q, value, bounds, _box(one) if boxed else None, ids)
        held = np.flatnonzero(n)
        return {"bin": held.astype(np.int32), "n": n[held]}

    pairs = tile_pairs(a, b, key, (tile, tile), ("atom", *XYZ, *(BOX if boxed else ())))
    return _grouped(pairs, key, work, "bin int, n long", b is None, partitions).groupBy(*key, "bin").agg(F.sum("n").alias("n"))


def near_pair_sums(a: DataFrame, cutoff: float, b: DataFrame | None = None, key: Sequence[str] = ("frame",)) -> DataFrame:
    """key, n, total: number of pairs no farther apart than ``cutoff`` through nearest images, and the sum of their distances, where there are any."""

    def work(one: pa.Table, two: pa.Table | None) -> dict:
        (p, ids), (q, _) = _finite(one), (None, None) if two is None else _finite(two)
        n, total = near_sums(p, q, cutoff, _box(one), ids) if len(p) and (q is None or len(q)) else (0, 0.0)
        return {"n": [n], "total": [total]} if n else {"n": [], "total": []}

    pairs = tile_pairs(a, b, key, (TILE, TILE), ("atom", *XYZ, *BOX))
    return _grouped(pairs, key, work, "n long, total double", b is None).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def pair_sinc_sums(a: DataFrame, b: DataFrame, q: float, key: Sequence[str] = ("frame",)) -> DataFrame:
    """key, value: sum of sin(qd) / (qd) over all pairs."""
    pairs = tile_pairs(a, b, key, (WIDE_TILE, WIDE_TILE), (*XYZ, *BOX))

    def work(one: pa.Table, two: pa.Table | None) -> dict:
        return {"value": [sinc_sum(_points(one), _points(two), q, _box(one))]}

    return _grouped(pairs, key, work, "value double", False).groupBy(*key).agg(F.sum("value").alias("value"))


def nearest_pairs(query: DataFrame, reference: DataFrame, n: int, box: bool, key: Sequence[str], ties: Sequence[str] = ("atom",), carry: tuple[Sequence[str], Sequence[str]] | None = None) -> DataFrame:
    """key, a, b, d: each query atom with the n nearest reference rows of every reference tile; ties in the order of ``ties``.

    ``a`` and ``b`` are structs of ``carry``, or of all columns beside the key.
    """
    names = carry or tuple([c for c in df.columns if c not in key] for df in (query, reference))
    kinds = [f"struct<{', '.join(f'`{c}`: {dict(df.dtypes)[c]}' for c in held)}>" for df, held in zip((query, reference), names, strict=True)]
    shared = ("atom", *XYZ, *BOX) if box else ("atom", *XYZ)
    one = query.select(*key, *shared, F.struct(*names[0]).alias("a"), F.lit(None).cast(kinds[1]).alias("b"))
    two = reference.select(*key, *shared, F.lit(None).cast(kinds[0]).alias("a"), F.struct(*names[1]).alias("b"))

    def work(held: pa.Table, others: pa.Table) -> dict:
        b = others["b"].combine_chunks()
        order = np.lexsort([b.field(c).to_numpy(zero_copy_only=False) for c in reversed(ties)])
        i, j, d = nearest_of(_points(held), _points(others)[order], n, _box(held) if box else None)
        return {"a": held["a"].combine_chunks().take(pa.array(i)), "b": b.take(pa.array(order[j])), "d": d}

    pairs = tile_pairs(one, two, key, (TILE, WIDE_TILE), (*(shared[1:]), "a", "b"))
    return _grouped(pairs, key, work, f"a {kinds[0]}, b {kinds[1]}, d double", False)
