"""Multi-origin time correlation.

The pairs of frames are planned on the driver: ``segments`` onsets times the
lags of an index distribution, a few hundred rows at most. Positions of the frames that
the plan touches are brought together by atom in one shuffle; an atom then holds at
most as many positions as the plan has frames, and its pairs are made in
place, so no position is shuffled twice and nothing is joined.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legendre, minimum_image, norm, sinc, square, wrap
from ..schema import BOX, XYZ
from .hist import densify, histogram_bin, is_fast
from .joins import frame_pairs, within
from .pairs import PARTITIONS, WIDE_TILE, Distance, pair_counts, pair_sinc_sums, squared_edges, squared_fast_edges


def log_indices(first: int, last: int, num: int = 100) -> np.ndarray:
    """Distinct integers, evenly spaced on a log scale; what rounding leaves just below a whole number, by the machine, counts as it."""
    return np.unique(np.int_(np.logspace(0, np.log10(last - first + 1), num=num) + 1e-9) - 1 + first)


@dataclass(frozen=True)
class LagPlan:
    onsets: tuple[int, ...]
    lags: tuple[int, ...]

    @property
    def pairs(self) -> list[tuple[int, int, int]]:
        """(onset, lag, frame)."""
        return [(o, k, o + k) for o in self.onsets for k in self.lags]

    @property
    def frames(self) -> list[int]:
        return sorted({f for o, _, f in self.pairs} | set(self.onsets))

    def sql_values(self) -> str:
        return ", ".join(f"({o}, {k}, {f})" for o, k, f in self.pairs)


def plan_lags(n_frames: int, segments: int = 10, window: float = 0.5, skip: float = 0.0, index_distribution: Callable = log_indices) -> LagPlan:
    """Onsets between skip and 1 - window, lags up to the window; fractions become indices by truncation."""
    if not window + skip < 1:
        raise ValueError("window and skip leave no frames")
    onsets = np.unique(np.linspace(n_frames * skip, n_frames * (1 - window), num=segments, endpoint=False, dtype=int))
    return LagPlan(tuple(int(x) for x in onsets), tuple(int(x) for x in index_distribution(0, int(n_frames * window))))


def skip_of(start: int | None, n_frames: int) -> float:
    """The fraction skipped by default: a slice's start."""
    return (start or 0) / n_frames


def lag_pairs(positions: DataFrame, plan: LagPlan, columns: Sequence[str] = ("x", "y", "z"), carry: Sequence[str] = ()) -> DataFrame:
    """onset, lag, atom, a, b: an atom's structs at the onset and at the later frame.

    Atoms that lack some of the frames give the pairs they have. ``carry`` are
    columns that are constant for an atom.
    """
    frames = plan.frames
    rank = {f: k for k, f in enumerate(frames)}
    held = positions.where(F.col("frame").isin(frames)).groupBy("atom", *carry).agg(F.sort_array(F.collect_list(F.struct("frame", *columns))).alias("all"))
    text = json.dumps([{"onset": o, "lag": k, "frame": f, "i": rank[o], "j": rank[f]} for o, k, f in plan.pairs])
    pairs = F.from_json(F.lit(text), "array<struct<onset:int,lag:int,frame:int,i:int,j:int>>")

    def at(frame: Column, place: Column) -> Column:
        return F.when(F.size("all") == len(frames), F.get("all", place)).otherwise(F.get(F.filter("all", lambda e: e["frame"] == frame), F.lit(0)))

    # pairs are cut out before rows are multiplied, so no row carries the whole array
    cut = F.transform(pairs, lambda p: F.struct(p["onset"].alias("onset"), p["lag"].alias("lag"), at(p["onset"], p["i"]).alias("a"), at(p["frame"], p["j"]).alias("b")))
    out = held.select("atom", *carry, F.inline(cut))
    return out.where(F.col("a").isNotNull() & F.col("b").isNotNull())


Kernel = Callable[[], Column]


def difference() -> tuple[Column, Column, Column]:
    return tuple(F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz")


def msd() -> Column:
    return F.avg(square(*difference()))


def isf(q: float) -> Column:
    return F.avg(sinc(norm(*difference()) * q))


def rotational(order: int = 2) -> Column:
    u = sum((F.col(f"a.{c}") * F.col(f"b.{c}") for c in "yz"), F.col("a.x") * F.col("b.x"))
    return F.avg(legendre(order, u))


def non_gaussian() -> Column:
    r2 = square(*difference())
    return F.try_divide(F.lit(0.6) * F.avg(r2 * r2), F.avg(r2) * F.avg(r2)) - 1


def shifted_correlation(positions: DataFrame, kernel: Column, plan: LagPlan, average: bool = False, columns: Sequence[str] = ("x", "y", "z"), selector: Callable[[DataFrame], DataFrame] | None = None, correlation: Callable[..., DataFrame] = lag_pairs) -> DataFrame:
    """onset, lag, value of an aggregate kernel over (a, b); lag, value averaged over onsets if asked for.

    ``selector`` filters pairs by their onset side, ``a``: a subensemble is chosen at the onset and followed.
    ``correlation`` makes the pairs from (positions, plan, columns): onset, lag, a, b and whatever else the kernel reads.
    """
    pairs = correlation(positions, plan, columns)
    if selector is not None:
        pairs = selector(pairs)
    values = pairs.groupBy("onset", "lag").agg(kernel.alias("value"))
    return values.groupBy("lag").agg(F.avg("value").alias("value")) if average else values


def multi_subensemble(positions: DataFrame, kernel: Column, plan: LagPlan, selector: Column, n_selectors: int, average: bool = True) -> DataFrame:
    """lag, sel_id, value, count: mean over onsets weighted by each selection's size at the onset; 0 where it is empty.

    Without ``average`` a row for each onset too, with its value and the selection's size there.

    ``selector`` is an array of selection numbers of the onset struct ``a``.
    """
    pairs = lag_pairs(positions, plan).withColumn("sel_id", F.explode(selector))
    values = pairs.groupBy("onset", "lag", "sel_id").agg(kernel.alias("v"), F.count("*").alias("c"))
    spark = positions.sparkSession
    if not average:
        every = spark.createDataFrame([(o, k, s) for o, k, _ in plan.pairs for s in range(n_selectors)], "onset int, lag int, sel_id int")
        return every.join(values, ["onset", "lag", "sel_id"], "left").select("onset", "lag", "sel_id", F.coalesce("v", F.lit(0.0)).alias("value"), F.coalesce("c", F.lit(0)).alias("count"))
    means = values.groupBy("lag", "sel_id").agg(F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum("c")).alias("value"), (F.sum("c") / len(plan.onsets)).alias("count"))
    every = spark.createDataFrame([(k, s) for k in plan.lags for s in range(n_selectors)], "lag int, sel_id int")
    return every.join(means, ["lag", "sel_id"], "left").select("lag", "sel_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("count", F.lit(0.0)).alias("count"))


def van_hove_self(positions: DataFrame, plan: LagPlan, edges: Sequence[float]) -> DataFrame:
    """lag, bin, value: share of atoms by displacement, averaged over onsets."""
    pairs = lag_pairs(positions, plan).select("onset", "lag", norm(*difference()).alias("d"))  # named, so that it is worked out once
    counts = pairs.groupBy("onset", "lag", histogram_bin(F.col("d"), edges, signed=False).alias("bin")).agg(F.count("*").alias("n"))
    return _per_lag(counts, edges, plan)


def _per_lag(counts: DataFrame, edges: Sequence[float], plan: LagPlan, size: DataFrame | None = None) -> DataFrame:
    """Counts by (onset, lag, bin) over the number of atoms, averaged over onsets, with a row for every bin; a null bin is outside."""
    if size is None:
        totals = counts.groupBy("onset", "lag").agg(F.sum("n").alias("all"))
    else:
        totals = size
    shares = counts.where("bin IS NOT NULL").join(totals, ["onset", "lag"] if size is None else ["onset"])
    means = shares.groupBy("lag", "bin").agg((F.sum(F.col("n") / F.col("all")) / len(plan.onsets)).alias("value"))
    spark = counts.sparkSession
    every = spark.createDataFrame([(k, b) for k in plan.lags for b in range(len(edges) - 1)], "lag int, bin int")
    return every.join(means, ["lag", "bin"], "left").select("lag", "bin", F.coalesce("value", F.lit(0.0)).alias("value"))


def cross_sets(positions: DataFrame, plan: LagPlan) -> tuple[DataFrame, DataFrame]:
    """The atoms of each onset, and of each later frame, by onset and lag."""
    table = F.broadcast(positions.sparkSession.createDataFrame(plan.pairs, "onset int, lag int, later int"))
    return tuple(positions.join(table, positions.frame == table[c]).drop("frame", "later") for c in ("onset", "later"))


def cross_pairs(positions: DataFrame, plan: LagPlan) -> DataFrame:
    """All pairs of an onset's atoms with a later frame's atoms: onset, lag, a, b."""
    return frame_pairs(*cross_sets(positions, plan), key=("onset", "lag"))


def _onset_sizes(positions: DataFrame, plan: LagPlan) -> DataFrame:
    return positions.where(F.col("frame").isin(list(plan.onsets))).groupBy(F.col("frame").alias("onset")).agg(F.count("*").alias("all"))


def van_hove_distinct(positions: DataFrame, plan: LagPlan, edges: Sequence[float], include_self: bool = True) -> DataFrame:
    """lag, bin, value: pairs by nearest-image distance over the number of atoms, averaged over onsets."""
    a, b = cross_sets(positions, plan)
    bounds = squared_fast_edges(float(np.diff(np.asarray(edges, dtype=float)).mean()), len(edges) - 1) if is_fast(edges) else squared_edges(edges)
    # more partitions than pairs of frames, so that few get several of these long groups
    counts = pair_counts(a, b, Distance(), bounds, ("onset", "lag"), WIDE_TILE, max(PARTITIONS, 4 * len(plan.pairs)))
    if not include_self:
        # less an atom's pairs with itself
        d = norm(*(minimum_image(F.col(f"b.{c}") - F.col(f"a.{c}"), F.col(f"a.b{c}")) for c in "xyz"))
        own = a.alias("a").join(b.alias("b"), ["onset", "lag", "atom"]).select("onset", "lag", d.alias("d"))
        own = own.groupBy("onset", "lag", histogram_bin(F.col("d"), edges, signed=False).alias("bin")).agg((-F.count("*")).alias("n")).where("bin IS NOT NULL")
        counts = counts.unionByName(own).groupBy("onset", "lag", "bin").agg(F.sum("n").alias("n"))
    return _per_lag(counts, edges, plan, _onset_sizes(positions, plan))


def coherent_scattering(positions: DataFrame, plan: LagPlan, q: float) -> DataFrame:
    """lag, value: sum over all pairs of sin(qd)/(qd) over the number of atoms, averaged over onsets; wrapped positions."""
    # of wrapped positions, half a box is moved exactly where another image is nearer
    sums = pair_sinc_sums(*cross_sets(positions.withColumns({c: wrap(F.col(c), F.col(b)) for c, b in zip(XYZ, BOX, strict=True)}), plan), q, ("onset", "lag")).withColumnRenamed("value", "s")
    return sums.join(_onset_sizes(positions, plan), "onset").groupBy("lag").agg((F.sum(F.col("s") / F.col("all")) / len(plan.onsets)).alias("value"))


def overlap(positions: DataFrame, plan: LagPlan, radius: float, reference: DataFrame | None = None) -> DataFrame:
    """lag, value: share of reference points, at the onset, that later atoms lie within ``radius`` of; averaged over onsets."""
    spark = positions.sparkSession
    table = F.broadcast(spark.createDataFrame(plan.pairs, "onset int, lag int, later int"))
    held = positions if reference is None else reference
    later = positions.join(table, positions.frame == table.later).select("onset", "lag", "atom", "x", "y", "z")
    points = held.join(table, held.frame == table.onset).select("onset", "lag", "atom", "x", "y", "z")
    hits = within(later, points, radius, key=("onset", "lag")).groupBy("onset", "lag").agg(F.count("*").alias("n"))
    sizes = _onset_sizes(held, plan)
    every = spark.createDataFrame([(o, k) for o, k, _ in plan.pairs], "onset int, lag int")
    full = every.join(hits, ["onset", "lag"], "left").join(F.broadcast(sizes), "onset")
    return full.groupBy("lag").agg((F.sum(F.coalesce("n", F.lit(0)) / F.col("all")) / len(plan.onsets)).alias("value"))


def chi4(positions: DataFrame, plan: LagPlan, q: float) -> DataFrame:
    """lag, value: number of atoms times the variance of the scattering function over onsets."""
    values = lag_pairs(positions, plan).groupBy("onset", "lag").agg(isf(q).alias("f"), F.count("*").alias("n"))
    return values.groupBy("lag").agg((F.max("n") * F.var_pop("f")).alias("value"))


def susceptibility_from(spectrum: DataFrame) -> DataFrame:
    """omega, value: omega times the real part of a transform."""
    return spectrum.select("omega", (F.col("omega") * F.col("re")).alias("value"))


__all__ = [
    "LagPlan", "chi4", "coherent_scattering", "cross_pairs", "densify", "isf", "lag_pairs", "log_indices", "msd", "multi_subensemble", "non_gaussian", "overlap", "plan_lags", "rotational",
    "shifted_correlation", "skip_of", "susceptibility_from", "van_hove_distinct", "van_hove_self",
]
