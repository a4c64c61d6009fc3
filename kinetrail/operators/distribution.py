"""Static averages and distributions. ``frames`` below is the number of frames averaged over; frames without a row count as 0."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norm, polar, pore_coordinates
from .hist import bin_table, densify, edge_bin, spatial_density, with_edge_bin
from .joins import cell_list_pairs, distance, frame_pairs, nearest
from .pairs import Product, Sinc, equal_edges, near_pair_sums, pair_counts, pair_sinc_sums, squared_edges
from .pairs import Distance as PairDistance
from .pbc import images, into_box


def time_average(per_frame: DataFrame, keys: Sequence[str], value: str, frames: int) -> DataFrame:
    """Mean over frames of a per-frame value by ``keys``."""
    total = F.sum(value) / frames
    return per_frame.groupBy(*keys).agg(total.alias(value)) if keys else per_frame.agg(total.alias(value))


def time_histogram(values: DataFrame, row: str, value: Column, edges: Sequence[float]) -> DataFrame:
    """row, bin, n: one histogram for each output row of the per-frame function, over all frames."""
    return values.select(row, edge_bin(value, edges).alias("bin")).where("bin IS NOT NULL").groupBy(row, "bin").agg(F.count("*").alias("n"))


def _shell_volumes(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    table = bin_table(df.sparkSession, edges)
    return table.select("bin", "mid", (F.lit(4 / 3 * math.pi) * (F.pow("upper", F.lit(3.0)) - F.pow("lower", F.lit(3.0)))).alias("shell"))


def _pair_numbers(a: DataFrame, b: DataFrame | None, kind: str | None) -> DataFrame:
    """frame, all, volume: the number of pairs of each frame, from counts of atoms and of residues' atoms alone."""

    def sizes(df: DataFrame, name: str, *by: str) -> DataFrame:
        return df.groupBy("frame", *by).agg(F.count("*").cast("double").alias(name), F.first(F.col("bx") * F.col("by") * F.col("bz")).alias(f"{name}_volume"))

    n, volume = F.col("n"), F.col("n_volume")
    if b is None:
        whole = sizes(a, "n").select("frame", (n * (n - 1) / 2).alias("all"), volume.alias("volume"))
        same = None if kind is None else sizes(a, "n", "residue_id").groupBy("frame").agg(F.sum(n * (n - 1) / 2).alias("same"))
    else:
        whole = sizes(a, "n").join(sizes(b, "m").select("frame", "m"), "frame").select("frame", (n * F.col("m")).alias("all"), volume.alias("volume"))
        same = None if kind is None else sizes(a, "n", "residue_id").join(sizes(b, "m", "residue_id").select("frame", "residue_id", "m"), ["frame", "residue_id"]).groupBy("frame").agg(F.sum(n * F.col("m")).alias("same"))
    if same is None:
        return whole
    same_of = F.coalesce("same", F.lit(0.0))
    return whole.join(same, "frame", "left").select("frame", (same_of if kind == "intra" else F.col("all") - same_of).alias("all"), "volume")


def rdf(a: DataFrame, edges: Sequence[float], frames: int, b: DataFrame | None = None, kind: str | None = None, box: Sequence[float] | None = None) -> DataFrame:
    """bin, mid, value: pairs by nearest-image distance over the shell's volume and the pairs' density, averaged over frames.

    ``kind`` keeps pairs of equal ('intra') or different ('inter') residue_id, which
    positions must then carry. Kept pairs count for the density in range or not; their number follows from
    counts of atoms, so with ``box`` and a last edge under a third of it only pairs of neighbouring cells are made.
    """

    def binned(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("frame", distance().alias("d"))  # named, so that it is worked out once
        inside = with_edge_bin(pairs.where(F.col("d").between(float(min(edges)), float(max(edges)))), F.col("d"), edges, "bin")
        return inside.groupBy("frame", "bin").agg(F.count("*").alias("n"))

    if box is not None:
        pairs = cell_list_pairs(a, float(max(edges)), box, b)
        if kind is not None:
            same = F.col("a.residue_id") == F.col("b.residue_id")
            pairs = pairs.where({"intra": same, "inter": ~same}[kind])
        found = binned(pairs)
    else:
        # pairs of different residues are all pairs less those of equal ones, which are few and are joined by residue
        named = [None if df is None or kind is None else df.where("residue_id IS NOT NULL") for df in (a, b)]
        same = None if kind is None else binned(frame_pairs(*named, key=("frame", "residue_id")))
        if kind == "intra":
            found = same
        else:
            found = pair_counts(*(named if kind else (a, b)), PairDistance(), squared_edges(edges))
            if kind == "inter":
                found = found.unionByName(same.withColumn("n", -F.col("n"))).groupBy("frame", "bin").agg(F.sum("n").alias("n"))
    counts = found.join(_pair_numbers(a, b, kind), "frame")
    means = counts.groupBy("bin").agg((F.sum(F.col("n") * F.col("volume") / F.col("all")) / frames).alias("v"))
    return _shell_volumes(a, edges).join(means, "bin", "left").select("bin", "mid", F.coalesce(F.col("v") / F.col("shell"), F.lit(0.0)).alias("value"))


def periodic_rdf(a: DataFrame, b: DataFrame, edges: Sequence[float], frames: int, exclude: int = 0, box: Sequence[float] | None = None) -> DataFrame:
    """bin, mid, value: like rdf, but over all images of b within the last edge, normalised by N_a (N_b - exclude).

    With ``box`` and a last edge under a third of it an image is met once, and pairs are counted in tiles.
    """
    if box is not None and max(edges) * 3 <= min(box):
        counts = pair_counts(a, b, PairDistance(), squared_edges(edges))
    else:
        # images are clipped about the box, so both sets are folded into it first
        near = images(into_box(b), thickness=float(max(edges)) + 0.1)
        pairs = frame_pairs(into_box(a), near).withColumn("d", distance(box=False))
        counts = pairs.withColumn("bin", edge_bin(F.col("d"), edges)).where("bin IS NOT NULL").groupBy("frame", "bin").agg(F.count("*").alias("n"))
    sizes = a.groupBy("frame").agg(F.count("*").alias("na"), F.first(F.col("bx") * F.col("by") * F.col("bz")).alias("volume")).join(b.groupBy("frame").agg(F.count("*").alias("nb")), "frame")
    means = counts.join(sizes, "frame").groupBy("bin").agg((F.sum(F.col("n") * F.col("volume") / F.col("na") / (F.col("nb") - exclude)) / frames).alias("v"))
    return _shell_volumes(a, edges).join(means, "bin", "left").select("bin", "mid", F.coalesce(F.col("v") / F.col("shell"), F.lit(0.0)).alias("value"))


def sampled_frames(n_frames: int, times: int = 10) -> list[int]:
    """``times`` equally spaced frames, all if there are fewer."""
    return list(range(0, n_frames, max(1, n_frames // times)))[:times]


def averaged_rdf(positions: DataFrame, edges: Sequence[float], n_frames: int, to: DataFrame | None = None, times: int = 10, exclude: int | None = None, box: Sequence[float] | None = None) -> DataFrame:
    """periodic_rdf averaged over equally spaced frames; without ``to``, of a set with itself and exclude = 1."""
    picked = sampled_frames(n_frames, times)
    own = positions.where(F.col("frame").isin(picked))
    other = own if to is None else to.where(F.col("frame").isin(picked))
    return periodic_rdf(own, other, edges, len(picked), (1 if to is None else 0) if exclude is None else exclude, box)


def near_pairs(positions: DataFrame, cutoff: float) -> DataFrame:
    """frame, n, total: pairs of a frame closer than ``cutoff`` through nearest images, and the sum of their distances; no rows of pairs."""
    return near_pair_sums(positions, cutoff)


def distance_distribution(positions: DataFrame, edges: Sequence[float]) -> DataFrame:
    """frame, bin, n: distances between consecutive atoms, without images."""
    order = Window.partitionBy("frame").orderBy("atom")
    step = norm(*(F.lead(c).over(order) - F.col(c) for c in "xyz"))
    return positions.select("frame", step.alias("d")).select("frame", edge_bin(F.col("d"), edges).alias("bin")).where("bin IS NOT NULL").groupBy("frame", "bin").agg(F.count("*").alias("n"))


def tetrahedral_order(positions: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """frame, atom, q: 1 - 3/8 times the sum over pairs of the four nearest neighbours of (cos + 1/3) squared; no images."""
    columns = ("frame", "atom", "x", "y", "z")
    near = nearest(positions.select(*columns), (positions if reference is None else reference).select(*columns), 4, drop_first=True)
    unit = [F.try_divide(F.col(f"b.{c}") - F.col(f"a.{c}"), F.col("d")).alias(c) for c in "xyz"]
    # four structs an atom
    held = near.groupBy("frame", "atom").agg(F.sort_array(F.collect_list(F.struct("rank", *unit))).alias("u")).where(F.size("u") == 4)
    total = None
    for j in range(4):
        for k in range(j + 1, 4):
            a, b = F.col("u")[j], F.col("u")[k]
            cos = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
            term = (cos + 1 / 3) * (cos + 1 / 3)
            total = term if total is None else total + term
    return held.select("frame", "atom", (1 - F.lit(0.375) * total).alias("q"))


def tetrahedral_distribution(positions: DataFrame, edges: Sequence[float], reference: DataFrame | None = None) -> DataFrame:
    """bin, mid, n over all frames."""
    found = tetrahedral_order(positions, reference).select(edge_bin(F.col("q"), edges).alias("bin")).where("bin IS NOT NULL")
    return densify(found.groupBy("bin").agg(F.count("*").alias("n")), edges, "n")


def radial_density(positions: DataFrame, edges: Sequence[float], frames: int, symmetry_axis: Sequence[float] = (0, 0, 1), origin: Sequence[float] = (0, 0, 0), height: float = 1) -> DataFrame:
    """bin, mid, value: atoms by cylindrical radius over the ring's volume, averaged over frames."""
    x, y, _ = pore_coordinates(F.col("x"), F.col("y"), F.col("z"), origin, symmetry_axis)
    counts = positions.select(edge_bin(polar(x, y)[0], edges).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    table = bin_table(positions.sparkSession, edges)
    ring = F.lit(math.pi) * (F.col("upper") * F.col("upper") - F.col("lower") * F.col("lower")) * float(height)
    return table.join(counts, "bin", "left").select("bin", "mid", (F.coalesce("n", F.lit(0)) / frames / ring).alias("value"))


def shell_density(positions: DataFrame, shell_radius: float, edges: Sequence[Sequence[float]], shell_thickness: float = 0.5, symmetry_axis: Sequence[float] = (0, 0, 1), origin: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """b0, b1, n: counts by azimuth and height inside a cylindrical shell, bounds included."""
    x, y, z = pore_coordinates(F.col("x"), F.col("y"), F.col("z"), origin, symmetry_axis)
    radius, phi = polar(x, y)
    inside = positions.select(radius.alias("radius"), phi.alias("phi"), z.alias("h")).where(F.col("radius").between(shell_radius, shell_radius + shell_thickness))
    return spatial_density(inside, [F.col("phi"), F.col("h")], edges)


def mixing_ratio(a: DataFrame, b: DataFrame, columns: Sequence[str], edges: Sequence[Sequence[float]], ratio_edges: Sequence[float]) -> DataFrame:
    """bin, mid, n: cells that hold atoms of both sets by the first set's share."""
    names = [f"b{k}" for k in range(len(columns))]
    one = spatial_density(a, [F.col(c) for c in columns], edges).withColumnRenamed("n", "na")
    two = spatial_density(b, [F.col(c) for c in columns], edges).withColumnRenamed("n", "nb")
    share = one.join(two, names).select(edge_bin(F.col("na") / (F.col("na") + F.col("nb")), ratio_edges).alias("bin")).where("bin IS NOT NULL")
    return densify(share.groupBy("bin").agg(F.count("*").alias("n")), ratio_edges, "n")


def neighbor_composition(positions: DataFrame, edges: Sequence[float], number_of_neighbors: int = 4, normed: bool = True) -> DataFrame:
    """bin, mid, value: atoms by how many of their nearest neighbours have their residue name, as a density if ``normed``.

    Positions must carry residue_name. The nearest one, the atom itself, is left out.
    """
    held = positions.select("frame", "atom", "x", "y", "z", "residue_name")
    near = nearest(held, held, number_of_neighbors, drop_first=True)
    counts = near.groupBy("frame", "atom").agg(F.count(F.when(F.col("a.residue_name") == F.col("b.residue_name"), 1)).alias("c"))
    found = densify(counts.select(edge_bin(F.col("c").cast("double"), edges).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n")), edges, "n")
    if not normed:
        return found.withColumnRenamed("n", "value")
    width = bin_table(positions.sparkSession, edges).select("bin", (F.col("upper") - F.col("lower")).alias("width"))
    # as many rows as bins
    total = found.agg(F.sum("n").alias("all"))
    return found.join(F.broadcast(width), "bin").join(F.broadcast(total), F.lit(True)).select("bin", "mid", F.try_divide(F.col("n"), F.col("all") * F.col("width")).alias("value"))


def coherent_sum(a: DataFrame, b: DataFrame, f: Column | Sinc, key: Sequence[str] = ("frame",)) -> DataFrame:
    """key, value: sum over all pairs of a pair function; ``Sinc`` makes no rows of pairs."""
    if isinstance(f, Sinc):
        return pair_sinc_sums(a, b, f.q, key)
    return frame_pairs(a, b, key).groupBy(*key).agg(F.sum(f).alias("value"))


def coherent_histogram(a: DataFrame, b: DataFrame, f: Column | Product, lowest: float, highest: float, n: int, distinct: bool = False, key: Sequence[str] = ("frame",)) -> DataFrame:
    """key, bin, n: pairs by a pair function in n equal bins of [lowest, highest). ``Product`` of a set with itself, or of all pairs, makes no rows of pairs."""
    if isinstance(f, Product):
        if not distinct:
            return pair_counts(a, b, f, equal_edges(lowest, highest, n), key)
        if b is a:
            return pair_counts(a, None, f, equal_edges(lowest, highest, n), key).withColumn("n", 2 * F.col("n"))
        f = F.col("a.x") * F.col("b.x") + F.col("a.y") * F.col("b.y") + F.col("a.z") * F.col("b.z")
    pairs = frame_pairs(a, b, key)
    if distinct:
        pairs = pairs.where(F.col("a.atom") != F.col("b.atom"))
    width = (highest - lowest) / n
    held = pairs.select(*key, f.alias("h")).where((F.col("h") >= lowest) & (F.col("h") < highest))
    return held.groupBy(*key, F.floor((F.col("h") - lowest) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
