"""Pairs of positions: within a frame, across frames, by radius, and nearest neighbours.

Frame pairs are dealt in tiles: both sides' atoms fall into groups, as many as the
frame's size asks for, and a pair of groups is one join key, so one large frame is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import minimum_image, norm
from ..schema import BOX
from .pairs import nearest_pairs

#: Atoms of a group, about; a frame has as many groups on each side as its larger side needs.
TILE_ATOMS = 2000


def _tiled(df: DataFrame, own: str, other: str, sizes: DataFrame, key: Sequence[str]) -> DataFrame:
    placed = df.join(sizes, list(key)).withColumn(own, F.pmod(F.xxhash64("atom"), F.col("tiles")).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))


def _tiles(a: DataFrame, b: DataFrame | None, key: Sequence[str], atoms: int) -> DataFrame:
    """key, tiles: groups on each side, one for every ``atoms`` atoms of the larger side."""
    counts = a.groupBy(*key).agg(F.count("*").alias("n"))
    if b is not None:
        counts = counts.unionByName(b.groupBy(*key).agg(F.count("*").alias("n"))).groupBy(*key).agg(F.max("n").alias("n"))
    return counts.select(*key, F.ceil(F.col("n") / atoms).cast("int").alias("tiles"))


def frame_pairs(a: DataFrame, b: DataFrame | None = None, key: Sequence[str] = ("frame",), tile_atoms: int = TILE_ATOMS) -> DataFrame:
    """All pairs with equal ``key``, as structs ``a`` and ``b``. Without ``b`` the pairs a.atom < b.atom of one set.

    Both sides are shuffled by (key, tiles), whatever their size: pairs are many
    more than rows, and a broadcast would leave them to as many tasks as the scan has. A tile pair has about
    ``tile_atoms`` squared pairs, however many atoms a frame has.
    A merge join spills where a tile is large.
    """
    other, sizes = a if b is None else b, _tiles(a, b, key, tile_atoms)
    left = _tiled(a, "ta", "tb", sizes, key).select(*key, "ta", "tb", F.struct(*(c for c in a.columns if c not in key)).alias("a"))
    right = _tiled(other, "tb", "ta", sizes, key).select(*key, "ta", "tb", F.struct(*(c for c in other.columns if c not in key)).alias("b"))
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*key, "ta", "tb")]
    if b is None:
        on.append(F.col("a.atom") < F.col("b.atom"))
    return left.alias("l").join(right.alias("r").hint("merge"), on).select(*(F.col(f"l.{k}").alias(k) for k in key), "a", "b")


def deltas(box: bool = True) -> tuple[Column, Column, Column]:
    """Components of b - a of a pair; nearest images if ``box``."""
    raw = [F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz"]
    return tuple(minimum_image(d, F.col(f"a.{b}")) if box else d for d, b in zip(raw, BOX, strict=True))


def distance(box: bool = True) -> Column:
    return norm(*deltas(box))


def cell_list_pairs(a: DataFrame, cutoff: float, box: Sequence[float], b: DataFrame | None = None) -> DataFrame:
    """Pairs of a frame closer than ``cutoff`` through nearest images, by an equi-join on cells of at least that width.

    With fewer than three cells along an axis neighbouring cells repeat, so all pairs of a frame are taken instead.
    """
    counts = [int(x // cutoff) for x in box]
    if min(counts) < 3:
        return frame_pairs(a, b).withColumn("d", distance()).where(F.col("d") <= cutoff)
    cells = [F.least(F.floor(F.pmod(F.col(c), F.lit(float(x))) / (float(x) / n)).cast("int"), F.lit(n - 1)) for c, x, n in zip("xyz", box, counts, strict=True)]
    other = a if b is None else b
    left = a.select("frame", *(c.alias(f"c{k}") for k, c in enumerate(cells)), F.struct(*(c for c in a.columns if c != "frame")).alias("a"))
    around = other.select("frame", *(c.alias(f"c{k}") for k, c in enumerate(cells)), F.struct(*(c for c in other.columns if c != "frame")).alias("b"))
    for k, n in enumerate(counts):
        around = around.withColumn("o", F.explode(F.array(*(F.lit(o) for o in (-1, 0, 1))))).withColumn(f"c{k}", F.pmod(F.col(f"c{k}") + F.col("o"), F.lit(n))).drop("o")
    pairs = left.join(around, ["frame", "c0", "c1", "c2"]).drop("c0", "c1", "c2")
    if b is None:
        pairs = pairs.where(F.col("a.atom") < F.col("b.atom"))
    return pairs.withColumn("d", distance()).where(F.col("d") <= cutoff)


def nearest(query: DataFrame, reference: DataFrame, k: int = 1, box: bool = False, upper: float | None = None, drop_first: bool = False, key: Sequence[str] = ("frame",)) -> DataFrame:
    """The k nearest reference atoms of each query atom: key, atom, rank, neighbor, d and the neighbour's struct.

    ``drop_first`` leaves out the nearest one, the atom itself when both sets are
    the same. Ties go to the smaller atom. No periodic images unless ``box``. Atoms without coordinates take no part.
    """
    first = 1 if drop_first else 0
    # of each tile the nearest ones alone, so no pair of all atoms is ever a row
    pairs = nearest_pairs(query, reference, k + first, box, key)
    if upper is not None:
        pairs = pairs.where(F.col("d") < upper)
    order = Window.partitionBy(*key, F.col("a.atom")).orderBy("d", F.col("b.atom"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + first)
    return ranked.where(F.col("rank") > first).select(*key, F.col("a.atom").alias("atom"), (F.col("rank") - first).alias("rank"), F.col("b.atom").alias("neighbor"), "d", "a", "b")


def min_distance(query: DataFrame, reference: DataFrame, box: bool = True) -> DataFrame:
    """frame, atom, d: distance to the nearest reference atom; a minimum that is combined before it is shuffled."""
    return frame_pairs(query, reference).groupBy("frame", F.col("a.atom").alias("atom")).agg(F.min(distance(box)).alias("d"))


def within(query: DataFrame, reference: DataFrame, radius: float, key: Sequence[str] = ("frame",)) -> DataFrame:
    """Query atoms with a reference atom at most ``radius`` away, without images, by a cell equi-join and a semi-join."""
    ids = [F.floor(F.col(c) / radius).cast("long") for c in "xyz"]
    left = query.select(*query.columns, *(c.alias(f"c{k}") for k, c in enumerate(ids)))
    right = reference.select(*(F.col(c).alias(f"k_{c}") for c in key), *(F.col(c).alias(f"r{c}") for c in "xyz"), *(c.alias(f"n{k}") for k, c in enumerate(ids)))
    for k in range(3):
        right = right.withColumn("o", F.explode(F.array(*(F.lit(o) for o in (-1, 0, 1))))).withColumn(f"n{k}", F.col(f"n{k}") + F.col("o")).drop("o")
    d = norm(*(F.col(c) - F.col(f"r{c}") for c in "xyz"))
    on = [F.col(c) == F.col(f"k_{c}") for c in key] + [F.col(f"c{k}") == F.col(f"n{k}") for k in range(3)]
    return left.join(right, [*on, d <= radius], "left_semi").select(*query.columns)
