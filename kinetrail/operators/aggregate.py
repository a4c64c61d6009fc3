"""Grouped reductions of positions: centres of mass, gyration, vectors between atoms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import minimum_image, norm, square
from ..schema import BOX, XYZ
from .ranks import with_position


def center_of_mass(positions: DataFrame, by: Sequence[str] = ("frame",), mass: str | None = None) -> DataFrame:
    """Mean position of each group, weighted by ``mass`` if given."""
    if mass is None:
        return positions.groupBy(*by).agg(*(F.avg(c).alias(c) for c in XYZ))
    return positions.groupBy(*by).agg(*(F.try_divide(F.sum(F.col(mass) * F.col(c)), F.sum(mass)).alias(c) for c in XYZ))


def block_centers(positions: DataFrame, masses: Sequence[float]) -> DataFrame:
    """Centres of consecutive blocks of len(masses) atoms: frame, atom (the block's number), x, y, z, box."""
    k = len(masses)
    placed = with_position(positions.select("atom").distinct(), "atom", "place")
    rows = positions.join(placed, "atom").withColumn("w", F.get(F.array(*(F.lit(float(m)) for m in masses)), (F.col("place") % k).cast("int")))
    return rows.groupBy("frame", F.floor(F.col("place") / k).alias("atom")).agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in XYZ), *(F.first(b).alias(b) for b in BOX))


def gyration_radius(positions: DataFrame, atoms: DataFrame) -> DataFrame:
    """frame, residue_id, radius: mass-weighted, by nearest image to the residue's centre of mass; one shuffle by (frame, residue)."""
    rows = positions.join(atoms.select("atom", "residue_id", "mass"), "atom")
    group = Window.partitionBy("frame", "residue_id")
    rows = rows.withColumns({f"m{c}": F.sum(F.col("mass") * F.col(c)).over(group) / F.sum("mass").over(group) for c in XYZ})
    r2 = square(*(minimum_image(F.col(c) - F.col(f"m{c}"), F.col(b)) for c, b in zip(XYZ, BOX, strict=True)))
    return rows.groupBy("frame", "residue_id").agg(F.sqrt(F.sum(F.col("mass") * r2) / F.sum("mass")).alias("radius"))


def vectors(positions: DataFrame, pairs: DataFrame, normed: bool = False, box: bool = False) -> DataFrame:
    """Differences a - b for each pair: frame, pair, x, y, z.

    ``pairs`` has pair, side ('a' or 'b'), atom; several atoms of a side are averaged first.
    """
    held = positions.join(pairs, "atom").groupBy("frame", "pair")
    sides = held.agg(*(F.avg(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in "ab" for c in XYZ), *(F.first(b).alias(b) for b in BOX))
    boxes = dict(zip(XYZ, BOX, strict=True))
    raw = {c: F.col(f"a_{c}") - F.col(f"b_{c}") for c in XYZ}
    d = {c: minimum_image(e, F.col(boxes[c])) if box else e for c, e in raw.items()}
    out = sides.select("frame", "pair", *(e.alias(c) for c, e in d.items()))
    if normed:
        r = norm(*(F.col(c) for c in XYZ))
        out = out.withColumn("r", r).select("frame", "pair", *(F.try_divide(F.col(c), F.col("r")).alias(c) for c in XYZ))
    return out


def mean_frames(positions: DataFrame, n: int) -> DataFrame:
    """Mean of n consecutive frames from each frame on, for each atom; the last n - 1 frames have none."""
    order = Window.partitionBy("atom").orderBy("frame").rowsBetween(0, n - 1)
    held = positions.withColumns({f"_{c}": F.avg(c).over(order) for c in XYZ} | {"_n": F.count("*").over(order)}).where(F.col("_n") == n)
    return held.withColumns({c: F.col(f"_{c}") for c in XYZ}).select(*positions.columns)
