"""Periodic boundaries: differences, images, unwrapping and whole molecules."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import minimum_image, norm, square, wrap, wrapped_difference
from ..schema import BOX, XYZ

#: The 27 images, the original first.
OFFSETS = sorted(product((-1, 0, 1), repeat=3), key=lambda o: (o != (0, 0, 0), o))


def difference(v1: Sequence[Column], v2: Sequence[Column] | None = None, box: Sequence[Column | float] | Sequence[Sequence[float]] | None = None) -> tuple[Column, ...]:
    """v1 - v2 without a box, by nearest image in a rectangular one, or in a triclinic one given as a matrix; v1 itself without v2."""
    d = [a if v2 is None else a - b for a, b in zip(v1, v2 or v1, strict=True)]
    if box is None:
        return tuple(d)
    if isinstance(box[0], Sequence) and not isinstance(box[0], str):
        return triclinic(d, box)
    if len(box) != len(d):
        raise NotImplementedError("a box is a diagonal or a matrix")
    return tuple(minimum_image(x, b) for x, b in zip(d, box, strict=True))


def triclinic(d: Sequence[Column], box: Sequence[Sequence[float]]) -> tuple[Column, ...]:
    """Nearest image by the rows z, y, x of a lower triangular box matrix, in that order."""
    held = list(d)
    for k in (2, 1, 0):
        n = F.rint(held[k] / float(box[k][k]))
        held = [x - n * float(box[k][j]) if box[k][j] else x for j, x in enumerate(held)]
    return tuple(held)


def distance(v1: Sequence[Column], v2: Sequence[Column] | None = None, box: Sequence[Column | float] | None = None) -> Column:
    return norm(*difference(v1, v2, box))


def difference_wrapped(v1: Sequence[Column], v2: Sequence[Column], box: Sequence[Column | float]) -> tuple[Column, ...]:
    """The older formula: wrap both, then move by one box where beyond half."""
    return tuple(wrapped_difference(a, b, x) for a, b, x in zip(v1, v2, box, strict=True))


def into_box(positions: DataFrame) -> DataFrame:
    """Mode ``pbc``: coordinates modulo the box."""
    return positions.withColumns({c: wrap(F.col(c), F.col(b)) for c, b in zip(XYZ, BOX, strict=True)})


def images(positions: DataFrame, thickness: float = 0.0, inclusive: bool = True, center: Sequence[float] | None = None) -> DataFrame:
    """Each position and its 26 images (ix, iy, iz), the original atom's id kept.

    With a thickness, those strictly inside center +- (box / 2 + thickness).
    Without ``inclusive``, the images alone.
    """
    offsets = F.array(*(F.struct(*(F.lit(o).alias(n) for o, n in zip(off, ("ix", "iy", "iz"), strict=True))) for off in OFFSETS))
    out = positions.withColumn("o", F.explode(offsets)).select(*positions.columns, "o.*")
    out = out.withColumns({c: F.col(c) + F.col(f"i{c}") * F.col(b) for c, b in zip(XYZ, BOX, strict=True)})
    if thickness != 0:
        for k, (c, b) in enumerate(zip(XYZ, BOX, strict=True)):
            middle = F.col(b) / 2 if center is None else F.lit(float(center[k]))
            out = out.where((F.col(c) < middle + F.col(b) / 2 + thickness) & (F.col(c) > middle - F.col(b) / 2 - thickness))
    return out if inclusive else out.where("ix <> 0 OR iy <> 0 OR iz <> 0")


def nearest_images(query: DataFrame, reference: DataFrame, n: int = 1) -> DataFrame:
    """frame, atom, rank, neighbor, d: the n nearest among all images of the reference atoms."""
    from .pairs import nearest_pairs

    ties = ("atom", "ix", "iy", "iz")
    pairs = nearest_pairs(query, images(reference), n, False, ("frame",), ties, (("atom",), ties))
    order = Window.partitionBy("frame", F.col("a.atom")).orderBy("d", F.col("b.atom"), F.col("b.ix"), F.col("b.iy"), F.col("b.iz"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("frame", F.col("a.atom").alias("atom"), "rank", F.col("b.atom").alias("neighbor"), "d")


def backfold_rect(positions: DataFrame) -> DataFrame:
    """Fold into the box around its centre."""
    return positions.withColumns({c: F.col(b) / 2 + minimum_image(F.col(c) - F.col(b) / 2, F.col(b)) for c, b in zip(XYZ, BOX, strict=True)})


def backfold_compact(positions: DataFrame, box: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """The image nearest to the box centre, for a box matrix or the rectangular box; ties to the first image.

    The 27 images are compared in place, without a join or a shuffle.
    """
    def row(k: int, j: int) -> Column:
        return (F.col(BOX[k]) if k == j else F.lit(0.0)) if box is None else F.lit(float(box[k][j]))

    centre = [sum((row(k, j) for k in (1, 2)), row(0, j)) / 2 for j in range(3)]
    found = []
    for number, off in enumerate(OFFSETS):
        at = [sum((row(k, j) * float(off[k]) for k in range(3) if off[k]), F.col(c)) for j, c in enumerate(XYZ)]
        d = square(*(a - m for a, m in zip(at, centre, strict=True)))
        found.append(F.struct(d.alias("d"), F.lit(number).alias("k"), *(a.alias(c) for a, c in zip(at, XYZ, strict=True))))
    return positions.withColumn("_best", F.array_min(F.array(*found))).withColumns({c: F.col(f"_best.{c}") for c in XYZ}).drop("_best")


def jumps(positions: DataFrame, first_whole: DataFrame | None = None) -> DataFrame:
    """frame, atom, jx, jy, jz: crossings of the boundary since the frame before, rows that are not all zero.

    Boxes are the first frame's. Frame 0 is compared with its own whole molecules if they are given.
    """
    order = Window.partitionBy("atom").orderBy("frame")
    first = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = positions
    if first_whole is not None:
        held = first_whole.select("frame", "atom", *(F.col(c).alias(f"w{c}") for c in XYZ))
        rows = rows.join(held, ["frame", "atom"], "left")
    found = {}
    for c, b in zip(XYZ, BOX, strict=True):
        step = F.rint((F.col(c) - F.lag(c).over(order)) / F.first(b).over(first))
        start = F.lit(0.0) if first_whole is None else F.coalesce(F.rint((F.col(c) - F.col(f"w{c}")) / F.col(b)), F.lit(0.0))
        found[f"j{c}"] = F.when(F.lag(c).over(order).isNull(), start).otherwise(step).cast("int")
    return rows.withColumns(found).select("frame", "atom", *found).where("jx <> 0 OR jy <> 0 OR jz <> 0")


def nojump(positions: DataFrame, jump_table: DataFrame | None = None) -> DataFrame:
    """Mode ``nojump``: coordinates less the boxes crossed so far, by one shuffle and sort of an atom's frames; a join only with a stored jump table."""
    order = Window.partitionBy("atom").orderBy("frame")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if jump_table is None:
        # the first frame has no step; the box is the first frame's
        steps = {f"j{c}": F.coalesce(F.rint((F.col(c) - F.lag(c).over(order)) / F.first(b).over(so_far)), F.lit(0.0)) for c, b in zip(XYZ, BOX, strict=True)}
        rows = positions.withColumns(steps)
    else:
        rows = positions.join(jump_table, ["frame", "atom"], "left").na.fill(0, ["jx", "jy", "jz"])
    return rows.withColumns({c: F.col(c) - F.col(b) * F.sum(f"j{c}").over(so_far) for c, b in zip(XYZ, BOX, strict=True)}).select(*positions.columns)


def whole(positions: DataFrame, atoms: DataFrame, mode: str = "com") -> DataFrame:
    """Mode ``whole``: residues made contiguous by one box where an atom is over 0.9 half boxes from its residue's reference.

    The reference is the centre of mass (``com``) or the first atom (``simple``). With ``com`` a residue of two
    atoms is corrected in its first, third, ... place of the whole selection only.
    """
    if mode not in ("com", "simple"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = positions.join(atoms.select("atom", "residue_id", "mass"), "atom")
    group = Window.partitionBy("frame", "residue_id")
    if mode == "com":
        centre = {c: F.sum(F.col("mass") * F.col(c)).over(group) / F.sum("mass").over(group) for c in XYZ}
    else:
        centre = {c: F.min_by(c, "atom").over(group) for c in XYZ}
    rows = rows.withColumns({f"m{c}": e for c, e in centre.items()} | {"size": F.count("*").over(group)})
    free = F.lit(True)
    if mode == "com":
        from .ranks import with_position

        places = with_position(positions.select("atom").distinct(), "atom", "place")
        rows = rows.join(places, "atom")
        free = ~((F.col("size") == 2) & (F.col("place") % 2 == 1))
    moved = {}
    for c, b in zip(XYZ, BOX, strict=True):
        d, half = F.col(c) - F.col(f"m{c}"), F.col(b) / 2 * 0.9
        moved[c] = F.when(free & (d > half), F.col(c) - F.col(b)).when(free & (d < -half), F.col(c) + F.col(b)).otherwise(F.col(c))
    return rows.withColumns(moved).select(*positions.columns)
