"""Atom selection by predicates over the atoms table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norm
from .ranks import with_position


class AtomMismatch(Exception):
    """Two selections are over different atoms tables."""


def matches(column: Column | str, expression: str) -> Column:
    """Regular expression match from the start; an end anchor is appended unless there is one, so it binds to the last alternative only."""
    expression = expression if expression.endswith("$") else expression + "$"
    return (F.col(column) if isinstance(column, str) else column).rlike(f"^(?:{expression})")


@dataclass(frozen=True)
class AtomSubset:
    """A lazy selection: a predicate over ``atoms`` and a description; closed under & | ~."""

    atoms: DataFrame
    predicate: Column
    description: str = ""
    groups: DataFrame | None = None

    @classmethod
    def all(cls, atoms: DataFrame, groups: DataFrame | None = None) -> AtomSubset:
        return cls(atoms, F.lit(True), "", groups)

    def subset(self, atom_name: str | None = None, residue_name: str | None = None, residue_id: int | Iterable[int] | None = None, indices: Sequence[int] | None = None) -> AtomSubset:
        """All given conditions at once; ``indices`` are atom ids."""
        p, said = self.predicate, [self.description] if self.description else []
        if atom_name is not None:
            p, said = p & matches("atom_name", atom_name), [*said, atom_name]
        if residue_name is not None:
            p, said = p & matches("residue_name", residue_name), [*said, residue_name]
        if residue_id is not None:
            ids = [residue_id] if isinstance(residue_id, int) else [int(x) for x in residue_id]
            p, said = p & F.col("residue_id").isin(ids), [*said, "resid"]
        if indices is not None:
            p, said = p & F.col("atom").isin([int(x) for x in indices]), [*said, "indices"]
        return AtomSubset(self.atoms, p, "_".join(said), self.groups)

    def __checksum__(self) -> str:
        """By the plan of the selected rows: source, predicate and all."""
        return f"{self.description}:{self.table.semanticHash()}"

    def _same(self, other: AtomSubset) -> None:
        if not self.atoms.sameSemantics(other.atoms):
            raise AtomMismatch("selections are over different atoms")

    def __and__(self, other: AtomSubset) -> AtomSubset:
        self._same(other)
        return AtomSubset(self.atoms, self.predicate & other.predicate, "_".join(x for x in (self.description, other.description) if x), self.groups)

    def __or__(self, other: AtomSubset) -> AtomSubset:
        self._same(other)
        return AtomSubset(self.atoms, self.predicate | other.predicate, "_".join(x for x in (self.description, other.description) if x), self.groups)

    def __invert__(self) -> AtomSubset:
        return AtomSubset(self.atoms, ~F.coalesce(self.predicate, F.lit(False)), f"not_{self.description}", self.groups)

    @property
    def table(self) -> DataFrame:
        return self.atoms.where(self.predicate)

    @property
    def atom_names(self) -> DataFrame:
        return self.table.select("atom", "atom_name")

    @property
    def residue_names(self) -> DataFrame:
        return self.table.select("atom", "residue_name")

    @property
    def residue_ids(self) -> DataFrame:
        return self.table.select("atom", "residue_id")

    @property
    def indices(self) -> DataFrame:
        return self.table.select("atom")

    def summary(self) -> DataFrame:
        """Atoms by residue and atom name."""
        return self.table.groupBy("residue_name", "atom_name").agg(F.count("*").alias("n"))

    def group(self, name: str) -> DataFrame:
        """Rows of this selection that a named index group holds."""
        if self.groups is None:
            raise KeyError(name)
        return self.table.join(self.groups.where(F.col("group") == name), "atom", "left_semi")

    def positions(self, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
        """Atoms by place within the selection, in atom order."""
        placed = with_position(self.table, "atom")
        first = start or 0
        keep = (F.col("position") >= first) & (F.pmod(F.col("position") - first, F.lit(step)) == 0)
        return placed.where(keep if stop is None else keep & (F.col("position") < stop)).drop("position")

    def pick(self, places: Sequence[int]) -> DataFrame:
        """Atoms at given places within the selection."""
        return with_position(self.table, "atom").where(F.col("position").isin([int(x) for x in places])).drop("position")

    def of(self, positions: DataFrame) -> DataFrame:
        """The positions of the selected atoms."""
        return positions.join(self.indices, "atom", "left_semi")


def spatial_selector(value: Column, rmin: float, rmax: float) -> Column:
    return value.between(rmin, rmax)


def radial_selector(positions: DataFrame, other: DataFrame, rmin: float, rmax: float) -> DataFrame:
    """Positions whose atom has, in another trajectory at the same frame, a cylindrical radius in [rmin, rmax]."""
    inside = other.where(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).between(rmin, rmax)).select("frame", "atom")
    return positions.join(inside, ["frame", "atom"], "left_semi")


def layer(thickness: float, plane_offset: Sequence[float] = (0, 0, 0), plane_normal: Sequence[float] = (1, 0, 0)) -> Column:
    """Whether a position's distance along the normal, as given, is at most the thickness."""
    d = sum(((F.col(c) - float(o)) * float(n) for c, o, n in zip("yz", plane_offset[1:], plane_normal[1:], strict=True)), (F.col("x") - float(plane_offset[0])) * float(plane_normal[0]))
    return F.abs(d) <= thickness


def true_indices(mask: Column) -> Column:
    """Places of the true values of a boolean array."""
    return F.filter(F.transform(mask, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())


__all__ = ["AtomMismatch", "AtomSubset", "layer", "matches", "norm", "radial_selector", "spatial_selector", "true_indices"]
