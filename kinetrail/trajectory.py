"""A lazy trajectory: positions, atoms, a slice of frames and a boundary mode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pbc
from .operators.select import AtomSubset
from .sources import TOPOLOGIES, TRAJECTORIES, one_path, read_ndx, reader_for

MODES = (None, "pbc", "whole", "nojump")


class UnknownMode(Exception):
    """A boundary mode that does not exist."""


@dataclass(frozen=True)
class Trajectory:
    """Slicing keeps absolute frame numbers and replaces an earlier slice; ``frames`` alone honours it."""

    raw: DataFrame
    selection: AtomSubset
    n_frames: int
    mode: str | None = None
    window: slice = slice(None)
    jump_table: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise UnknownMode(str(self.mode))

    def __len__(self) -> int:
        return self.n_frames

    def subset(self, **conditions) -> Trajectory:
        """The same trajectory, slice and mode for fewer atoms."""
        return replace(self, selection=self.selection.subset(**conditions))

    def with_mode(self, mode: str | None) -> Trajectory:
        return replace(self, mode=mode)

    @property
    def pbc(self) -> Trajectory:
        return self.with_mode("pbc")

    @property
    def whole(self) -> Trajectory:
        return self.with_mode("whole")

    @property
    def nojump(self) -> Trajectory:
        return self.with_mode("nojump")

    @property
    def positions(self) -> DataFrame:
        """Positions of the selected atoms in all frames, in this mode."""
        rows = self.selection.of(self.raw)
        if self.mode == "pbc":
            return pbc.into_box(rows)
        if self.mode == "whole":
            return pbc.whole(rows, self.selection.table)
        if self.mode == "nojump":
            return pbc.nojump(rows, self.jump_table)
        return rows

    def __getitem__(self, key: int | slice) -> DataFrame | Trajectory:
        if isinstance(key, slice):
            return replace(self, window=key)
        frame = key + self.n_frames if key < 0 else key
        if not 0 <= frame < self.n_frames:
            raise IndexError(key)
        # a running sum needs the frames before
        return self.positions.where(F.col("frame") == frame)

    @property
    def frame_range(self) -> range:
        return range(*self.window.indices(self.n_frames))

    @property
    def frames(self) -> DataFrame:
        """Positions of the slice's frames."""
        r = self.frame_range
        if not len(r):
            return self.positions.where(F.lit(False))
        low, high = min(r[0], r[-1]), max(r[0], r[-1])
        return self.positions.where(F.col("frame").between(low, high) & (F.pmod(F.col("frame") - low, F.lit(abs(r.step))) == 0))

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Trajectory:
        """The trajectory of mapped positions; slice and mode are kept, the mode is applied before ``f``."""
        return replace(self, raw=f(self.positions), mode=None)

    def filter(self, condition) -> Trajectory:
        return self.map(lambda rows: rows.where(condition))

    def times(self) -> DataFrame:
        return self.raw.select("frame", "time").distinct()

    def boxes(self) -> DataFrame:
        """frame, box diagonal, volume."""
        return self.raw.select("frame", "bx", "by", "bz").distinct().withColumn("volume", F.col("bx") * F.col("by") * F.col("bz"))

    def with_atoms(self) -> DataFrame:
        """Positions with their atoms' names, masses and charges."""
        return self.frames.join(self.selection.table, "atom")

    def cached(self) -> Trajectory:
        return replace(self, raw=self.raw.persist(StorageLevel.MEMORY_AND_DISK))

    def uncached(self) -> Trajectory:
        return replace(self, raw=self.raw.unpersist())


def open_trajectory(spark: SparkSession, directory: str, topology: str = "*.gro", trajectory: str = "*.parquet", index_file: str | None = None, cached: bool = False, nojump: bool = False) -> Trajectory:
    """The one topology and the one trajectory that the patterns match; FileNotFoundError otherwise."""
    top, path = one_path(spark, f"{directory}/{topology}"), one_path(spark, f"{directory}/{trajectory}")
    atoms, raw = reader_for(top, TOPOLOGIES)(spark, top), reader_for(path, TRAJECTORIES)(spark, path)
    groups = read_ndx(spark, one_path(spark, f"{directory}/{index_file}")) if index_file else None
    last = raw.agg(F.max("frame")).first()[0]
    out = Trajectory(raw, AtomSubset.all(atoms, groups), 0 if last is None else last + 1)
    if nojump:
        out = replace(out, jump_table=pbc.jumps(raw).persist(StorageLevel.MEMORY_AND_DISK))
    return out.cached() if cached else out
