"""Inputs: Parquet trajectories, text topologies and index files, energy series, and the adapters of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ATOMS, INDEX_GROUPS

#: Frames and box of the trajectory that the embeddings are read as.
N_FRAMES, BOX_LENGTH = 21, 1.0


class NoReaderAvailable(Exception):
    """No source is registered for a file's extension."""


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern matches, in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def one_path(spark: SparkSession, pattern: str) -> str:
    found = _matches(spark, pattern)
    if len(found) != 1:
        raise FileNotFoundError(f"{pattern} matches {len(found)} paths")
    return found[0]


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """The atoms of a fixed-width coordinate file: columns of 5 for residue id, residue name, atom name; two lines before, one after."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("n", "line"))
    last = Window.partitionBy(F.lit(0))
    lines = lines.withColumn("last", F.max("n").over(last)).where("n >= 2 AND n < last")
    field = lambda k: F.trim(F.substring("line", 1 + 5 * k, 5))
    return lines.select((F.col("n") - 2).cast("long").alias("atom"), field(0).cast("int").alias("residue_id"), field(1).alias("residue_name"), field(2).alias("atom_name"), F.lit(None).cast("double").alias("mass"), F.lit(None).cast("double").alias("charge"))


def read_ndx(spark: SparkSession, path: str) -> DataFrame:
    """Named index groups: a line [ name ], then 1-based atom numbers; 0-based here."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", r"\["), 2, 2**30)).alias("part"))
    parts = lines.select(F.trim(F.element_at(F.split("part", r"\]"), 1)).alias("group"), F.explode(F.split(F.trim(F.element_at(F.split("part", r"\]"), 2)), r"\s+")).alias("number"))
    return parts.where(F.col("number") != "").select("group", (F.col("number").cast("long") - 1).alias("atom"))


def read_gro_frames(spark: SparkSession, path: str) -> DataFrame:
    """Positions of fixed-width coordinate files, one frame a file in the order of their names; coordinates in columns of 8, the box's diagonal in the last line.

    A title that ends in ``t= number`` gives the time, else it is the frame's number.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n").alias("lines"))
    # the names of the files, one row each
    names = files.select("file").withColumn("frame", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file")) - 1)
    held = files.join(names, "file")
    box = F.split(F.trim(F.element_at("lines", -1)), r"\s+")
    time = F.coalesce(F.regexp_extract(F.get("lines", F.lit(0)), r"t=\s*([-+0-9.eE]+)", 1).try_cast("double"), F.col("frame").cast("double"))
    rows = held.select("frame", time.alias("time"), box.alias("b"), F.posexplode(F.slice("lines", 3, F.size("lines") - 3)).alias("n", "line"))
    part = lambda k: F.trim(F.substring("line", 21 + 8 * k, 8)).cast("double")
    return rows.select("frame", "time", F.col("n").cast("long").alias("atom"), part(0).alias("x"), part(1).alias("y"), part(2).alias("z"), *(F.get("b", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("bx", "by", "bz"))))


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Readers of topologies and trajectories by extension; others can be registered.
TOPOLOGIES = {"gro": read_gro, "parquet": _parquet}
TRAJECTORIES = {"parquet": _parquet, "gro": read_gro_frames}


def reader_for(path: str, registry: dict):
    kind = path.rstrip("/").rpartition(".")[2]
    if kind not in registry:
        raise NoReaderAvailable(kind)
    return registry[kind]


def read_energy(spark: SparkSession, pattern: str) -> DataFrame:
    """time, type, unit, value of the first path that matches."""
    found = _matches(spark, pattern)
    if not found:
        raise FileNotFoundError(pattern)
    return spark.read.parquet(found[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a trajectory: frame f holds components 3f to 3f + 2, the vector is the atom, the box is a unit cube."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(N_FRAMES - 1))).alias("frame"))
    part = lambda k: F.get("embedding", F.col("frame") * 3 + k).cast("double")
    box = F.lit(BOX_LENGTH)
    return rows.select("frame", F.col("frame").cast("double").alias("time"), F.col("vec_id").alias("atom"), part(0).alias("x"), part(1).alias("y"), part(2).alias("z"), box.alias("bx"), box.alias("by"), box.alias("bz"))


def _by_id(values: list, column: str = "vec_id") -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col(column) % len(values)).cast("int"))


ATOM_NAMES, MASSES, CHARGES, RESIDUES = ("OW", "HW1", "HW2"), (16.0, 1.0, 1.0), (-0.8, 0.4, 0.4), ("SOL", "NA", "CL")


def embedding_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their atoms: names, masses and charges by vec_id modulo 3, residues by label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("atom"), F.col("label").alias("residue_id"), _by_id(list(RESIDUES), "label").alias("residue_name"), _by_id(list(ATOM_NAMES)).alias("atom_name"), _by_id(list(MASSES)).alias("mass"), _by_id(list(CHARGES)).alias("charge"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, frame (the place of an event in its user's order), t (seconds since the epoch), value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "value", "event_type", "event_id")


__all__ = ["ATOMS", "INDEX_GROUPS", "N_FRAMES", "NoReaderAvailable", "embedding_atoms", "embedding_positions", "event_series", "one_path", "read_energy", "read_gro", "read_gro_frames", "read_ndx", "reader_for", "table"]
