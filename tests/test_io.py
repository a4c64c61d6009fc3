import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail import cache, ingest, sources, streaming
from kinetrail.operators import pbc
from kinetrail.schema import POSITIONS
from kinetrail.trajectory import Trajectory, UnknownMode, open_trajectory

GRO = """water
    3
    1SOL     OW    1   0.1   0.2   0.3
    1SOL    HW1    2   0.1   0.2   0.3
    2NA      NA    3   0.1   0.2   0.3
   1.0 1.0 1.0
"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("run")
    (top / "conf.gro").write_text(GRO)
    (top / "index.ndx").write_text("[ water ]\n1 2\n[ ion ]\n3\n")
    rows = [(f, float(f), a, 0.3 * f + 0.1 * a, 0.2, 0.3, 1.0, 1.0, 1.0) for f in range(8) for a in range(3)]
    pbc.into_box(spark.createDataFrame(rows, POSITIONS)).write.parquet(str(top / "traj.parquet"))
    return str(top)


def test_open_and_slice(spark, folder):
    t = open_trajectory(spark, folder, index_file="*.ndx", nojump=True)
    assert len(t) == 8 and t.selection.table.count() == 3
    assert {r.frame for r in t[3].collect()} == {3} and {r.frame for r in t[-1].collect()} == {7}
    part = t[2:7:2]
    assert sorted({r.frame for r in part.frames.collect()}) == [2, 4, 6] and len(part) == 8
    assert sorted({r.frame for r in part[::4].frames.collect()}) == [0, 4]  # a new slice replaces the old one
    assert part.subset(atom_name="OW").frames.count() == 3  # and a subset keeps it
    assert sorted({r.frame for r in t[5:1:-2].frames.collect()}) == [3, 5]
    assert t[8:].frames.count() == 0
    with pytest.raises(IndexError):
        t[8]
    assert t.selection.group("ion").first().atom == 2
    x = t.nojump.subset(atom_name="NA").frames.orderBy("frame").toPandas().x
    assert np.allclose(np.diff(x), 0.3)
    assert t.boxes().first().volume == 1.0 and t.times().count() == 8
    assert t.map(lambda rows: rows.withColumn("x", F.lit(0.0)))[1:3].frames.agg(F.sum("x")).first()[0] == 0
    assert t.filter("frame > 3").frames.count() == 12 and t.pbc.whole.mode == "whole"
    held = t.cached()
    assert held.raw.storageLevel.useMemory
    held.uncached()
    with pytest.raises(UnknownMode):
        t.with_mode("other")


def test_missing_inputs(spark, folder):
    with pytest.raises(FileNotFoundError):
        open_trajectory(spark, folder, topology="*.none")
    with pytest.raises(FileNotFoundError):
        sources.read_energy(spark, folder + "/none*")
    with pytest.raises(sources.NoReaderAvailable):
        sources.reader_for("a.xyz", sources.TOPOLOGIES)


def test_result_cache(spark, folder, tmp_path):
    calls = []

    @cache.cached_result(1)
    def mean(rows, window=0.1, skip=0.1):
        calls.append((window, skip))
        return rows.agg(F.avg("x").alias("m"))

    rows = spark.read.parquet(folder + "/traj.parquet")
    mean(rows)
    cache.enable(str(tmp_path))
    try:
        a = mean(rows, window=0.2, description="first try").first().m
        assert mean(rows, window=0.2, description="first try").first().m == a and len(calls) == 2
        mean(rows, skip=0.2)
        mean(rows, window=0.2, skip=0.1, autoload=False)
        assert len(calls) == 4
        with cache.disabled():
            mean(rows)
        assert len(calls) == 5 and cache._state["folder"]
    finally:
        cache.disable()
    with cache.disabled():
        pass
    assert cache._state["folder"] is None


def test_checksum():
    assert cache.checksum(1) == cache.checksum(1) != cache.checksum(1, salt="other")
    assert cache.checksum(b"42") == cache.checksum("42") == cache.checksum(42)
    assert cache.checksum(np.array([1, 2, 3])) == cache.checksum(np.array([1, 2, 3]).tobytes())

    @cache.version(1)
    def f():
        return 1

    a = cache.checksum(f)

    @cache.version(1)
    def f():  # noqa: F811
        return 2

    b = cache.checksum(f)

    @cache.version(2)
    def f():  # noqa: F811
        return 2

    assert a == b != cache.checksum(f)
    assert cache.strip_comments("# a\nx = 1  # b\n") == "x = 1"


def test_jump_tables_belong_to_a_trajectory(spark, folder, tmp_path):
    rows = spark.read.parquet(folder + "/traj.parquet")
    held = cache.save_jumps(rows, str(tmp_path / "j"), "one")
    assert held.count() == pbc.jumps(rows).count() > 0
    with pytest.raises(ValueError):
        cache.load_jumps(spark, str(tmp_path / "j"), "two")


def test_ingest(spark, folder, tmp_path):
    ingest.main([folder + "/traj.parquet", str(tmp_path), "--nojump"])
    assert spark.read.parquet(f"{tmp_path}/positions.parquet").count() == 24
    assert spark.read.parquet(f"{tmp_path}/jumps.parquet").count() > 0


def test_streamed_histogram(spark, folder, tmp_path):
    stream = spark.readStream.schema(POSITIONS).parquet(folder + "/traj.parquet*")
    q = streaming.running_histogram(stream, F.col("x"), [0.0, 0.5, 1.0]).writeStream.outputMode("complete").format("memory").queryName("h").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM h").first()[0] == 24


def test_lazy_modes(spark, folder):
    t = open_trajectory(spark, folder)
    assert isinstance(t, Trajectory) and t.pbc.positions.count() == t.positions.count()
    assert t.with_atoms().select("atom_name").distinct().count() == 3
