import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import positions

from kinetrail.operators import correlation, custom
from kinetrail.sources import read_gro_frames


@pytest.fixture(scope="module")
def held(spark):
    rng = np.random.default_rng(6)
    return positions(spark, [(f, a, *rng.random(3)) for f in range(8) for a in range(5)]).cache()


def test_custom_kernel_equals_the_column_kernel(spark, held):
    plan = correlation.plan_lags(8, segments=2)
    want = correlation.shifted_correlation(held, correlation.msd(), plan).orderBy("onset", "lag").toPandas()
    got = custom.correlation_of(held, lambda a, b: ((a[["x", "y", "z"]].to_numpy() - b[["x", "y", "z"]].to_numpy()) ** 2).sum(axis=1).mean(), plan).orderBy("onset", "lag").toPandas()
    assert np.allclose(got.value, want.value) and (got.onset == want.onset).all()
    assert custom.correlation_of(held, lambda a, b: 1.0, plan, average=True).agg(F.max("value")).first()[0] == 1.0


def test_custom_time_average(spark, held):
    got = custom.time_average_of(held, lambda frame: [frame.x.mean(), len(frame)]).orderBy("place").toPandas()
    assert np.allclose(got.value, [held.agg(F.avg("x")).first()[0], 5])
    assert custom.time_average_of(held, lambda frame: [1.0], frames=16).first().value == 0.5


def test_two_trajectories_side_by_side(spark, held):
    got = custom.zip_frames(held, held.withColumn("x", F.col("x") + 1))
    assert got.count() == 40 and got.where(F.abs(F.col("x_b") - F.col("x") - 1) > 1e-12).count() == 0


def test_coordinate_files_are_frames(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}.gro").write_text(f"water t= {k * 0.5}\n    2\n    1SOL     OW    1   0.1{k}0   0.200   0.300\n    1SOL    HW1    2   1.000   2.000  -3.000\n   1.0 2.0 3.0\n")
    got = read_gro_frames(spark, str(tmp_path / "*.gro")).orderBy("frame", "atom").collect()
    assert [(r.frame, r.time, r.atom) for r in got] == [(0, 0.0, 0), (0, 0.0, 1), (1, 0.5, 0), (1, 0.5, 1)]
    assert (got[2].x, got[3].z, got[3].by) == (0.11, -3.0, 2.0)
