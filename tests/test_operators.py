import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrail import functions as fx
from kinetrail.operators import aggregate, correlation, distribution, hist, joins, pbc, select, series
from kinetrail.operators.ranks import with_position
from kinetrail.operators.select import AtomMismatch, AtomSubset
from kinetrail.schema import ATOMS, POSITIONS


def positions(spark, rows, box=1.0):
    """rows: (frame, atom, x, y, z)."""
    return spark.createDataFrame([(f, float(f), a, float(x), float(y), float(z), box, box, box) for f, a, x, y, z in rows], POSITIONS)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def atoms(spark, rows):
    return spark.createDataFrame(rows, ATOMS)


WATER = [(0, 1, "SOL", "OW", 16.0, 0.0), (1, 1, "SOL", "HW1", 1.0, 0.0), (2, 1, "SOL", "HW2", 1.0, 0.0), (3, 2, "NA", "NA1", 23.0, 1.0), (4, 3, "NA", "NA12", 23.0, 1.0)]


@given(st.integers(0, 50), st.integers(2, 500), st.integers(1, 100))
def test_log_indices_are_distinct_and_inside(first, length, num):
    got = correlation.log_indices(first, first + length, num)
    assert (np.diff(got) > 0).all() and got[0] == first and got[-1] <= first + length


@given(st.integers(4, 400), st.integers(1, 12), st.floats(0.1, 0.6), st.floats(0, 0.35))
def test_lag_plans_stay_inside_the_trajectory(n, segments, window, skip):
    plan = correlation.plan_lags(n, segments, window, skip)
    assert 0 <= min(plan.frames) and max(plan.frames) < n + 1
    assert len(plan.pairs) == len(plan.onsets) * len(plan.lags)


def test_lag_plan_needs_room():
    with pytest.raises(ValueError):
        correlation.plan_lags(10, window=0.7, skip=0.4)


def test_ballistic_motion(spark):
    v = {0: 0.5, 1: 1.0, 2: 2.0}
    held = positions(spark, [(f, a, v[a] * f, 0, 0) for f in range(12) for a in v])
    plan = correlation.plan_lags(12, segments=3)
    got = correlation.shifted_correlation(held, correlation.msd(), plan, average=True).collect()
    mean = np.mean([x * x for x in v.values()])
    assert all(math.isclose(r.value, mean * r.lag**2, abs_tol=1e-9) for r in got)


def test_static_atoms(spark):
    held = positions(spark, [(f, a, 0.3 * a, 0.1, 0) for f in range(8) for a in range(4)])
    plan = correlation.plan_lags(8, segments=2)
    assert {r.value for r in correlation.shifted_correlation(held, correlation.isf(3.0), plan).collect()} == {1.0}
    assert {r.value for r in correlation.overlap(held, plan, 0.1).collect()} == {1.0}
    # no motion: a quotient of zeros, a null
    assert all(r.value is None for r in correlation.shifted_correlation(held, correlation.non_gaussian(), plan).collect())


def test_atoms_that_lack_frames_give_the_pairs_they_have(spark):
    held = positions(spark, [(f, a, f, 0, 0) for f in range(6) for a in range(3) if not (a == 2 and f == 3)])
    plan = correlation.LagPlan((0, 2), (0, 1))
    got = {(r.onset, r.lag): r.n for r in correlation.lag_pairs(held, plan).groupBy("onset", "lag").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 0): 3, (0, 1): 3, (2, 0): 3, (2, 1): 2}


def test_empty_selection_counts_zero(spark):
    held = positions(spark, [(f, 0, 0.1, 0, 0) for f in range(4)])
    plan = correlation.LagPlan((0, 1), (0, 1))
    chosen = F.filter(F.array(F.when(F.col("a.x") > 5, F.lit(0)), F.lit(1)), lambda k: k.isNotNull())
    got = {(r.lag, r.sel_id): (r.value, r["count"]) for r in correlation.multi_subensemble(held, correlation.msd(), plan, chosen, 2).collect()}
    assert got[(0, 0)] == (0.0, 0.0) and got[(1, 1)] == (0.0, 1.0)


def test_half_a_box_goes_to_the_even_multiple(spark):
    row = one(spark, a=fx.minimum_image(F.lit(0.5), 1.0), b=fx.minimum_image(F.lit(1.5), 1.0), c=fx.minimum_image(F.lit(-0.5), 1.0))
    assert (row.a, row.b, row.c) == (0.5, -0.5, -0.5)


def test_distances_in_a_unit_box(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((10, 3)), rng.random((10, 3))
    df = spark.createDataFrame(pd.DataFrame(np.hstack((a, b)), columns=["ax", "ay", "az", "bx", "by", "bz"]))
    v1, v2 = [F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"]
    got = df.select(pbc.distance(v1, v2, [1.0] * 3).alias("d"), pbc.distance(v1, v1, [1.0] * 3).alias("s"), fx.norm(*pbc.difference_wrapped(v1, v2, [1.0] * 3)).alias("w")).toPandas()
    assert (got.d <= math.sqrt(3) / 2 + 1e-12).all() and (got.s == 0).all()
    assert np.allclose(got.d, got.w)
    want = np.sqrt((((a - b) - np.rint(a - b)) ** 2).sum(axis=1))
    assert np.allclose(sorted(got.d), sorted(want))
    with pytest.raises(NotImplementedError):
        pbc.difference(v1, v2, [1.0])


def test_triclinic_equals_rectangular_for_a_diagonal_box(spark):
    df = spark.createDataFrame([(1.7, -2.2, 0.4), (0.5, 1.5, -3.3)], "x double, y double, z double")
    v = [F.col(c) for c in "xyz"]
    t, r = pbc.difference(v, None, ((1.0, 0, 0), (0, 2.0, 0), (0, 0, 3.0))), pbc.difference(v, None, [1.0, 2.0, 3.0])
    got = df.select(*(e.alias(f"t{k}") for k, e in enumerate(t)), *(e.alias(f"r{k}") for k, e in enumerate(r))).toPandas()
    assert np.allclose(got[["t0", "t1", "t2"]], got[["r0", "r1", "r2"]])


def test_nojump_restores_a_straight_line(spark):
    held = pbc.into_box(positions(spark, [(f, a, 0.3 * f + 0.1 * a, 0.05 * f, -0.2 * f) for f in range(20) for a in range(2)]))
    got = pbc.nojump(held).toPandas().sort_values(["atom", "frame"])
    for a in (0, 1):
        x = got[got.atom == a]
        assert np.allclose(np.diff(x.x), 0.3) and np.allclose(np.diff(x.z), -0.2)
    stored = pbc.jumps(held)
    assert stored.count() < held.count()
    assert np.allclose(pbc.nojump(held, stored).toPandas().sort_values(["atom", "frame"]).x, got.x)


def test_whole_joins_a_split_molecule(spark):
    held = positions(spark, [(0, 0, 0.95, 0.5, 0.5), (0, 1, 0.02, 0.5, 0.5), (0, 2, 0.97, 0.5, 0.5), (0, 3, 0.1, 0.1, 0.1), (0, 4, 0.9, 0.1, 0.1)])
    for mode in ("com", "simple"):
        got = pbc.whole(held, atoms(spark, WATER), mode).toPandas().set_index("atom")
        assert got.x[0:3].max() - got.x[0:3].min() < 0.2
        assert got.x[3] == 0.1 and got.x[4] == 0.9
    with pytest.raises(ValueError):
        pbc.whole(held, atoms(spark, WATER), "other")


def test_images(spark):
    held = positions(spark, [(0, 0, 0.1, 0.5, 0.5)])
    assert pbc.images(held).count() == 27
    assert pbc.images(held, inclusive=False).count() == 26
    near = pbc.images(held, thickness=0.2).collect()
    assert sorted((r.ix, r.iy, r.iz) for r in near) == [(0, 0, 0), (1, 0, 0)]
    assert pbc.nearest_images(held, positions(spark, [(0, 7, 0.95, 0.5, 0.5)])).first().d == pytest.approx(0.15)


def test_selection(spark):
    every = AtomSubset.all(atoms(spark, WATER), spark.createDataFrame([("g", 0), ("g", 3)], "group string, atom long"))
    ids = lambda s: sorted(r.atom for r in s.select("atom").collect())
    assert ids(every.subset(atom_name="NA.|OW").table) == [0, 3, 4]  # only the last alternative is anchored
    assert ids(every.subset(atom_name="NA.").table) == [3]
    assert ids(every.subset(residue_id=[1, 3], indices=[0, 1, 4]).table) == [0, 1, 4]
    a, b = every.subset(residue_name="SOL"), every.subset(atom_name="OW")
    assert ids((a & ~b).table) == [1, 2] and ids((b | every.subset(residue_id=2)).table) == [0, 3]
    assert ids(every.group("g")) == [0, 3] and ids(a.group("g")) == [0] and every.group("none").count() == 0
    assert ids(a.positions(1)) == [1, 2] and ids(a.pick([2])) == [2]
    assert every.summary().count() == 5 and (a & b).description == "SOL_OW"
    with pytest.raises(AtomMismatch):
        a & AtomSubset.all(atoms(spark, WATER[:2]))
    with pytest.raises(KeyError):
        AtomSubset.all(atoms(spark, WATER)).group("g")


def test_positions_in_order_over_chunks(spark):
    df = spark.createDataFrame([(k * 40_000,) for k in range(50)], "atom long").orderBy(F.rand(3))
    assert {(r.atom // 40_000) == r.position for r in with_position(df, "atom").collect()} == {True}


@pytest.mark.parametrize("edges", [np.linspace(0, 1, 50), np.linspace(0.3, 1.5, 50), np.array([0.1, 0.2, 0.5, 0.9])])
def test_bins_equal_numpy(spark, edges):
    rng = np.random.default_rng(2)
    data = np.concatenate((rng.random(300), edges, [edges[0] - 1e-9, edges[-1] + 1e-9]))
    df = spark.createDataFrame(pd.DataFrame({"d": data}))
    got = hist.histogram(df, F.col("d"), edges.tolist(), rule="edges").orderBy("bin").toPandas()
    assert (got.n.to_numpy() == np.histogram(data, edges)[0]).all()


def test_fast_bins_leave_the_right_edge_out(spark):
    edges = np.linspace(0, 1, 11).tolist()
    data = [*(k * 0.1 for k in range(11)), 0.55]
    df = spark.createDataFrame([(x,) for x in data], "d double")
    got = hist.histogram(df, F.col("d"), edges).orderBy("bin").toPandas().n.to_numpy()
    dx = np.diff(edges).mean()
    assert (got == np.bincount((np.array(data) // dx).astype(int), minlength=10)[:10]).all()
    with pytest.raises(Exception, match="negative"):
        hist.histogram(spark.createDataFrame([(-0.5,)], "d double"), F.col("d"), edges).collect()


def test_pairs_by_cells_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    held = positions(spark, [(f, a, *rng.random(3)) for f in range(2) for a in range(60)])
    brute = joins.frame_pairs(held).withColumn("d", joins.distance()).where("d <= 0.24")
    cells = joins.cell_list_pairs(held, 0.24, (1.0, 1.0, 1.0))
    key = lambda df: sorted((r.frame, r.a.atom, r.b.atom, round(r.d, 12)) for r in df.collect())
    assert key(brute) == key(cells)
    assert key(joins.cell_list_pairs(held, 0.4, (1.0, 1.0, 1.0))) == key(joins.frame_pairs(held).withColumn("d", joins.distance()).where("d <= 0.4"))


def test_within_equals_minimum(spark):
    rng = np.random.default_rng(4)
    a, b = positions(spark, [(0, k, *rng.random(3)) for k in range(50)]), positions(spark, [(0, k, *rng.random(3)) for k in range(30)])
    want = {r.atom for r in joins.min_distance(a, b, box=False).where("d <= 0.2").collect()}
    assert {r.atom for r in joins.within(a, b, 0.2).collect()} == want


def test_nearest_breaks_ties_by_atom(spark):
    ring = [(0, 0, 0, 0, 0), (0, 1, 1, 0, 0), (0, 2, -1, 0, 0), (0, 3, 0, 1, 0)]
    held = positions(spark, ring, box=100.0)
    got = joins.nearest(held.where("atom = 0"), held, 2, drop_first=True).orderBy("rank").collect()
    assert [(r.rank, r.neighbor) for r in got] == [(1, 1), (2, 2)]
    assert joins.nearest(held.where("atom = 0"), held, 4, upper=0.5).count() == 1


def test_perfect_tetrahedron(spark):
    corners = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]
    held = positions(spark, [(0, 0, 0, 0, 0), *((0, k + 1, *c) for k, c in enumerate(corners))], box=100.0)
    got = {r.atom: r.q for r in distribution.tetrahedral_order(held).collect()}
    assert got[0] == pytest.approx(1.0)


def test_ideal_gas_has_a_flat_distribution(spark):
    rng = np.random.default_rng(5)
    held = positions(spark, [(f, a, *rng.random(3)) for f in range(3) for a in range(300)])
    got = distribution.rdf(held, np.linspace(0.1, 0.5, 5).tolist(), 3).toPandas()
    assert (abs(got.value - 1) < 0.1).all()
    both = distribution.periodic_rdf(held, held, np.linspace(0.1, 0.3, 3).tolist(), 3, exclude=1)
    cells = distribution.periodic_rdf(held, held, np.linspace(0.1, 0.3, 3).tolist(), 3, exclude=1, box=(1.0, 1.0, 1.0))
    assert np.allclose(both.orderBy("bin").toPandas().value, cells.orderBy("bin").toPandas().value)


def test_sampled_frames():
    assert distribution.sampled_frames(100, 10) == list(range(0, 100, 10))
    assert distribution.sampled_frames(4, 10) == [0, 1, 2, 3]


def test_gyration_and_vectors(spark):
    held = positions(spark, [(0, 0, 0.0, 0, 0), (0, 1, 0.2, 0, 0), (0, 2, 0.4, 0, 0)], box=10.0)
    top = atoms(spark, [(k, 1, "A", "X", 1.0, 0.0) for k in range(3)])
    assert aggregate.gyration_radius(held, top).first().radius == pytest.approx(math.sqrt(2 * 0.04 / 3))
    pairs = spark.createDataFrame([(0, "a", 2), (0, "b", 0), (0, "b", 1)], "pair long, side string, atom long")
    assert aggregate.vectors(held, pairs).first().x == pytest.approx(0.3)
    assert aggregate.vectors(held, pairs, normed=True, box=True).first().x == pytest.approx(1.0)
    assert aggregate.center_of_mass(held).first().x == pytest.approx(0.2)


def test_rotation():
    for axis in ((0, 0, 1), (0, 0, -1), (1, 2, 3), (0, -1, 0)):
        m = fx.rotation_to_z(axis)
        a = np.array(axis) / np.linalg.norm(axis)
        assert np.allclose(m @ a, [0, 0, 1]) and np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)


def test_spherical_at_the_origin(spark):
    r, phi, theta = fx.spherical(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    row = one(spark, r=r, phi=phi, theta=theta)
    assert row.r == 0 and row.theta is None


def test_havriliak_negami_is_the_imaginary_part(spark):
    w = 0.7
    want = -(1.3 / (1 + (1j * w * 2.0) ** 0.8) ** 0.6).imag
    assert one(spark, h=fx.havriliak_negami(F.lit(w), 1.3, 0.6, 0.8, 2.0)).h == pytest.approx(want)
    assert one(spark, k=fx.kww_1e(0.2, 1.0, 1.0)).k is None


def test_filon_of_an_exponential(spark):
    t = np.concatenate(([0], np.logspace(-3, 2.5, 2000)))
    curve = spark.createDataFrame(pd.DataFrame({"t": t, "c": np.exp(-t)}))
    got = series.filon(curve, "t", "c", [0.1, 1.0, 5.0]).orderBy("omega").toPandas()
    assert np.allclose(got.re, 1 / (1 + got.omega**2), rtol=1e-2)
    assert np.allclose(got.im, got.omega / (1 + got.omega**2), rtol=1e-2)
    assert len(series.default_frequencies(t, 1.0)) == 60


def test_stencil_of_a_quartic_and_means(spark):
    s = spark.createDataFrame([(0, k, float(k) ** 4) for k in range(9)], "g int, x int, y double")
    got = series.five_point_stencil(s, "x", "y", ["g"]).toPandas()
    assert np.allclose(got.derivative, 4 * got.x.astype(float) ** 3) and len(got) == 5
    assert series.running_mean(s, "x", "y", 3, ["g"]).count() == 7


def test_fits():
    t = np.logspace(-1, 2, 40)
    fit = series.fit_kww(t, 0.9 * np.exp(-((t / 5) ** 0.7)), (1.0, 3.0, 0.9))
    assert np.allclose(fit, [0.9, 5, 0.7], rtol=1e-4)
    assert series.crossing_time(t, np.exp(-((t / 5) ** 0.7))) == pytest.approx(5, rel=1e-9)
    assert series.crossing_time(np.array([1.0, 2.0]), np.array([0.3, 0.1])) == 1.0


def curve(spark, rows):
    return spark.createDataFrame(rows, "g int, time double, value double")


def test_times_of_decay(spark):
    t = np.logspace(-1, 2, 30)
    rows = [(k, float(x), math.exp(-((x / tau) ** beta))) for k, (tau, beta) in enumerate(((5.0, 0.7), (0.3, 1.0), (40.0, 0.4))) for x in t]
    # never below; straight where the stretched form is not defined (time 0); the first of several falls
    rows += [(3, 1.0, 0.9), (3, 2.0, 0.8), (4, 0.0, 1.0), (4, 1.0, 0.0), (5, 1.0, 0.5), (5, 2.0, 0.2), (5, 3.0, 0.6), (5, 4.0, 0.1), (6, 1.0, math.nan), (6, 2.0, 0.4)]
    got = {r.g: r.tau for r in series.quick_taus(curve(spark, rows), ["g"]).collect()}
    assert [got[k] for k in range(3)] == pytest.approx([5.0, 0.3, 40.0], rel=1e-9)
    assert got[3] == 2.0 and got[4] == pytest.approx(1 - math.exp(-1)) and 1 < got[5] < 2 and got[6] == 2.0


def test_curves_are_fitted(spark):
    t = np.logspace(-1, 2, 40)
    rows = [(k, float(x), a * math.exp(-((x / tau) ** beta))) for k, (a, tau, beta) in enumerate(((0.9, 5.0, 0.7), (1.0, 2.0, 1.0))) for x in t]
    got = series.fit_curves(curve(spark, rows), ["g"]).orderBy("g").toPandas()
    assert np.allclose(got[["amplitude", "tau", "beta"]], [[0.9, 5, 0.7], [1, 2, 1]], rtol=1e-4)
    # the amplitude bends the line between two points a little
    assert np.allclose(got.tau_1e, [5 * math.log(0.9 * math.e) ** (1 / 0.7), 2.0], rtol=1e-2)


def test_two_curves_as_one(spark):
    one = curve(spark, [(0, x, 1 - math.log(x) / 5) for x in (0.5, 1.0, 2.0, 4.0)])
    two = curve(spark, [(0, x, 1 - math.log(x) / 5) for x in (1.5, 3.0, 8.0, 20.0)])
    got = series.superposed(one, two, by=["g"]).orderBy("time").toPandas()
    # a line over the logarithm of time stays as it is
    assert got.time.tolist() == [0.5, 1, 1.5, 2, 3, 4, 8, 20] and np.allclose(got.value, 1 - np.log(got.time) / 5)
    # the weight falls from the first curve to the second one
    flat = series.superposed(curve(spark, [(0, x, 1.0) for x in (1.0, 2.0, 4.0)]), curve(spark, [(0, x, 0.0) for x in (1.0, 2.0, 4.0)]), damping=2.0).orderBy("time").toPandas()
    assert flat.value.tolist() == pytest.approx([1.0, 0.25, 0.0])
    apart = series.superposed(curve(spark, [(0, 0.0, 5.0), (0, 1.0, 4.0)]), curve(spark, [(0, 2.0, 1.0)])).orderBy("time").toPandas()
    assert apart.value.tolist() == [5, 4, 1]
    assert series.superposed(one.limit(0), two).count() == 4


def test_plans_of_pairs_and_unwrapping(spark):
    held = positions(spark, [(f, a, 0.1 * a, 0, 0) for f in range(3) for a in range(9)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(pbc.nojump(held)) and plan(pbc.nojump(held)).count("Exchange hashpartitioning") == 1
    # one huge frame is many pairs of groups
    wide = positions(spark, [(0, a, 0.01 * a, 0, 0) for a in range(100)])
    pairs = joins.frame_pairs(wide, tile_atoms=10)
    assert pairs.count() == 100 * 99 // 2 and joins.frame_pairs(wide, wide, tile_atoms=7).count() == 10_000
    assert joins.frame_pairs(wide.limit(0)).count() == 0


def test_selections_of_different_tables_have_different_digests(spark):
    from kinetrail.cache import checksum

    one, two = atoms(spark, WATER), atoms(spark, WATER[:3])
    pick = lambda t, **k: AtomSubset.all(t).subset(**k)
    assert checksum(pick(one, atom_name="OW")) == checksum(pick(one, atom_name="OW"))
    assert len({checksum(pick(one, atom_name="OW")), checksum(pick(two, atom_name="OW")), checksum(pick(one, residue_id=[1])), checksum(pick(one, residue_id=[2]))}) == 4


def test_energy(spark):
    df = spark.createDataFrame([(0.0, "T", "K", 300.0)], "time double, type string, unit string, value double")
    assert series.energy(df, "T").count() == 1 and series.energy_types(df).first().unit == "K"
    with pytest.raises(KeyError):
        series.energy(df, "P")


def test_selectors(spark):
    held = positions(spark, [(0, 0, 0.1, 0, 0), (0, 1, 0.5, 0, 0), (0, 2, 0.3, 0, 0)])
    assert sorted(r.atom for r in held.where(select.spatial_selector(F.col("x"), 0.1, 0.3)).collect()) == [0, 2]
    assert sorted(r.atom for r in select.radial_selector(held, held, 0.3, 0.5).collect()) == [1, 2]
    assert [r.atom for r in held.where(select.layer(0.1, (0.5, 0, 0))).collect()] == [1]
    assert one(spark, i=select.true_indices(F.array(F.lit(True), F.lit(False), F.lit(True)))).i == [0, 2]
