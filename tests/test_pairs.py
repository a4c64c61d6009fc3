"""Counts, sums and neighbours of all pairs against brute force, and that no row is made for a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import correlation, distribution, joins, pairs, pbc

BOX = (1.0, 1.0, 1.0)
EDGES = np.linspace(0, 0.85, 18).tolist()


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(3)
    a, b = (rng.normal(scale=0.2, size=(n, 3)).astype(np.float32).astype(float) for n in (700, 713))
    a[100:150], b[:5] = a[7], a[:5]  # a large group of equal points
    return a, b


def distances(a, b, box=True):
    u = 0
    for c in range(3):
        d = b[None, :, c] - a[:, None, c]
        d = d - np.rint(d) if box else d
        u = u + d * d
    return np.sqrt(u)


def test_counts_equal_brute_force(sets):
    a, b = sets
    once = np.triu_indices(len(a), 1)
    for other, d in ((b, distances(a, b).ravel()), (None, distances(a, a)[once])):
        got = pairs.count(a, other, pairs.Distance(), pairs.squared_edges(EDGES), BOX)
        assert got.tolist() == np.histogram(d, EDGES)[0].tolist()
        n, total = pairs.near_sums(a, other, 0.2, BOX)
        assert n == (d <= 0.2).sum() and total == pytest.approx(d[d <= 0.2].sum())
    d = distances(a, b).ravel()
    found = np.rint((d - np.fmod(d, 0.1)) / 0.1).astype(int)
    assert pairs.count(a, b, pairs.Distance(), pairs.squared_fast_edges(0.1, 9), BOX).tolist() == np.bincount(found[found < 9], minlength=9).tolist()
    h = (a[:, None, 0] * a[None, :, 0] + a[:, None, 1] * a[None, :, 1] + a[:, None, 2] * a[None, :, 2])[once]
    kept = np.floor((h + 0.25) / 0.0625)[(h >= -0.25) & (h < 0.25)].astype(int)
    assert pairs.count(a, None, pairs.Product(), pairs.equal_edges(-0.25, 0.25, 8), None).tolist() == np.bincount(kept, minlength=8).tolist()


@pytest.fixture(scope="module")
def clouds():
    """Two dense clouds, the second one half a box away from the first one in x."""
    rng = np.random.default_rng(5)
    a, b = (rng.normal(scale=0.05, size=(n, 3)) + at for n, at in ((6400, 0.0), (4800, [0.45, 0.1, -0.2])))
    a[:200], b[:300] = a[7], a[:300]  # a large group of equal points, and points of both
    return a, b


@pytest.mark.parametrize("box", [BOX, (1.3, 0.9, 1.1), None])
@pytest.mark.parametrize("step", [None, 1 / 64])
def test_counts_of_dense_sets_equal_brute_force(clouds, box, step, monkeypatch):
    """Spheres, shells, points with several nearest images; and a lattice, where many distances are bounds."""
    monkeypatch.setattr(pairs, "MANY", 1)
    a, b = clouds if step is None else (np.rint(x / step) * step for x in clouds)
    bounds = np.asarray(pairs.squared_edges(np.linspace(0.125, 0.875, 7).tolist()))
    want = np.zeros(len(bounds) + 1, np.int64)
    for part in np.array_split(a, 40):
        u = 0
        for c in range(3):
            d = b[None, :, c] - part[:, None, c]
            if box is not None:
                d = d / box[c]
                d = (d - np.rint(d)) * box[c]
            u = u + d * d
        want += np.bincount(np.searchsorted(bounds, u.ravel(), "right"), minlength=len(want))
    assert want[1:-1].sum() > 1e6
    assert pairs.count(a, b, pairs.Distance(box is not None), bounds, box).tolist() == want[1:-1].tolist()


def test_few_pairs_of_dense_sets_are_worked_out_in_doubles(clouds, monkeypatch):
    (a, b), done, values = (0.5 * x for x in clouds), [], pairs._values
    b = np.concatenate([b + k * 1e-3 for k in range(4)])

    def noted(*args):
        out = values(*args)
        done.append(out.size)
        return out

    monkeypatch.setattr(pairs, "_values", noted)
    assert pairs.count(a, b, pairs.Distance(), pairs.squared_fast_edges(0.1, 9), BOX).sum() == len(a) * len(b)
    assert sum(done) < 0.1 * len(a) * len(b)


def test_waves_sum_what_pairs_sum():
    rng = np.random.default_rng(4)
    a, b = (rng.normal(scale=0.2, size=(n, 3)) for n in (6000, 5000))
    x = distances(a, b) * 4
    assert pairs.sinc_sum(a, b, 4.0, BOX) == pytest.approx(np.sinc(x / np.pi).sum(), rel=1e-12)


def test_nearest_ones_and_ties(sets):
    a, b = sets
    for box in (None, BOX):
        for other in (b, a):
            i, j, d = pairs.nearest_of(a, other, 5, box)
            order = np.argsort(i, kind="stable")
            held = distances(a, other, box is not None)
            want = np.argsort(held, axis=1, kind="stable")[:, :5]
            assert (j[order].reshape(-1, 5) == want).all()
            assert (d[order].reshape(-1, 5) == np.take_along_axis(held, want, 1)).all()
    assert len(pairs.nearest_of(a, b[:3], 5, None)[0]) == 3 * len(a)


def frames(spark, points, copies=1):
    rows = [(f, float(f), k, *map(float, p), *BOX, k % 7) for f in (0, 1) for k, p in enumerate(points) for _ in range(copies if k == 3 else 1)]
    return spark.createDataFrame(rows, "frame int, time double, atom long, x double, y double, z double, bx double, by double, bz double, residue_id int")


def test_tiles_and_repeated_rows(spark, sets, monkeypatch):
    """Many tiles give what one gives; an atom's own rows are no pair."""
    held = frames(spark, sets[0][:90], copies=3)
    brute = joins.frame_pairs(held).withColumn("d", joins.distance())
    want = {r.frame: (r.n, r.total) for r in brute.where("d <= 0.3").groupBy("frame").agg(F.count("*").alias("n"), F.sum("d").alias("total")).collect()}
    monkeypatch.setattr(pairs, "TILE", 20)
    got = {r.frame: (r.n, r.total) for r in distribution.near_pairs(held, 0.3).collect()}
    assert got == {k: (n, pytest.approx(t)) for k, (n, t) in want.items()}
    for kind, where in (("inter", "a.residue_id <> b.residue_id"), (None, "true")):
        n = brute.where(where).where("d <= 0.85").count()
        value = distribution.rdf(held, [0.0, 0.85], 2, kind=kind).first().value
        all_ = brute.where(where).count() + (2 * 3 if kind is None else 0)  # the density counts rows
        assert value == pytest.approx(n / all_ / (4 / 3 * np.pi * 0.85**3))


@pytest.mark.parametrize("name", ["nearest", "images", "tetrahedral", "composition", "near", "rdf", "inter", "averaged", "sum", "histogram", "van_hove", "coherent"])
def test_no_row_is_made_for_a_pair(spark, sets, name):
    held = frames(spark, sets[0][:50])
    plan = correlation.plan_lags(2)
    df = {
        "nearest": lambda: joins.nearest(held, held, 2), "images": lambda: pbc.nearest_images(held, held, 2), "tetrahedral": lambda: distribution.tetrahedral_order(held),
        "composition": lambda: distribution.neighbor_composition(held.withColumn("residue_name", F.lit("A")), [0.0, 2.0, 5.0]), "near": lambda: distribution.near_pairs(held, 0.2),
        "rdf": lambda: distribution.rdf(held, EDGES, 2), "inter": lambda: distribution.rdf(held, EDGES, 2, kind="inter"), "averaged": lambda: distribution.averaged_rdf(held, [0.0, 0.3], 2, box=BOX),
        "sum": lambda: distribution.coherent_sum(held, held, pairs.Sinc(4.0)), "histogram": lambda: distribution.coherent_histogram(held, held, pairs.Product(), -0.25, 0.25, 8, distinct=True),
        "van_hove": lambda: correlation.van_hove_distinct(held, plan, EDGES), "coherent": lambda: correlation.coherent_scattering(held, plan, 5.0),
    }[name]()
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 0
