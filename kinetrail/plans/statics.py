"""Distributions, pair and neighbour queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import distribution, hist, joins, series
from ..operators.pairs import Product, Sinc
from ..sources import N_FRAMES, embedding_atoms, embedding_positions, table
from .registry import POSITIONS, length, out6, pair_distance, query, rounded, sql_bin, sql_fast_bin, sql_mids

EDGES = np.linspace(0.0, 0.85, 18).tolist()
N = len(EDGES) - 1
_SHELL = f"({4 / 3 * math.pi!r} * (pow(hi, 3) - pow(lo, 3)))"
_BINS = f"bins(bin, mid, lo, hi) AS (VALUES {sql_mids(EDGES)})"


def _named(spark, sf_dir):
    return embedding_positions(spark, sf_dir).join(embedding_atoms(spark, sf_dir).select("atom", "residue_id", "residue_name", "atom_name"), "atom")


def _rdf_sql(pairs: str) -> str:
    return f"""WITH {POSITIONS}, {_BINS}, named AS (SELECT * FROM pos JOIN atoms USING (atom)), d AS ({pairs}),
    c AS (SELECT frame, {sql_bin("d", EDGES)} AS bin, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY frame) AS alln FROM c),
    m AS (SELECT bin, sum(n / alln) / {N_FRAMES} AS v FROM t WHERE bin IS NOT NULL GROUP BY bin)
    SELECT b.bin, {out6("b.mid")} AS mid, {out6(f"coalesce(m.v / {_SHELL}, 0.0)")} AS value FROM bins b LEFT JOIN m ON m.bin = b.bin"""


_SELF = f"SELECT a.frame, {pair_distance()} AS d FROM named a JOIN named b ON a.frame = b.frame AND a.atom < b.atom"


@query("rdf", _rdf_sql(_SELF))
def rdf(spark, sf_dir):
    return rounded(distribution.rdf(embedding_positions(spark, sf_dir), EDGES, N_FRAMES), "mid", "value")


@query("rdf_inter", _rdf_sql(f"{_SELF} AND a.residue_id <> b.residue_id"))
def rdf_inter(spark, sf_dir):
    return rounded(distribution.rdf(_named(spark, sf_dir), EDGES, N_FRAMES, kind="inter"), "mid", "value")


@query("rdf_intra", _rdf_sql(f"{_SELF} AND a.residue_id = b.residue_id"))
def rdf_intra(spark, sf_dir):
    return rounded(distribution.rdf(_named(spark, sf_dir), EDGES, N_FRAMES, kind="intra"), "mid", "value")


@query("rdf_ab", _rdf_sql(f"SELECT a.frame, {pair_distance()} AS d FROM named a JOIN named b ON a.frame = b.frame AND a.atom_name = 'OW' AND b.atom_name <> 'OW'"))
def rdf_ab(spark, sf_dir):
    held = _named(spark, sf_dir)
    return rounded(distribution.rdf(held.where("atom_name = 'OW'"), EDGES, N_FRAMES, held.where("atom_name <> 'OW'")), "mid", "value")


NEAR = np.linspace(0.0, 0.3, 13).tolist()
_NEAR_BINS = f"bins(bin, mid, lo, hi) AS (VALUES {sql_mids(NEAR)})"


def _periodic_sql(frames: str, n_frames: int, exclude: int, a: str, b: str) -> str:
    offsets = ", ".join(f"range(-1, 2) AS t{c}(i{c})" for c in "xyz")
    return f"""WITH {POSITIONS}, {_NEAR_BINS}, named AS (SELECT * FROM pos JOIN atoms USING (atom) WHERE {frames}), aa AS (SELECT * FROM named WHERE {a}), bb AS (SELECT frame, atom, x + ix AS x, y + iy AS y, z + iz AS z FROM named, {offsets} WHERE {b}),
    c AS (SELECT a.frame, {sql_bin("d", NEAR)} AS bin, count(*) AS n FROM (SELECT a.frame, {pair_distance(box=False)} AS d FROM aa a JOIN bb b ON a.frame = b.frame) a GROUP BY ALL),
    m AS (SELECT bin, sum(n / (SELECT count(*) FROM aa WHERE aa.frame = c.frame) / ((SELECT count(*) / 27 FROM bb WHERE bb.frame = c.frame) - {exclude})) / {n_frames} AS v FROM c WHERE bin IS NOT NULL GROUP BY bin)
    SELECT b.bin, {out6("b.mid")} AS mid, {out6(f"coalesce(m.v / {_SHELL}, 0.0)")} AS value FROM bins b LEFT JOIN m ON m.bin = b.bin"""


@query("rdf_periodic", _periodic_sql("true", N_FRAMES, 0, "atom_name = 'OW'", "atom_name <> 'OW'"))
def rdf_periodic(spark, sf_dir):
    held = _named(spark, sf_dir)
    return rounded(distribution.periodic_rdf(held.where("atom_name = 'OW'"), held.where("atom_name <> 'OW'"), NEAR, N_FRAMES, 0, (1.0, 1.0, 1.0)), "mid", "value")


PICKED = distribution.sampled_frames(N_FRAMES)


@query("averaged_rdf", _periodic_sql(f"frame IN ({', '.join(map(str, PICKED))})", len(PICKED), 1, "true", "true"))
def averaged_rdf(spark, sf_dir):
    return rounded(distribution.averaged_rdf(embedding_positions(spark, sf_dir), NEAR, N_FRAMES, box=(1.0, 1.0, 1.0)), "mid", "value")


_KNN = f"""k AS (SELECT a.frame, a.atom, b.atom AS neighbor, {pair_distance(box=False)} AS d, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM pos a JOIN pos b ON a.frame = b.frame),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame, atom ORDER BY d, neighbor) - 1 AS INTEGER) AS rank FROM k QUALIFY rank BETWEEN 1 AND 4)"""
_TETRA = f"""{_KNN}, u AS (SELECT frame, atom, rank, dx / nullif(d, 0) AS x, dy / nullif(d, 0) AS y, dz / nullif(d, 0) AS z FROM r),
    q AS (SELECT a.frame, a.atom, 1 - 0.375 * sum((a.x * b.x + a.y * b.y + a.z * b.z + {1 / 3!r}) * (a.x * b.x + a.y * b.y + a.z * b.z + {1 / 3!r})) AS q FROM u a JOIN u b ON a.frame = b.frame AND a.atom = b.atom AND a.rank < b.rank GROUP BY ALL)"""


@query("next_neighbors", f"WITH {POSITIONS}, {_KNN} SELECT frame, atom, rank, neighbor, {out6('d')} AS d FROM r")
def next_neighbors(spark, sf_dir):
    held = embedding_positions(spark, sf_dir).select("frame", "atom", "x", "y", "z")
    return rounded(joins.nearest(held, held, 4, drop_first=True).select("frame", "atom", "rank", "neighbor", "d"), "d")


@query("tetrahedral_order", f"WITH {POSITIONS}, {_TETRA} SELECT frame, atom, {out6('q')} AS q FROM q")
def tetrahedral_order(spark, sf_dir):
    return rounded(distribution.tetrahedral_order(embedding_positions(spark, sf_dir)), "q")


TETRA_EDGES = np.linspace(-3.0, 1.0, 17).tolist()


@query(
    "tetrahedral_hist",
    f"WITH {POSITIONS}, bins(bin, mid, lo, hi) AS (VALUES {sql_mids(TETRA_EDGES)}), {_TETRA}, c AS (SELECT {sql_bin('q', TETRA_EDGES)} AS bin, count(*) AS n FROM q GROUP BY ALL) SELECT b.bin, {out6('b.mid')} AS mid, coalesce(c.n, 0) AS n FROM bins b LEFT JOIN c ON c.bin = b.bin",
)
def tetrahedral_hist(spark, sf_dir):
    return rounded(distribution.tetrahedral_distribution(embedding_positions(spark, sf_dir), TETRA_EDGES), "mid")


COUNT_EDGES = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


@query(
    "neighbor_composition",
    f"""WITH {POSITIONS}, bins(bin, mid, lo, hi) AS (VALUES {sql_mids(COUNT_EDGES)}), {_KNN}, s AS (SELECT r.frame, r.atom, CAST(count(*) FILTER (a.residue_name = b.residue_name) AS DOUBLE) AS c FROM r JOIN atoms a ON a.atom = r.atom JOIN atoms b ON b.atom = r.neighbor GROUP BY ALL),
    c AS (SELECT {sql_bin('c', COUNT_EDGES)} AS bin, count(*) AS n FROM s GROUP BY ALL)
    SELECT b.bin, {out6('b.mid')} AS mid, {out6('coalesce(c.n, 0) / (SELECT sum(n) FROM c WHERE bin IS NOT NULL) / (hi - lo)')} AS value FROM bins b LEFT JOIN c ON c.bin = b.bin""",
)
def neighbor_composition(spark, sf_dir):
    return rounded(distribution.neighbor_composition(_named(spark, sf_dir), COUNT_EDGES), "mid", "value")


@query("min_distance", f"WITH {POSITIONS} SELECT a.frame, a.atom, {out6(f'min({pair_distance()})')} AS d FROM pos a JOIN pos b ON a.frame = b.frame AND a.atom % 3 = 0 AND b.atom % 3 <> 0 GROUP BY a.frame, a.atom")
def min_distance(spark, sf_dir):
    """Of each first atom of a triple to all second and third ones."""
    held = _named(spark, sf_dir)
    return rounded(joins.min_distance(held.where("atom_name = 'OW'"), held.where("atom_name <> 'OW'")), "d")


@query("cell_list_pairs", f"WITH {POSITIONS} SELECT a.frame, count(*) AS n, {out6(f'sum({pair_distance()})')} AS total FROM pos a JOIN pos b ON a.frame = b.frame AND a.atom < b.atom AND {pair_distance()} <= 0.2 GROUP BY a.frame")
def cell_list_pairs(spark, sf_dir):
    return rounded(distribution.near_pairs(embedding_positions(spark, sf_dir), 0.2), "total")


@query("coherent_sum", f"WITH {POSITIONS}, d AS (SELECT a.frame, {pair_distance()} * 4.0 AS d FROM pos a JOIN pos b ON a.frame = b.frame) SELECT frame, {out6('sum(CASE WHEN d = 0 THEN 1.0 ELSE sin(d) / d END)')} AS value FROM d GROUP BY frame")
def coherent_sum(spark, sf_dir):
    held = embedding_positions(spark, sf_dir)
    return rounded(distribution.coherent_sum(held, held, Sinc(4.0)), "value")


@query(
    "coherent_histogram",
    f"WITH {POSITIONS}, d AS (SELECT a.frame, a.x * b.x + a.y * b.y + a.z * b.z AS h FROM pos a JOIN pos b ON a.frame = b.frame AND a.atom <> b.atom) SELECT frame, CAST(floor((h - (-0.25)) / 0.0625) AS INTEGER) AS bin, count(*) AS n FROM d WHERE h >= -0.25 AND h < 0.25 GROUP BY ALL",
)
def coherent_histogram(spark, sf_dir):
    held = embedding_positions(spark, sf_dir)
    return distribution.coherent_histogram(held, held, Product(), -0.25, 0.25, 8, distinct=True)


CHAIN = np.linspace(0.0, 1.2, 13).tolist()


@query(
    "chain_distance_hist",
    f"WITH {POSITIONS}, s AS (SELECT frame, {length('lead(x) OVER w - x', 'lead(y) OVER w - y', 'lead(z) OVER w - z')} AS d FROM pos WINDOW w AS (PARTITION BY frame ORDER BY atom)), c AS (SELECT frame, {sql_bin('d', CHAIN)} AS bin, count(*) AS n FROM s GROUP BY ALL) SELECT frame, bin, n FROM c WHERE bin IS NOT NULL",
)
def chain_distance_hist(spark, sf_dir):
    return distribution.distance_distribution(embedding_positions(spark, sf_dir), CHAIN)


RADII = np.linspace(0.0, 0.5, 11).tolist()


@query(
    "radial_density",
    f"WITH {POSITIONS}, bins(bin, mid, lo, hi) AS (VALUES {sql_mids(RADII)}), c AS (SELECT {sql_bin('r', RADII)} AS bin, count(*) AS n FROM (SELECT sqrt((x - 0.05) * (x - 0.05) + (y - 0.0) * (y - 0.0)) AS r FROM pos) GROUP BY ALL) SELECT b.bin, {out6('b.mid')} AS mid, {out6(f'coalesce(c.n, 0) / {N_FRAMES} / ({math.pi!r} * (hi * hi - lo * lo) * 2.0)')} AS value FROM bins b LEFT JOIN c ON c.bin = b.bin",
)
def radial_density(spark, sf_dir):
    return rounded(distribution.radial_density(embedding_positions(spark, sf_dir), RADII, N_FRAMES, origin=(0.05, 0, 0), height=2), "mid", "value")


ANGLES, HEIGHTS = np.linspace(-3.2, 3.2, 9).tolist(), np.linspace(-0.5, 0.5, 6).tolist()


@query(
    "shell_density",
    f"WITH {POSITIONS}, c AS (SELECT {sql_bin('phi', ANGLES)} AS b0, {sql_bin('z', HEIGHTS)} AS b1, count(*) AS n FROM (SELECT atan2(y, x) AS phi, z, sqrt(x * x + y * y) AS r FROM pos) WHERE r BETWEEN 0.1 AND 0.25 GROUP BY ALL) SELECT b0, b1, n FROM c WHERE b0 IS NOT NULL AND b1 IS NOT NULL",
)
def shell_density(spark, sf_dir):
    return distribution.shell_density(embedding_positions(spark, sf_dir), 0.1, [ANGLES, HEIGHTS], 0.15)


CLOUD = (np.linspace(0, 50, 6).tolist(), np.linspace(0, 120_000, 7).tolist(), np.linspace(0, 0.1, 6).tolist())


@query(
    "spatial_density",
    f"WITH c AS (SELECT {sql_bin('l_quantity', CLOUD[0])} AS b0, {sql_bin('l_extendedprice', CLOUD[1])} AS b1, {sql_bin('l_discount', CLOUD[2])} AS b2, sum(l_tax) AS n FROM lineitem GROUP BY ALL) SELECT b0, b1, b2, {out6('n')} AS n FROM c WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL",
)
def spatial_density(spark, sf_dir):
    return rounded(hist.spatial_density(table(spark, sf_dir, "lineitem"), [F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")], CLOUD, F.col("l_tax")), "n")


GRID, SHARES = np.linspace(-0.6, 0.6, 7).tolist(), np.linspace(0, 1, 11).tolist()


@query(
    "mixing_ratio",
    f"""WITH {POSITIONS}, bins(bin, mid, lo, hi) AS (VALUES {sql_mids(SHARES)}), g AS (SELECT {', '.join(f'{sql_bin(c, GRID)} AS b{k}' for k, c in enumerate('xyz'))}, atom % 3 = 0 AS a FROM pos),
    s AS (SELECT b0, b1, b2, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM g WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL GROUP BY ALL),
    c AS (SELECT {sql_bin('r', SHARES)} AS bin, count(*) AS n FROM (SELECT na / (na + nb) AS r FROM s WHERE na > 0 AND nb > 0) GROUP BY ALL)
    SELECT b.bin, {out6('b.mid')} AS mid, coalesce(c.n, 0) AS n FROM bins b LEFT JOIN c ON c.bin = b.bin""",
)
def mixing_ratio(spark, sf_dir):
    held = _named(spark, sf_dir)
    return rounded(distribution.mixing_ratio(held.where("atom_name = 'OW'"), held.where("atom_name <> 'OW'"), ("x", "y", "z"), [GRID] * 3, SHARES), "mid")


FAST, UNEVEN = np.linspace(0, 50, 26).tolist(), [1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 50.0]


def _hist_sql(found: str, edges: list[float], value: str) -> str:
    return f"WITH bins(bin, mid, lo, hi) AS (VALUES {sql_mids(edges)}), c AS (SELECT {found} AS bin, count(*) AS n FROM lineitem WHERE {value} IS NOT NULL GROUP BY ALL) SELECT b.bin, {out6('b.mid')} AS mid, coalesce(c.n, 0) AS n FROM bins b LEFT JOIN c ON c.bin = b.bin"


@query("histogram_fast", _hist_sql(sql_fast_bin("l_quantity", float(np.diff(FAST).mean()), 25), FAST, "l_quantity"))
def histogram_fast(spark, sf_dir):
    return rounded(hist.histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), FAST), "mid")


@query("histogram_edges", _hist_sql(sql_bin("l_quantity", UNEVEN), UNEVEN, "l_quantity"))
def histogram_edges(spark, sf_dir):
    return rounded(hist.histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), UNEVEN), "mid")


LINE = np.linspace(-0.5, 0.5, 11).tolist()


@query("time_histogram", f'WITH {POSITIONS}, c AS (SELECT atom AS "row", {sql_bin("x", LINE)} AS bin, count(*) AS n FROM pos GROUP BY ALL) SELECT "row", bin, n FROM c WHERE bin IS NOT NULL')
def time_histogram(spark, sf_dir):
    return distribution.time_histogram(embedding_positions(spark, sf_dir).withColumnRenamed("atom", "row"), "row", F.col("x"), LINE)


@query("time_average", f"WITH {POSITIONS}, f AS (SELECT frame, residue_id, avg(sqrt(x * x + y * y + z * z)) AS v FROM pos JOIN atoms USING (atom) GROUP BY ALL) SELECT residue_id, {out6(f'sum(v) / {N_FRAMES}')} AS v FROM f GROUP BY residue_id")
def time_average(spark, sf_dir):
    per_frame = _named(spark, sf_dir).groupBy("frame", "residue_id").agg(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("v"))
    return rounded(distribution.time_average(per_frame, ["residue_id"], "v", N_FRAMES), "v")


QS = (2.0, 5.0, 9.0)
_STEP = "(r1 - r0) * ((g0 - 1) * r0 * sin(q * r0) + (g1 - 1) * r1 * sin(q * r1)) / 2"


@query(
    "structure_factor",
    _rdf_sql(_SELF).replace(f"SELECT b.bin, {out6('b.mid')} AS mid, {out6(f'coalesce(m.v / {_SHELL}, 0.0)')} AS value FROM bins b LEFT JOIN m ON m.bin = b.bin", f", g AS (SELECT b.mid AS r0, coalesce(m.v / {_SHELL}, 0.0) AS g0 FROM bins b LEFT JOIN m ON m.bin = b.bin), s AS (SELECT *, lead(r0) OVER (ORDER BY r0) AS r1, lead(g0) OVER (ORDER BY r0) AS g1 FROM g), qs(q) AS (VALUES {', '.join(f'(CAST({q!r} AS DOUBLE))' for q in QS)}) SELECT q, {out6(f'sum({_STEP}) * {4 * math.pi * 500!r} / q + 1')} AS value FROM s, qs GROUP BY q"),
)
def structure_factor(spark, sf_dir):
    return rounded(series.structure_factor(distribution.rdf(embedding_positions(spark, sf_dir), EDGES, N_FRAMES), "mid", "value", QS, 500.0), "value")
