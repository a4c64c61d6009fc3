"""Selection, boundaries, geometry and series queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import aggregate, pbc, select, series
from ..operators.select import AtomSubset
from ..sources import embedding_atoms, embedding_positions, event_series, table
from .registry import EVENTS, POSITIONS, length, mi, out6, query, rounded, sql_list


def _xyz_sql(e: str = "") -> str:
    return ", ".join(f"{out6(e.format(c=c) if e else c)} AS {c}" for c in "xyz")


def _all(spark, sf_dir) -> AtomSubset:
    groups = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("group"), F.col("vec_id").alias("atom"))
    return AtomSubset.all(embedding_atoms(spark, sf_dir), groups)


COLUMNS = "atom, residue_id, residue_name, atom_name, mass, charge"


@query("subset_regex", f"WITH {POSITIONS} SELECT {COLUMNS} FROM atoms WHERE regexp_matches(atom_name, '^(?:HW.|OW$)')")
def subset_regex(spark, sf_dir):
    return _all(spark, sf_dir).subset(atom_name="HW.|OW").table


@query("subset_algebra", f"WITH {POSITIONS} SELECT {COLUMNS} FROM atoms WHERE (regexp_matches(atom_name, '^(?:OW$)') OR residue_id IN (1, 2)) AND NOT regexp_matches(residue_name, '^(?:NA$)')")
def subset_algebra(spark, sf_dir):
    every = _all(spark, sf_dir)
    return ((every.subset(atom_name="OW") | every.subset(residue_id=[1, 2])) & ~every.subset(residue_name="NA")).table


@query("index_group", f"WITH {POSITIONS} SELECT {COLUMNS} FROM atoms WHERE residue_id = 3 AND regexp_matches(atom_name, '^(?:OW$)')")
def index_group(spark, sf_dir):
    return _all(spark, sf_dir).subset(atom_name="OW").group("label3")


@query("subset_positions", f"WITH {POSITIONS}, p AS (SELECT *, row_number() OVER (ORDER BY atom) - 1 AS k FROM atoms WHERE regexp_matches(atom_name, '^(?:OW$)')) SELECT {COLUMNS} FROM p WHERE k >= 2 AND (k - 2) % 3 = 0")
def subset_positions(spark, sf_dir):
    return _all(spark, sf_dir).subset(atom_name="OW").positions(2, None, 3)


@query("atom_summary", f"WITH {POSITIONS} SELECT residue_name, atom_name, count(*) AS n FROM atoms GROUP BY ALL")
def atom_summary(spark, sf_dir):
    return _all(spark, sf_dir).summary()


@query("spatial_selector", f"WITH {POSITIONS}, s AS (SELECT *, {length('x - 0.5', 'y - 0.5', 'z - 0.5')} AS r FROM pos) SELECT frame, atom, {out6('r')} AS r FROM s WHERE r BETWEEN 0.7 AND 0.9")
def spatial_selector(spark, sf_dir):
    r = fx.spherical_radius(F.col("x"), F.col("y"), F.col("z"), (F.col("bx") / 2, F.col("by") / 2, F.col("bz") / 2))
    held = embedding_positions(spark, sf_dir).withColumn("r", r).where(select.spatial_selector(F.col("r"), 0.7, 0.9))
    return rounded(held.select("frame", "atom", "r"), "r")


@query("radial_selector", f"WITH {POSITIONS}, o AS (SELECT frame, atom, x + 0.05 AS x, y FROM pos) SELECT p.frame, p.atom, {', '.join(f'{out6("p." + c)} AS {c}' for c in 'xyz')} FROM pos p JOIN o USING (frame, atom) WHERE sqrt(o.x * o.x + o.y * o.y) BETWEEN 0.1 AND 0.2")
def radial_selector(spark, sf_dir):
    held = embedding_positions(spark, sf_dir)
    return rounded(select.radial_selector(held, held.withColumn("x", F.col("x") + 0.05), 0.1, 0.2).select("frame", "atom", "x", "y", "z"), "x", "y", "z")


@query("layer_filter", f"WITH {POSITIONS} SELECT frame, atom, {_xyz_sql()} FROM pos WHERE abs((x - 0.1) * 1.0 + (y - 0.0) * 0.5 + (z - 0.0) * 0.0) <= 0.05")
def layer_filter(spark, sf_dir):
    held = embedding_positions(spark, sf_dir).where(select.layer(0.05, (0.1, 0, 0), (1.0, 0.5, 0.0)))
    return rounded(held.select("frame", "atom", "x", "y", "z"), "x", "y", "z")


@query("pbc_wrap", f"WITH {POSITIONS} SELECT frame, atom, {_xyz_sql('{c} - floor({c})')} FROM pos")
def pbc_wrap(spark, sf_dir):
    return rounded(pbc.into_box(embedding_positions(spark, sf_dir)).select("frame", "atom", "x", "y", "z"), "x", "y", "z")


_NEXT = "b AS (SELECT frame, atom, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, x, y, z FROM pos WINDOW w AS (PARTITION BY frame ORDER BY atom))"


def _with_next(spark, sf_dir):
    order = Window.partitionBy("frame").orderBy("atom")
    return embedding_positions(spark, sf_dir).withColumns({f"n{c}": F.lead(c).over(order) for c in "xyz"}).where("nx IS NOT NULL")


def _pair(f):
    return tuple(F.col(f"n{c}") * 3 for c in "xyz"), tuple(F.col(c) for c in "xyz")


@query("pbc_diff_rect", f"WITH {POSITIONS}, {_NEXT} SELECT frame, atom, {', '.join(f'{out6(mi(f"n{c} * 3 - {c}"))} AS {c}' for c in 'xyz')} FROM b WHERE nx IS NOT NULL")
def pbc_diff_rect(spark, sf_dir):
    d = pbc.difference(*_pair(0), [F.lit(1.0)] * 3)
    return rounded(_with_next(spark, sf_dir).select("frame", "atom", *(e.alias(c) for e, c in zip(d, "xyz", strict=True))), "x", "y", "z")


@query(
    "pbc_diff_wrapped",
    f"WITH {POSITIONS}, {_NEXT}, w AS (SELECT frame, atom, {', '.join(f'(n{c} * 3 - floor(n{c} * 3)) - ({c} - floor({c})) AS d{c}' for c in 'xyz')} FROM b WHERE nx IS NOT NULL) "
    f"SELECT frame, atom, {', '.join(f'{out6(f"d{c} - CASE WHEN d{c} > 0.5 THEN 1.0 ELSE 0.0 END + CASE WHEN d{c} < -0.5 THEN 1.0 ELSE 0.0 END")} AS {c}' for c in 'xyz')} FROM w",
)
def pbc_diff_wrapped(spark, sf_dir):
    d = pbc.difference_wrapped(*_pair(0), [F.lit(1.0)] * 3)
    return rounded(_with_next(spark, sf_dir).select("frame", "atom", *(e.alias(c) for e, c in zip(d, "xyz", strict=True))), "x", "y", "z")


TRICLINIC = ((1.0, 0.0, 0.0), (0.2, 0.9, 0.0), (0.3, 0.1, 0.8))


@query(
    "pbc_diff_triclinic",
    f"""WITH {POSITIONS}, {_NEXT}, d AS (SELECT frame, atom, {', '.join(f'n{c} * 3 - {c} AS {c}' for c in 'xyz')} FROM b WHERE nx IS NOT NULL),
    d2 AS (SELECT frame, atom, x - round_even(z / 0.8, 0) * 0.3 AS x, y - round_even(z / 0.8, 0) * 0.1 AS y, z - round_even(z / 0.8, 0) * 0.8 AS z FROM d),
    d1 AS (SELECT frame, atom, x - round_even(y / 0.9, 0) * 0.2 AS x, y - round_even(y / 0.9, 0) * 0.9 AS y, z FROM d2)
    SELECT frame, atom, {out6('x - round_even(x / 1.0, 0) * 1.0')} AS x, {out6('y')} AS y, {out6('z')} AS z FROM d1""",
)
def pbc_diff_triclinic(spark, sf_dir):
    # each step's columns are given names, so that expressions stay small
    rows = _with_next(spark, sf_dir).select("frame", "atom", *((F.col(f"n{c}") * 3 - F.col(c)).alias(c) for c in "xyz"))
    d = pbc.triclinic([F.col(c) for c in "xyz"], TRICLINIC)
    return rounded(rows.select("frame", "atom", *(e.alias(c) for e, c in zip(d, "xyz", strict=True))), "x", "y", "z")


@query(
    "pbc_images",
    f"""WITH {POSITIONS}, o AS (SELECT CAST(a AS INTEGER) AS ix, CAST(b AS INTEGER) AS iy, CAST(c AS INTEGER) AS iz FROM range(-1, 2) AS t(a), range(-1, 2) AS u(b), range(-1, 2) AS v(c)),
    i AS (SELECT frame, atom, ix, iy, iz, x + ix * 1.0 AS x, y + iy * 1.0 AS y, z + iz * 1.0 AS z FROM pos, o)
    SELECT frame, atom, ix, iy, iz, {_xyz_sql()} FROM i WHERE {" AND ".join(f"{c} < 0.5 + 0.5 + 0.1 AND {c} > 0.5 - 0.5 - 0.1" for c in "xyz")}""",
)
def pbc_images(spark, sf_dir):
    held = pbc.images(embedding_positions(spark, sf_dir), thickness=0.1)
    return rounded(held.select("frame", "atom", "ix", "iy", "iz", "x", "y", "z"), "x", "y", "z")


@query("backfold_rect", f"WITH {POSITIONS} SELECT frame, atom, {', '.join(f'{out6("0.5 + " + mi(c + " * 3 - 0.5"))} AS {c}' for c in 'xyz')} FROM pos")
def backfold_rect(spark, sf_dir):
    held = embedding_positions(spark, sf_dir).withColumns({c: F.col(c) * 3 for c in "xyz"})
    return rounded(pbc.backfold_rect(held).select("frame", "atom", "x", "y", "z"), "x", "y", "z")


@query(
    "backfold_compact",
    f"""WITH {POSITIONS}, o AS (SELECT CAST(a AS INTEGER) AS ix, CAST(b AS INTEGER) AS iy, CAST(c AS INTEGER) AS iz FROM range(-1, 2) AS t(a), range(-1, 2) AS u(b), range(-1, 2) AS v(c)),
    i AS (SELECT frame, atom, x + ix * 1.0 + iy * 0.2 + iz * 0.3 AS x, y + iy * 0.9 + iz * 0.1 AS y, z + iz * 0.8 AS z FROM pos, o),
    r AS (SELECT *, row_number() OVER (PARTITION BY frame, atom ORDER BY (x - 0.75) * (x - 0.75) + (y - 0.5) * (y - 0.5) + (z - 0.4) * (z - 0.4)) AS k FROM i)
    SELECT frame, atom, {_xyz_sql()} FROM r WHERE k = 1""",
)
def backfold_compact(spark, sf_dir):
    held = pbc.backfold_compact(embedding_positions(spark, sf_dir), TRICLINIC)
    return rounded(held.select("frame", "atom", "x", "y", "z"), "x", "y", "z")


_STRETCHED = "far AS (SELECT frame, atom, x * 3 AS x, y * 3 AS y, z * 3 AS z FROM pos)"
_JUMPS = f"""j AS (SELECT frame, atom, x, y, z, {', '.join(f'CAST(coalesce(round_even(({c} - lag({c}) OVER w) / 1.0, 0), 0) AS INTEGER) AS j{c}' for c in 'xyz')} FROM far WINDOW w AS (PARTITION BY atom ORDER BY frame))"""


def _stretched(spark, sf_dir):
    return embedding_positions(spark, sf_dir).withColumns({c: F.col(c) * 3 for c in "xyz"})


@query("jump_table", f"WITH {POSITIONS}, {_STRETCHED}, {_JUMPS} SELECT frame, atom, jx, jy, jz FROM j WHERE jx <> 0 OR jy <> 0 OR jz <> 0")
def jump_table(spark, sf_dir):
    return pbc.jumps(_stretched(spark, sf_dir))


@query("nojump", f"WITH {POSITIONS}, {_STRETCHED}, {_JUMPS} SELECT frame, atom, {', '.join(f'{out6(f"{c} - 1.0 * sum(j{c}) OVER w")} AS {c}' for c in 'xyz')} FROM j WINDOW w AS (PARTITION BY atom ORDER BY frame ROWS UNBOUNDED PRECEDING)")
def nojump(spark, sf_dir):
    return rounded(pbc.nojump(_stretched(spark, sf_dir)).select("frame", "atom", "x", "y", "z"), "x", "y", "z")


@query(
    "whole",
    f"""WITH {POSITIONS}, {_STRETCHED}, p AS (SELECT atom, row_number() OVER (ORDER BY atom) - 1 AS place FROM atoms), m AS (
        SELECT f.frame, f.atom, f.x, f.y, f.z, p.place, count(*) OVER g AS size, {', '.join(f'sum(a.mass * f.{c}) OVER g / sum(a.mass) OVER g AS m{c}' for c in 'xyz')}
        FROM far f JOIN atoms a USING (atom) JOIN p USING (atom) WINDOW g AS (PARTITION BY f.frame, a.residue_id))
    SELECT frame, atom, {', '.join(f'{out6(f"CASE WHEN size = 2 AND place % 2 = 1 THEN {c} WHEN {c} - m{c} > 0.45 THEN {c} - 1.0 WHEN {c} - m{c} < -0.45 THEN {c} + 1.0 ELSE {c} END")} AS {c}' for c in 'xyz')} FROM m""",
)
def whole(spark, sf_dir):
    return rounded(pbc.whole(_stretched(spark, sf_dir), embedding_atoms(spark, sf_dir)).select("frame", "atom", "x", "y", "z"), "x", "y", "z")


@query("center_of_mass", f"WITH {POSITIONS} SELECT frame, residue_id, {', '.join(f'{out6(f"sum(mass * {c}) / sum(mass)")} AS {c}' for c in 'xyz')} FROM pos JOIN atoms USING (atom) GROUP BY frame, residue_id")
def center_of_mass(spark, sf_dir):
    rows = embedding_positions(spark, sf_dir).join(embedding_atoms(spark, sf_dir), "atom")
    return rounded(aggregate.center_of_mass(rows, ("frame", "residue_id"), "mass"), "x", "y", "z")


@query(
    "centers_of_mass_blocks",
    f"""WITH {POSITIONS}, p AS (SELECT atom, row_number() OVER (ORDER BY atom) - 1 AS place FROM atoms), b AS (SELECT frame, CAST(floor(place / 4) AS BIGINT) AS block, [1.0, 2.0, 1.0, 3.0][CAST(place % 4 AS INTEGER) + 1] AS w, x, y, z FROM pos JOIN p USING (atom))
    SELECT frame, block AS atom, {', '.join(f'{out6(f"sum(CAST(w AS DOUBLE) * {c}) / sum(CAST(w AS DOUBLE))")} AS {c}' for c in 'xyz')} FROM b GROUP BY frame, block""",
)
def centers_of_mass_blocks(spark, sf_dir):
    return rounded(aggregate.block_centers(embedding_positions(spark, sf_dir), (1.0, 2.0, 1.0, 3.0)).select("frame", "atom", "x", "y", "z"), "x", "y", "z")


@query(
    "gyration_radius",
    f"""WITH {POSITIONS}, m AS (SELECT frame, residue_id, mass, x, y, z, {', '.join(f'sum(mass * {c}) OVER g / sum(mass) OVER g AS m{c}' for c in 'xyz')} FROM pos JOIN atoms USING (atom) WINDOW g AS (PARTITION BY frame, residue_id)),
    r AS (SELECT frame, residue_id, mass, {' + '.join(f'{mi(f"{c} - m{c}")} * {mi(f"{c} - m{c}")}' for c in 'xyz')} AS r2 FROM m)
    SELECT frame, residue_id, {out6('sqrt(sum(mass * r2) / sum(mass))')} AS radius FROM r GROUP BY frame, residue_id""",
)
def gyration_radius(spark, sf_dir):
    return rounded(aggregate.gyration_radius(embedding_positions(spark, sf_dir), embedding_atoms(spark, sf_dir)), "radius")


@query(
    "pair_vectors",
    f"""WITH {POSITIONS}, v AS (SELECT frame, CAST(floor(atom / 3) AS BIGINT) AS pair, {', '.join(f'{mi(f"avg({c}) FILTER (atom % 3 = 0) - avg({c}) FILTER (atom % 3 <> 0)")} AS {c}' for c in 'xyz')} FROM pos GROUP BY ALL)
    SELECT frame, pair, {', '.join(f'{out6(f"{c} / nullif({length("x", "y", "z")}, 0)")} AS {c}' for c in 'xyz')} FROM v""",
)
def pair_vectors(spark, sf_dir):
    """From the mean of a triple's second and third atom to its first."""
    pairs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("atom"), F.floor(F.col("vec_id") / 3).alias("pair"), F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("side"))
    return rounded(aggregate.vectors(embedding_positions(spark, sf_dir), pairs, normed=True, box=True), "x", "y", "z")


AXIS = (1.0, 1.0, 0.5)
_M = fx.rotation_to_z(AXIS)


def _rotated(k: int) -> str:
    return " + ".join(f"{float(_M[k][j])!r} * {c}" for j, c in enumerate("xyz"))


@query("rotate_axis", f"WITH {POSITIONS} SELECT frame, atom, {', '.join(f'{out6(_rotated(k))} AS {c}' for k, c in enumerate('xyz'))} FROM pos")
def rotate_axis(spark, sf_dir):
    out = fx.rotate_axis(F.col("x"), F.col("y"), F.col("z"), AXIS)
    return rounded(embedding_positions(spark, sf_dir).select("frame", "atom", *(e.alias(c) for e, c in zip(out, "xyz", strict=True))), "x", "y", "z")


@query("polar", f"WITH {POSITIONS} SELECT frame, atom, {out6('sqrt(x * x + y * y)')} AS r, {out6('atan2(y, x)')} AS phi FROM pos")
def polar(spark, sf_dir):
    r, phi = fx.polar(F.col("x"), F.col("y"))
    return rounded(embedding_positions(spark, sf_dir).select("frame", "atom", r.alias("r"), phi.alias("phi")), "r", "phi")


@query("spherical", f"WITH {POSITIONS}, s AS (SELECT *, {length('x', 'y', 'z')} AS r FROM pos) SELECT frame, atom, {out6('r')} AS r, {out6('atan2(y, x)')} AS phi, {out6('acos(z / nullif(r, 0))')} AS theta FROM s")
def spherical(spark, sf_dir):
    r, phi, theta = fx.spherical(F.col("x"), F.col("y"), F.col("z"))
    return rounded(embedding_positions(spark, sf_dir).select("frame", "atom", r.alias("r"), phi.alias("phi"), theta.alias("theta")), "r", "phi", "theta")


@query("running_mean", f"WITH {EVENTS}, m AS (SELECT user_id, frame, avg(value) OVER w AS mean, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) SELECT user_id, frame, {out6('mean')} AS mean FROM m WHERE n = 7")
def running_mean(spark, sf_dir):
    return rounded(series.running_mean(event_series(spark, sf_dir), "frame", "value", 7, ["user_id"]), "mean")


@query(
    "five_point_stencil",
    f"""WITH {EVENTS}, s AS (SELECT user_id, frame, -lead(value, 2) OVER w + 8 * lead(value, 1) OVER w - 8 * lag(value, 1) OVER w + lag(value, 2) OVER w AS up, 3 * (lead(frame, 2) OVER w - lag(frame, 2) OVER w) AS down
        FROM series WINDOW w AS (PARTITION BY user_id ORDER BY frame))
    SELECT user_id, frame, {out6('up / down')} AS derivative FROM s WHERE down IS NOT NULL""",
)
def five_point_stencil(spark, sf_dir):
    return rounded(series.five_point_stencil(event_series(spark, sf_dir), "frame", "value", ["user_id"]), "derivative")


@query("energy_series", f"WITH {EVENTS} SELECT event_type AS type, count(*) AS n, {out6('avg(value)')} AS mean, {out6('min(value)')} AS least, {out6('max(value)')} AS most FROM series GROUP BY event_type")
def energy_series(spark, sf_dir):
    rows = event_series(spark, sf_dir).select(F.col("us").alias("time"), F.col("event_type").alias("type"), F.lit("").alias("unit"), "value")
    return rounded(rows.groupBy("type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")), "mean", "least", "most")


HN = dict(a=1.0, beta=0.6, alpha=0.8, tau=2.0)
_U = f"pow(w * {HN['tau']}, {HN['alpha']})"
_RE, _IM = f"(1.0 + {_U} * {math.cos(math.pi * HN['alpha'] / 2)!r})", f"({_U} * {math.sin(math.pi * HN['alpha'] / 2)!r})"


@query(
    "relaxation_functions",
    f"""WITH w AS (SELECT l_orderkey, l_quantity / 10 AS w FROM lineitem)
    SELECT w, count(*) AS n, {out6('0.9 * exp(-pow(w / 2.0, 0.7))')} AS kww, {out6('1.0 * pow(cos(atan(w * 2.0)), 0.5) * sin(0.5 * atan(w * 2.0))')} AS cole_davidson,
        {out6(f'pow(w * 2.0, 0.5) * {math.sin(math.pi / 4)!r} / (1.0 + pow(w * 2.0, 0.5) * {2 * math.cos(math.pi / 4)!r} + pow(w * 2.0, 0.5) * pow(w * 2.0, 0.5))')} AS cole_cole,
        {out6(f'pow(sqrt({_RE} * {_RE} + {_IM} * {_IM}), -0.6) * sin(0.6 * atan2({_IM}, {_RE}))')} AS havriliak_negami,
        {out6('3.0 * exp(2.0 * exp(-w / 0.5))')} AS colen, {out6('0.8 * exp(-pow(w / 0.5, 1.5)) + 0.2')} AS colen_q, {out6('2.0 * pow(ln(0.9 * exp(1)), 1.0 / w)')} AS kww_1e
    FROM w GROUP BY w""",
)
def relaxation_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    w = F.col("w")
    out = rows.select(
        "w", "n", fx.kww(w, 0.9, 2.0, 0.7).alias("kww"), fx.cole_davidson(w, 1.0, 0.5, 2.0).alias("cole_davidson"), fx.cole_cole(w, 1.0, 0.5, 2.0).alias("cole_cole"),
        fx.havriliak_negami(w, **HN).alias("havriliak_negami"), fx.colen(w, 0.5, 3.0, 2.0).alias("colen"), fx.colen_q(w, 0.5, 0.2, 1.5).alias("colen_q"), fx.kww_1e(F.lit(0.9), F.lit(2.0), w).alias("kww_1e"),
    )
    return rounded(out, *out.columns[2:])


@query("mask_indices", f"SELECT vec_id, list_filter(list_transform({sql_list(range(64))}, lambda k: CASE WHEN embedding[CAST(k AS INTEGER) + 1] > 0.2 THEN CAST(k AS INTEGER) END), lambda k: k IS NOT NULL)::VARCHAR AS places FROM embeddings")
def mask_indices(spark, sf_dir):
    places = select.true_indices(F.transform("embedding", lambda x: x > F.lit(0.2).cast("float")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform(places, lambda k: k.cast("string")), ", "), F.lit("]")).alias("places"))
