"""Queries of readers, stored tables, trajectories and user functions, each read back from files written from the test tables."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cache, sources
from ..operators import correlation, custom, distribution, pbc, series
from ..operators.aggregate import center_of_mass
from ..operators.select import AtomSubset
from ..sources import embedding_atoms, embedding_positions, table
from ..trajectory import Trajectory, open_trajectory
from .dynamics import _CURVE, FREQUENCIES, PLAN, SELECTIONS, SINC, Q, _isf_curve, _lag_sql, _length, quick_tau
from .geometry import _JUMPS, _STRETCHED, _stretched
from .registry import POSITIONS, out6, pair_distance, query, rounded


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps shared files; a temporary one where it names none, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="kinetrail-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _line(*parts) -> Column:
    return F.concat(*parts)


def _right(c, n: int):
    return F.lpad(c.cast("string"), n, " ")


def write_gro(rows: DataFrame, path: str) -> None:
    """One coordinate file of a frame's rows (atom, residue_id, residue_name, atom_name, x, y, z), in atom order; a frame is one file by its format."""
    line = _line(_right(F.col("residue_id"), 5), F.rpad("residue_name", 5, " "), F.lpad("atom_name", 5, " "), _right(F.col("atom") % 100_000, 5), *(F.format_string("%8.3f", F.col(c)) for c in "xyz"))
    held = rows.select(F.struct("atom", line.alias("line")).alias("r")).agg(F.sort_array(F.collect_list("r"))["line"].alias("lines"))
    held.select(F.concat_ws("\n", F.lit("from a table, t= 0.0"), F.size("lines").cast("string"), F.concat_ws("\n", "lines"), F.lit("   1.00000   1.00000   1.00000"))).write.text(path)


def _first_frame(spark, sf_dir) -> DataFrame:
    return embedding_positions(spark, sf_dir).where("frame = 0").join(embedding_atoms(spark, sf_dir), "atom")


@query("gro_atoms", f"WITH {POSITIONS} SELECT row_number() OVER (ORDER BY atom) - 1 AS atom, residue_id, residue_name, atom_name FROM atoms")
def gro_atoms(spark, sf_dir):
    """Atoms of a coordinate file, numbered by their line."""
    path = folder(spark, "atoms.gro")
    write_gro(_first_frame(spark, sf_dir), path)
    return sources.read_gro(spark, path).select("atom", "residue_id", "residue_name", "atom_name")


@query("gro_positions", f"WITH {POSITIONS} SELECT 0 AS frame, row_number() OVER (ORDER BY atom) - 1 AS atom, {', '.join(f'round({c}, 3) + 0.0 AS {c}' for c in 'xyz')}, CAST(1 AS DOUBLE) AS bx FROM pos WHERE frame = 0")
def gro_positions(spark, sf_dir):
    path = folder(spark, "positions.gro")
    held = _first_frame(spark, sf_dir).withColumns({c: F.round(c, 3) for c in "xyz"})
    write_gro(held, path)
    return sources.read_gro_frames(spark, path).select("frame", "atom", *((F.col(c) + 0.0).alias(c) for c in "xyz"), "bx")


@query("ndx_groups", "SELECT 'label' || CAST(label AS VARCHAR) AS \"group\", vec_id AS atom FROM embeddings")
def ndx_groups(spark, sf_dir):
    """Index groups by a file of names and 1-based numbers."""
    path = folder(spark, "groups.ndx")
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.col("vec_id") + 1)).cast("array<string>")).alias("numbers"))
    rows.agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("[ label"), F.col("label").cast("string"), F.lit(" ]\n"), "numbers")))).write.text(path)
    return sources.read_ndx(spark, path)


def _energy_file(spark, sf_dir) -> DataFrame:
    path = folder(spark, "energy.parquet")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("double").alias("time"), F.col("event_type").alias("type"), F.lit("kJ/mol").alias("unit"), "value")
    rows.write.parquet(path)
    return sources.read_energy(spark, path)


@query("energy_types", "SELECT DISTINCT event_type AS type, 'kJ/mol' AS unit FROM events")
def energy_types(spark, sf_dir):
    return series.energy_types(_energy_file(spark, sf_dir))


@query("energy_of_a_kind", f"SELECT CAST(event_id AS DOUBLE) AS time, {out6('value')} AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def energy_of_a_kind(spark, sf_dir):
    held = _energy_file(spark, sf_dir)
    return rounded(series.energy(held, held.agg(F.min("type")).first()[0]), "value")


_NOJUMP = f"WITH {POSITIONS}, {_STRETCHED}, {_JUMPS} SELECT frame, atom, {', '.join(f'{out6(f"{c} - 1.0 * sum(j{c}) OVER w")} AS {c}' for c in 'xyz')} FROM j WINDOW w AS (PARTITION BY atom ORDER BY frame ROWS UNBOUNDED PRECEDING)"


@query("nojump_stored", _NOJUMP)
def nojump_stored(spark, sf_dir):
    """Unwrapping by a jump table that was kept."""
    held = _stretched(spark, sf_dir)
    stored = cache.save_jumps(held, folder(spark, "jumps"), "embeddings")
    return rounded(pbc.nojump(held, stored).select("frame", "atom", "x", "y", "z"), "x", "y", "z")


_WHOLE_SIMPLE = f"""m AS (SELECT f.frame, f.atom, f.x, f.y, f.z, {', '.join(f'first_value(f.{c}) OVER g AS m{c}' for c in 'xyz')} FROM far f JOIN atoms a USING (atom) WINDOW g AS (PARTITION BY f.frame, a.residue_id ORDER BY f.atom)),
    w AS (SELECT frame, atom, x, y, z, {', '.join(f'CASE WHEN {c} - m{c} > 0.45 THEN {c} - 1.0 WHEN {c} - m{c} < -0.45 THEN {c} + 1.0 ELSE {c} END AS w{c}' for c in 'xyz')} FROM m)"""


@query("whole_simple", f"WITH {POSITIONS}, {_STRETCHED}, {_WHOLE_SIMPLE} SELECT frame, atom, {', '.join(f'{out6("w" + c)} AS {c}' for c in 'xyz')} FROM w")
def whole_simple(spark, sf_dir):
    """Residues around their first atom."""
    return rounded(pbc.whole(_stretched(spark, sf_dir), embedding_atoms(spark, sf_dir), "simple").select("frame", "atom", "x", "y", "z"), "x", "y", "z")


@query(
    "jumps_from_whole",
    f"""WITH {POSITIONS}, {_STRETCHED}, {_WHOLE_SIMPLE}, j AS (SELECT frame, atom, {', '.join(f'CAST(CASE WHEN frame = 0 THEN round_even(({c} - w{c}) / 1.0, 0) ELSE round_even(({c} - lag({c}) OVER o) / 1.0, 0) END AS INTEGER) AS j{c}' for c in 'xyz')} FROM w WINDOW o AS (PARTITION BY atom ORDER BY frame))
    SELECT frame, atom, jx, jy, jz FROM j WHERE jx <> 0 OR jy <> 0 OR jz <> 0""",
)
def jumps_from_whole(spark, sf_dir):
    """The first frame compared with its whole molecules."""
    held = _stretched(spark, sf_dir)
    return pbc.jumps(held, pbc.whole(held.where("frame = 0"), embedding_atoms(spark, sf_dir), "simple"))


@query(
    "nearest_images",
    f"""WITH {POSITIONS}, q AS (SELECT * FROM pos WHERE frame < 3 AND atom % 50 = 0), o AS (SELECT CAST(a AS INTEGER) AS ix, CAST(b AS INTEGER) AS iy, CAST(c AS INTEGER) AS iz FROM range(-1, 2) AS t(a), range(-1, 2) AS u(b), range(-1, 2) AS v(c)),
    i AS (SELECT frame, atom, ix, iy, iz, x + ix AS x, y + iy AS y, z + iz AS z FROM pos, o WHERE frame < 3),
    k AS (SELECT a.frame, a.atom, b.atom AS neighbor, {pair_distance(box=False)} AS d, CAST(row_number() OVER (PARTITION BY a.frame, a.atom ORDER BY {pair_distance(box=False)}, b.atom, ix, iy, iz) AS INTEGER) AS rank FROM q a JOIN i b ON a.frame = b.frame)
    SELECT frame, atom, rank, neighbor, {out6('d')} AS d FROM k WHERE rank <= 3""",
)
def nearest_images(spark, sf_dir):
    held = embedding_positions(spark, sf_dir).where("frame < 3")
    return rounded(pbc.nearest_images(held.where("atom % 50 = 0"), held, 3), "d")


_MIDDLE = (0.25, 0.5, 0.75)


@query(
    "images_outside",
    f"""WITH {POSITIONS}, o AS (SELECT CAST(a AS INTEGER) AS ix, CAST(b AS INTEGER) AS iy, CAST(c AS INTEGER) AS iz FROM range(-1, 2) AS t(a), range(-1, 2) AS u(b), range(-1, 2) AS v(c)),
    i AS (SELECT frame, atom, ix, iy, iz, x + ix * 1.0 AS x, y + iy * 1.0 AS y, z + iz * 1.0 AS z FROM pos, o)
    SELECT frame, atom, ix, iy, iz, {', '.join(f'{out6(c)} AS {c}' for c in 'xyz')} FROM i
    WHERE (ix <> 0 OR iy <> 0 OR iz <> 0) AND {" AND ".join(f"{c} < {m} + 0.5 + 0.05 AND {c} > {m} - 0.5 - 0.05" for c, m in zip("xyz", _MIDDLE, strict=True))}""",
)
def images_outside(spark, sf_dir):
    """Images alone, clipped about a centre that is given."""
    held = pbc.images(embedding_positions(spark, sf_dir), thickness=0.05, inclusive=False, center=_MIDDLE)
    return rounded(held.select("frame", "atom", "ix", "iy", "iz", "x", "y", "z"), "x", "y", "z")


@query("zip_frames", f"WITH {POSITIONS} SELECT frame, {out6('avg((x - y) * (x - y))')} AS value FROM pos WHERE atom % 2 = 0 GROUP BY frame")
def zip_frames(spark, sf_dir):
    """Two trajectories side by side."""
    held = embedding_positions(spark, sf_dir)
    other = held.where("atom % 2 = 0").withColumn("x", F.col("y"))
    return rounded(custom.zip_frames(held, other, ("x",)).groupBy("frame").agg(F.avg((F.col("x") - F.col("x_b")) * (F.col("x") - F.col("x_b"))).alias("value")), "value")


@query("user_time_average", f"WITH {POSITIONS}, f AS (SELECT frame, [max(x), avg(y)] AS v FROM pos GROUP BY frame) SELECT k AS place, {out6('avg(v[k + 1])')} AS value FROM f, (VALUES (0), (1)) AS p(k) GROUP BY k")
def user_time_average(spark, sf_dir):
    """A function of a frame's rows, averaged over frames."""
    return rounded(custom.time_average_of(embedding_positions(spark, sf_dir), lambda frame: [frame["x"].max(), frame["y"].mean()]), "value")


@query("user_correlation", _lag_sql("max(d)", True).replace("CAST(lag AS DOUBLE) AS time, ", ""))
def user_correlation(spark, sf_dir):
    """A function of two frames' rows: the largest displacement."""

    def largest(a, b):
        return float(((b[["x", "y", "z"]].to_numpy() - a[["x", "y", "z"]].to_numpy()) ** 2).sum(axis=1).max() ** 0.5)

    return rounded(custom.correlation_of(embedding_positions(spark, sf_dir), largest, PLAN, average=True), "value")


@query("correlation_hook", _lag_sql("avg((bx - ax) * (bx - ax))", True, extra="AND a.atom % 2 = 0").replace("CAST(lag AS DOUBLE) AS time, ", ""))
def correlation_hook(spark, sf_dir):
    """Pairs made by a function of the caller's."""

    def even(positions, plan, columns):
        return correlation.lag_pairs(positions.where("atom % 2 = 0"), plan, columns)

    kernel = F.avg((F.col("b.x") - F.col("a.x")) * (F.col("b.x") - F.col("a.x")))
    return rounded(correlation.shifted_correlation(embedding_positions(spark, sf_dir), kernel, PLAN, average=True, correlation=even), "value")


def _opened(spark, sf_dir) -> Trajectory:
    """A trajectory of Parquet positions and a coordinate file's atoms, opened by patterns."""
    root = folder(spark, "trajectory")
    write_gro(_first_frame(spark, sf_dir), f"{root}/top.gro")
    embedding_positions(spark, sf_dir).write.parquet(f"{root}/run.parquet")
    return open_trajectory(spark, root, "*.gro", "*.parquet")


@query("open_and_slice", f"WITH {POSITIONS} SELECT frame, count(*) AS n, {out6('avg(x - floor(x))')} AS x FROM pos JOIN atoms USING (atom) WHERE atom_name = 'OW' AND frame IN (2, 5, 8, 11) GROUP BY frame")
def open_and_slice(spark, sf_dir):
    """Opened by patterns, a subset of atoms, wrapped, every third frame of a slice; frames keep their numbers."""
    held = _opened(spark, sf_dir).subset(atom_name="OW").pbc[2:13:3]
    return rounded(held.frames.groupBy("frame").agg(F.count("*").alias("n"), F.avg("x").alias("x")), "x")


@query("one_frame", f"WITH {POSITIONS} SELECT atom, {', '.join(f'{out6(c)} AS {c}' for c in 'xyz')} FROM pos WHERE frame = 20")
def one_frame(spark, sf_dir):
    """The last frame by its negative number."""
    return rounded(_opened(spark, sf_dir).cached()[-1].select("atom", "x", "y", "z"), "x", "y", "z")


@query("mapped_frames", f"WITH {POSITIONS} SELECT frame, residue_id, {', '.join(f'{out6(f"sum(mass * {c}) / sum(mass)")} AS {c}' for c in 'xyz')} FROM pos JOIN atoms USING (atom) WHERE x > 0 AND frame >= 10 GROUP BY frame, residue_id")
def mapped_frames(spark, sf_dir):
    """A filter and a map of each frame, then a slice of the result."""
    raw, atoms = embedding_positions(spark, sf_dir), embedding_atoms(spark, sf_dir)
    held = Trajectory(raw, AtomSubset.all(atoms), sources.N_FRAMES)[10:].filter(F.col("x") > 0)
    return rounded(center_of_mass(held.with_atoms(), ("frame", "residue_id"), "mass"), "x", "y", "z")


@query("frame_boxes", "SELECT CAST(f AS INTEGER) AS frame, CAST(f AS DOUBLE) AS time, CAST(1 AS DOUBLE) AS volume FROM range(21) AS t(f)")
def frame_boxes(spark, sf_dir):
    held = Trajectory(embedding_positions(spark, sf_dir), AtomSubset.all(embedding_atoms(spark, sf_dir)), sources.N_FRAMES)
    return held.boxes().join(held.times(), "frame").select("frame", "time", "volume")


@query("cached_result", _lag_sql("avg(d * d)", True).replace("CAST(lag AS DOUBLE) AS time, ", ""))
def cached_result(spark, sf_dir):
    """Worked out once, kept, and read back under a digest of its arguments."""
    held = dict(cache._state)  # noqa: SLF001
    calls = []

    @cache.cached_result(1)
    def displacement(positions, power):
        calls.append(power)
        return rounded(correlation.shifted_correlation(positions, correlation.msd(), PLAN, average=True), "value")

    cache.enable(folder(spark, "results"))
    try:
        positions = embedding_positions(spark, sf_dir)
        displacement(positions, power=2)
        out = displacement(positions, power=2)
    finally:
        cache._state.update(held)  # noqa: SLF001
    if calls != [2]:
        raise AssertionError("a kept result was worked out again")
    return out


@query("metadata_join", f"WITH {POSITIONS}, n AS (SELECT residue_name, count(*) AS atoms FROM atoms GROUP BY residue_name) SELECT a.atom, n.atoms AS size FROM atoms a JOIN n USING (residue_name)")
def metadata_join(spark, sf_dir):
    atoms = embedding_atoms(spark, sf_dir)
    return atoms.join(atoms.groupBy("residue_name").agg(F.count("*").alias("size")), "residue_name").select("atom", "size")


_SEL = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(SELECTIONS))
_SINC_AB = SINC.replace("d *", _length() + " *").replace("(d", "(" + _length())
_MULTI = f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), sel(sel_id, lo, hi) AS (VALUES {_SEL}),
    v AS (SELECT p.onset, p.lag, s.sel_id, {_SINC_AB} AS v, count(*) AS c
        FROM plan p JOIN pos a ON a.frame = p.onset JOIN sel s ON a.x BETWEEN s.lo AND s.hi JOIN pos b ON b.frame = p.frame AND b.atom = a.atom GROUP BY ALL),
    g AS (SELECT onset, lag, sel_id FROM plan, sel)"""


def _chosen() -> Column:
    return F.filter(F.array(*(F.when(F.col("a.x").between(a, b), F.lit(k)) for k, (a, b) in enumerate(SELECTIONS))), lambda k: k.isNotNull())


@query("multi_subensemble_onsets", f"{_MULTI} SELECT onset, lag, sel_id, {out6('coalesce(v, 0.0)')} AS value, coalesce(c, 0) AS count FROM g LEFT JOIN v USING (onset, lag, sel_id)")
def multi_subensemble_onsets(spark, sf_dir):
    """Values and counts of each onset, not averaged."""
    return rounded(correlation.multi_subensemble(embedding_positions(spark, sf_dir), correlation.isf(Q), PLAN, _chosen(), len(SELECTIONS), average=False), "value")


_LEVEL = math.exp(-1)


def crossing_sql(by: str, curve: str) -> str:
    """SQL of the first time below 1/e of curves (by, t, c) in a table."""
    u = lambda c: f"ln(-ln({c}))"
    stretched = f"exp(ln(t0) + ({math.log(-math.log(_LEVEL))!r} - {u('c0')}) / ({u('c1')} - {u('c0')}) * (ln(t1) - ln(t0)))"
    return f"""cs AS (SELECT {by}, t AS t0, c AS c0, lead(t) OVER w AS t1, lead(c) OVER w AS c1 FROM {curve} WINDOW w AS (PARTITION BY {by} ORDER BY t)),
    ct AS (SELECT {by}, t0, abs(c0 - {_LEVEL!r}) AS off, CASE WHEN c0 >= {_LEVEL!r} AND c1 < {_LEVEL!r} THEN CASE WHEN t0 > 0 AND c0 < 1 AND c1 > 0 THEN {stretched} ELSE t0 + (c0 - {_LEVEL!r}) / (c0 - c1) * (t1 - t0) END END AS tau FROM cs),
    cr AS (SELECT {by}, coalesce(arg_min(tau, t0) FILTER (tau IS NOT NULL), arg_min(t0, off)) AS tau FROM ct GROUP BY {by})"""


query("quick_tau", f"{_lag_sql(SINC, False).split(' SELECT onset, lag, ')[0]}, qc AS (SELECT onset, CAST(lag AS DOUBLE) AS t, value AS c FROM v), {crossing_sql('onset', 'qc')} SELECT onset, {out6('tau')} AS tau FROM cr")(quick_tau)


#: A number of waves at which the curves fall below 1/e.
Q_FALL = 9.0
_SINC_FALL = _SINC_AB.replace(str(Q), str(Q_FALL))
_SPATIAL = _MULTI.replace(_SINC_AB, _SINC_FALL)


@query("spatial_isf_tau", f"{_SPATIAL}, sc AS (SELECT sel_id, CAST(lag AS DOUBLE) AS t, sum(v * c) / sum(c) AS c FROM v GROUP BY sel_id, lag), {crossing_sql('sel_id', 'sc')} SELECT sel_id, {out6('tau')} AS tau FROM cr")
def spatial_isf_tau(spark, sf_dir):
    """Spatially resolved relaxation: selections at the onset, a scattering function of each, its time of decay."""
    curves = correlation.multi_subensemble(embedding_positions(spark, sf_dir), correlation.isf(Q_FALL), PLAN, _chosen(), len(SELECTIONS))
    curves = curves.where(F.col("count") > 0).withColumn("time", F.col("lag").cast("double"))
    return rounded(series.quick_taus(curves, ["sel_id"]), "tau")


_STENCIL = """s5 AS (SELECT t AS t0, c AS c0, lead(t) OVER w AS t1, lead(c) OVER w AS c1, lead(t, 2) OVER w - lag(t, 2) OVER w AS far, -lead(c, 2) OVER w + 8 * lead(c) OVER w - 8 * lag(c) OVER w + lag(c, 2) OVER w AS five, row_number() OVER w AS k FROM c WINDOW w AS (ORDER BY t)),
    s6 AS (SELECT *, coalesce(five / (3 * far), (c1 - c0) / (t1 - t0)) AS slope FROM s5)"""


def _transform(frequencies: str) -> str:
    return f"""SELECT {out6('omega')} AS omega, {out6('sum(slope * (cos(omega * t1) - cos(omega * t0)) / (omega * omega))')} AS re,
    {out6('sum(slope * (sin(omega * t1) - sin(omega * t0)) / (omega * omega)) + sum(CASE WHEN k = 1 THEN c0 / omega ELSE 0 END)')} AS im FROM {frequencies} GROUP BY omega"""


@query("filon_stencil", f"{_CURVE}, {_STENCIL} {_transform('s6, w')}")
def filon_stencil(spark, sf_dir):
    """Slopes by the five-point stencil."""
    return rounded(series.filon(_isf_curve(spark, sf_dir), "t", "c", FREQUENCIES, derivative="stencil"), "omega", "re", "im")


_DEFAULT = f"""wd AS (SELECT 2 * pi() * pow(10.0, lo + (hi - lo) * CAST(k AS DOUBLE) / 59) AS omega FROM (SELECT -log10(max(t)) AS lo, log10(pow({series.HIGHEST_BASE}, {series.HIGHEST_SHIFT}) / min(t) FILTER (t > 0)) AS hi FROM c), range(60) AS r(k))"""


@query("filon_default_frequencies", f"{_CURVE}, {_STENCIL.replace('coalesce(five / (3 * far), (c1 - c0) / (t1 - t0))', '(c1 - c0) / (t1 - t0)')}, {_DEFAULT} {_transform('s6, wd')}")
def filon_default_frequencies(spark, sf_dir):
    return rounded(series.filon(_isf_curve(spark, sf_dir), "t", "c"), "omega", "re", "im")


@query("overlap_of_a_reference", f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), ref AS (SELECT * FROM pos WHERE atom % 3 = 0), size AS (SELECT count(*) AS n FROM ref WHERE frame = 0),
    m AS (SELECT p.onset, p.lag, b.atom, min({pair_distance(box=False)}) AS d FROM plan p JOIN ref a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame GROUP BY ALL)
    SELECT lag, {out6(f"count(*) FILTER (d <= 0.1) / any_value(size.n) / {len(PLAN.onsets)}")} AS value FROM m, size GROUP BY lag""")
def overlap_of_a_reference(spark, sf_dir):
    """Atoms near some of the points of an earlier frame."""
    held = embedding_positions(spark, sf_dir)
    return rounded(correlation.overlap(held, PLAN, 0.1, held.where("atom % 3 = 0")), "value")


@query("rdf_cells", f"""WITH {POSITIONS}, bins(bin, mid, lo, hi) AS (VALUES (0, 0.05, 0.0, 0.1), (1, 0.15, 0.1, 0.2), (2, 0.25, 0.2, 0.3)), d AS (SELECT a.frame, {pair_distance()} AS d, a.residue_id = b.residue_id AS same FROM (SELECT * FROM pos JOIN atoms USING (atom)) a JOIN (SELECT * FROM pos JOIN atoms USING (atom)) b ON a.frame = b.frame AND a.atom < b.atom),
    t AS (SELECT frame, count(*) FILTER (NOT same) AS alln FROM d GROUP BY frame), c AS (SELECT frame, bin, count(*) AS n FROM d JOIN bins ON d >= lo AND (d < hi OR (bin = 2 AND d <= hi)) WHERE NOT same GROUP BY ALL),
    m AS (SELECT bin, sum(n / alln) / 21 AS v FROM c JOIN t USING (frame) GROUP BY bin) SELECT b.bin, {out6('CAST(b.mid AS DOUBLE)')} AS mid, {out6(f'coalesce(m.v / ({4 / 3 * math.pi!r} * (pow(hi, 3) - pow(lo, 3))), 0.0)')} AS value FROM bins b LEFT JOIN m USING (bin)""")
def rdf_cells(spark, sf_dir):
    """Pairs of neighbouring cells alone; the number of all pairs comes from counts."""
    held = embedding_positions(spark, sf_dir).join(embedding_atoms(spark, sf_dir).select("atom", "residue_id"), "atom")
    return rounded(distribution.rdf(held, [0.0, 0.1, 0.2, 0.3], sources.N_FRAMES, kind="inter", box=(1.0, 1.0, 1.0)), "mid", "value")
