"""Time-correlation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregate, correlation, series
from ..sources import N_FRAMES, embedding_positions
from .registry import POSITIONS, out6, pair_distance, query, rounded, sql_fast_bin

PLAN = correlation.plan_lags(N_FRAMES)
Q, RADIUS = 5.0, 0.2
EDGES = np.linspace(0, 0.9, 10).tolist()
DX = float(np.diff(EDGES).mean())


def _lag_sql(kernel: str, average: bool, plan: correlation.LagPlan = PLAN, extra: str = "") -> str:
    inner = f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {plan.sql_values()}), pairs AS (
        SELECT p.onset, p.lag, a.atom, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, {_length()} AS d
        FROM plan p JOIN pos a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame AND b.atom = a.atom {extra}
    ), v AS (SELECT onset, lag, {kernel} AS value FROM pairs GROUP BY onset, lag)"""
    if average:
        return f"{inner} SELECT lag, CAST(lag AS DOUBLE) AS time, {out6('avg(value)')} AS value FROM v GROUP BY lag"
    return f"{inner} SELECT onset, lag, {out6('value')} AS value FROM v"


def _length() -> str:
    return pair_distance(box=False)


SINC = f"avg(CASE WHEN d * {Q} = 0 THEN 1.0 ELSE sin(d * {Q}) / (d * {Q}) END)"
LEGENDRE = "avg(-0.5 + 1.5 * ((ax * bx + ay * by_ + az * bz) * (ax * bx + ay * by_ + az * bz)))"


def _averaged(spark, sf_dir, kernel, **more):
    out = correlation.shifted_correlation(embedding_positions(spark, sf_dir), kernel, PLAN, average=True, **more)
    return rounded(out.select("lag", F.col("lag").cast("double").alias("time"), "value"), "value")


@query("msd", _lag_sql("avg((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az))", True))
def msd(spark, sf_dir):
    return _averaged(spark, sf_dir, correlation.msd())


@query("msd_segments", _lag_sql("avg((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az))", False))
def msd_segments(spark, sf_dir):
    return rounded(correlation.shifted_correlation(embedding_positions(spark, sf_dir), correlation.msd(), PLAN), "value")


@query("isf", _lag_sql(SINC, True))
def isf(spark, sf_dir):
    return _averaged(spark, sf_dir, correlation.isf(Q))


@query("rotational_p2", _lag_sql(LEGENDRE, True))
def rotational_p2(spark, sf_dir):
    return _averaged(spark, sf_dir, correlation.rotational(2))


@query("non_gaussian", _lag_sql("CASE WHEN avg(d * d) = 0 THEN NULL ELSE 0.6 * avg((d * d) * (d * d)) / (avg(d * d) * avg(d * d)) - 1 END", True))
def non_gaussian(spark, sf_dir):
    return _averaged(spark, sf_dir, correlation.non_gaussian())


@query("subensemble_isf", _lag_sql(SINC, True, extra="AND a.x BETWEEN -0.1 AND 0.1"))
def subensemble_isf(spark, sf_dir):
    return _averaged(spark, sf_dir, correlation.isf(Q), selector=lambda pairs: pairs.where(F.col("a.x").between(-0.1, 0.1)))


#: Overlapping selections by x at the onset.
SELECTIONS = ((-0.2, 0.0), (-0.05, 0.05), (0.0, 0.2), (5.0, 6.0))


@query(
    "multi_subensemble_isf",
    f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), sel(sel_id, lo, hi) AS (VALUES {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(SELECTIONS))}),
    v AS (SELECT p.onset, p.lag, s.sel_id, {SINC.replace("d *", _length() + " *").replace("(d", "(" + _length())} AS v, count(*) AS c
        FROM plan p JOIN pos a ON a.frame = p.onset JOIN sel s ON a.x BETWEEN s.lo AND s.hi JOIN pos b ON b.frame = p.frame AND b.atom = a.atom GROUP BY ALL),
    g AS (SELECT DISTINCT lag, sel_id FROM plan, sel)
    SELECT g.lag, g.sel_id, {out6("coalesce(sum(v * c) / sum(c), 0.0)")} AS value, {out6(f"coalesce(sum(c), 0) / {len(PLAN.onsets)}.0")} AS count
    FROM g LEFT JOIN v ON v.lag = g.lag AND v.sel_id = g.sel_id GROUP BY g.lag, g.sel_id""",
)
def multi_subensemble_isf(spark, sf_dir):
    chosen = F.filter(F.array(*(F.when(F.col("a.x").between(a, b), F.lit(k)) for k, (a, b) in enumerate(SELECTIONS))), lambda k: k.isNotNull())
    return rounded(correlation.multi_subensemble(embedding_positions(spark, sf_dir), correlation.isf(Q), PLAN, chosen, len(SELECTIONS)), "value", "count")


@query(
    "van_hove_self",
    f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), d AS (
        SELECT p.onset, p.lag, {_length()} AS d FROM plan p JOIN pos a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame AND b.atom = a.atom),
    c AS (SELECT onset, lag, {sql_fast_bin("d", DX, len(EDGES) - 1)} AS bin, count(*) AS n FROM d GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY onset, lag) AS alln FROM c),
    g AS (SELECT DISTINCT lag, CAST(b AS INTEGER) AS bin FROM plan, range({len(EDGES) - 1}) AS r(b))
    SELECT g.lag, g.bin, {out6(f"coalesce(sum(n / alln), 0.0) / {len(PLAN.onsets)}")} AS value FROM g LEFT JOIN t ON t.lag = g.lag AND t.bin = g.bin GROUP BY g.lag, g.bin""",
)
def van_hove_self(spark, sf_dir):
    return rounded(correlation.van_hove_self(embedding_positions(spark, sf_dir), PLAN, EDGES), "value")


@query(
    "van_hove_distinct",
    f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), size AS (SELECT count(*) AS n FROM embeddings), d AS (
        SELECT p.lag, {pair_distance()} AS d FROM plan p JOIN pos a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame),
    c AS (SELECT lag, {sql_fast_bin("d", DX, len(EDGES) - 1)} AS bin, count(*) AS n FROM d GROUP BY ALL),
    g AS (SELECT DISTINCT lag, CAST(b AS INTEGER) AS bin FROM plan, range({len(EDGES) - 1}) AS r(b))
    SELECT g.lag, g.bin, {out6(f"coalesce(c.n / size.n, 0.0) / {len(PLAN.onsets)}")} AS value FROM g CROSS JOIN size LEFT JOIN c ON c.lag = g.lag AND c.bin = g.bin""",
)
def van_hove_distinct(spark, sf_dir):
    return rounded(correlation.van_hove_distinct(embedding_positions(spark, sf_dir), PLAN, EDGES), "value")


def _folded(c: str) -> str:
    d = f"((a.{c} - floor(a.{c})) - (b.{c} - floor(b.{c})))"
    return f"({d} - CASE WHEN {d} > 0.5 THEN 1.0 ELSE 0.0 END + CASE WHEN {d} < -0.5 THEN 1.0 ELSE 0.0 END)"


@query(
    "coherent_scattering",
    f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), size AS (SELECT count(*) AS n FROM embeddings), d AS (
        SELECT p.onset, p.lag, sqrt({" + ".join(f"{_folded(c)} * {_folded(c)}" for c in "xyz")}) * {Q} AS d FROM plan p JOIN pos a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame)
    SELECT lag, {out6(f"sum(CASE WHEN d = 0 THEN 1.0 ELSE sin(d) / d END) / any_value(size.n) / {len(PLAN.onsets)}")} AS value FROM d, size GROUP BY lag""",
)
def coherent_scattering(spark, sf_dir):
    return rounded(correlation.coherent_scattering(embedding_positions(spark, sf_dir), PLAN, Q), "value")


@query(
    "overlap",
    f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), size AS (SELECT count(*) AS n FROM embeddings), m AS (
        SELECT p.onset, p.lag, b.atom, min({pair_distance(box=False)}) AS d FROM plan p JOIN pos a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame GROUP BY ALL)
    SELECT lag, {out6(f"count(*) FILTER (d <= {RADIUS}) / any_value(size.n) / {len(PLAN.onsets)}")} AS value FROM m, size GROUP BY lag""",
)
def overlap(spark, sf_dir):
    return rounded(correlation.overlap(embedding_positions(spark, sf_dir), PLAN, RADIUS), "value")


@query(
    "chi4",
    f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), d AS (
        SELECT p.onset, p.lag, {_length()} AS d FROM plan p JOIN pos a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame AND b.atom = a.atom),
    f AS (SELECT onset, lag, {SINC} AS f, count(*) AS n FROM d GROUP BY onset, lag)
    SELECT lag, {out6("max(n) * var_pop(f)")} AS value FROM f GROUP BY lag""",
)
def chi4(spark, sf_dir):
    return rounded(correlation.chi4(embedding_positions(spark, sf_dir), PLAN, Q), "value")


FREQUENCIES = (0.5, 1.0, 2.0, 4.0)
_OMEGA = ", ".join(f"(CAST({w!r} AS DOUBLE))" for w in FREQUENCIES)
_CURVE = f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), d AS (
        SELECT p.onset, p.lag, {_length()} AS d FROM plan p JOIN pos a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame AND b.atom = a.atom),
    f AS (SELECT onset, lag, {SINC} AS f FROM d GROUP BY onset, lag), c AS (SELECT CAST(lag AS DOUBLE) AS t, avg(f) AS c FROM f GROUP BY lag),
    s AS (SELECT t AS t0, c AS c0, lead(t) OVER (ORDER BY t) AS t1, lead(c) OVER (ORDER BY t) AS c1, row_number() OVER (ORDER BY t) AS k FROM c), w(omega) AS (VALUES {_OMEGA}),
    r AS (SELECT omega, sum((c1 - c0) / (t1 - t0) * (cos(omega * t1) - cos(omega * t0)) / (omega * omega)) AS re,
        sum((c1 - c0) / (t1 - t0) * (sin(omega * t1) - sin(omega * t0)) / (omega * omega)) + sum(CASE WHEN k = 1 THEN c0 / omega ELSE 0 END) AS im FROM s, w GROUP BY omega)"""


def _isf_curve(spark, sf_dir):
    out = correlation.shifted_correlation(embedding_positions(spark, sf_dir), correlation.isf(Q), PLAN, average=True)
    return out.select(F.col("lag").cast("double").alias("t"), F.col("value").alias("c"))


@query("filon_re_im", f"{_CURVE} SELECT omega, {out6('re')} AS re, {out6('im')} AS im FROM r")
def filon_re_im(spark, sf_dir):
    return rounded(series.filon(_isf_curve(spark, sf_dir), "t", "c", FREQUENCIES), "re", "im")


@query("susceptibility", f"{_CURVE} SELECT omega, {out6('omega * re')} AS value FROM r")
def susceptibility(spark, sf_dir):
    return rounded(correlation.susceptibility_from(series.filon(_isf_curve(spark, sf_dir), "t", "c", FREQUENCIES)), "value")


QF = 3.0


@query(
    "fqt_from_grt",
    f"""WITH {POSITIONS}, plan(onset, lag, frame) AS (VALUES {PLAN.sql_values()}), d AS (
        SELECT p.lag, {_length()} AS d, count(*) OVER () AS alln FROM plan p JOIN pos a ON a.frame = p.onset JOIN pos b ON b.frame = p.frame AND b.atom = a.atom),
    c AS (SELECT lag, {sql_fast_bin("d", DX, len(EDGES) - 1)} AS bin, count(*) AS n FROM d GROUP BY ALL),
    g AS (SELECT lag, ({DX!r} * (2 * bin + 1) / 2) * {QF} AS x, n / {len(PLAN.onsets)} / (SELECT count(*) FROM embeddings) AS g FROM c WHERE bin IS NOT NULL)
    SELECT CAST(lag AS DOUBLE) AS time, {out6("sum(g * CASE WHEN x = 0 THEN 1.0 ELSE sin(x) / x END)")} AS isf, CAST({QF} AS DOUBLE) AS q FROM g GROUP BY lag""",
)
def fqt_from_grt(spark, sf_dir):
    held = correlation.van_hove_self(embedding_positions(spark, sf_dir), PLAN, EDGES)
    data = held.select(((F.col("bin") * 2 + 1) * (DX / 2)).alias("r"), F.col("lag").cast("double").alias("time"), F.col("value").alias("G"))
    return rounded(series.fqt_from_grt(data, QF), "isf")


@query("kww_fit")
def kww_fit(spark, sf_dir):
    """Stretched exponentials of the scattering functions, one for each onset."""
    curves = correlation.shifted_correlation(embedding_positions(spark, sf_dir), correlation.isf(Q), PLAN)
    return series.fit_curves(curves.withColumn("time", F.col("lag").cast("double")), ["onset"])


def quick_tau(spark, sf_dir):
    """Times of decay to 1/e of the scattering functions, one for each onset."""
    curves = correlation.shifted_correlation(embedding_positions(spark, sf_dir), correlation.isf(Q), PLAN)
    return rounded(series.quick_taus(curves.withColumn("time", F.col("lag").cast("double")), ["onset"]), "tau")


def _superposed_sql() -> str:
    window = {"a": "(ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "b": "(ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}
    near = ", ".join(
        f"last_value(CASE WHEN v{k} IS NOT NULL THEN t END IGNORE NULLS) OVER {window['a']} AS ta{k}, last_value(v{k} IGNORE NULLS) OVER {window['a']} AS va{k}, "
        f"first_value(CASE WHEN v{k} IS NOT NULL THEN t END IGNORE NULLS) OVER {window['b']} AS tb{k}, first_value(v{k} IGNORE NULLS) OVER {window['b']} AS vb{k}"
        for k in (1, 2)
    )
    at = lambda k: f"(va{k} + CASE WHEN tb{k} > ta{k} THEN (ln(t) - ln(ta{k})) / (ln(tb{k}) - ln(ta{k})) ELSE 0 END * (vb{k} - va{k}))"
    weight = "(ln(hi) - ln(t)) / (ln(hi) - ln(lo))"
    return f"""{_CURVE}, one AS (SELECT t, c FROM c WHERE t > 0), two AS (SELECT t * 2.5 AS t, c FROM one),
    p AS (SELECT t, one.c AS v1, two.c AS v2 FROM one FULL JOIN two USING (t)), n AS (SELECT t, v1, v2, {near} FROM p),
    e AS (SELECT greatest((SELECT min(t) FROM one), (SELECT min(t) FROM two)) AS lo, least((SELECT max(t) FROM one), (SELECT max(t) FROM two)) AS hi)
    SELECT {out6('t')} AS time, {out6(f"CASE WHEN t BETWEEN lo AND hi THEN {weight} * {at(1)} + (1 - {weight}) * {at(2)} ELSE coalesce(v1, v2) END")} AS value FROM n, e"""


@query("superpose", _superposed_sql())
def superpose(spark, sf_dir):
    """The scattering function at short times and at times stretched by 2.5, as one curve."""
    curve = _isf_curve(spark, sf_dir).where("t > 0").select(F.col("t").alias("time"), F.col("c").alias("value"))
    later = _isf_curve(spark, sf_dir).where("t > 0").select((F.col("t") * 2.5).alias("time"), F.col("c").alias("value"))
    return rounded(series.superposed(curve, later), "time", "value")


@query(
    "mean_frames",
    f"""WITH {POSITIONS}, m AS (SELECT frame, atom, avg(x) OVER w AS x, avg(y) OVER w AS y, avg(z) OVER w AS z, count(*) OVER w AS n FROM pos
        WINDOW w AS (PARTITION BY atom ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
    SELECT frame, atom, {out6("x")} AS x, {out6("y")} AS y, {out6("z")} AS z FROM m WHERE n = 5""",
)
def mean_frames(spark, sf_dir):
    return rounded(aggregate.mean_frames(embedding_positions(spark, sf_dir), 5).select("frame", "atom", "x", "y", "z"), "x", "y", "z")
