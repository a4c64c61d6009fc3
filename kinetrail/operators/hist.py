"""Bin columns and dense histograms.

Two rules, which differ at the last edge: ``edge_bin`` closes the last bin,
``fast_bin`` (uniform edges from 0) does not. Both give null outside.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_fast(edges: Sequence[float]) -> bool:
    """Whether the fast rule applies: first edge 0, uniform to 1e-6."""
    e = np.asarray(edges, dtype=float)
    return bool(e.min() == 0 and np.diff(e).std() < 1e-6)


def _literals(edges: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(e)) for e in edges))


def edge_bin(d: Column, edges: Sequence[float]) -> Column:
    """Half-open bins, the last one closed. Uniform edges: a guess that the two edges beside it correct."""
    e = np.asarray(edges, dtype=float)
    n, held = len(e) - 1, _literals(edges)
    inside = (d >= float(e[0])) & (d <= float(e[-1]))
    if np.allclose(np.diff(e), (e[-1] - e[0]) / n, rtol=1e-6, atol=0):
        guess = F.least(F.greatest(F.floor((d - float(e[0])) / ((e[-1] - e[0]) / n)).cast("int"), F.lit(0)), F.lit(n - 1))
        found = guess - (d < F.get(held, guess)).cast("int") + (d >= F.get(held, guess + 1)).cast("int")
    else:
        found = F.size(F.filter(held, lambda x: x <= d)) - 1
    return F.when(inside, F.least(found, F.lit(n - 1)))


def with_edge_bin(df: DataFrame, d: Column, edges: Sequence[float], name: str) -> DataFrame:
    """``df`` with the ``edge_bin`` of values that are inside, their guess worked out in a projection of its own."""
    e = np.asarray(edges, dtype=float)
    n, held = len(e) - 1, _literals(edges)
    if not np.allclose(np.diff(e), (e[-1] - e[0]) / n, rtol=1e-6, atol=0):
        return df.withColumn(name, edge_bin(d, edges))
    guess = F.floor((d - float(e[0])) / ((e[-1] - e[0]) / n)).cast("int")
    placed = df.withColumn(f"_{name}", F.least(F.greatest(guess, F.lit(0)), F.lit(n - 1)))
    g = F.col(f"_{name}")
    found = g - (d < F.get(held, g)).cast("int") + (d >= F.get(held, g + 1)).cast("int")
    return placed.withColumn(name, F.least(found, F.lit(n - 1))).drop(f"_{name}")


def fast_bin(d: Column, edges: Sequence[float], signed: bool = True) -> Column:
    """floor division by the mean width; the right edge is outside and negative values raise an error.

    Lengths cannot be negative: without ``signed`` there is no such test, and the code stays small enough to be compiled.
    """
    dx, n = float(np.diff(np.asarray(edges, dtype=float)).mean()), len(edges) - 1
    found = F.rint((d - F.pmod(d, F.lit(dx))) / dx).cast("long")  # the quotient is whole but for rounding
    inside = F.when(found < n, found.cast("int"))
    return F.when(d < 0, F.raise_error(F.lit("negative value in a histogram from 0")).cast("int")).otherwise(inside) if signed else inside


def histogram_bin(d: Column, edges: Sequence[float], signed: bool = True) -> Column:
    return fast_bin(d, edges, signed) if is_fast(edges) else edge_bin(d, edges)


def middles(edges: Sequence[float]) -> list[float]:
    e = np.asarray(edges, dtype=float)
    return ((e[1:] + e[:-1]) / 2).tolist()


def bin_table(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    """bin, mid, lower, upper: a row for each bin."""
    e = [float(x) for x in edges]
    return spark.createDataFrame([(k, m, e[k], e[k + 1]) for k, m in enumerate(middles(e))], "bin int, mid double, lower double, upper double")


def densify(counts: DataFrame, edges: Sequence[float], value: str) -> DataFrame:
    """Every bin once, 0 where it has no row. Counts have a row a bin at most."""
    return bin_table(counts.sparkSession, edges).select("bin", "mid").join(counts, "bin", "left").select("bin", "mid", F.coalesce(F.col(value), F.lit(0)).alias(value))


def histogram(df: DataFrame, value: Column, edges: Sequence[float], weight: Column | None = None, rule: str | None = None) -> DataFrame:
    """bin, mid, n."""
    pick = {None: histogram_bin, "edges": edge_bin, "fast": fast_bin}[rule]
    counted = df.select(pick(value, edges).alias("bin"), (F.lit(1) if weight is None else weight).alias("w")).where("bin IS NOT NULL")
    return densify(counted.groupBy("bin").agg(F.sum("w").alias("n")), edges, "n")


def spatial_density(df: DataFrame, columns: Sequence[Column], edges: Sequence[Sequence[float]], weight: Column | None = None) -> DataFrame:
    """Counts (or weights) of the cells that hold rows: b0, b1, ..., n."""
    names = [f"b{k}" for k in range(len(columns))]
    values = df.select(*(c.alias(f"v{k}") for k, c in enumerate(columns)), (F.lit(1) if weight is None else weight).alias("w"))
    for k, e in enumerate(edges):
        values = values.where(F.col(f"v{k}").between(float(min(e)), float(max(e))))
    # guesses have names, so that each is worked out once
    for k, e in enumerate(edges):
        values = with_edge_bin(values, F.col(f"v{k}"), e, names[k])
    return values.groupBy(*names).agg(F.sum("w").alias("n"))
