"""Pairs of a query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def sql_list(values: Sequence[float]) -> str:
    return "[" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in values) + "]"


def sql_bin(d: str, edges: Sequence[float]) -> str:
    """Half-open bins, the last closed; NULL outside."""
    n = len(edges) - 1
    return f"(CASE WHEN {d} >= {float(edges[0])!r} AND {d} <= {float(edges[-1])!r} THEN CAST(least(len(list_filter({sql_list(edges)}, lambda e: e <= {d})) - 1, {n - 1}) AS INTEGER) END)"


def sql_fast_bin(d: str, dx: float, n: int) -> str:
    b = f"CAST(round(({d} - {d} % {dx!r}) / {dx!r}) AS INTEGER)"
    return f"(CASE WHEN {b} < {n} THEN {b} END)"


def sql_mids(edges: Sequence[float]) -> str:
    return ", ".join(f"({k}, CAST({(float(a) + float(b)) / 2!r} AS DOUBLE), CAST({float(a)!r} AS DOUBLE), CAST({float(b)!r} AS DOUBLE))" for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))


#: The embeddings as positions and atoms.
POSITIONS = """pos AS (
    SELECT CAST(f AS INTEGER) AS frame, vec_id AS atom, CAST(embedding[3 * f + 1] AS DOUBLE) AS x, CAST(embedding[3 * f + 2] AS DOUBLE) AS y, CAST(embedding[3 * f + 3] AS DOUBLE) AS z
    FROM embeddings, range(21) AS t(f)
), atoms AS (
    SELECT vec_id AS atom, label AS residue_id, ['SOL', 'NA', 'CL'][CAST(label % 3 AS INTEGER) + 1] AS residue_name,
        ['OW', 'HW1', 'HW2'][CAST(vec_id % 3 AS INTEGER) + 1] AS atom_name,
        CAST([16, 1, 1][CAST(vec_id % 3 AS INTEGER) + 1] AS DOUBLE) AS mass, CAST([-0.8, 0.4, 0.4][CAST(vec_id % 3 AS INTEGER) + 1] AS DOUBLE) AS charge
    FROM embeddings
)"""
EVENTS = """series AS (
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, CAST(epoch_us(ts) AS DOUBLE) AS us, value, event_type, event_id
    FROM events
)"""


def mi(d: str) -> str:
    """Nearest image in the unit box."""
    return f"(({d}) - round_even(({d}), 0))"


def length(x: str, y: str, z: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}))"


def pair_distance(box: bool = True, a: str = "a", b: str = "b") -> str:
    parts = [f"{b}.{c} - {a}.{c}" for c in "xyz"]
    return length(*(mi(p) for p in parts)) if box else length(*parts)


def out6(e: str) -> str:
    return f"round({e}, 6) + 0.0"
