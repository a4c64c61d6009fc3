"""Registered queries over the test tables, each with DuckDB SQL where SQL can express it."""

from . import dynamics, geometry, inputs, statics
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


__all__ = ["dynamics", "geometry", "inputs", "oracle_sql", "queries", "statics"]
