"""Rows of a query against those of DuckDB SQL over the same Parquet files."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "fiu":
            frame[c] = frame[c].astype(float)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame):
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = normal(got), normal(want)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c].astype(float), rtol=0, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
