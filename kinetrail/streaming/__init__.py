"""Incremental time averages: positions that arrive frame by frame, reduced as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hist import edge_bin


def running_histogram(stream: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """bin, n over all frames so far; state is one row for each bin. Write it with output mode ``complete`` or ``update``."""
    return stream.select(edge_bin(value, edges).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
