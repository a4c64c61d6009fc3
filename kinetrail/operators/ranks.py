"""Dense positions without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a chunk, the unit that one task orders.
CHUNK = 65_536


def with_position(df: DataFrame, key: str, name: str = "position", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the 0-based rank of ``key`` (an integer column), within ``by``: counts by chunk, then a rank inside each chunk."""
    chunk: Column = F.floor(F.col(key) / CHUNK)
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = counts.select(*by, "_chunk", F.coalesce(F.sum("_n").over(order.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(key)) - 1
    return rows.withColumn("_inside", inside).join(before, [*by, "_chunk"]).withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)
