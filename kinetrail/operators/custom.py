"""User functions: Column builders where they can be, grouped pandas functions where they cannot.

The pandas forms get one frame, or one pair of frames, at a time; that group must fit
into a task's memory, which a frame does by design of the format.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .correlation import LagPlan


def time_average_of(positions: DataFrame, f: Callable[[pd.DataFrame], Sequence[float]], frames: int | None = None) -> DataFrame:
    """place, value: mean over frames of a function of a frame's rows (in atom order) that returns a list of numbers."""

    def per_frame(frame: pd.DataFrame) -> pd.DataFrame:
        values = [float(v) for v in f(frame.sort_values("atom"))]
        return pd.DataFrame({"frame": int(frame["frame"].iloc[0]), "place": range(len(values)), "value": values})

    each = positions.groupBy("frame").applyInPandas(per_frame, "frame int, place int, value double")
    if frames is None:
        return each.groupBy("place").agg(F.avg("value").alias("value"))
    return each.groupBy("place").agg((F.sum("value") / frames).alias("value"))


def correlation_of(positions: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], float], plan: LagPlan, average: bool = False) -> DataFrame:
    """onset, lag, value of a function of an onset's and a later frame's rows, both in atom order; lag, value if averaged."""
    spark = positions.sparkSession
    table = F.broadcast(spark.createDataFrame(plan.pairs, "onset int, lag int, later int"))
    first = positions.join(table, positions["frame"] == table["onset"]).drop("later")
    later = positions.join(table, positions["frame"] == table["later"]).drop("later")
    later = later.select(*(F.col(c).alias(f"_{c}") for c in later.columns)).toDF(*later.columns)  # columns of its own beside those of ``first``

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"onset": [], "lag": [], "value": []})
        return pd.DataFrame({"onset": [int(a["onset"].iloc[0])], "lag": [int(a["lag"].iloc[0])], "value": [float(f(a.sort_values("atom"), b.sort_values("atom")))]})

    values = first.groupBy("onset", "lag").cogroup(later.groupBy("onset", "lag")).applyInPandas(pair, "onset int, lag int, value double")
    return values.groupBy("lag").agg(F.avg("value").alias("value")) if average else values


def zip_frames(a: DataFrame, b: DataFrame, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Two trajectories side by side: the rows of ``a`` with the other's columns for the same frame and atom, suffixed _b."""
    other = b.select("frame", "atom", *(F.col(c).alias(f"{c}_b") for c in columns))
    return a.join(other, ["frame", "atom"])
