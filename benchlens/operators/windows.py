"""Window operators (W1-W6) and ordering (O1-O3).

Windows over raw rows use bounded forms only: top-k per group (planned as a
``WindowGroupLimit`` that trims each task before the shuffle) or the range-
partitioned numbering in ``ranking``.  Curve windows (W3-W5) run on curves
that were aggregated first: a handful of points per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse_size
from .agg import with_group_count
from .ranking import row_positions

MIB = 1024 ** 2


def with_iteration(df: DataFrame, keys: Sequence[str], order: str, name: str = "iteration",
                   base: int = 0) -> DataFrame:
    """Position of each row in its group by a unique order (0-based by default)."""
    out = row_positions(df, keys, [order], name)
    return out.withColumn(name, F.col(name) - F.lit(1 - base))


def measure_window(df: DataFrame, keys: Sequence[str], order: str, warmup: int = 20,
                   measure: int = 80, name: str = "step_no") -> DataFrame:
    """Drop the first ``warmup`` steps of each run and keep the next ``measure``.

    ``row_number() <= warmup + measure`` is a top-k filter, so Spark inserts a
    partial WindowGroupLimit before the shuffle: each task forwards at most
    warmup + measure rows per run.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn(name, F.row_number().over(w))
    x = x.where(F.col(name) <= warmup + measure)
    return x.where(F.col(name) > warmup).withColumn(name, F.col(name).cast("bigint"))


def gain(curve: DataFrame, series: Sequence[str], size_col: str, value: str,
         name: str = "gain") -> DataFrame:
    """Ratio of each point to the previous (smaller) size of the same series."""
    w = Window.partitionBy(*series).orderBy(size_col)
    prev = F.lag(value).over(w)
    return curve.withColumn(name, F.col(value).cast("double") / F.nullif(prev.cast("double"), F.lit(0.0)))


def plateau(curve: DataFrame, series: Sequence[str], size_col: str, value: str,
            eps: float = 0.10) -> DataFrame:
    """Recommended size per series.

    The plateau starts at the first size after which every later gain is
    below 1 + eps (the point needs at least one later point).  Without such
    a point the largest size is recommended and ``plateau`` is false.
    """
    series = list(series)
    g = gain(curve, series, size_col, value)
    w = (Window.partitionBy(*series).orderBy(size_col)
         .rowsBetween(1, Window.unboundedFollowing))
    g = g.withColumn("_later", F.max("gain").over(w))
    ok = F.col("_later") < F.lit(1.0 + eps)
    out = g.groupBy(*series).agg(F.min(F.when(ok, F.col(size_col))).alias("_p"),
                                 F.max(size_col).alias("_top"))
    return out.select(*series, F.col("_p").isNotNull().alias("plateau"),
                      F.coalesce("_p", "_top").alias("recommended_size"))


def small_file_penalty(curve: DataFrame, series: Sequence[str], size_col: str, value: str,
                       small_below: int = MIB, threshold: float = 0.5) -> DataFrame:
    """Best rate below ``small_below`` bytes / best rate overall, flagged when low."""
    s = F.col(size_col)
    out = curve.groupBy(*series).agg(F.max(F.when(s < small_below, F.col(value))).alias("best_small"),
                                     F.max(value).alias("best_all"))
    r = F.col("best_small").cast("double") / F.nullif(F.col("best_all").cast("double"), F.lit(0.0))
    return out.withColumn("small_ratio", r).withColumn("small_file_penalty", r < F.lit(threshold))


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "group_size", bounded: bool = False) -> DataFrame:
    """Group cardinality on each row (``bounded``: the keys come from a fixed table)."""
    return with_group_count(df, keys, name, bounded)


def file_order(df: DataFrame, file_col: str = "file", name: str = "ord") -> DataFrame:
    """O1: 1-based global position by file name (code-point order)."""
    return row_positions(df, [], [file_col], name)


def size_order(df: DataFrame, label_col: str, tie: str, name: str = "ord") -> DataFrame:
    """O2: 1-based global position by parsed size (not by label text), then ``tie``."""
    x = df.withColumn("_bytes", parse_size(label_col))
    return row_positions(x, [], ["_bytes", tie], name).drop("_bytes")


def top_per_group(df: DataFrame, keys: Sequence[str], order_cols, k: int = 1,
                  name: str = "rank") -> DataFrame:
    """O3: top-k rows per group (WindowGroupLimit keeps every task bounded)."""
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    x = df.withColumn(name, F.row_number().over(w))
    return x.where(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))
