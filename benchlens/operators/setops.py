"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def summary_union(frames: list[DataFrame]) -> DataFrame:
    """Stack per-benchmark KPI rows into one table; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
