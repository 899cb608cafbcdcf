"""File inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_inventory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file under ``path`` (recursively) with its size, each file once.

    Only ``path`` and ``length`` are selected, so the binaryFile source never
    reads file contents (the ``content`` column is pruned).
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length")


def inventory_totals(inv: DataFrame) -> DataFrame:
    """Number of files and total bytes (counted once, not once per rank)."""
    return inv.agg(F.count("*").alias("n_files"), F.sum("length").alias("total_bytes"))
