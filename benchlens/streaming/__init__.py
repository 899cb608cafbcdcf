"""Incremental ingest of result documents (Structured Streaming).

The reference has no streaming operators.  This module only runs the
report's stateless part (S1 -> S2 -> S3 -> P1 -> P2/P3) as a file-source
stream, so result files are turned into metric points as they land; the
positional parts of the report (iteration numbers, first-file parameters)
need all files and stay batch (``plans.report``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import joins
from ..plans.report import DocumentPoints
from ..sources import documents as D


def stream_points(spark: SparkSession, results_dir: str, extensions: bool = True,
                  max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming DataFrame of (bench, file, key, label, value) metric points."""
    raw = (spark.readStream.option("pathGlobFilter", "*.json")
           .option("maxFilesPerTrigger", max_files_per_trigger)
           .text(results_dir, wholetext=True)
           .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw")))
    raw = raw.withColumn("stem", F.regexp_replace("file", r"\.json$", ""))
    c = joins.classify(raw, "stem", dims.registry_rules(extensions), "inner")
    valid, _ = D.split_valid(D.parse_documents(c))
    points = DocumentPoints(valid, dims.REGISTRY + (dims.REGISTRY_EXTENSIONS if extensions else [])).points
    return points.select("bench", "file", F.explode("points").alias("p")).select("bench", "file", "p.key", "p.label", "p.value")


def start_points_sink(points: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Append the points as Parquet partitioned by benchmark (exactly-once file sink)."""
    w = (points.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).partitionBy("bench").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
