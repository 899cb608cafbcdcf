"""Driver-table roles shared by the bindings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

# --- fixed values: file-name prefixes given to documents (by doc_id % 9) ------
# Seven known benchmark families, the sweep family, and one unknown family.
STEM_PREFIXES = ["hpl_", "nccl_", "mlperf_", "lerobot_", "pi05_1n8g_", "pi05_2n16g_",
                 "pi05_ckpt_1n_", "storage_sweep_", "stream_"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Scan one driver table."""
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def cents(c) -> Column:
    """Two-decimal values as exact integer hundredths: averages of these are
    order-independent (integer-valued doubles sum exactly), so Spark and the
    oracle agree to the last bit, ties included."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("bigint")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


# ----------------------------------------------------------------- trials
def trials(spark: SparkSession, sf: str) -> DataFrame:
    """events as raw sweep trials: size = event_type, rw by event_id parity, bw bytes/s."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type"), F.col("user_id"), F.col("event_id"),
        F.when(F.col("event_id") % 2 == 0, "write").otherwise("read").alias("rw"),
        F.round(F.col("value") * F.lit(1e6)).cast("bigint").alias("bw_bytes"))


TRIALS_SQL = """
SELECT event_type, user_id, event_id,
       CASE WHEN event_id % 2 = 0 THEN 'write' ELSE 'read' END AS rw,
       CAST(round(value * 1e6) AS BIGINT) AS bw_bytes
FROM events"""


# ----------------------------------------------------------------- files
def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    """documents as result files: stem from a prefix list, size = n_chars KiB."""
    d = table(spark, sf, "documents")
    pre = F.array(*[F.lit(p) for p in STEM_PREFIXES])
    stem = F.concat(F.element_at(pre, (F.col("doc_id") % len(STEM_PREFIXES) + 1).cast("int")),
                    F.col("doc_id").cast("string"))
    return d.select("doc_id", "source", "lang", stem.alias("stem"),
                    F.concat(stem, F.lit(".json")).alias("file"),
                    (F.col("n_chars") * 1024).alias("bytes"))


DOC_FILES_SQL = f"""
SELECT doc_id, source, lang,
       {sql_list(STEM_PREFIXES)}[doc_id % {len(STEM_PREFIXES)} + 1] || CAST(doc_id AS VARCHAR) AS stem,
       {sql_list(STEM_PREFIXES)}[doc_id % {len(STEM_PREFIXES)} + 1] || CAST(doc_id AS VARCHAR) || '.json' AS file,
       n_chars * 1024 AS bytes
FROM documents"""


def registry_sql(extensions: bool = True) -> str:
    rows = dims.REGISTRY + (dims.REGISTRY_EXTENSIONS if extensions else [])
    vals = ", ".join(f"({i + 1}, {sql_str(p)}, {sql_str(b)})" for i, (p, b, _, _) in enumerate(rows))
    return f"(VALUES {vals}) AS reg(reg_ord, prefix, bench)"


def prefix_regex(extensions: bool = True) -> str:
    rows = dims.REGISTRY + (dims.REGISTRY_EXTENSIONS if extensions else [])
    return "^(" + "|".join(p for p, _, _, _ in rows) + ")"


def classified_sql(extensions: bool = True) -> str:
    """doc files with prefix + bench (NULL when unknown), as SQL."""
    return f"""
SELECT f.*, reg.reg_ord, reg.bench, pf.prefix
FROM ({DOC_FILES_SQL}) f
CROSS JOIN LATERAL (SELECT NULLIF(regexp_extract(f.stem, '{prefix_regex(extensions)}', 1), '') AS prefix) pf
LEFT JOIN {registry_sql(extensions)} ON reg.prefix = pf.prefix"""


# ----------------------------------------------------------------- curves
def size_bucket_curve(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a throughput curve: per (source, sweep size bucket) the mean KiB.

    A file is put in the largest sweep size <= its bytes (as-of on the sweep
    sizes); files below the first size make a point of their own at size 0.
    """
    from ..operators.joins import asof_fixed
    f = doc_files(spark, sf).select("source", F.col("bytes").alias("file_bytes"))
    points = [(dims._size_bytes(lbl), lbl) for lbl, _ in dims.SWEEP_SIZES]
    x = asof_fixed(f, "file_bytes", points, ["size_bytes", "block_size"], ["bigint", "string"])
    return x.groupBy("source", F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"),
                     F.coalesce("block_size", F.lit("below")).alias("block_size")).agg(
        F.bround(F.avg("file_bytes") / F.lit(1024.0), 6).alias("rate"), F.count("*").alias("n_files"))


def sweep_sizes_sql() -> str:
    vals = ", ".join(f"({sql_str(l)}, CAST({dims._size_bytes(l)} AS BIGINT))" for l, _ in dims.SWEEP_SIZES)
    return f"(VALUES {vals}) AS sw(block_size, size_bytes)"


CURVE_SQL = f"""
SELECT source, coalesce(size_bytes, 0) AS size_bytes, coalesce(block_size, 'below') AS block_size,
       round_even(avg(bytes) / 1024.0::DOUBLE, 6) AS rate, count(*) AS n_files
FROM ({DOC_FILES_SQL}) f
ASOF LEFT JOIN {sweep_sizes_sql()} ON f.bytes >= sw.size_bytes
GROUP BY ALL"""
