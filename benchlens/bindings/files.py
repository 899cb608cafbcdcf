"""File bindings: documents as files with sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims, sinks
from ..functions import format_size, parse_size, test_file_size, transfer_seconds
from ..operators import joins, project
from ..session import shared_subdir
from . import common as C
from . import query


LABELS_SQL = """
SELECT doc_id, n_chars,
       CASE doc_id % 6 WHEN 0 THEN CAST(n_chars AS VARCHAR) || 'k'
                       WHEN 1 THEN CAST(n_chars AS VARCHAR) || 'K'
                       WHEN 2 THEN CAST(n_chars // 1024 AS VARCHAR) || 'm'
                       WHEN 3 THEN CAST(n_chars AS VARCHAR)
                       WHEN 4 THEN CAST(n_chars AS VARCHAR) || '.5m'
                       ELSE CAST(n_chars AS VARCHAR) || 'mb' END AS label
FROM documents"""

PARSE_SQL = """CASE WHEN regexp_full_match(lower(label), '[0-9]+[kmg]?')
  THEN CAST(regexp_extract(lower(label), '^([0-9]+)', 1) AS BIGINT) *
       CASE right(lower(label), 1) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 ELSE 1 END
  END"""


def labels(spark, sf):
    d = C.table(spark, sf, "documents")
    n = F.col("n_chars").cast("string")
    m = F.col("doc_id") % 6
    lbl = (F.when(m == 0, F.concat(n, F.lit("k"))).when(m == 1, F.concat(n, F.lit("K")))
           .when(m == 2, F.concat(F.floor(F.col("n_chars") / 1024).cast("string"), F.lit("m")))
           .when(m == 3, n).when(m == 4, F.concat(n, F.lit(".5m"))).otherwise(F.concat(n, F.lit("mb"))))
    return d.select("doc_id", "n_chars", lbl.alias("label"))


@query("f1_parse_size", f"""
SELECT doc_id, label, {PARSE_SQL} AS bytes FROM ({LABELS_SQL})""")
def f1_parse_size(spark, sf):
    return labels(spark, sf).select("doc_id", "label", parse_size("label").alias("bytes"))


@query("p4_size_cap", f"""
SELECT doc_id, label FROM ({LABELS_SQL}) WHERE {PARSE_SQL} <= 4194304""")
def p4_size_cap(spark, sf):
    """Keep sizes up to 4 MiB; labels that do not parse are dropped."""
    return project.cap(labels(spark, sf), "label", 4 * 1024 ** 2).select("doc_id", "label")


@query("f2_format_size", """
SELECT doc_id, CASE WHEN n_chars * 1024 >= 1048576 THEN CAST((n_chars * 1024) // 1048576 AS VARCHAR) || 'm'
                    ELSE CAST(n_chars AS VARCHAR) || 'k' END AS size_label
FROM documents""")
def f2_format_size(spark, sf):
    d = C.table(spark, sf, "documents")
    return d.select("doc_id", format_size(F.col("n_chars") * 1024).alias("size_label"))


@query("f3_file_size", """
SELECT doc_id, greatest(n_chars * 1024 * 4, 67108864) AS test_file_bytes FROM documents""")
def f3_file_size(spark, sf):
    d = C.table(spark, sf, "documents")
    return d.select("doc_id", test_file_size(F.col("n_chars") * 1024).alias("test_file_bytes"))


def _classes_sql() -> str:
    vals = ", ".join(f"({lo}, {hi if hi is not None else 'NULL'}, {C.sql_str(c)})"
                     for lo, hi, c in dims.SIZE_CLASSES)
    return f"(VALUES {vals}) AS sc(lo, hi, class)"


@query("j4_size_class", f"""
SELECT f.doc_id, f.bytes, sc.class
FROM ({C.DOC_FILES_SQL}) f LEFT JOIN {_classes_sql()}
  ON f.bytes >= sc.lo AND (sc.hi IS NULL OR f.bytes < sc.hi)""")
def j4_size_class(spark, sf):
    f = C.doc_files(spark, sf).select("doc_id", "bytes")
    return f.withColumn("class", joins.size_class_fixed(F.col("bytes"), dims.SIZE_CLASSES))


def _read_curve_sql() -> str:
    vals = ", ".join(f"(CAST({dims._size_bytes(l)} AS BIGINT), {r}::DOUBLE)" for l, _, r in dims.BASELINE_SWEEP)
    return f"(VALUES {vals}) AS cv(curve_bytes, read_mbs)"


@query("j5_asof_curve", f"""
SELECT f.doc_id, f.bytes, cv.curve_bytes, cv.read_mbs,
       round_even(f.bytes / 1e6 / cv.read_mbs, 9) AS expected_s
FROM ({C.DOC_FILES_SQL}) f ASOF LEFT JOIN {_read_curve_sql()} ON f.bytes >= cv.curve_bytes""")
def j5_asof_curve(spark, sf):
    """Expected read time of each file from the published read curve
    (largest swept size not above the file size; none below 64 KiB)."""
    f = C.doc_files(spark, sf).select("doc_id", "bytes")
    x = joins.asof_fixed(f, "bytes", [(dims._size_bytes(lbl), r) for lbl, _, r in dims.BASELINE_SWEEP], ["curve_bytes", "read_mbs"], ["bigint", "double"])
    return x.select("doc_id", "bytes", "curve_bytes", "read_mbs",
                    F.bround(transfer_seconds(F.col("bytes") / F.lit(1e6), "read_mbs"), 9).alias("expected_s"))


@query("f16_transfer_time", """
SELECT doc_id, round_even(n_chars * 1024 / 1e9 / 10.5::DOUBLE, 12) AS save_s, round_even(n_chars * 1024 / 1e9 / 8.4::DOUBLE, 12) AS load_s
FROM documents""")
def f16_transfer_time(spark, sf):
    """F16: save and load time of each file at the published 10.5 / 8.4 GB/s."""
    d = C.table(spark, sf, "documents").withColumn("gb", F.col("n_chars") * 1024 / F.lit(1e9))
    return d.select("doc_id", F.bround(transfer_seconds("gb", F.lit(10.5)), 12).alias("save_s"),
                    F.bround(transfer_seconds("gb", F.lit(8.4)), 12).alias("load_s"))


@query("k1_json_roundtrip", f"""
SELECT source, block_size, rate, n_files FROM ({C.CURVE_SQL})""")
def k1_json_roundtrip(spark, sf):
    """K1: the per-source curve written as JSON result records and read back."""
    curve = C.size_bucket_curve(spark, sf).select("source", "block_size", "rate", "n_files")
    path = shared_subdir(spark, "results-json")
    sinks.write_results(curve, path)
    return spark.read.schema("source STRING, block_size STRING, rate DOUBLE, n_files BIGINT").json(path)
