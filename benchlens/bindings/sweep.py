"""Sweep bindings: events as raw trials (A1, A2, A11, F4, F5) and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gb_per_s, mb_per_s, round_half_even
from ..operators import agg, windows
from ..session import shared_subdir
from . import common as C
from . import query

# ---------------------------------------------------------------- flagship
SWEEP_SUMMARY_SQL = f"""
WITH t AS ({C.TRIALS_SQL}),
s AS (
  SELECT event_type, rw,
         round_even(list_sort(list(bw_bytes / 1e6))[count(*) // 2 + 1], 1) AS bw_median_mbs,
         round_even(min(bw_bytes / 1e6), 1) AS bw_min_mbs
  FROM t GROUP BY event_type, rw)
SELECT event_type,
       max(CASE WHEN rw = 'write' THEN bw_median_mbs END) AS write_bw_median_mbs,
       max(CASE WHEN rw = 'write' THEN bw_min_mbs END) AS write_bw_min_mbs,
       max(CASE WHEN rw = 'read' THEN bw_median_mbs END) AS read_bw_median_mbs,
       max(CASE WHEN rw = 'read' THEN bw_min_mbs END) AS read_bw_min_mbs
FROM s GROUP BY event_type"""


def sweep_summary(spark, sf):
    """Raw trials -> F4 MB/s -> A1 median / A2 min -> F5 round -> A11 pivot."""
    stats = agg.sweep_stats(C.trials(spark, sf), ["event_type", "rw"], "bw_bytes")
    return agg.pivot_rw(stats, ["event_type"], "rw", ["bw_median_mbs", "bw_min_mbs"])


query("a11_pivot", SWEEP_SUMMARY_SQL)(sweep_summary)


@query("a1_ordinal_median", f"""
WITH t AS ({C.TRIALS_SQL})
SELECT event_type, user_id, list_sort(list(bw_bytes))[count(*) // 2 + 1] AS median_bw_bytes
FROM t GROUP BY event_type, user_id""")
def a1_ordinal_median(spark, sf):
    return agg.ordinal_median(C.trials(spark, sf), ["event_type", "user_id"], "bw_bytes",
                              "median_bw_bytes").select(
        "event_type", "user_id", F.col("median_bw_bytes").cast("bigint").alias("median_bw_bytes"))


@query("a2_min_passes", f"""
WITH t AS ({C.TRIALS_SQL})
SELECT event_type, rw, min(bw_bytes) AS min_bw_bytes FROM t GROUP BY event_type, rw""")
def a2_min_passes(spark, sf):
    return agg.min_passes(C.trials(spark, sf), ["event_type", "rw"], "bw_bytes", "min_bw_bytes")


@query("f4_rates", f"""
WITH t AS ({C.TRIALS_SQL})
SELECT event_id, bw_bytes / 1e6 AS mbs,
       CASE WHEN (event_id % 5) > 0 THEN bw_bytes * 1000 / 1e9 / (event_id % 5) ELSE 0.0 END AS gbs
FROM t""")
def f4_rates(spark, sf):
    t = C.trials(spark, sf)
    return t.select("event_id", mb_per_s("bw_bytes").alias("mbs"),
                    gb_per_s(F.col("bw_bytes") * 1000, F.col("event_id") % 5).alias("gbs"))


@query("f5_round", """
SELECT event_id, round_even(value, 1) AS r1, round_even(value / 7.0::DOUBLE, 2) AS r2 FROM events""")
def f5_round(spark, sf):
    e = C.table(spark, sf, "events")
    return e.select("event_id", round_half_even("value", 1).alias("r1"),
                    round_half_even(F.col("value") / F.lit(7.0), 2).alias("r2"))


# ---------------------------------------------------------------- curves
@query("w3_gain", f"""
SELECT source, block_size, rate,
       round_even(rate / NULLIF(lag(rate) OVER (PARTITION BY source ORDER BY size_bytes), 0), 6) AS gain
FROM ({C.CURVE_SQL})""")
def w3_gain(spark, sf):
    g = windows.gain(C.size_bucket_curve(spark, sf), ["source"], "size_bytes", "rate")
    return g.select("source", "block_size", "rate", F.bround("gain", 6).alias("gain"))


def _plateau_sql(eps: float) -> str:
    return f"""
WITH g AS (
  SELECT source, size_bytes, rate / NULLIF(lag(rate) OVER (PARTITION BY source ORDER BY size_bytes), 0) AS gain
  FROM ({C.CURVE_SQL})),
l AS (
  SELECT source, size_bytes,
         max(gain) OVER (PARTITION BY source ORDER BY size_bytes
                         ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
  FROM g)
SELECT source, min(CASE WHEN later < {1.0 + eps}::DOUBLE THEN size_bytes END) IS NOT NULL AS plateau,
       coalesce(min(CASE WHEN later < {1.0 + eps}::DOUBLE THEN size_bytes END), max(size_bytes)) AS recommended_size
FROM l GROUP BY source"""


@query("w4_plateau", _plateau_sql(0.10))
def w4_plateau(spark, sf):
    return windows.plateau(C.size_bucket_curve(spark, sf), ["source"], "size_bytes", "rate", eps=0.10)


@query("w5_small_file", f"""
SELECT source, max(CASE WHEN size_bytes < 1048576 THEN rate END) AS best_small, max(rate) AS best_all,
       max(CASE WHEN size_bytes < 1048576 THEN rate END) / NULLIF(max(rate), 0) AS small_ratio,
       max(CASE WHEN size_bytes < 1048576 THEN rate END) / NULLIF(max(rate), 0) < 0.5::DOUBLE AS small_file_penalty
FROM ({C.CURVE_SQL}) GROUP BY source""")
def w5_small_file(spark, sf):
    return windows.small_file_penalty(C.size_bucket_curve(spark, sf), ["source"], "size_bytes", "rate")


@query("a14_peak_at", f"""
SELECT source, max(rate) AS max_rate,
       min(size_bytes) FILTER (WHERE rate = mx) AS size_bytes_at_max
FROM (SELECT *, max(rate) OVER (PARTITION BY source) AS mx FROM ({C.CURVE_SQL})) GROUP BY source""")
def a14_peak_at(spark, sf):
    """Best curve rate per source and the size it came from."""
    return agg.peak_at(C.size_bucket_curve(spark, sf), ["source"], "rate", "size_bytes")


# --- SURVEY 3.2 end to end: events as raw tester outputs of a size sweep ------
# cluster = event_type, block size by user_id (8 sizes), direction by event parity;
# each output holds both directions' bandwidth, the trial picks its own.
def _sizes_list() -> list[str]:
    from .. import dims
    return [lbl for lbl, _ in dims.SWEEP_SIZES]


def tester_outputs(spark, sf):
    e = C.table(spark, sf, "events")
    sizes = F.array(*[F.lit(x) for x in _sizes_list()])
    job = F.struct(F.struct(F.round(F.col("value") * 1e6).cast("bigint").alias("bw_bytes")).alias("read"),
                   F.struct(F.round(F.col("value") * 5e5).cast("bigint").alias("bw_bytes")).alias("write"))
    return e.select(F.col("event_type").alias("cluster"),
                    F.element_at(sizes, (F.col("user_id") % 8 + 1).cast("int")).alias("block_size"),
                    F.when(F.col("event_id") % 2 == 0, "write").otherwise("read").alias("rw"),
                    F.col("event_id").alias("pass"),
                    F.to_json(F.struct(F.array(job).alias("jobs"))).alias("raw"))


def _sweep_summary_df(spark, sf):
    from ..plans import sweep as SW
    trials = SW.trials_from_outputs(tester_outputs(spark, sf))
    return SW.summarize(trials, ["cluster", "block_size"])


def _sweep_sql_base() -> str:
    from .. import dims
    sizes = ", ".join(f"({C.sql_str(l)}, CAST({dims._size_bytes(l)} AS BIGINT))" for l, _ in dims.SWEEP_SIZES)
    return f"""
WITH t AS (
  SELECT event_type AS cluster, {C.sql_list(_sizes_list())}[user_id % 8 + 1] AS block_size,
         CASE WHEN event_id % 2 = 0 THEN 'write' ELSE 'read' END AS rw,
         CASE WHEN event_id % 2 = 0 THEN CAST(round(value * 5e5) AS BIGINT) ELSE CAST(round(value * 1e6) AS BIGINT) END AS bw_bytes
  FROM events),
s AS (
  SELECT cluster, block_size, rw,
         round_even(list_sort(list(bw_bytes / 1e6))[count(*) // 2 + 1], 1) AS med,
         round_even(min(bw_bytes / 1e6), 1) AS mn
  FROM t GROUP BY ALL),
w AS (
  SELECT s.cluster, s.block_size, sz.size_bytes,
         max(CASE WHEN rw = 'write' THEN med END) AS write_bw_median_mbs,
         max(CASE WHEN rw = 'write' THEN mn END) AS write_bw_min_mbs,
         max(CASE WHEN rw = 'read' THEN med END) AS read_bw_median_mbs,
         max(CASE WHEN rw = 'read' THEN mn END) AS read_bw_min_mbs
  FROM s JOIN (VALUES {sizes}) AS sz(block_size, size_bytes) ON s.block_size = sz.block_size
  GROUP BY s.cluster, s.block_size, sz.size_bytes)"""


def _layout_sql() -> str:
    from .. import dims
    vals = ", ".join(f"({lo}, {hi if hi is not None else 'NULL'}, {C.sql_str(c)})" for lo, hi, c in dims.SIZE_CLASSES)
    return f"(VALUES {vals}) AS lc(lo, hi, layout_class)"


@query("sweep_summary", _sweep_sql_base() + f"""
SELECT w.*, lc.layout_class FROM w LEFT JOIN {_layout_sql()}
  ON w.size_bytes >= lc.lo AND (lc.hi IS NULL OR w.size_bytes < lc.hi)""")
def sweep_summary_query(spark, sf):
    """SURVEY 3.2: raw outputs -> S5 bandwidth -> F4 MB/s -> A1/A2 -> F5 -> A11,
    with the storage layout class of each size (J4)."""
    from ..plans import sweep as SW
    return SW.with_layout_class(_sweep_summary_df(spark, sf), spark)


@query("sweep_verdicts", _sweep_sql_base() + """,
g AS (SELECT cluster, size_bytes, read_bw_median_mbs AS r,
             read_bw_median_mbs / NULLIF(lag(read_bw_median_mbs) OVER (PARTITION BY cluster ORDER BY size_bytes), 0) AS gain
      FROM w),
l AS (SELECT *, max(gain) OVER (PARTITION BY cluster ORDER BY size_bytes
                                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM g)
SELECT cluster,
       min(CASE WHEN later < 1.1::DOUBLE THEN size_bytes END) IS NOT NULL AS plateau,
       coalesce(min(CASE WHEN later < 1.1::DOUBLE THEN size_bytes END), max(size_bytes)) AS recommended_size,
       max(CASE WHEN size_bytes < 1048576 THEN r END) AS best_small, max(r) AS best_all,
       max(CASE WHEN size_bytes < 1048576 THEN r END) / NULLIF(max(r), 0) AS small_ratio,
       max(CASE WHEN size_bytes < 1048576 THEN r END) / NULLIF(max(r), 0) < 0.5::DOUBLE AS small_file_penalty
FROM l GROUP BY cluster""")
def sweep_verdicts_query(spark, sf):
    """SURVEY 3.2: W3/W4 plateau and recommended size, W5 small-file penalty, per cluster."""
    from ..plans import sweep as SW
    return SW.curve_verdicts(_sweep_summary_df(spark, sf), ["cluster"], eps=0.10)


def _labels_sql() -> str:
    from .. import dims
    return f"(VALUES {', '.join(f'({C.sql_str(l)}, {C.sql_str(d)})' for l, d in dims.SWEEP_SIZES)}) AS lb(block_size, block_size_label)"


@query("sweep_records", _sweep_sql_base() + f"""
SELECT cluster, 1 AS workers, 3 AS passes, row_number() OVER (PARTITION BY cluster ORDER BY size_bytes) - 1 AS "at",
       block_size_label, w.block_size, write_bw_median_mbs, write_bw_min_mbs, read_bw_median_mbs, read_bw_min_mbs
FROM w JOIN {_labels_sql()} ON lb.block_size = w.block_size""")
def sweep_records_query(spark, sf):
    """K1 shape of SURVEY 3.2: one record per cluster with its ordered sweep array, unfolded to compare."""
    from ..plans import sweep as SW
    rec = SW.to_records(_sweep_summary_df(spark, sf), {"workers": 1, "passes": 3}, ["cluster"])
    x = rec.select("cluster", "workers", "passes", F.posexplode("sweep").alias("at", "e"))
    return x.select("cluster", "workers", "passes", F.col("at").cast("bigint").alias("at"), "e.block_size_label", "e.block_size",
                    "e.write_bw_median_mbs", "e.write_bw_min_mbs", "e.read_bw_median_mbs", "e.read_bw_min_mbs")


@query("k1_named_documents", _sweep_sql_base() + """
SELECT 'storage_sweep_' || cluster || '.json' AS file, 'Storage Sweep' AS bench, cluster,
       CAST(row_number() OVER (PARTITION BY cluster ORDER BY size_bytes) - 1 AS BIGINT) AS "at", w.block_size, read_bw_median_mbs
FROM w""")
def k1_named_documents(spark, sf):
    """K1 -> S1 -> S2 -> S3 -> S6: every sweep record as a named file, read back with the registry's prefixes,
    recognised by its name and unfolded; files under other names are not opened."""
    from .. import dims
    from ..operators import joins
    from ..plans import sweep as SW
    from ..sources import documents as D
    rec = SW.to_records(_sweep_summary_df(spark, sf), {"workers": 1, "passes": 3}, ["cluster"])
    path = shared_subdir(spark, "sweep-documents")
    SW.write_records(rec, path, ["cluster"])
    SW.write_records(rec, path, ["cluster"], prefix="not_in_the_registry_")
    rules = dims.registry_rules()
    files = D.read_results(spark, path, prefixes=[p for _, p, _ in rules])
    docs, _ = D.split_valid(D.parse_documents(joins.classify(files, "stem", rules, "inner")))
    x = docs.select("file", "bench", D.extract_path("doc", "$.cluster", "string").alias("cluster"),
                    F.posexplode(D.extract_path("doc", "$.sweep", "array<struct<block_size string, read_bw_median_mbs double>>")).alias("at", "e"))
    return x.select("file", "bench", "cluster", F.col("at").cast("bigint").alias("at"), "e.block_size", "e.read_bw_median_mbs")
