"""Wide-metric bindings: lineitem as one result per line (P1-P3, P6, P8, A15, A17,
F14, U1, K2, K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import metric_text
from ..operators import agg, project, setops
from ..session import shared_subdir
from . import common as C
from . import query

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Declared metrics (key, label, aliases): the canonical keys do not exist in
# lineitem, the aliases do, as with producers that write other key names.
DECLARED = [("quantity", "qty", ["l_quantity"]), ("extendedprice", "price", ["l_extendedprice"]),
            ("discount", "disc", ["l_discount"]), ("tax", "tax", ["l_tax"])]
LABELS = [lbl for _, lbl, _ in DECLARED]

PROJECTED_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
       l_quantity AS qty, l_extendedprice AS price, l_discount + 0.0 AS disc, l_tax AS tax
FROM lineitem"""


def projected(spark, sf):
    li = C.table(spark, sf, "lineitem")
    p = project.project_metrics(li, DECLARED, KEYS + ["l_returnflag", "l_linestatus"])
    return p.withColumn("disc", F.col("disc") + F.lit(0.0))


@query("p1_project_metrics", PROJECTED_SQL)
def p1_project_metrics(spark, sf):
    return projected(spark, sf)


@query("p2_unpivot", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, metric, value
FROM (UNPIVOT ({PROJECTED_SQL}) ON qty, price, disc, tax INTO NAME metric VALUE value)""")
def p2_unpivot(spark, sf):
    return project.to_scalars(projected(spark, sf).drop("l_returnflag", "l_linestatus"), KEYS, LABELS)


# Lines with tax 0.08 have no tax reading (NULL); zero discounts stay points.
SPARSE_SQL = """
SELECT l_orderkey, l_linenumber, l_discount + 0.0 AS disc, NULLIF(l_tax, 0.08::DOUBLE) AS tax FROM lineitem"""


@query("p3_null_suppress", f"""
SELECT metric, count(*) AS n_points, count(*) FILTER (WHERE value = 0) AS n_zero
FROM (UNPIVOT ({SPARSE_SQL}) ON disc, tax INTO NAME metric VALUE value) GROUP BY metric""")
def p3_null_suppress(spark, sf):
    li = C.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") + F.lit(0.0)).alias("disc"),
        F.nullif(F.col("l_tax"), F.lit(0.08)).alias("tax"))
    pts = project.to_scalars(li, ["l_orderkey", "l_linenumber"], ["disc", "tax"])
    return pts.groupBy("metric").agg(F.count("*").alias("n_points"),
                                     F.count(F.when(F.col("value") == 0, 1)).alias("n_zero"))


@query("p6_placeholder", """
SELECT l_orderkey, l_linenumber,
       coalesce(CAST(CASE WHEN l_quantity <= 45 THEN l_quantity END AS VARCHAR), '—') AS qty,
       coalesce(CAST(NULLIF(l_tax, 0.08::DOUBLE) AS VARCHAR), '—') AS tax
FROM lineitem""")
def p6_placeholder(spark, sf):
    li = C.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("qty"),
        F.nullif(F.col("l_tax"), F.lit(0.08)).alias("tax"))
    return project.with_placeholders(li, ["qty", "tax"])


@query("p8_validity", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.05::DOUBLE THEN 'PASSED' ELSE 'FAILED' END AS status
FROM lineitem""")
def p8_validity(spark, sf):
    """The discount plays the residual, 0.05 the threshold."""
    li = C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return project.validate(li, "l_discount", 0.05).drop("l_discount")


@query("f14_metric_text", """
SELECT l_orderkey, l_linenumber,
       array_to_string(list_filter([
         CASE WHEN l_quantity IS NOT NULL THEN 'Qty: ' || CAST(l_quantity AS VARCHAR) END,
         CASE WHEN NULLIF(l_tax, 0.08::DOUBLE) IS NOT NULL THEN 'Tax: ' || CAST(NULLIF(l_tax, 0.08::DOUBLE) AS VARCHAR) END,
         CASE WHEN l_discount IS NOT NULL THEN 'Disc: ' || CAST(l_discount + 0.0 AS VARCHAR) END],
         lambda x: x IS NOT NULL), '  ') AS metrics_text
FROM lineitem""")
def f14_metric_text(spark, sf):
    li = C.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.nullif(F.col("l_tax"), F.lit(0.08)).alias("tax"),
        (F.col("l_discount") + F.lit(0.0)).alias("disc"))
    return li.select("l_orderkey", "l_linenumber",
                     metric_text([("Qty", "l_quantity"), ("Tax", "tax"), ("Disc", "disc")]).alias("metrics_text"))


@query("a15_series", """
WITH p AS (SELECT l_returnflag || l_linestatus AS series, metric, min(o) AS o, sum(value) AS v
           FROM (UNPIVOT (SELECT l_returnflag, l_linestatus, CAST(round(l_quantity * 100) AS BIGINT) AS "1_qty",
                                 CAST(round(l_tax * 100) AS BIGINT) AS "2_tax",
                                 CAST(round(l_discount * 100) AS BIGINT) AS "3_disc" FROM lineitem)
                 ON "1_qty", "2_tax", "3_disc" INTO NAME metric VALUE value)
                CROSS JOIN LATERAL (SELECT CAST(split_part(metric, '_', 1) AS INT) AS o) GROUP BY ALL)
SELECT series, string_agg(split_part(metric, '_', 2), ',' ORDER BY o) AS categories,
       string_agg(CAST(v AS VARCHAR), ',' ORDER BY o) AS data
FROM p GROUP BY series""")
def a15_series(spark, sf):
    """Per (returnflag, linestatus) series the totals of three metrics (in
    hundredths, so sums are exact integers), in a fixed category order."""
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    li = C.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("series"),
        cents("l_quantity").alias("qty"), cents("l_tax").alias("tax"), cents("l_discount").alias("disc"))
    long = project.to_scalars(li, ["series"], ["qty", "tax", "disc"], "cat", "val")
    long = long.withColumn("o", F.when(F.col("cat") == "qty", 1).when(F.col("cat") == "tax", 2).otherwise(3))
    s = agg.to_series(long, "series", "o", "cat", "val")
    return s.select("series", F.array_join("categories", ",").alias("categories"),
                    F.array_join(F.transform("data", lambda v: v.cast("string")), ",")
                    .alias("data"))


@query("a17_per_device", """
SELECT l_returnflag, l_linestatus, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 AS total,
       count(*) AS devices,
       round_even(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 / count(*), 6) AS per_device
FROM lineitem GROUP BY ALL""")
def a17_per_device(spark, sf):
    """Group total (exact, in hundredths) and the same per line (each line one device)."""
    li = C.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus",
                                               C.cents("l_extendedprice").alias("cents"), F.lit(1).alias("one"))
    out = agg.per_device(li, ["l_returnflag", "l_linestatus"], "cents", "one")
    return out.select("l_returnflag", "l_linestatus", (F.col("total") / 100).alias("total"),
                      F.col("devices").cast("bigint").alias("devices"),
                      F.bround(F.col("total") / 100 / F.col("devices"), 6).alias("per_device"))


@query("u1_summary_union", """
SELECT 'lineitem' AS bench, l_returnflag || l_linestatus AS item, round_even(sum(l_quantity), 4) AS qty,
       NULL::DOUBLE AS mean_value, count(*) AS n
FROM lineitem GROUP BY ALL
UNION ALL
SELECT 'events' AS bench, event_type AS item, NULL::DOUBLE AS qty, round_even(avg(CAST(round(value * 100) AS BIGINT)) / 100, 6) AS mean_value, count(*) AS n
FROM events GROUP BY ALL""")
def u1_summary_union(spark, sf):
    li = C.table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("item")).agg(
        F.bround(F.sum("l_quantity"), 4).alias("qty"), F.count("*").alias("n")).withColumn("bench", F.lit("lineitem"))
    ev = C.table(spark, sf, "events").groupBy(F.col("event_type").alias("item")).agg(
        F.bround(F.avg(C.cents("value")) / 100, 6).alias("mean_value"), F.count("*").alias("n")).withColumn("bench", F.lit("events"))
    return setops.summary_union([li, ev]).select("bench", "item", "qty", "mean_value", "n")


@query("k2_scalars_roundtrip", f"""
SELECT l_returnflag AS bench, l_orderkey, l_linenumber, metric, value
FROM (UNPIVOT ({PROJECTED_SQL}) ON qty, price, disc, tax INTO NAME metric VALUE value)""")
def k2_scalars_roundtrip(spark, sf):
    """K2: long points written partitioned by benchmark, then read back."""
    p = projected(spark, sf).withColumnRenamed("l_returnflag", "bench")
    pts = project.to_scalars(p, ["bench", "l_orderkey", "l_linenumber"], LABELS)
    path = shared_subdir(spark, "scalars")
    sinks.write_scalars(pts, path)
    return spark.read.parquet(path).select("bench", "l_orderkey", "l_linenumber", "metric", "value")


@query("k2_rerun", f"""
SELECT l_returnflag AS bench, l_orderkey, l_linenumber, metric, CASE WHEN l_returnflag = 'A' THEN value * 2 ELSE value END AS value
FROM (UNPIVOT ({PROJECTED_SQL}) ON qty, price, disc, tax INTO NAME metric VALUE value) WHERE l_returnflag <> 'N'""")
def k2_rerun(spark, sf):
    """K2: all benchmarks written, then a run about two of them, with other values for the one and none for the other:
    the first is replaced, the second empties, the third stays."""
    p = projected(spark, sf).withColumnRenamed("l_returnflag", "bench")
    pts = project.to_scalars(p, ["bench", "l_orderkey", "l_linenumber"], LABELS)
    path = shared_subdir(spark, "scalars")
    sinks.write_scalars(pts, path)
    sinks.write_scalars(pts.where("bench = 'A'").withColumn("value", F.col("value") * 2), path, covered=["A", "N"])
    return sinks.read_committed(spark, path).select("bench", "l_orderkey", "l_linenumber", "metric", "value")


@query("k3_summary_roundtrip", """
SELECT l_returnflag AS bench, l_linestatus, round_even(sum(l_quantity), 4) AS qty, round_even(avg(CAST(round(l_discount * 100) AS BIGINT)) / 100, 6) AS disc,
       count(*) AS n
FROM lineitem GROUP BY ALL""")
def k3_summary_roundtrip(spark, sf):
    """K3: wide summary rows written partitioned by benchmark, then read back."""
    li = C.table(spark, sf, "lineitem")
    s = li.groupBy(F.col("l_returnflag").alias("bench"), "l_linestatus").agg(
        F.bround(F.sum("l_quantity"), 4).alias("qty"), F.bround(F.avg(C.cents("l_discount")) / 100, 6).alias("disc"),
        F.count("*").alias("n"))
    path = shared_subdir(spark, "summary")
    sinks.write_summary(s, path)
    return spark.read.parquet(path).select("bench", "l_linestatus", "qty", "disc", "n")
