"""Cluster and grid bindings: supplier x nation x region as nodes/clusters
(P9, F7-F10, F12, F15, F17, J9, F11), orders dates (F13), synthetic
observations per order (S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import (dataset_path, geometric_series, global_batch, headroom, model_sizing,
                         node_class, problem_size, share_pct, task_label)
from ..operators import joins, project
from . import common as C
from . import query

CLUSTERS_SQL = """
SELECT s.s_suppkey, s.s_acctbal, n.n_name, r.r_name, s.s_suppkey % 16 + 1 AS world
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""


def clusters(spark, sf):
    s, n, r = (C.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    x = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.select("s_suppkey", "s_acctbal", "n_name", "r_name",
                    (F.col("s_suppkey") % 16 + 1).alias("world"))


@query("p9_process_grids", f"""
SELECT s_suppkey, world, p, world // p AS q
FROM ({CLUSTERS_SQL}) CROSS JOIN LATERAL (SELECT unnest(generate_series(1, greatest(CAST(floor(sqrt(world)) AS BIGINT), 1))) AS p)
WHERE world % p = 0 AND p <= world // p""")
def p9_process_grids(spark, sf):
    g = project.process_grids(clusters(spark, sf).select("s_suppkey", "world"), "world")
    return g.select("s_suppkey", F.col("world").cast("bigint").alias("world"),
                    F.col("p").cast("bigint").alias("p"), F.col("q").cast("bigint").alias("q"))


@query("f7_node_class", f"""
SELECT s_suppkey, world, CASE WHEN world <= 8 THEN '1node' ELSE '2node' END AS node_class FROM ({CLUSTERS_SQL})""")
def f7_node_class(spark, sf):
    return clusters(spark, sf).select("s_suppkey", F.col("world").cast("bigint").alias("world"),
                                      node_class("world").alias("node_class"))


@query("f8_global_batch", f"""
SELECT s_suppkey, 32 * world AS global_batch_size FROM ({CLUSTERS_SQL})""")
def f8_global_batch(spark, sf):
    return clusters(spark, sf).select("s_suppkey", global_batch(F.lit(32), "world").alias("global_batch_size"))


@query("f9_model_sizing", f"""
WITH c AS (SELECT s_suppkey, world,
                  CASE WHEN s_acctbal <= 0 THEN 6000000000
                       ELSE CAST(floor(s_acctbal / 1000 * 1e9 / 2.0::DOUBLE) AS BIGINT) END AS params
           FROM ({CLUSTERS_SQL}))
SELECT s_suppkey, params, params // world AS params_per_rank, (params // world) // 100000000 AS blocks FROM c""")
def f9_model_sizing(spark, sf):
    """model of (account balance / 1000) GB, default size when negative."""
    c = clusters(spark, sf)
    gb = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / F.lit(1000.0))
    params, per_rank, blocks = model_sizing(gb, F.col("world"))
    return c.select("s_suppkey", params.alias("params"), per_rank.alias("params_per_rank"), blocks.alias("blocks"))


@query("f10_problem_size", f"""
SELECT s_suppkey, CAST(floor(sqrt(0.8::DOUBLE * (world * 80e9) / 8.0::DOUBLE)) AS BIGINT) AS hpl_n FROM ({CLUSTERS_SQL})""")
def f10_problem_size(spark, sf):
    """Linpack N for 80 GB of device memory per rank."""
    c = clusters(spark, sf)
    return c.select("s_suppkey", problem_size(F.col("world") * F.lit(80e9)).alias("hpl_n"))


@query("f12_dataset_path", f"""
SELECT s_suppkey,
       coalesce('/mnt/scratch/lerobot-datasets/' ||
                regexp_replace(CASE WHEN s_suppkey % 5 <> 0 THEN lower(r_name) || '/' || lower(replace(n_name, ' ', '-')) END,
                               '^([^/]*)/', '\\1--'),
                '/mnt/scratch/fallback-dataset') AS dataset_path
FROM ({CLUSTERS_SQL})""")
def f12_dataset_path(spark, sf):
    """'<region>/<nation>' slugs become '<region>--<nation>' under the root;
    every fifth cluster has no slug and takes the fallback path."""
    c = clusters(spark, sf)
    slug = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lower("r_name"), F.lit("/"),
                                                         F.lower(F.regexp_replace("n_name", " ", "-"))))
    return c.select("s_suppkey", dataset_path(slug, F.lit("/mnt/scratch/lerobot-datasets"),
                                              F.lit("/mnt/scratch/fallback-dataset")).alias("dataset_path"))


@query("f12_existing_folder", f"""
WITH c AS (SELECT s_suppkey, '/mnt/' || lower(r_name) || '--' || lower(replace(n_name, ' ', '-')) AS path FROM ({CLUSTERS_SQL})),
     h AS (SELECT DISTINCT '/mnt/' || lower(r_name) || '--' || lower(replace(n_name, ' ', '-')) AS path
           FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0)
SELECT s_suppkey, coalesce(h.path, '/mnt/fallback') AS dataset_path FROM c LEFT JOIN h USING (path)""")
def f12_existing_folder(spark, sf):
    """the folder of two thirds of the nations exists; clusters of the others take the fallback."""
    name = F.concat(F.lower("r_name"), F.lit("/"), F.lower(F.regexp_replace("n_name", " ", "-")))
    c = clusters(spark, sf).select("s_suppkey", dataset_path(name, F.lit("/mnt")).alias("path"), F.lit("/mnt/fallback").alias("other"))
    n = C.table(spark, sf, "nation").join(C.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folders = n.where("n_nationkey % 3 <> 0").select(dataset_path(name, F.lit("/mnt")).alias("path"))
    return joins.existing_folder(c, "path", folders, "other").select("s_suppkey", "dataset_path")


@query("f13_task_label", """
SELECT o_orderkey, o_orderpriority || ' — ' || o_orderstatus || ' — ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || ' UTC' AS task_name
FROM orders""")
def f13_task_label(spark, sf):
    o = C.table(spark, sf, "orders")
    return o.select("o_orderkey", task_label("o_orderpriority", "o_orderstatus", "o_orderdate").alias("task_name"))


@query("f15_headroom", f"""
SELECT s_suppkey, round_even((abs(s_acctbal) / 100 + 1) / 288.0::DOUBLE * 100, 9) AS mem_share_pct,
       CAST(floor(288.0::DOUBLE / (abs(s_acctbal) / 100 + 1)) AS BIGINT) AS batch_headroom
FROM ({CLUSTERS_SQL})""")
def f15_headroom(spark, sf):
    """memory used of a 288 GB device and how many times the batch fits."""
    c = clusters(spark, sf).withColumn("used", F.abs("s_acctbal") / F.lit(100.0) + F.lit(1.0))
    return c.select("s_suppkey", F.bround(share_pct("used", F.lit(288.0)), 9).alias("mem_share_pct"),
                    headroom("used", F.lit(288.0)).alias("batch_headroom"))


# --- fixed values: verdict bands on a share of peak (the collective band is 40-55 %)
BANDS = [(0.0, 40.0, "below expected"), (40.0, 55.0, "typical"), (55.0, None, "above typical")]


@query("f17_verdict", f"""
WITH c AS (SELECT s_suppkey, (abs(s_acctbal) / 100 + 1) / 288.0::DOUBLE * 100 * 2 AS share FROM ({CLUSTERS_SQL}))
SELECT s_suppkey, round_even(share, 9) AS share, b.verdict
FROM c LEFT JOIN (VALUES {", ".join(f"({lo}::DOUBLE, {'NULL' if hi is None else str(hi) + '::DOUBLE'}, {C.sql_str(v)})" for lo, hi, v in BANDS)}) AS b(lo, hi, verdict)
  ON c.share >= b.lo AND (b.hi IS NULL OR c.share < b.hi)""")
def f17_verdict(spark, sf):
    """a share of peak put in its verdict band ."""
    c = clusters(spark, sf).withColumn(
        "share", share_pct(F.abs("s_acctbal") / F.lit(100.0) + F.lit(1.0), F.lit(288.0)) * F.lit(2.0))
    v = c.withColumn("verdict", joins.size_class_fixed(F.col("share"), BANDS))
    return v.select("s_suppkey", F.bround("share", 9).alias("share"), "verdict")


def _sizes_sql() -> str:
    return C.sql_list([lbl for lbl, _ in dims.SWEEP_SIZES])


@query("j9_trial_grid", f"""
SELECT s_suppkey, block_size, rw, pass
FROM supplier, (SELECT unnest({_sizes_sql()}) AS block_size), (SELECT unnest(['write', 'read']) AS rw),
     (SELECT unnest([1, 2, 3]) AS pass)""")
def j9_trial_grid(spark, sf):
    """Per cluster (supplier) every sweep size x direction x pass: 48 trials each."""
    n = C.table(spark, sf, "supplier").select("s_suppkey")
    g = joins.trial_grid(n, {"block_size": [lbl for lbl, _ in dims.SWEEP_SIZES], "rw": ["write", "read"],
                             "pass": [1, 2, 3]})
    return g.withColumn("pass", F.col("pass").cast("int"))


@query("j9_config_grid", f"""
SELECT s_suppkey, n, nb, p, world // p AS q
FROM ({CLUSTERS_SQL}),
     (SELECT unnest([100000, 150000, 200000]) AS n), (SELECT unnest([336, 512]) AS nb),
     (SELECT unnest(generate_series(1, 4)) AS p)
WHERE world % p = 0 AND p <= world // p""")
def j9_config_grid(spark, sf):
    """Config lists (Ns, NBs, process grids) combined as a product per cluster."""
    c = clusters(spark, sf).select("s_suppkey", "world")
    c = c.withColumn("ns", F.array(*[F.lit(x) for x in (100000, 150000, 200000)])) \
         .withColumn("nbs", F.array(F.lit(336), F.lit(512)))
    g = joins.expand_grid(c, ["ns", "nbs"])
    g = project.process_grids(g, "world")
    return g.select("s_suppkey", F.col("ns").cast("int").alias("n"), F.col("nbs").cast("int").alias("nb"),
                    F.col("p").cast("bigint").alias("p"), F.col("q").cast("bigint").alias("q"))


@query("f11_geometric", f"""
SELECT s_suppkey, CAST(i AS INT) AS idx, CAST(1048576 * pow(2, i) AS BIGINT) AS size_bytes
FROM ({CLUSTERS_SQL}), LATERAL (SELECT unnest(generate_series(0, s_suppkey % 14)) AS i)""")
def f11_geometric(spark, sf):
    """message sizes from 1 MiB doubling up to 1 MiB x 2^(key mod 14), inclusive."""
    c = clusters(spark, sf).select(
        "s_suppkey", (F.lit(1048576) * F.pow(F.lit(2), F.col("s_suppkey") % 14)).cast("bigint").alias("end"))
    s = c.select("s_suppkey", F.posexplode(geometric_series(F.lit(1048576), F.lit(2), "end")).alias("idx", "size_bytes"))
    return s.withColumn("idx", F.col("idx").cast("int"))
