"""Golden cases (FIXTURES F9) for the column expressions and lookups."""

import pytest
from pyspark.sql import functions as F

from benchlens import dims
from benchlens.functions import (dataset_path, format_size, gb_per_s, geometric_series, mfu_pct, model_sizing,
                                 node_class, parse_size, round_half_even)
from benchlens.functions import test_file_size as file_size_for_block
from benchlens.functions import sizes
from benchlens.operators import agg, joins, project, windows


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("label,expected", [("64k", 65536), ("4M", 4194304), ("1g", 1073741824), ("512", 512),
                                            ("1.5m", None), ("4mb", None), ("", None), ("k", None)])
def test_parse_size(spark, label, expected):
    assert one(spark, parse_size(F.lit(label))) == expected


def test_test_file_size_and_format(spark):
    assert one(spark, file_size_for_block(parse_size(F.lit("64k")))) == 64 * 1024 ** 2
    assert one(spark, file_size_for_block(parse_size(F.lit("1g")))) == 4 * 1024 ** 3
    assert one(spark, format_size(F.lit(4 * 1024 ** 2))) == "4m"
    assert one(spark, format_size(F.lit(65536))) == "64k"


def test_rates_and_rounding(spark):
    assert one(spark, gb_per_s(F.lit(1e9), F.lit(0.0))) == 0.0
    assert one(spark, gb_per_s(F.lit(2e9), F.lit(2.0))) == 1.0
    assert one(spark, round_half_even(F.lit(0.25), 1)) == 0.2
    assert one(spark, round_half_even(F.lit(0.35), 1)) == 0.4


def test_node_class(spark):
    df = spark.createDataFrame([(8,), (9,), (16,)], "w int")
    assert [r[0] for r in df.select(node_class("w")).collect()] == ["1node", "2node", "2node"]


def test_device_lookup_first_match_default_override(spark):
    df = spark.createDataFrame([("NVIDIA B300 SXM6 AC",), ("NVIDIA H100 80GB HBM3",), ("h100 nvl sxm",), (None,)],
                               "gpu string")
    out = joins.lookup_first_match(df, "gpu", dims.peak_flops(spark), "flops", default=dims.DEFAULT_PEAK_FLOPS)
    got = {r["gpu"]: r["flops"] for r in out.collect()}
    assert got["NVIDIA B300 SXM6 AC"] == 9000e12
    assert got["NVIDIA H100 80GB HBM3"] == 989e12          # no pattern hits -> default
    assert got["h100 nvl sxm"] == 989e12                   # both SXM (1) and NVL (2) match: order wins
    assert got[None] == 989e12
    ov = joins.lookup_first_match(df, "gpu", dims.peak_flops(spark), "flops", default=1.0, override=5.0)
    assert {r["flops"] for r in ov.collect()} == {5.0}


def test_model_sizing(spark):
    p, r, b = model_sizing(F.lit(None).cast("double"), F.lit(8))
    row = spark.range(1).select(p.alias("p"), r.alias("r"), b.alias("b")).first()
    assert (row.p, row.r, row.b) == (6_000_000_000, 750_000_000, 7)
    p0, _, _ = model_sizing(F.lit(0.0), F.lit(8))  # zero is falsy in the producer: default too
    assert one(spark, p0) == 6_000_000_000
    p1, r1, b1 = model_sizing(F.lit(1.4), F.lit(1))
    row = spark.range(1).select(p1.alias("p"), r1.alias("r"), b1.alias("b")).first()
    assert (row.p, row.r, row.b) == (700_000_000, 700_000_000, 7)


def test_mfu_null_for_missing_or_zero(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1e15,)], "f double")
    vals = [r[0] for r in df.select(mfu_pct("f", F.lit(1.0), F.lit(1e15), F.lit(8))).collect()]
    assert vals[0] is None and vals[1] is None and vals[2] == pytest.approx(12.5)


def test_rounds_mean_cold_warm(spark):
    df = spark.createDataFrame([([1.28, 10.5, 10.5],)], "r array<double>")
    cold, warm, _ = agg.cold_warm_array("r")
    row = df.select(F.bround(agg.mean_array("r"), 2).alias("m"), cold.alias("c"), warm.alias("w")).first()
    assert (row.m, row.c, row.w) == (7.43, 1.28, 10.5)


def test_geometric_series(spark):
    n = one(spark, F.size(geometric_series(F.lit(1024 ** 2), F.lit(2), F.lit(8 * 1024 ** 3))))
    assert n == 14
    s = one(spark, geometric_series(F.lit(65536), F.lit(4), F.lit(1024 ** 3)))
    assert len(s) == 8 and s[-1] == 1024 ** 3


def test_trial_grid_and_process_grids(spark):
    df = spark.createDataFrame([(1, [100, 200, 300], [336, 512], [1, 2, 3])], "id int, ns array<int>, nbs array<int>, pf array<int>")
    assert joins.expand_grid(df, ["ns", "nbs", "pf"]).count() == 18
    g = project.process_grids(spark.createDataFrame([(8,)], "ranks int"), "ranks")
    assert sorted((r.p, r.q) for r in g.collect()) == [(1, 8), (2, 4)]


def test_dataset_path(spark):
    p = one(spark, dataset_path(F.lit("physical-intelligence/libero"), F.lit("/mnt/x/lerobot-datasets")))
    assert p == "/mnt/x/lerobot-datasets/physical-intelligence--libero"
    fb = one(spark, dataset_path(F.lit(None).cast("string"), F.lit("/r"), F.lit("/fallback")))
    assert fb == "/fallback"


def test_classification(spark):
    df = spark.createDataFrame([("pi05_1n8g_7",), ("pi05_ckpt_1n_7",), ("storage_sweep_7",)], "stem string")
    orig = {r.stem: r.prefix for r in joins.classify(df, "stem", dims.registry(spark, False)).collect()}
    assert orig == {"pi05_1n8g_7": "pi05_1n", "pi05_ckpt_1n_7": "pi05_ckpt", "storage_sweep_7": None}
    ext = {r.stem: r.bench for r in joins.classify(df, "stem", dims.registry(spark)).collect()}
    assert ext["storage_sweep_7"] == "Storage Sweep"


def test_plateau_on_published_read_curve(spark):
    curve = dims.baseline_sweep(spark).where("rw = 'read'").withColumn("s", F.lit(1))
    p10 = windows.plateau(curve, ["s"], "bytes", "mbs", eps=0.10).first()
    assert (p10.plateau, p10.recommended_size) == (False, 1024 ** 3)
    p25 = windows.plateau(curve, ["s"], "bytes", "mbs", eps=0.25).first()
    assert (p25.plateau, p25.recommended_size) == (True, 64 * 1024 ** 2)
    g = windows.gain(curve, ["s"], "bytes", "mbs").where("block_size = '1g'").first()
    assert round(g.gain, 3) == 1.118


def test_published_efficiencies(spark):
    b = dims.baseline(spark)
    e = joins.efficiency(b.select("metric", "value"), "metric", "value", b)
    got = {r.metric: r for r in e.collect()}
    assert round(got["hpl_fp64_per_gpu"].pct_of_peak) == 78
    assert round(got["stream_triad"].pct_of_peak, 1) == 88.6
    assert round(got["allreduce_busbw"].pct_of_peak) == 46
    assert round(got["train_mem_per_gpu"].pct_of_peak) == 24
    assert round(got["stream_triad"].vs_other, 1) == 2.1


def test_lookup_peak_and_expected_read_time(spark):
    df = spark.createDataFrame([("NVIDIA B300 SXM6 AC",), ("RTX",)], "gpu string")
    got = {r.gpu: r.peak_flops for r in joins.lookup_peak(df, "gpu").collect()}
    assert got == {"NVIDIA B300 SXM6 AC": 9000e12, "RTX": 989e12}
    files = spark.createDataFrame([(1, 1024 ** 3), (2, 1000), (3, 3 * 1024 ** 2)], "id int, size long")
    t = {r.id: r for r in joins.expected_read_time(files, "size", dims.published_curve(spark)).collect()}
    assert t[1].expected_s == pytest.approx(1024 ** 3 / 1e6 / 7064.1)
    assert t[2].expected_s is None
    assert t[3].read_mbs == 306.4  # 1 MB <= 3 MiB < 4 MB


def test_first_match_fixed_equals_table(spark):
    names = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(
        F.concat_ws(" ", "p_type", "p_brand", F.col("p_size").cast("string")).alias("device"))
    rows = [(1, "standard.*brand#1[0-9]", 1.5e15), (2, "standard", 1.0e15), (3, "brand#2", 8.0e14)]
    table = spark.createDataFrame(rows, "ord INT, pattern STRING, flops DOUBLE")
    a = joins.lookup_first_match(names, "device", table, "flops", default=1.0)
    b = names.withColumn("flops", joins.first_match_fixed(F.col("device"), rows, "double", 1.0))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert "NestedLoopJoin" not in a._jdf.queryExecution().executedPlan().toString()


def test_fixed_ranges_and_curves_equal_tables(spark):
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", (F.col("n_chars") * 1024).alias("bytes"))
    a = joins.size_class(files, "bytes", dims.size_classes(spark)).collect()
    b = files.withColumn("class", joins.size_class_fixed(F.col("bytes"), dims.SIZE_CLASSES)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    x = joins.asof_lookup(files, "bytes", dims.published_curve(spark), "curve_bytes", ["read_mbs"]).collect()
    points = [(dims._size_bytes(lbl), r) for lbl, _, r in dims.BASELINE_SWEEP]
    y = joins.asof_fixed(files, "bytes", points, ["curve_bytes", "read_mbs"], ["bigint", "double"]).collect()
    key = lambda r: (r.doc_id, r.bytes, r.curve_bytes, r.read_mbs)
    assert sorted(map(key, x)) == sorted(map(key, y))


def test_oversized_label_is_null(spark):
    df = spark.createDataFrame([("9223372036854775g",), ("99999999999999999999",), ("8g",)], "s string")
    assert [r.b for r in df.select(sizes.parse_size("s").alias("b")).collect()] == [None, None, 8 * 1024 ** 3]


def test_one_sided_clusters_stay(spark):
    c = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, train double")
    s = spark.createDataFrame([("a", 3.0), ("c", 1.0)], "k string, store double")
    got = {r.k: (r.headroom, r.bottleneck) for r in joins.bottleneck(c, s, ["k"], "train", "store").collect()}
    assert got == {"a": (3.0, "compute_or_network"), "b": (None, None), "c": (None, None)}
    n = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 2, 3.0)], "k string, nodes int, v double")
    assert {r.k: r.scale_ratio for r in joins.scaling(n, ["k"], "nodes", "v").collect()} == {"a": 1.5, "b": None}


def test_curve_keeps_every_file(spark):
    from benchlens.bindings import common
    sf = "/root/testdata/sf0.001"
    n = common.size_bucket_curve(spark, sf).agg(F.sum("n_files")).first()[0]
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count()
