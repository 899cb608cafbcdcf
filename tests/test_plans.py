"""End-to-end plans: report over result files, sweep summary, run and
checkpoint summaries, streaming ingest."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from benchlens.plans import report as R
from benchlens.plans import runs, sweep


@pytest.fixture
def results(tmp_path):
    d = tmp_path / "res"
    d.mkdir()
    train = {"schema": ["pi05_train", "1node"], "gpu": "NVIDIA B300 SXM6 AC", "world_size": 8,
             "batch_size_per_gpu": 32, "global_batch_size": 256, "warmup_steps": 20, "measure_steps": 80,
             "elapsed_s": 78.4, "steps_per_sec": 1.02, "samples_per_sec": 262.0, "peak_mem_gb": 68.8,
             "mfu_pct": None}
    (d / "pi05_1n8g_7.json").write_text(json.dumps(train))
    (d / "pi05_1n8g_9.json").write_text(json.dumps({**train, "steps_per_sec": 0.0, "gpu": None}))
    (d / "pi05_ckpt_1n_7.json").write_text(json.dumps({"world_size": 8, "checkpoint_size_gb": 11.2,
                                                       "save_gb_s": 7.43, "load_gb_s": 8}))
    (d / "storage_sweep_7.json").write_text(json.dumps({"workers": 1, "passes": 3, "sweep": []}))
    (d / "hpl_bad.json").write_text("{oops")
    (d / "misc_1.json").write_text("{}")
    return str(d)


def test_report(spark, results):
    rep = R.report(spark, results, cluster="c1", at=dt.datetime(2026, 6, 24, 12, 0))
    assert {r.file for r in rep.unknown.collect()} == {"misc_1.json"}
    assert {r.file for r in rep.rejected.collect()} == {"hpl_bad.json"}
    sc = {(r.series, r.title): (r.value, r.iteration) for r in rep.scalars.collect()}
    # alias fills the canonical key; NULL metric suppressed; zero kept
    assert sc[("pi05_1n8g_7.json", "Peak GPU Mem GB")] == (68.8, 0)
    assert ("pi05_1n8g_7.json", "MFU %") not in sc
    assert sc[("pi05_1n8g_9.json", "Steps/s")] == (0.0, 1)
    assert sc[("pi05_ckpt_1n_7.json", "Save GB/s")] == (7.43, 0)
    params = {(r.bench, r.param): (r.value, r.is_null) for r in rep.params.collect()}
    assert params[("π₀.₅ Training (1 node × 8 GPU)", "gpu_name")] == ('"NVIDIA B300 SXM6 AC"', False)
    assert params[("π₀.₅ Training (1 node × 8 GPU)", "per_gpu_batch_size")] == ("32", False)
    assert ("Storage Sweep", "workers") in params
    cmp_ = rep.comparison.collect()
    assert {r.bench for r in cmp_} == {"π₀.₅ Training (1 node × 8 GPU)"}
    disp = {(r.file, r.key): r.display for r in cmp_}
    assert disp[("pi05_1n8g_7.json", "mfu_pct")] == "None"          # present but null
    assert disp[("pi05_1n8g_7.json", "peak_gpu_mem_gb")] == "—"      # absent under that name
    lines = {r.file: r.text for r in rep.lines.collect()}
    # an integer value prints as the producer's value does ('8', not '8.0')
    assert lines["pi05_ckpt_1n_7.json"] == "Save GB/s: 7.43  Load GB/s: 8  Checkpoint Size GB: 11.2"
    tasks = {r.bench: r for r in rep.tasks.collect()}
    assert tasks["π₀.₅ Checkpoint"].task_name == "π₀.₅ Checkpoint — c1 — 2026-06-24 12:00 UTC"
    assert [t.bench for t in sorted(tasks.values(), key=lambda t: t.ord)][0] == "π₀.₅ Training (1 node × 8 GPU)"


def test_write_report(spark, results, tmp_path):
    rep = R.report(spark, results, cluster="c1", at=dt.datetime(2026, 6, 24, 12, 0))
    out = str(tmp_path / "out")
    R.write_report(rep, out)
    back = spark.read.parquet(f"{out}/scalars").where("bench = 'π₀.₅ Checkpoint'")
    assert {r.title for r in back.collect()} == {"Save GB/s", "Load GB/s", "Checkpoint Size GB"}
    assert spark.read.json(f"{out}/tasks").count() == 3


def test_report_empty_is_error(spark, tmp_path):
    (tmp_path / "x_1.json").write_text("{}")
    with pytest.raises(ValueError):
        R.report(spark, str(tmp_path))


def test_sweep_plan(spark):
    clusters = spark.createDataFrame([("c1",)], "cluster string")
    plan = sweep.plan_trials(clusters, passes=3, max_bytes=256 * 1024 ** 2)
    assert plan.count() == 7 * 2 * 3
    # raw tester outputs: bandwidths chosen so the median is the upper middle element
    raw = plan.withColumn("bw", F.when(F.col("rw") == "read", 2e6).otherwise(1e6) * F.col("pass")) \
              .withColumn("raw", F.to_json(F.struct(F.array(F.struct(
                  F.struct(F.col("bw").cast("bigint").alias("bw_bytes")).alias("read"),
                  F.struct((F.col("bw") / 2).cast("bigint").alias("bw_bytes")).alias("write"))).alias("jobs"))))
    trials = sweep.trials_from_outputs(raw)
    summ = sweep.summarize(trials, ["cluster", "block_size"])
    r = summ.where("block_size = '4m'").first()
    assert (r.read_bw_median_mbs, r.read_bw_min_mbs, r.write_bw_median_mbs) == (4.0, 2.0, 1.0)
    rec = sweep.to_records(summ, {"workers": 1, "passes": 3}, ["cluster"]).first()
    assert [e.block_size for e in rec.sweep][:2] == ["64k", "256k"] and rec.workers == 1
    assert rec.sweep[0].block_size_label == "64 KB" and rec.sweep[0].passes == 3
    v = sweep.curve_verdicts(summ, ["cluster"], eps=0.10).first()
    assert v.plateau is True  # flat curve: plateau from the first size
    cls = {x.block_size: x.layout_class for x in sweep.with_layout_class(summ, spark).collect()}
    assert cls["64k"] == "metadata / row groups" and cls["256m"] == "long video / checkpoint fragments"


def test_run_and_checkpoint_summary(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("r1", rank, step, t0 + dt.timedelta(seconds=step), t0 + dt.timedelta(seconds=step + 1, microseconds=rank))
            for rank in range(8) for step in range(1, 101)]
    steps = spark.createDataFrame(rows, "run string, rank int, step int, start_ts timestamp, end_ts timestamp")
    meta = spark.createDataFrame([("r1", "NVIDIA B300 SXM6 AC", 8, 32, 1e15, 68.8e9)],
                                 "run string, gpu string, world_size int, batch_size_per_gpu int, "
                                 "flops_per_step double, peak_mem_bytes double")
    r = runs.run_summary(spark, steps, meta).first()
    assert r.measure_steps == 80 and r.schema == ["pi05_train", "1node"] and r.global_batch_size == 256
    assert r.elapsed_s == pytest.approx(80.000007)
    assert r.samples_per_sec == pytest.approx(80 / 80.000007 * 256)
    assert r.peak_mem_gb == pytest.approx(68.8)
    assert r.mfu_pct == pytest.approx(1e15 * r.steps_per_sec / (9000e12 * 8) * 100)
    # checkpoint rounds published as 1.28 then 10.5 GB/s: 1 GB in 1/1.28 s then 1/10.5 s over 2 ranks
    rr = []
    for rnd, rate in ((1, 1.28), (2, 10.5), (3, 10.5)):
        for rank in range(2):
            rr.append(("c", rank, rnd, "save", 0.0, 1.0 / rate, 500_000_000))
            rr.append(("c", rank, rnd, "load", 0.0, 1.0 / 8.4, 500_000_000))
    ck = runs.checkpoint_summary(spark.createDataFrame(
        rr, "run string, rank int, round int, phase string, start_s double, end_s double, bytes long")).first()
    assert round(ck.save_gb_s, 2) == 7.43 and ck.save_cold_gb_s == pytest.approx(1.28)
    assert ck.save_warm_gb_s == pytest.approx(10.5) and ck.load_gb_s == pytest.approx(8.4)
    assert ck.checkpoint_size_gb == pytest.approx(1.0)
    assert [round(x, 2) for x in ck.save_rounds] == [1.28, 10.5, 10.5]


def test_streaming_points(spark, results, tmp_path):
    from benchlens.streaming import start_points_sink, stream_points
    pts = stream_points(spark, results)
    q = start_points_sink(pts, str(tmp_path / "out"), str(tmp_path / "chk"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    vals = {(r.file, r.key): r.value for r in got.collect()}
    assert vals[("pi05_1n8g_7.json", "peak_gpu_mem_gb")] == 68.8
    assert ("pi05_1n8g_7.json", "mfu_pct") not in vals
    assert ("misc_1.json", "tflops") not in vals


def test_report_materialized_matches(spark, results):
    a = R.report(spark, results, cluster="c1", at=dt.datetime(2026, 6, 24, 12, 0))
    b = R.report(spark, results, cluster="c1", at=dt.datetime(2026, 6, 24, 12, 0), materialize=True)
    for t in ("scalars", "params", "comparison", "lines", "tasks"):
        da, db = getattr(a, t), getattr(b, t)
        assert sorted(map(tuple, da.collect())) == sorted(map(tuple, db.select(*da.columns).collect())), t


def test_streaming_is_incremental(spark, tmp_path):
    from benchlens.streaming import start_points_sink, stream_points
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    src.mkdir()
    (src / "hpl_1.json").write_text(json.dumps({"tflops": 1.0}))
    (src / "hpl_2.json").write_text(json.dumps({"tflops": 2.0}))
    start_points_sink(stream_points(spark, str(src)), out, chk).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    (src / "hpl_3.json").write_text(json.dumps({"tflops": 3.0}))
    (src / "nccl_1.json").write_text(json.dumps({"busbw_gb_s": 5.0, "algbw_gb_s": None}))
    start_points_sink(stream_points(spark, str(src)), out, chk).awaitTermination(120)
    got = sorted((r.file, r.key, r.value) for r in spark.read.parquet(out).collect())
    assert got == [("hpl_1.json", "tflops", 1.0), ("hpl_2.json", "tflops", 2.0), ("hpl_3.json", "tflops", 3.0),
                   ("nccl_1.json", "busbw_gb_s", 5.0)]


def test_display_text(spark):
    df = spark.createDataFrame([('{"a": 18.0, "b": 8, "c": "x", "d": null, "e": [1]}',)], "raw string")
    d = df.select(F.parse_json("raw").alias("v"))
    cols = {k: R.display_text(F.variant_get("v", f"$.{k}", "variant")) for k in "abcdez"}
    row = d.select(*[c.alias(k) for k, c in cols.items()]).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.z) == ("18.0", "8", "x", "None", "[1]", "—")


def test_cli_report(spark, results, tmp_path, capsys):
    from benchlens.__main__ import main
    assert main(["report", results, "--show", "20"]) == 0
    out = capsys.readouterr().out
    assert "pi05_ckpt_1n_7.json" in out and "Load GB/s: 8" in out
    assert main(["report", results, "--write", str(tmp_path / "rep")]) == 0
    assert spark.read.parquet(str(tmp_path / "rep" / "scalars")).count() > 0


def test_same_names_in_folders(spark, tmp_path):
    """Files of one name stay apart, and a run's folder names the benchmark of files that do not."""
    for folder, value in (("a", 1.0), ("b", 2.0), ("mlperf_unet_77", 3.0)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "hpl_1.json").write_text(json.dumps({"tflops": value}))
    (tmp_path / "mlperf_unet_77" / "summary.json").write_text(json.dumps({"samples_per_sec": 5}))
    (tmp_path / "a" / "notes.json").write_text("{}")
    rep = R.report(spark, str(tmp_path), recursive=True)
    assert sorted((r.series, r.value, r.iteration) for r in rep.scalars.where("title = 'TFLOPS'").collect()) == [
        ("a/hpl_1.json", 1.0, 0), ("b/hpl_1.json", 2.0, 1), ("mlperf_unet_77/hpl_1.json", 3.0, 2)]
    assert {(r.bench, r.file): r.text for r in rep.lines.collect()}["MLPerf Storage", "mlperf_unet_77/summary.json"] == "Samples/s: 5"
    assert len(rep.lines.collect()) == 4 and [r.file for r in rep.unknown.collect()] == ["a/notes.json"]
    wide = rep.comparison_of("HPL (Linpack)")
    assert wide.columns == ["file", "tflops"] and sorted(map(tuple, wide.collect())) == [
        ("a/hpl_1.json", "1.0"), ("b/hpl_1.json", "2.0"), ("mlperf_unet_77/hpl_1.json", "3.0")]
