"""Training and checkpoint plans on per-rank logs.

Step log (run, rank, step, start_ts, end_ts) -> W2 measure window -> A7
barrier span -> A10 throughput, A8 peak memory, J2 device peak -> F6 MFU,
F7 node class.  Round log (run, rank, round, phase, start_s, end_s, bytes) ->
A7 per round -> A6 bytes -> F4 GB/s -> A3 mean and A4 cold/warm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import gb_per_s, global_batch, mfu_pct, node_class
from ..operators import agg, joins


def run_summary(spark: SparkSession, steps: DataFrame, runs: DataFrame, warmup: int = 20,
                measure: int = 80, peak_override: float | None = None) -> DataFrame:
    """One row per run.

    ``steps``: run, rank, step, start_ts, end_ts (one row per rank and step).
    ``runs``: run, gpu, world_size, batch_size_per_gpu, flops_per_step (nullable),
    peak_mem_bytes (max allocated over ranks may also come from ``steps``).
    """
    # W2 by dense_rank: steps are in lockstep across ranks, so a step's rows share a number;
    # the top-k filter reaches the tasks as a WindowGroupLimit
    numbered = steps.withColumn("_n", F.dense_rank().over(Window.partitionBy("run").orderBy("step")))
    measured = numbered.where(F.col("_n") <= warmup + measure).where(F.col("_n") > warmup)
    span = agg.barrier_elapsed(measured, ["run"], "start_ts", "end_ts", "elapsed_s", last={"measure_steps": "_n"})
    r = runs.join(span, "run").withColumn("measure_steps", (F.col("measure_steps") - warmup).cast("bigint"))
    r = agg.throughput(r, "measure_steps", "elapsed_s", "batch_size_per_gpu", "world_size")
    r = joins.lookup_first_match(r, "gpu", dims.PEAK_FLOPS, "flops",
                                 default=dims.DEFAULT_PEAK_FLOPS, override=peak_override, out="peak_flops")
    return r.select(
        "run", F.array(F.lit("pi05_train"), node_class("world_size")).alias("schema"), "gpu", "world_size",
        "batch_size_per_gpu", global_batch("batch_size_per_gpu", "world_size").alias("global_batch_size"),
        F.lit(warmup).alias("warmup_steps"), "measure_steps", "elapsed_s", "steps_per_sec", "samples_per_sec",
        (F.col("peak_mem_bytes") / F.lit(1e9)).alias("peak_mem_gb"),
        mfu_pct("flops_per_step", "steps_per_sec", "peak_flops", "world_size").alias("mfu_pct"))


def checkpoint_rounds(rounds: DataFrame) -> DataFrame:
    """Per (run, round, phase): barrier seconds over ranks, bytes summed once per rank, GB/s."""
    g = rounds.groupBy("run", "round", "phase").agg(
        (F.max("end_s") - F.min("start_s")).alias("elapsed_s"), F.sum("bytes").alias("bytes"))
    return g.withColumn("gb_s", gb_per_s("bytes", "elapsed_s"))


def checkpoint_summary(rounds: DataFrame) -> DataFrame:
    """Per run: save/load GB/s as the mean of all rounds (A3) and split cold/warm (A4)."""
    r = checkpoint_rounds(rounds)
    r = r.withColumn("_cold", F.col("round") == F.min("round").over(Window.partitionBy("run", "phase")))
    aggs, rate = [], F.col("gb_s")
    for phase in ("save", "load"):
        mine = F.col("phase") == phase
        aggs += [F.avg(F.when(mine, rate)).alias(f"{phase}_gb_s"),
                 F.avg(F.when(mine & F.col("_cold"), rate)).alias(f"{phase}_cold_gb_s"),
                 F.avg(F.when(mine & ~F.col("_cold"), rate)).alias(f"{phase}_warm_gb_s"),
                 # per-round rates in round order (one element per round: bounded)
                 F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("round", "gb_s")))),
                             lambda x: x["gb_s"]).alias(f"{phase}_rounds")]
    size = (F.max(F.when(F.col("phase") == "save", F.col("bytes"))) / F.lit(1e9)).alias("checkpoint_size_gb")
    return r.groupBy("run").agg(*aggs, size)
