"""Measurement-log bindings: events as per-rank step logs, conversations as
ordered runs, embeddings as arrays of rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agg, joins, project, windows
from ..operators.ranking import materialize
from . import common as C
from . import query

# events as a step log: run = event_type, rank = user_id % 8, one step per event.
STEPS_SQL = """
SELECT event_type AS run, user_id % 8 AS rank, user_id, event_id, ts, value FROM events"""


def steps(spark, sf):
    e = C.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("run"), (F.col("user_id") % 8).alias("rank"),
                    "user_id", "event_id", "ts", "value")


@query("a3_mean_rounds", """
SELECT user_id, round_even(avg(CAST(round(value * 100) AS BIGINT)) / 100, 6) AS mean_value FROM events GROUP BY user_id""")
def a3_mean_rounds(spark, sf):
    e = C.table(spark, sf, "events").withColumn("cents", C.cents("value"))
    m = agg.mean_rounds(e, ["user_id"], "cents", "mean_value")
    return m.select("user_id", F.bround(F.col("mean_value") / 100, 6).alias("mean_value"))


@query("a3_mean_array", """
SELECT vec_id, round_even(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS mean_round
FROM embeddings""")
def a3_mean_array(spark, sf):
    e = C.table(spark, sf, "embeddings")
    return e.select("vec_id", F.bround(agg.mean_array("embedding"), 6).alias("mean_round"))


@query("a4_cold_warm", """
SELECT vec_id, round_even(embedding[1]::DOUBLE, 6) AS cold,
       round_even(list_sum(list_transform(embedding[2:], lambda x: x::DOUBLE)) / (len(embedding) - 1), 6) AS warm,
       round_even((list_sum(list_transform(embedding[2:], lambda x: x::DOUBLE)) / (len(embedding) - 1))
             / NULLIF(embedding[1]::DOUBLE, 0), 6) AS cold_penalty
FROM embeddings""")
def a4_cold_warm(spark, sf):
    """A4: first element is the cold round, the rest are warm rounds."""
    e = C.table(spark, sf, "embeddings")
    cold, warm, pen = agg.cold_warm_array("embedding")
    return e.select("vec_id", F.bround(cold, 6).alias("cold"), F.bround(warm, 6).alias("warm"),
                    F.bround(pen, 6).alias("cold_penalty"))


@query("a4_cold_warm_rows", """
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS round,
                  CAST(round(value * 100) AS BIGINT) AS value FROM events)
SELECT user_id, round_even(avg(value) FILTER (WHERE round = 1) / 100, 6) AS cold,
       round_even(avg(value) FILTER (WHERE round > 1) / 100, 6) AS warm,
       round_even(avg(value) FILTER (WHERE round > 1) / NULLIF(avg(value) FILTER (WHERE round = 1), 0), 6) AS cold_penalty
FROM r GROUP BY user_id""")
def a4_cold_warm_rows(spark, sf):
    """A4 on rows: W1 numbers each user's events (rounds), then cold/warm means."""
    e = C.table(spark, sf, "events").select("user_id", "event_id", C.cents("value").alias("value"))
    r = windows.with_iteration(e, ["user_id"], "event_id", "round", base=1)
    out = agg.cold_warm(r, ["user_id"], "round", "value")
    return out.select("user_id", F.bround(F.col("cold") / 100, 6).alias("cold"),
                      F.bround(F.col("warm") / 100, 6).alias("warm"), F.bround("cold_penalty", 6).alias("cold_penalty"))


@query("a6_rank_sum", f"""
SELECT run, round_even(sum(value), 6) AS total, count(*) AS n_ranks FROM ({STEPS_SQL}) GROUP BY run""")
def a6_rank_sum(spark, sf):
    out = agg.rank_sum(steps(spark, sf), ["run"], "value")
    return out.select("run", F.bround("total", 6).alias("total"), "n_ranks")


@query("a7_barrier_span", """
SELECT user_id, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS elapsed_s FROM events GROUP BY user_id""")
def a7_barrier_span(spark, sf):
    e = C.table(spark, sf, "events")
    return agg.barrier_elapsed(e, ["user_id"], "ts", "ts")


@query("a8_peak", f"""
SELECT run, rank, max(CAST(round(value * 1e9) AS BIGINT)) / 1e9 AS peak_gb
FROM ({STEPS_SQL}) GROUP BY run, rank""")
def a8_peak(spark, sf):
    s = steps(spark, sf).withColumn("mem_bytes", F.round(F.col("value") * F.lit(1e9)).cast("bigint"))
    return agg.peak(s, ["run", "rank"], "mem_bytes")


@query("a9_latency", """
SELECT event_type, round_even(avg(CAST(round(value * 100) AS BIGINT)) / 100, 6) AS avg_latency_ms,
       round_even(quantile_cont(value, 0.99), 6) AS p99_latency_ms
FROM events GROUP BY event_type""")
def a9_latency(spark, sf):
    out = agg.latency_summary(C.table(spark, sf, "events"), ["event_type"], "value", avg_of=C.cents)
    return out.select("event_type", F.bround(F.col("avg_latency_ms") / 100, 6).alias("avg_latency_ms"),
                      F.bround("p99_latency_ms", 6).alias("p99_latency_ms"))


@query("a9_sketch_ranks", """
SELECT event_type, n, name, p, true AS within
FROM (SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type),
     (VALUES ('p50', 0.5::DOUBLE), ('p99', 0.99::DOUBLE)) AS q(name, p)""")
def a9_sketch_ranks(spark, sf):
    """A9 from stored sketches: one for each event type and user is written as a run's table, the runs are merged
    by event type, and the exact rank of every estimate must lie within the sketch's bound."""
    e = C.table(spark, sf, "events").select("event_type", "user_id", "value")
    stored = materialize(agg.latency_sketches(e, ["event_type", "user_id"], "value"), "latency-sketches")
    q = {"p50": 0.5, "p99": 0.99}
    est = agg.sketch_quantiles(agg.merge_sketches(stored, ["event_type"]), ["event_type"], q)
    est = est.select("event_type", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p).alias("p"), F.col(k).alias("at"))
                                                            for k, p in q.items()])).alias("e")).select("event_type", "n", "e.*")
    low = F.sum(F.when(F.col("value") < F.col("at"), 1).otherwise(0))
    high = F.sum(F.when(F.col("value") <= F.col("at"), 1).otherwise(0))
    rank = e.join(F.broadcast(est), "event_type").groupBy("event_type", "n", "name", "p").agg(low.alias("low"), high.alias("high"))
    slack = agg.KLL_RANK_ERROR * F.col("n") + 1
    return rank.select("event_type", "n", "name", "p", ((F.col("low") <= F.col("p") * F.col("n") + slack) & (F.col("high") >= F.col("p") * F.col("n") - slack)).alias("within"))


@query("a10_throughput", """
SELECT user_id, count(*) AS steps, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS elapsed_s,
       round_even(count(*) / NULLIF(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0), 9) AS steps_per_sec,
       round_even(count(*) / NULLIF(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0) * 32 * 8, 9) AS samples_per_sec
FROM events GROUP BY user_id""")
def a10_throughput(spark, sf):
    """A10: steps per user over the A7 span; 32 samples per rank and 8 ranks."""
    span = agg.barrier_elapsed(C.table(spark, sf, "events"), ["user_id"], "ts", "ts", count="steps")
    x = span.withColumn("batch", F.lit(32)).withColumn("world", F.lit(8))
    t = agg.throughput(x, "steps", "elapsed_s", "batch", "world")
    return t.select("user_id", "steps", "elapsed_s", F.bround("steps_per_sec", 9).alias("steps_per_sec"),
                    F.bround("samples_per_sec", 9).alias("samples_per_sec"))


@query("a13_first_params", """
SELECT conv_id, arg_min(role, turn) AS role, arg_min(length(text), turn) AS text_chars
FROM conversations GROUP BY conv_id""")
def a13_first_params(spark, sf):
    c = C.table(spark, sf, "conversations").withColumn("text_chars", F.length("text").cast("bigint"))
    return agg.first_params(c, ["conv_id"], "turn", ["role", "text_chars"])


@query("w2_measure_window", """
SELECT conv_id, turn, role, step_no FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step_no
  FROM conversations) WHERE step_no > 1 AND step_no <= 4""")
def w2_measure_window(spark, sf):
    c = C.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return windows.measure_window(c, ["conv_id"], "turn", warmup=1, measure=3)


@query("p7_leader", f"""
SELECT run, user_id, event_id FROM ({STEPS_SQL}) WHERE rank = 0""")
def p7_leader(spark, sf):
    return project.leader_only(steps(spark, sf)).select("run", "user_id", "event_id")


@query("j6_scaling", """
WITH a AS (SELECT event_type, user_id % 10 AS config, 1 + user_id % 3 AS nodes,
                  avg(CAST(round(value * 100) AS BIGINT)) AS thr
           FROM events GROUP BY ALL),
b AS (SELECT event_type, config, thr AS base_thr FROM a WHERE nodes = 1)
SELECT a.event_type, a.config, a.nodes, round_even(b.base_thr / 100, 6) AS base_thr, round_even(a.thr / 100, 6) AS thr,
       round_even(a.thr / NULLIF(b.base_thr, 0), 6) AS scale_ratio,
       round_even(a.thr / NULLIF(b.base_thr, 0) / (a.nodes / 1), 6) AS scale_eff
FROM a LEFT JOIN b USING (event_type, config) WHERE a.nodes <> 1""")
def j6_scaling(spark, sf):
    """Runs on 2 and 3 nodes against the same cluster/config on 1 node."""
    e = C.table(spark, sf, "events").select(
        "event_type", (F.col("user_id") % 10).alias("config"), (1 + F.col("user_id") % 3).alias("nodes"),
        C.cents("value").alias("value"))
    s = joins.scaling(e, ["event_type", "config"], "nodes", "value")
    return s.select("event_type", "config", "nodes",
                    *[F.bround(F.col(c) / 100, 6).alias(c) for c in ("base_thr", "thr")],
                    *[F.bround(c, 6).alias(c) for c in ("scale_ratio", "scale_eff")])


@query("j7_bottleneck", """
WITH c AS (SELECT user_id, sum(value) AS train_rate FROM events WHERE event_type <> 'view' GROUP BY user_id),
s AS (SELECT user_id, sum(value) AS storage_rate FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id, round_even(train_rate, 6) AS train_rate, round_even(storage_rate, 6) AS storage_rate,
       round_even(storage_rate / NULLIF(train_rate, 0), 6) AS headroom,
       CASE WHEN train_rate < storage_rate THEN 'compute_or_network' WHEN train_rate >= storage_rate THEN 'storage' END AS bottleneck
FROM c FULL JOIN s USING (user_id)""")
def j7_bottleneck(spark, sf):
    """Per user, 'view' volume as the supplier rate and all other volume as the consumer rate."""
    e = C.table(spark, sf, "events")
    c = e.where(F.col("event_type") != "view").groupBy("user_id").agg(F.sum("value").alias("train_rate"))
    s = e.where(F.col("event_type") == "view").groupBy("user_id").agg(F.sum("value").alias("storage_rate"))
    b = joins.bottleneck(c, s, ["user_id"], "train_rate", "storage_rate")
    return b.select("user_id", *[F.bround(x, 6).alias(x) for x in ("train_rate", "storage_rate", "headroom")],
                    "bottleneck")


@query("o3_top_per_metric", """
SELECT metric, l_orderkey, l_linenumber, value, rank FROM (
  SELECT metric, l_orderkey, l_linenumber, value,
         row_number() OVER (PARTITION BY metric ORDER BY value DESC, l_orderkey, l_linenumber) AS rank
  FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
        ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value))
WHERE rank <= 3""")
def o3_top_per_metric(spark, sf):
    """O3: best three lines per metric (KPI strip)."""
    li = C.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = project.to_scalars(li, ["l_orderkey", "l_linenumber"],
                              ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return windows.top_per_group(long, ["metric"],
                                 [F.col("value").desc(), "l_orderkey", "l_linenumber"], k=3)


# --- SURVEY 3.3 end to end: events as per-rank step logs and checkpoint rounds ---
# --- fixed values: run metadata given to the five event types (binding fixture)
RUN_META = [("click", "NVIDIA B300 SXM6 AC", 8, 1e15), ("view", "NVIDIA H100 80GB HBM3", 16, 1e15),
            ("signup", "NVIDIA H200 SXM 141GB", 8, 1e15), ("purchase", "NVIDIA A100-SXM4-40GB", 4, 1e15),
            ("error", "NVIDIA B200", 16, None)]


def step_log(spark, sf):
    """run = event_type, rank = event_id % 8, step = event_id div 8; a step lasts value seconds."""
    e = C.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("run"), (F.col("event_id") % 8).alias("rank"),
                    F.floor(F.col("event_id") / 8).cast("bigint").alias("step"), F.col("ts").alias("start_ts"),
                    F.expr("timestampadd(MICROSECOND, CAST(round(value * 1e6) AS BIGINT), ts)").alias("end_ts"))


def run_meta(spark, sf):
    e = C.table(spark, sf, "events")
    meta = e.groupBy(F.col("event_type").alias("run")).agg(
        F.max(F.round(F.col("value") * 1e9).cast("bigint")).alias("peak_mem_bytes"))
    gpu, world, flops = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("double")
    for run, g, w, f in reversed(RUN_META):
        hit = F.col("run") == run
        gpu, world = F.when(hit, F.lit(g)).otherwise(gpu), F.when(hit, F.lit(w)).otherwise(world)
        flops = F.when(hit, F.lit(f).cast("double")).otherwise(flops)
    return meta.select("run", gpu.alias("gpu"), world.alias("world_size"), F.lit(32).alias("batch_size_per_gpu"),
                       flops.alias("flops_per_step"), "peak_mem_bytes")


def _case(col: str, idx: int) -> str:
    whens = " ".join(f"WHEN {col} = {C.sql_str(r[0])} THEN "
                     f"{C.sql_str(r[idx]) if isinstance(r[idx], str) else ('NULL' if r[idx] is None else repr(r[idx]))}"
                     for r in RUN_META)
    return f"CASE {whens} END"


def _peaks_sql() -> str:
    from .. import dims
    vals = ", ".join(f"({o}, {C.sql_str(p)}, {f}::DOUBLE)" for o, p, f in dims.PEAK_FLOPS)
    return f"(VALUES {vals}) AS pk(ord, pattern, flops)"


@query("run_summary", f"""
WITH s AS (SELECT event_type AS run, event_id % 8 AS rank, event_id // 8 AS step, ts AS start_ts,
                  ts + to_microseconds(CAST(round(value * 1e6) AS BIGINT)) AS end_ts FROM events),
ids AS (SELECT DISTINCT run, step FROM s),
k AS (SELECT run, step FROM (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM ids)
      WHERE rn > 20 AND rn <= 100),
m AS (SELECT s.* FROM s SEMI JOIN k USING (run, step)),
e AS (SELECT run, date_diff('microsecond', min(start_ts), max(end_ts)) / 1e6 AS elapsed_s FROM m GROUP BY run),
n AS (SELECT run, count(*) AS measure_steps FROM k GROUP BY run),
x AS (SELECT event_type AS run, {_case('event_type', 1)} AS gpu, CAST({_case('event_type', 2)} AS INTEGER) AS world_size,
             32 AS batch_size_per_gpu, CAST({_case('event_type', 3)} AS DOUBLE) AS flops_per_step,
             max(CAST(round(value * 1e9) AS BIGINT)) AS peak_mem_bytes
      FROM events GROUP BY event_type),
y AS (SELECT x.*, n.measure_steps, e.elapsed_s FROM x JOIN n USING (run) JOIN e USING (run)),
p AS (SELECT y.run, coalesce(arg_min(pk.flops, pk.ord), 989e12) AS peak
      FROM y LEFT JOIN {_peaks_sql()} ON regexp_matches(y.gpu, pk.pattern, 'i') GROUP BY y.run)
SELECT y.run, CASE WHEN world_size <= 8 THEN '1node' ELSE '2node' END AS node_class, gpu, world_size,
       batch_size_per_gpu, CAST(batch_size_per_gpu * world_size AS BIGINT) AS global_batch_size, 20 AS warmup_steps,
       measure_steps, elapsed_s, measure_steps / elapsed_s AS steps_per_sec,
       measure_steps / elapsed_s * batch_size_per_gpu * world_size AS samples_per_sec,
       peak_mem_bytes / 1e9 AS peak_mem_gb,
       flops_per_step * (measure_steps / elapsed_s) / (p.peak * world_size) * 100 AS mfu_pct
FROM y JOIN p USING (run)""")
def run_summary_query(spark, sf):
    """SURVEY 3.3: W2 warm-up/measure window on each run's steps, A7 barrier span,
    A10 throughput, A8 peak memory, J2 device peak, F6 MFU, F7 node class."""
    from ..plans import runs
    r = runs.run_summary(spark, step_log(spark, sf), run_meta(spark, sf))
    return r.withColumn("node_class", F.col("schema")[1]).drop("schema")


ROUNDS_SQL = """
SELECT event_type AS run, user_id % 8 AS rank, 1 + event_id % 3 AS round,
       CASE WHEN user_id % 2 = 0 THEN 'save' ELSE 'load' END AS phase,
       CAST(event_id // 3 AS DOUBLE) AS start_s, CAST(event_id // 3 AS DOUBLE) + value / 100 AS end_s,
       CAST(round(value * 1e6) AS BIGINT) AS bytes
FROM events"""


@query("checkpoint_summary", f"""
WITH r AS ({ROUNDS_SQL}),
g AS (SELECT run, round, phase, max(end_s) - min(start_s) AS elapsed_s, sum(bytes) AS bytes FROM r GROUP BY ALL),
q AS (SELECT *, CASE WHEN elapsed_s > 0 THEN bytes / 1e9 / elapsed_s ELSE 0.0 END AS gb_s FROM g)
SELECT run,
       round_even(avg(gb_s) FILTER (WHERE phase = 'save'), 9) AS save_gb_s,
       round_even(avg(gb_s) FILTER (WHERE phase = 'save' AND round = 1), 9) AS save_cold_gb_s,
       round_even(avg(gb_s) FILTER (WHERE phase = 'save' AND round > 1), 9) AS save_warm_gb_s,
       round_even(avg(gb_s) FILTER (WHERE phase = 'load'), 9) AS load_gb_s,
       round_even(avg(gb_s) FILTER (WHERE phase = 'load' AND round = 1), 9) AS load_cold_gb_s,
       round_even(avg(gb_s) FILTER (WHERE phase = 'load' AND round > 1), 9) AS load_warm_gb_s,
       max(bytes) FILTER (WHERE phase = 'save') / 1e9 AS checkpoint_size_gb
FROM q GROUP BY run""")
def checkpoint_summary_query(spark, sf):
    """SURVEY 3.3: per round and phase the barrier span over ranks, bytes summed once,
    GB/s (0 for an empty span); per run the mean of rounds and the cold/warm split."""
    from ..plans import runs
    e = C.table(spark, sf, "events")
    start = F.floor(F.col("event_id") / 3).cast("double")
    rounds = e.select(F.col("event_type").alias("run"), (F.col("user_id") % 8).alias("rank"),
                      (1 + F.col("event_id") % 3).alias("round"),
                      F.when(F.col("user_id") % 2 == 0, "save").otherwise("load").alias("phase"),
                      start.alias("start_s"), (start + F.col("value") / 100).alias("end_s"),
                      F.round(F.col("value") * 1e6).cast("bigint").alias("bytes"))
    s = runs.checkpoint_summary(rounds)
    cols = ["save_gb_s", "save_cold_gb_s", "save_warm_gb_s", "load_gb_s", "load_cold_gb_s", "load_warm_gb_s"]
    return s.select("run", *[F.bround(c, 9).alias(c) for c in cols], "checkpoint_size_gb")
