"""Aggregations over repeated measurements.

All of them are partial + final hash aggregations (map-side combine), so a
hot group costs one small partial row per task, not one task for the group.
The order statistics (A1, A9) use the bracketing selection in ``ranking``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mb_per_s, round_half_even
from .ranking import join_null_safe, materialize, ordinal_median, percentile_cont  # noqa: F401  (A1 re-export)


NO_RESULTS = "No recognised result documents found."


def min_passes(df: DataFrame, keys: Sequence[str], value: str, name: str = "min") -> DataFrame:
    """A2: minimum over passes."""
    return df.groupBy(*keys).agg(F.min(value).alias(name))


def mean_rounds(df: DataFrame, keys: Sequence[str], value: str, name: str = "mean") -> DataFrame:
    """A3: mean over rounds stored as rows."""
    return df.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(name))


def mean_array(arr):
    """A3: mean of an array column (rounds stored in one row), as DOUBLE."""
    a = F.transform(arr if not isinstance(arr, str) else F.col(arr), lambda x: x.cast("double"))
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def cold_warm_array(arr):
    """A4 on an array of rounds: (cold = first, warm = mean of the rest, cold penalty)."""
    a = F.transform(arr if not isinstance(arr, str) else F.col(arr), lambda x: x.cast("double"))
    rest = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1)))
    cold = F.element_at(a, 1)
    warm = F.when(F.size(a) > 1, F.aggregate(rest, F.lit(0.0), lambda acc, x: acc + x) / F.size(rest))
    return cold, warm, warm / F.nullif(cold, F.lit(0.0))


def cold_warm(df: DataFrame, keys: Sequence[str], round_col: str, value: str) -> DataFrame:
    """A4 on rows: round 1 is cold, later rounds are warm (1-based rounds)."""
    r, v = F.col(round_col), F.col(value).cast("double")
    out = df.groupBy(*keys).agg(F.avg(F.when(r == 1, v)).alias("cold"),
                                F.avg(F.when(r > 1, v)).alias("warm"))
    return out.withColumn("cold_penalty", F.col("warm") / F.nullif(F.col("cold"), F.lit(0.0)))


def group_results(df: DataFrame, bench_col: str = "bench", file_col: str = "file") -> DataFrame:
    """A5: one row per benchmark with its file count and first file.

    Benchmarks are ordered by their first file (``ord`` is 1-based); the
    ordering runs on the aggregated rows (one per benchmark), never on files.
    """
    g = df.groupBy(bench_col).agg(F.count("*").alias("n_files"), F.min(file_col).alias("first_file"))
    from pyspark.sql import Window
    return g.withColumn("ord", F.row_number().over(Window.orderBy("first_file")).cast("bigint"))


def rank_sum(df: DataFrame, keys: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """Sum-reduce over ranks (all-reduce SUM)."""
    return df.groupBy(*keys).agg(F.sum(value).alias(name), F.count("*").alias("n_ranks"))


def barrier_elapsed(df: DataFrame, keys: Sequence[str], start: str, end: str,
                    name: str = "elapsed_s", count: str | None = None, last: dict[str, str] | None = None) -> DataFrame:
    """Wall clock of a barrier: last end minus first start over ranks.

    Timestamps are differenced in microseconds; DOUBLE seconds work as is.
    ``count`` names a row count and ``last`` maximums (name to column) to take in
    the same aggregation.
    """
    s, e = F.col(start), F.col(end)
    counts = [F.count("*").alias(count)] if count else []
    counts += [F.max(c).alias(n) for n, c in (last or {}).items()]
    out = df.groupBy(*keys).agg(F.min(s).alias("_s"), F.max(e).alias("_e"), *counts)
    first = dict(df.dtypes)[start]
    if first.startswith("timestamp"):
        span = F.expr("timestampdiff(MICROSECOND, _s, _e)") / F.lit(1e6)
    else:
        span = F.col("_e") - F.col("_s")
    return out.withColumn(name, span.cast("double")).drop("_s", "_e")


def peak(df: DataFrame, keys: Sequence[str], bytes_col: str, name: str = "peak_gb") -> DataFrame:
    """Peak memory in GB (1e9 bytes)."""
    return df.groupBy(*keys).agg((F.max(bytes_col).cast("double") / F.lit(1e9)).alias(name))


def latency_summary(df: DataFrame, keys: Sequence[str], latency: str, p: float = 0.99,
                    approx: bool = False, avg_of=None) -> DataFrame:
    """Average and p99 latency per group.

    Exact p99 (linear interpolation) by default, skew-safe; ``approx=True`` takes
    it from a KLL sketch (``latency_sketches``) in a single partial aggregation.
    ``avg_of`` maps the latency to what is averaged (e.g. exact integer units).
    """
    keys = list(keys)
    of = avg_of or (lambda v: v)
    if approx:
        return sketch_quantiles(latency_sketches(df, keys, latency, avg_of=of), keys, {"p99_latency_ms": p}).drop("n")
    mean = lambda v, c: F.sum(of(v) * c) / F.sum(c)
    return percentile_cont(df, keys, latency, p, "p99_latency_ms", extra={"avg_latency_ms": mean}).drop("n")


#: Items a KLL sketch keeps on its largest level, and the rank error that holds for a quantile with 99 % confidence.
KLL_K, KLL_RANK_ERROR = 1000, 0.0034


def latency_sketches(df: DataFrame, keys: Sequence[str], latency: str, avg_of=None, k: int = KLL_K) -> DataFrame:
    """(keys, n, total, sketch) of a run, to be stored and merged with those of other runs.

    A sketch takes a few kilobytes whatever the number of rows, and partial
    sketches are merged on the map side, so a hot group is one row a task.
    """
    v = F.col(latency).cast("double")
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum((avg_of or (lambda x: x))(v)).alias("total"),
                                                      F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = KLL_K) -> DataFrame:
    """Stored sketches of several runs as one for each group, without the rows."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Average and named quantiles from sketches."""
    return sketches.select(*keys, "n", (F.col("total") / F.col("n")).alias("avg_latency_ms"),
                           *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in quantiles.items()])


def throughput(df: DataFrame, steps: str, elapsed: str, batch: str, world: str) -> DataFrame:
    """A10: steps/s = steps / elapsed; samples/s = steps/s x per-rank batch x world."""
    sps = F.col(steps).cast("double") / F.nullif(F.col(elapsed).cast("double"), F.lit(0.0))
    return (df.withColumn("steps_per_sec", sps)
              .withColumn("samples_per_sec", F.col("steps_per_sec") * F.col(batch) * F.col(world)))


def pivot_rw(df: DataFrame, keys: Sequence[str], rw_col: str, stats: Sequence[str],
             values: Sequence[str] = ("write", "read")) -> DataFrame:
    """Rows (keys, rw) -> columns ``<rw>_<stat>`` with explicit values."""
    aggs = [F.max(F.when(F.col(rw_col) == v, F.col(s))).alias(f"{v}_{s}")
            for v in values for s in stats]
    return df.groupBy(*keys).agg(*aggs)


def sweep_stats(trials: DataFrame, keys: Sequence[str], bw_bytes: str, digits: int = 1) -> DataFrame:
    """A1 + A2 + F4 + F5 on raw trials: MB/s median (upper) and min, rounded half-even."""
    t = trials.withColumn("_mbs", mb_per_s(bw_bytes))
    out = ordinal_median(t, keys, "_mbs", "bw_median_mbs", extra={"bw_min_mbs": lambda v, c: F.min(v)})
    return out.select(*keys, round_half_even("bw_median_mbs", digits).alias("bw_median_mbs"),
                      round_half_even("bw_min_mbs", digits).alias("bw_min_mbs"))


def _join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str, bounded: bool, n: str) -> DataFrame:
    """Join rows to a per-group table (with row counts ``n``) without piling a hot group's rows on one task.

    ``bounded`` keys come from a fixed table (the registry), so the group table
    is broadcast.  Of other keys, the heavy ones are those that hold more than
    1 / P of all rows, P the shuffle partitions: fewer than P of them, known from the
    counts themselves and broadcast.  A heavy key's rows are dealt over as many
    salts as it has Pths of the rows, by a hash of the row and its input
    partition (equal rows are spread too), and its group row is repeated for each.
    """
    if bounded:
        return join_null_safe(df, F.broadcast(groups.drop(n)), keys, how)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = materialize(groups, "groups")
    share = F.col(n) * parts / groups.agg(F.sum(n)).scalar()
    heavy = groups.where(share > 1).select(*keys, F.ceil(share).cast("int").alias("_salts"))
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(share).cast("int"), F.lit(1)) - 1))).drop(n)
    rows = join_null_safe(df, F.broadcast(heavy), keys, "left")
    spread = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.col("_salts")).cast("int")
    rows = rows.withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_salts")
    return join_null_safe(rows, salted, [*keys, "_salt"], how).drop("_salt")


def with_group_count(df: DataFrame, keys: Sequence[str], name: str = "group_size", bounded: bool = False) -> DataFrame:
    """The group's row count on every row (aggregate, then join back)."""
    c = df.groupBy(*keys).agg(F.count("*").alias(name), F.count("*").alias("_n"))
    return _join_groups(df, c, keys, "inner", bounded, "_n")


def comparison(df: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Only the rows of groups that have more than one row (HAVING count > 1)."""
    rep = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return _join_groups(df, rep, keys, "left_semi", bounded, "_n")


def first_params(df: DataFrame, keys: Sequence[str], order: str, params: Sequence[str]) -> DataFrame:
    """Parameters of the first row of each group (by a unique order)."""
    st = F.struct(*[F.col(p) for p in params])
    out = df.groupBy(*keys).agg(F.min_by(st, F.col(order)).alias("_p"))
    return out.select(*keys, *[F.col(f"_p.{p}").alias(p) for p in params])


def peak_at(df: DataFrame, keys: Sequence[str], value: str, arg: str) -> DataFrame:
    """Best value and the argument it came from (ties -> smallest argument)."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(arg)).alias("na")))
    out = df.groupBy(*keys).agg(best.alias("_b"))
    return out.select(*keys, F.col("_b.v").alias(f"max_{value}"), (-F.col("_b.na")).alias(f"{arg}_at_max"))


def to_series(df: DataFrame, series: str, ord_col: str, cat_col: str, val_col: str) -> DataFrame:
    """Chart series as ordered parallel arrays ``categories`` and ``data``.

    Input is first reduced to one row per (series, category), so each array
    holds the distinct categories of a series (chart-sized), never raw rows.
    """
    pts = df.groupBy(series, cat_col).agg(F.min(ord_col).alias("_o"), F.sum(val_col).alias("_v"))
    g = pts.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("_o", cat_col, "_v"))).alias("_a"))
    return g.select(series, F.transform("_a", lambda x: x[cat_col]).alias("categories"),
                    F.transform("_a", lambda x: x["_v"]).alias("data"))


def count_results(df: DataFrame, name: str = "n_results") -> DataFrame:
    """Number of recognised results; the report refuses an empty set.

    The check happens lazily inside the plan (``raise_error``), no extra job.
    """
    c = df.agg(F.count("*").alias(name))
    return c.select(F.when(F.col(name) > 0, F.col(name))
                    .otherwise(F.raise_error(F.lit(NO_RESULTS))).alias(name))


def per_device(df: DataFrame, keys: Sequence[str], value: str, devices: str) -> DataFrame:
    """Total over the group and the same total per device."""
    out = df.groupBy(*keys).agg(F.sum(value).alias("total"), F.sum(devices).alias("devices"))
    return out.withColumn("per_device", F.col("total") / F.nullif(F.col("devices").cast("double"), F.lit(0.0)))
