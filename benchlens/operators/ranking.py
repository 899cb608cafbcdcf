"""Skew-safe exact order statistics and positions.

A window ``partitionBy(group)`` sends every row of a group to one task; when one
group holds a third of all rows that task is the whole job.  The helpers here
keep every task bounded, with one plan for inputs of any size:

* ``kth_values`` finds the exact value at given 1-based ranks per group by
  distributed selection.  Each pass cuts the interval of every (group, rank) that
  is still open into ``BINS`` equal bins, counts the rows per bin (map-side
  partial counts, at most groups x ranks x bins rows in the shuffle, never
  the rows themselves) and goes on with the bin that holds the rank, between the
  smallest and largest value in it.  A bin of one value is the answer; on
  measurements two or three passes do.
* ``row_positions`` numbers rows within a group by a unique order, like
  ``row_number()``: rows are range-partitioned and sorted by (group, order) and
  written once with their place in the part; a group's rows in earlier parts
  are added from a table of one row per part and group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_subdir


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (as ``groupBy`` treats it),
    keeping one copy of the keys."""
    keys = list(keys)
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared checkpoint folder
    and read it back.  Unlike ``checkpoint()``, whose write recomputes the plan
    unless it is cached, the rows are computed once.  The tables are left for the cluster's
    checkpoint-folder retention to remove, like checkpoint files."""
    path = shared_subdir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranged(df: DataFrame, cols: Sequence[str], name: str, num_partitions: int | None = None) -> DataFrame:
    """``df`` cut into ranges of ``cols`` (equal keys stay together), sorted, written once.

    ``_at`` numbers the rows: the range's number above bit 33, the row's place in
    it below.  Writing fixes the ranges, so a recomputed task cannot see others.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    return materialize(x.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_bk", F.shiftright("_at", 33))


#: Bins of a pass of the selection, beside those of infinities and NaN.
BINS = 1 << 16


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value by its place between the finite bounds; -inf before all, inf and then NaN after them."""
    half = lambda x: x / F.lit(2.0)  # noqa: E731  the width of an interval may be above the largest double
    wide = (hi - lo) == F.lit(float("inf"))
    width = F.when(wide, half(hi) - half(lo)).otherwise(hi - lo)
    place = F.when(wide, half(v) - half(lo)).otherwise(v - lo)
    inner = F.when(width > 0, F.least(F.floor(place / width * F.lit(float(bins))).cast("int"), F.lit(bins - 1))).otherwise(F.lit(0))
    return F.when(F.isnan(v), F.lit(bins + 1)).when(v == float("inf"), F.lit(bins)).when(v == float("-inf"), F.lit(-1)).otherwise(inner)


def _bounds(v: Column) -> list[Column]:
    """The smallest and largest value, and the same of finite ones."""
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return [F.min(v).alias("_a"), F.max(v).alias("_z"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")]


def kth_values(df: DataFrame, keys: Sequence[str], value: str,
               ranks: dict[str, Callable[[Column], Column]],
               extra: dict[str, Callable[[Column, Column], Column]] | None = None, bins: int | None = None) -> DataFrame:
    """Exact value at 1-based rank ``ranks[name](n)`` per group.

    ``extra`` adds aggregates of (value, count) pairs, e.g. ``{"min": lambda v, c:
    F.min(v)}``, from the first scan.  Returns ``keys + ['n'] + list(extra) +
    list(ranks)``.  NULL values are ignored; NaN is the largest value; without keys
    all rows are one group.  The rows are scanned once and then once a pass; only
    (group, rank) tables are written.
    """
    extra, bins = extra or {}, bins or BINS
    names = list(keys)
    keys = names or ["_all"]
    base = df if names else df.withColumn("_all", F.lit(1))
    v = F.col("_v")
    base = base.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull())
    groups = materialize(base.groupBy(*keys).agg(F.count("*").alias("n"), *_bounds(v), *[
        fn(v, F.lit(1)).alias(f"_x_{name}") for name, fn in extra.items()]), "kth-groups")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), fn(F.col("n")).cast("long").alias("_need")) for name, fn in ranks.items()]))
    state = groups.select(*keys, "_a", "_z", "_lo", "_hi", wanted.alias("_w")).select(*keys, "_w.*", "_a", "_z", "_lo", "_hi")
    state = state.where("_need IS NOT NULL")
    found, open_ = [state.where("_a = _z")], state.where("_a <> _z")
    by = [*keys, "_name"]
    while not open_.isEmpty():
        x = join_null_safe(base, open_, keys).where((v >= F.col("_a")) & (v <= F.col("_z")))
        x = x.withColumn("_bin", _bin(v, F.col("_lo"), F.col("_hi"), bins))
        h = x.groupBy(*by, "_need", "_bin").agg(F.count("*").alias("_c"), *_bounds(v))
        w = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        h = h.withColumn("_cum", F.sum("_c").over(w)).where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_c") < F.col("_need")))
        h = h.withColumn("_need", F.col("_need") - F.col("_cum") + F.col("_c"))
        state = materialize(h.select(*by, "_need", "_a", "_z", "_lo", "_hi"), "kth-state")
        found.append(state.where("_a = _z"))
        open_ = state.where("_a <> _z")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    values = out.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_a"))).alias(name) for name in ranks])
    res = join_null_safe(groups.select(*keys, "n", *[F.col(f"_x_{name}").alias(name) for name in extra]), values, keys, "left")
    return res.select(*names, "n", *extra, *ranks)


def ordinal_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                   **kw) -> DataFrame:
    """A1: upper median ``sorted(x)[n // 2]`` per group (no averaging)."""
    out = kth_values(df, keys, value, {name: lambda n: F.floor(n / 2) + 1}, **kw)
    return out.drop("n")


def percentile_cont(df: DataFrame, keys: Sequence[str], value: str, p: float,
                    name: str, **kw) -> DataFrame:
    """Exact linear-interpolated percentile per group (DuckDB quantile_cont).

    pos = (n - 1) * p; result = x[floor(pos)] + frac * (x[ceil(pos)] - x[floor(pos)]).
    """
    pos = lambda n: (n - 1) * F.lit(p)
    out = kth_values(df, keys, value,
                     {"_x0": lambda n: F.floor(pos(n)) + 1, "_x1": lambda n: F.ceil(pos(n)) + 1}, **kw)
    frac = pos(F.col("n")) - F.floor(pos(F.col("n")))
    return out.select(*keys, "n", *(kw.get("extra") or {}), (F.col("_x0") + frac * (F.col("_x1") - F.col("_x0"))).alias(name))


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  name: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row within its group by a *unique* order.

    Same result as ``row_number().over(partitionBy(keys).orderBy(order))``, but
    no group is gathered into one task: see the module text.
    """
    keys = list(keys)
    x = ranged(df, [*keys, *order], "positions", num_partitions)
    parts = x.groupBy("_bk", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_bk", *keys, "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    # null-safe on the group keys: a NULL group is a group like any other
    res = join_null_safe(x, parts, ["_bk", *keys])
    return res.withColumn(name, F.col("_at") - F.col("_first") + F.col("_off") + 1).drop("_at", "_bk", "_first", "_off")
