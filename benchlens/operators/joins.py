"""Lookups as joins.

A lookup table in a DataFrame may have any size, and rows meet it by equal keys
only: a name its prefixes (J1), a name the trigrams of patterns (J2), a size the
dyadic nodes above it (J4), a key its place on a curve (J5).  Keyed tables are
equi-joins that AQE broadcasts or splits by their real size.  The fixed reference
tables also have literal forms (``*_fixed``), CASE chains with the same answers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import asof_lookup, stab
from .patterns import first_matches


def classify(df: DataFrame, stem_col: str | Sequence[str], registry: DataFrame | Sequence[tuple], how: str = "left") -> DataFrame:
    """Benchmark of each file by the first registry prefix its stem starts with.

    Of several columns (the stem, then its folder) the first that matches decides.
    ``how='left'`` keeps unknown files with NULL bench; ``'inner'`` drops them.
    ``registry`` is a table with (reg_ord, prefix, bench) or the literal rows of one,
    which are tried in the row.  A table meets each distinct stem by an equi-join
    on the stem's prefixes of the lengths that the table has.
    """
    stems = [stem_col] if isinstance(stem_col, str) else list(stem_col)
    rule = "struct<reg_ord:int,prefix:string,bench:string>"
    if isinstance(registry, DataFrame):
        rule = registry.select(F.struct("reg_ord", "prefix", "bench")).schema[0].dataType
        best, x, hits = _prefix_rules(df, stems, registry), df, []
        for i, stem in enumerate(stems):
            x = x.join(best.select(F.col("_name").alias(f"_name{i}"), F.col("_rule").alias(f"_rule{i}")), F.col(stem) == F.col(f"_name{i}"), "left")
            hits.append(F.col(f"_rule{i}"))
    else:
        x, hits = df, [_prefix_fixed(F.col(stem), registry, rule) for stem in stems]
    # out of a generator of one element, so that the chain is evaluated once a row
    hit = F.coalesce(*hits)
    x = x.select(*[df[c] for c in df.columns], F.explode(F.array(hit)).alias("_rule"))
    x = x.select(*df.columns, F.col("_rule.prefix").alias("prefix"), F.col("_rule.reg_ord").alias("reg_ord"), F.col("_rule.bench").alias("bench"))
    return x.where(F.col("prefix").isNotNull()) if how == "inner" else x


def _prefix_rules(df: DataFrame, stems: Sequence[str], registry: DataFrame) -> DataFrame:
    """(_name, _rule): the first rule of every distinct stem that has one."""
    rules = registry.where(F.col("prefix").isNotNull()).groupBy(F.col("prefix").alias("_prefix")).agg(
        F.min(F.struct("reg_ord", "prefix", "bench")).alias("_rule"))
    lengths = registry.agg(F.collect_set(F.length("prefix")).alias("lengths")).scalar()  # distinct lengths, not rows
    names = df.select(F.explode(F.array(*[F.col(s) for s in stems])).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    heads = F.transform(F.filter("_lengths", lambda n: n <= F.length("_name")), lambda n: F.substring(F.col("_name"), F.lit(1), n))
    cand = names.withColumn("_lengths", lengths).select("_name", F.explode(heads).alias("_prefix")).join(rules, "_prefix")
    return cand.groupBy("_name").agg(F.min("_rule").alias("_rule"))


def _prefix_fixed(stem: Column, rows: Sequence[tuple], kind: str) -> Column:
    val = F.lit(None).cast(kind)
    for reg_ord, prefix, bench in sorted(rows, reverse=True):
        val = F.when(stem.startswith(prefix), F.struct(F.lit(reg_ord), F.lit(prefix), F.lit(bench)).cast(kind)).otherwise(val)
    return val


def lookup_first_match(df: DataFrame, name_col: str, table: DataFrame | Sequence[tuple], value_col: str,
                       default=None, override=None, out: str | None = None) -> DataFrame:
    """First table row (by ``ord``) whose case-insensitive regex matches.

    ``table`` has (ord, pattern, <value_col>), or is the literal rows of one, which
    are tried in the row.  No match -> ``default``; ``override`` (a literal) wins over
    everything when given.  Patterns of a table are tried on the distinct names that
    hold their rarest trigram (see ``patterns``), and the answer is joined back by name.
    """
    out = out or value_col
    fixed = not isinstance(table, DataFrame)
    kind = ("double" if isinstance(table[0][2], float) else "int") if fixed else dict(table.dtypes)[value_col]
    if override is not None:
        return df.withColumn(out, F.lit(override).cast(kind))
    if fixed:
        return df.withColumn(out, first_match_fixed(F.col(name_col), table, kind, default))
    best = first_matches(df.select(F.col(name_col).alias("_name")), table, value_col).withColumnRenamed("value", "_val")
    res = df.join(best, F.col(name_col) == F.col("_name"), "left").select(*[df[c] for c in df.columns], "_val")
    val = F.coalesce("_val", F.lit(default).cast(kind)) if default is not None else F.col("_val")
    return res.withColumn(out, val).drop("_val")


def first_match_fixed(name: Column, rows: Sequence[tuple[int, str, object]], kind: str, default=None) -> Column:
    """J2 for a literal table of (ord, pattern, value): a CASE chain, compiled once."""
    val = F.lit(default).cast(kind)
    for _, pattern, value in sorted(rows, key=lambda r: r[0], reverse=True):
        val = F.when(name.rlike("(?i)" + pattern), F.lit(value).cast(kind)).otherwise(val)
    return val


def lookup_peak(df: DataFrame, name_col: str, table: DataFrame | None = None, default: float | None = None,
                override: float | None = None, out: str = "peak_flops") -> DataFrame:
    """J2 as the trainer uses it: peak FLOPS of a device name from the (ord,
    pattern, flops) table, first case-insensitive match, default when none
    matches, and an override (FLOPS, not TFLOPS) that wins over both."""
    from .. import dims
    return lookup_first_match(df, name_col, dims.PEAK_FLOPS if table is None else table, "flops",
                              default=dims.DEFAULT_PEAK_FLOPS if default is None else default,
                              override=override, out=out)


def existing_folder(df: DataFrame, path_col: str, folders: DataFrame, fallback: str, out: str = "dataset_path") -> DataFrame:
    """the path where its folder exists (``folders`` has a column ``path``), else the fallback column."""
    have = folders.select(F.col("path").alias("_have")).distinct()
    x = df.join(have, F.col(path_col) == F.col("_have"), "left")
    return x.withColumn(out, F.coalesce("_have", fallback)).drop("_have")


def efficiency(df: DataFrame, metric_col: str, measured_col: str, spec: DataFrame) -> DataFrame:
    """Measured / device peak x 100, and measured / other device's peak.

    ``spec`` has (metric, peak, other_peak).
    """
    s = spec.select(F.col("metric").alias(metric_col), "peak", "other_peak")
    x = df.join(s, metric_col, "left")
    m = F.col(measured_col).cast("double")
    return (x.withColumn("pct_of_peak", m / F.col("peak") * F.lit(100.0))
             .withColumn("vs_other", m / F.nullif(F.col("other_peak"), F.lit(0.0))))


def size_class(df: DataFrame, size_col: str, classes: DataFrame, out: str = "class", order: str | None = None) -> DataFrame:
    """Class of a size from [lo, hi) ranges (hi NULL = open) that may nest and overlap.

    The first range in the table's order that holds the size decides; ``order``
    names the column of that order, without it ranges are ordered by (lo, hi).
    """
    c = classes.withColumns({"_hi_open": F.col("hi").isNull(), "_lo": F.col("lo"), "_hi": F.col("hi")})
    cuts = stab(c, "lo", "hi", [order] if order else ["_lo", "_hi_open", "_hi"], "class")
    x = asof_lookup(df, size_col, cuts.select(F.col("cut").alias("_cut"), F.col("class").alias("_class")), "_cut", ["_class"])
    return x.withColumn(out, F.col("_class")).drop("_cut", "_class")


def size_class_fixed(size: Column, rows: Sequence[tuple]) -> Column:
    """J4 for literal ranges (lo, hi, class) in the table's order, with the same rule: a CASE chain."""
    val = F.lit(None).cast("string")
    for lo, hi, name in reversed(rows):
        held = size >= F.lit(lo)
        val = F.when(held if hi is None else held & (size < F.lit(hi)), F.lit(name)).otherwise(val)
    return val


def asof_fixed(df: DataFrame, key_col: str, rows: Sequence[tuple], cols: Sequence[str], types: Sequence[str]) -> DataFrame:
    """J5 for a literal curve (rows of ``cols``, the key first): CASE chains."""
    for j, (c, t) in enumerate(zip(cols, types, strict=True)):
        val = F.lit(None).cast(t)
        for row in sorted(rows, key=lambda r: r[0]):
            val = F.when(F.col(key_col) >= F.lit(row[0]), F.lit(row[j]).cast(t)).otherwise(val)
        df = df.withColumn(c, val)
    return df


def expected_read_time(files: DataFrame, size_col: str, curve: DataFrame, curve_size: str = "curve_bytes",
                       rate_col: str = "read_mbs", out: str = "expected_s") -> DataFrame:
    """J5 + F16: expected seconds to read each file at the rate of the largest
    swept size not above it (MB/s, decimal); NULL below the first size."""
    x = asof_lookup(files, size_col, curve, curve_size, [rate_col])
    return x.withColumn(out, F.col(size_col).cast("double") / F.lit(1e6)
                        / F.nullif(F.col(rate_col).cast("double"), F.lit(0.0)))


def scaling(df: DataFrame, keys: Sequence[str], nodes_col: str, value_col: str,
            base: int = 1) -> DataFrame:
    """N-node vs base-node throughput: ratio and efficiency = ratio / node factor.

    One aggregation; the base is picked by a window over its few rows.  A
    configuration without a base run keeps its rows with NULL ratios.
    """
    keys = list(keys)
    agg = df.groupBy(*keys, nodes_col).agg(F.avg(value_col).alias("thr"))
    x = agg.withColumn("base_thr", F.max(F.when(F.col(nodes_col) == base, F.col("thr"))).over(Window.partitionBy(*keys)))
    r = F.col("thr") / F.nullif(F.col("base_thr"), F.lit(0.0))
    return x.where(F.col(nodes_col) != base).select(*keys, nodes_col, "base_thr", "thr", r.alias("scale_ratio"),
                                                    (r / (F.col(nodes_col) / F.lit(base))).alias("scale_eff"))


def bottleneck(consumer: DataFrame, supplier: DataFrame, keys: Sequence[str],
               consumer_rate: str, supplier_rate: str) -> DataFrame:
    """Consumer (training) rate vs supplier (storage) rate on the same cluster.

    A cluster with one side only stays, with NULL headroom and bottleneck.
    """
    x = consumer.join(supplier, list(keys), "full_outer")
    c, s = F.col(consumer_rate), F.col(supplier_rate)
    return (x.withColumn("headroom", s / F.nullif(c, F.lit(0.0)))
             .withColumn("bottleneck", F.when(c < s, F.lit("compute_or_network")).when(c >= s, F.lit("storage"))))


def coverage(df: DataFrame, stem_col: str, registry: DataFrame, rules: Sequence[tuple] | None = None):
    """(unknown files, registry entries without any file, known files).

    ``rules`` are the literal rows of a fixed registry (see ``classify``).
    """
    c = classify(df, stem_col, registry if rules is None else rules, "left")
    unknown = c.where(F.col("bench").isNull()).drop("prefix", "reg_ord", "bench")
    found = c.where(F.col("prefix").isNotNull()).select("prefix").distinct()
    missing = registry.join(found, "prefix", "left_anti")
    known = c.where(F.col("bench").isNotNull()).drop("prefix", "reg_ord", "bench")
    return unknown, missing, known


def trial_grid(df: DataFrame, dims: dict) -> DataFrame:
    """Every combination of the given literal lists for each input row.

    Chained ``explode`` of literal arrays (a generator, no join): rows x product.
    """
    for name, values in dims.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def expand_grid(df: DataFrame, array_cols: Sequence[str]) -> DataFrame:
    """Product of the array columns of each row (config lists)."""
    for c in array_cols:
        df = df.withColumn(c, F.explode(F.col(c)))
    return df
