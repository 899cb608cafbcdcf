"""Sweep plan: raw tester outputs -> per-size summary -> curve
verdicts -> result records.

J9 plans the trials; S5 reads bandwidth out of each raw output; F4 -> A1/A2
-> F5 -> A11 make the summary row per size; O2 orders by parsed size; W3/W4/W5
judge the curve; J4 names the layout class; K1 writes the records.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, sinks
from ..functions import parse_size
from ..operators import agg, joins, windows
from ..operators.ranking import materialize
from ..sources import documents as D


def plan_trials(df: DataFrame, sizes: Sequence[str] | None = None, passes: int = 3,
                max_bytes: int | None = None) -> DataFrame:
    """J9 + P4: per input row (cluster) every size x {write, read} x pass, up to ``max_bytes`` if given.

    Size labels that do not parse are an error, not silently left out.
    """
    labels = list(sizes or [lbl for lbl, _ in dims.SWEEP_SIZES])
    bad = [x for x in labels if not re.fullmatch(r"[0-9]+[kmg]?", x.lower())]
    if bad:
        raise ValueError(f"sizes that do not parse: {bad}")
    g = joins.trial_grid(df, {"block_size": labels, "rw": ["write", "read"],
                              "pass": list(range(1, passes + 1))})
    return g.where(parse_size("block_size") <= max_bytes) if max_bytes is not None else g


def trials_from_outputs(raw: DataFrame, raw_col: str = "raw", rw_col: str = "rw") -> DataFrame:
    """``jobs[0].<rw>.bw_bytes`` of each raw tester JSON output (by the trial's direction)."""
    d = D.parse_documents(raw, raw_col, "_doc")
    bw = F.when(F.col(rw_col) == "write", D.extract_path("_doc", "$.jobs[0].write.bw_bytes")) \
          .otherwise(D.extract_path("_doc", "$.jobs[0].read.bw_bytes"))
    return d.withColumn("bw_bytes", bw).drop("_doc")


def summarize(trials: DataFrame, keys: Sequence[str] = ("block_size",)) -> DataFrame:
    """Per (keys, size): write/read median and min MB/s (upper median, half-even to 0.1)."""
    keys = list(keys)
    # the selection of the medians scans the trials a few times: keys and bandwidth only, parsed once
    trials = materialize(trials.select(*keys, "rw", "bw_bytes"), "trials")
    stats = agg.sweep_stats(trials, [*keys, "rw"], "bw_bytes")
    wide = agg.pivot_rw(stats, keys, "rw", ["bw_median_mbs", "bw_min_mbs"])
    return wide.withColumn("size_bytes", parse_size("block_size"))


def curve_verdicts(summary: DataFrame, series: Sequence[str] = (), eps: float = 0.10,
                   small_threshold: float = 0.5) -> DataFrame:
    """W4 + W5 on the read curve of each series: plateau/recommended size, small-file penalty."""
    series = list(series) or ["_all"]
    s = summary if "_all" not in series else summary.withColumn("_all", F.lit(1))
    p = windows.plateau(s, series, "size_bytes", "read_bw_median_mbs", eps)
    q = windows.small_file_penalty(s, series, "size_bytes", "read_bw_median_mbs", threshold=small_threshold)
    out = p.join(q, series)
    return out.drop("_all") if "_all" in series else out


def with_layout_class(summary: DataFrame, spark: SparkSession) -> DataFrame:
    """The storage layout class each swept size stands for."""
    return summary.withColumn("layout_class", joins.size_class_fixed(F.col("size_bytes"), dims.SIZE_CLASSES))


def to_records(summary: DataFrame, header: dict, keys: Sequence[str] = ()) -> DataFrame:
    """K1 shape: one document per sweep (header + ``sweep`` array ordered by size),
    elements as the sweep job writes them (display label, size, workers, passes,
    write/read median and min MB/s).

    The array holds one element per swept size (a handful), never raw trials.
    """
    keys = list(keys)
    label = F.lit(None).cast("string")
    for lbl, disp in reversed(dims.SWEEP_SIZES):
        label = F.when(F.col("block_size") == lbl, F.lit(disp)).otherwise(label)
    el = F.struct(F.col("size_bytes").alias("_o"), label.alias("block_size_label"), "block_size",
                  F.lit(header.get("workers")).alias("workers"), F.lit(header.get("passes")).alias("passes"),
                  "write_bw_median_mbs", "write_bw_min_mbs", "read_bw_median_mbs", "read_bw_min_mbs")
    g = summary.groupBy(*keys).agg(F.array_sort(F.collect_list(el)).alias("_s")) if keys else \
        summary.agg(F.array_sort(F.collect_list(el)).alias("_s"))
    sweep = F.transform("_s", lambda x: x.dropFields("_o"))
    return g.select(*keys, *[F.lit(v).alias(k) for k, v in header.items()], sweep.alias("sweep"))


def write_records(records: DataFrame, path: str, keys: Sequence[str], prefix: str = "storage_sweep_") -> int:
    """K1: every sweep record as a JSON document of its own, named by the registry's prefix and its keys,
    so that a report over the folder recognises it."""
    name = F.concat(F.lit(prefix), F.concat_ws("_", *keys))
    return sinks.write_documents(records.select(name.alias("name"), F.to_json(F.struct(*records.columns)).alias("text")), path, "name", "text")
