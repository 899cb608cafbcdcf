"""Numeric expressions: rates, rounding, utilisation, sizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col


def mb_per_s(bytes_per_s) -> Column:
    """bytes/s -> MB/s (decimal 1e6)."""
    return col(bytes_per_s).cast("double") / F.lit(1e6)


def gb_per_s(nbytes, seconds) -> Column:
    """bytes over seconds -> GB/s (decimal 1e9); 0.0 when seconds <= 0."""
    t = col(seconds).cast("double")
    return F.when(t > 0, col(nbytes).cast("double") / F.lit(1e9) / t).otherwise(F.lit(0.0))


def round_half_even(c, digits: int) -> Column:
    """round half to even (banker's rounding), as the producers round."""
    return F.bround(col(c).cast("double"), digits)


def mfu_pct(flops_per_step, steps_per_s, peak_flops, world) -> Column:
    """model FLOPS utilisation in percent.

    flops/step x steps/s / (peak x world) x 100; NULL when flops/step is
    missing or zero (the producer tests it for truthiness).
    """
    f = F.nullif(col(flops_per_step).cast("double"), F.lit(0.0))
    return f * col(steps_per_s) / (col(peak_flops) * col(world)) * F.lit(100.0)


def node_class(world) -> Column:
    """world size <= 8 ranks -> '1node', else '2node'."""
    return F.when(col(world) <= 8, F.lit("1node")).otherwise(F.lit("2node"))


def global_batch(per_rank_batch, world) -> Column:
    """F8: global batch = per-rank batch x world size."""
    return (col(per_rank_batch) * col(world)).cast("bigint")


def model_sizing(model_gb, world, default_params: float = 6e9, block: float = 1e8):
    """(params, params per rank, blocks) for a bf16 model of ``model_gb``.

    params = int(gb * 1e9 / 2) (2 bytes each), default 6e9 when gb is NULL or 0
    (the producer tests the size for truthiness); per rank = params div world;
    blocks = per rank div 1e8.
    """
    gb = col(model_gb).cast("double")
    params = F.when(gb.isNull() | (gb == 0), F.lit(int(default_params))).otherwise(
        F.floor(gb * F.lit(1e9) / F.lit(2.0))).cast("bigint")
    per_rank = F.floor(params / col(world)).cast("bigint")
    blocks = F.floor(per_rank / F.lit(block)).cast("bigint")
    return params, per_rank, blocks


def problem_size(mem_bytes, fill: float = 0.8) -> Column:
    """Linpack N = sqrt(fill x memory bytes / 8) (8-byte doubles), floored."""
    return F.floor(F.sqrt(F.lit(fill) * col(mem_bytes).cast("double") / F.lit(8.0))).cast("bigint")


def share_pct(used, total) -> Column:
    """used / total x 100."""
    return col(used).cast("double") / col(total).cast("double") * F.lit(100.0)


def headroom(used, total) -> Column:
    """how many times ``used`` fits into ``total`` (floored, e.g. ~4x)."""
    return F.floor(col(total).cast("double") / col(used).cast("double")).cast("bigint")


def transfer_seconds(size, rate) -> Column:
    """F16: time = size / rate (same units); NULL for a zero rate."""
    return col(size).cast("double") / F.nullif(col(rate).cast("double"), F.lit(0.0))


def ratio(a, b) -> Column:
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))
