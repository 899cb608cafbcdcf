"""Column expressions (vectorised, JVM-side; no Python UDFs)."""

from .metrics import (gb_per_s, global_batch, headroom, mb_per_s, mfu_pct, model_sizing,
                      node_class, problem_size, ratio, round_half_even, share_pct,
                      transfer_seconds)
from .sizes import format_size, geometric_series, parse_size, test_file_size
from .text import dataset_path, metric_text, task_label, with_placeholder

__all__ = [
    "parse_size", "format_size", "test_file_size", "geometric_series",
    "mb_per_s", "gb_per_s", "round_half_even", "mfu_pct", "node_class", "global_batch",
    "model_sizing", "problem_size", "share_pct", "headroom", "transfer_seconds", "ratio",
    "dataset_path", "task_label", "metric_text", "with_placeholder",
]
