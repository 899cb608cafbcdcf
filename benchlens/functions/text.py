"""String expressions: labels, paths, one-line metric text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

EM_DASH_SEP = " — "
PLACEHOLDER = "—"


def dataset_path(slug, root, fallback=None) -> Column:
    """'<root>/<org>--<name>': the first '/' of the slug becomes '--'.

    When the slug is NULL the fallback path (if any) is used.
    """
    p = F.concat(col(root), F.lit("/"), F.regexp_replace(col(slug), r"^([^/]*)/", r"$1--"))
    return p if fallback is None else F.coalesce(p, col(fallback))


def task_label(bench, cluster, ts) -> Column:
    """'<bench> — <cluster> — yyyy-MM-dd HH:mm UTC' (session time zone UTC)."""
    when = F.concat(F.date_format(col(ts), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
    return F.concat_ws(EM_DASH_SEP, col(bench), col(cluster), when)


def metric_text(pairs: list[tuple[str, object]]) -> Column:
    """'label: value' for each non-null value, joined by two spaces."""
    parts = [F.when(col(c).isNotNull(), F.concat(F.lit(f"{label}: "), col(c).cast("string")))
             for label, c in pairs]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "  ")


def with_placeholder(c) -> Column:
    """Missing value shown as an em dash in display tables."""
    return F.coalesce(col(c).cast("string"), F.lit(PLACEHOLDER))
