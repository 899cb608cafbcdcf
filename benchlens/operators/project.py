"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse_size, with_placeholder


def _first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """coalesce over the candidate names that exist in the schema (else NULL)."""
    have = [F.col(n) for n in names if n in df.columns]
    if not have:
        return F.lit(None)
    return have[0] if len(have) == 1 else F.coalesce(*have)


def project_metrics(df: DataFrame, metrics: Sequence[tuple], keep: Sequence[str] = ()) -> DataFrame:
    """Keep the declared metric keys, renamed to their label, as DOUBLE.

    ``metrics`` holds (key, label, aliases): the canonical key is preferred and
    the aliases fill in when it is absent or NULL (producers that write a
    different key name still reach the report).
    """
    out = [F.col(k) for k in keep]
    for key, label, aliases in metrics:
        out.append(_first_present(df, [key, *aliases]).try_cast("double").alias(label))
    return df.select(*out)


def to_scalars(df: DataFrame, keys: Sequence[str], metrics: Sequence[str],
               name: str = "metric", value: str = "value") -> DataFrame:
    """P2 + P3: wide -> long, one point per non-NULL metric (zeros are kept)."""
    long = df.unpivot(list(keys), list(metrics), name, value)
    return long.where(F.col(value).isNotNull())


def cap(df: DataFrame, size_col: str, max_bytes: int) -> DataFrame:
    """Keep rows whose parsed size label is at most ``max_bytes``."""
    return df.where(parse_size(size_col) <= F.lit(max_bytes))


def project_params(df: DataFrame, doc: str, keys: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    """P5: parameters captured by key *presence* in a VARIANT document.

    A key present with JSON null is kept (value NULL, ``is_null`` true); an
    absent key produces no row.  Output: id_cols, param, value (JSON text), is_null.
    """
    d = F.col(doc)
    entries = [F.struct(F.lit(k).alias("param"), F.variant_get(d, f"$.{k}", "variant").alias("v"))
               for k in keys]
    x = df.select(*id_cols, F.explode(F.array(*entries)).alias("e"))
    x = x.where(F.col("e.v").isNotNull())  # SQL NULL = key absent
    return x.select(*id_cols, F.col("e.param").alias("param"),
                    F.when(~F.is_variant_null("e.v"), F.to_json("e.v")).alias("value"),
                    F.is_variant_null("e.v").alias("is_null"))


def with_placeholders(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Display copy of ``cols`` with '—' for missing values."""
    return df.select(*[with_placeholder(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def leader_only(df: DataFrame, rank_col: str = "rank") -> DataFrame:
    """Only rank 0 reports."""
    return df.where(F.col(rank_col) == 0)


def validate(df: DataFrame, col: str, threshold: float, name: str = "status") -> DataFrame:
    """Residual below threshold -> 'PASSED', else 'FAILED' (NULL -> FAILED)."""
    ok = F.coalesce(F.col(col) < F.lit(threshold), F.lit(False))
    return df.withColumn(name, F.when(ok, "PASSED").otherwise("FAILED"))


def process_grids(df: DataFrame, ranks_col: str) -> DataFrame:
    """Every process grid P x Q = ranks with P <= Q, one row per grid."""
    n = F.col(ranks_col)
    p = F.explode(F.sequence(F.lit(1), F.greatest(F.floor(F.sqrt(n)).cast("int"), F.lit(1))))
    x = df.select("*", p.alias("p"))
    return (x.where((n % F.col("p")) == 0)
             .withColumn("q", (n / F.col("p")).cast("int"))
             .where(F.col("p") <= F.col("q")))
