"""Range tables and curves (J4, J5): interval stabbing and as-of lookup.

``stab`` turns ranges that may nest, overlap and repeat into disjoint pieces.  The
bounds of all ranges, in order, are the cuts; a range covers a run of cuts, and a run
is made of few dyadic nodes (level l, number k: cuts k * 2**l up to the next), at most
two a level.  The first range of a node is an aggregate; the first range at a cut
is the first of the nodes above it.  So ranges times log(cuts) rows meet by
equal keys, however many ranges cover a point.

``asof_lookup`` writes keys only: the distinct keys of the rows and the curve, sorted
together; the rows get their answer by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import join_null_safe, materialize, ranged, row_positions

#: Nodes of the so many highest levels, fewer than 2 ** (TOP + 1) rows, are broadcast; each of the
#: others is above at most one in 2 ** (TOP - 1) of the cuts, so no key of the other join is hot.
TOP = 10


def _left(c, by):
    return F.call_function("shiftleft", c, by)


def _right(c, by):
    return F.call_function("shiftright", c, by)


def _dyadic(a: str, b: str):
    """The nodes (l, k) that make up the run [a, b): those inside it whose parent is not."""
    one = F.lit(1).cast("bigint")

    def inside(level, k):
        first = _left(k, level)
        return (first >= F.col(a)) & (first + _left(one, level) <= F.col(b))

    def of_level(level):
        ks = F.array_distinct(F.array(_right(F.col(a) + _left(one, level) - 1, level), _right(F.col(b), level) - 1))
        return F.transform(F.filter(ks, lambda k: inside(level, k) & ~inside(level + 1, _right(k, F.lit(1)))),
                           lambda k: F.struct(level.alias("l"), k.alias("k")))
    levels = F.sequence(F.lit(0), F.floor(F.log2((F.col(b) - F.col(a)).cast("double")) + 1e-9).cast("int"))
    return F.flatten(F.transform(levels, of_level))


def stab(ranges: DataFrame, lo: str, hi: str, order: Sequence[str], value: str) -> DataFrame:
    """(cut, <value>): from each cut to the next, the first range by ``order`` that holds it (NULL where none does).

    Ranges are [lo, hi), open above where hi is NULL; those without lo and empty
    ones hold nothing.
    """
    r = ranges.select(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.struct(*[F.col(c) for c in order], F.col(value).alias("_value")).alias("first"))
    r = r.where("lo IS NOT NULL AND (hi IS NULL OR lo < hi)").groupBy("lo", "hi").agg(F.min("first").alias("first"))
    r = materialize(r, "ranges")
    cuts = r.select(F.explode(F.array("lo", "hi")).alias("cut")).where("cut IS NOT NULL").distinct()
    cuts = materialize(row_positions(cuts, [], ["cut"], "pos").select("cut", (F.col("pos") - 1).alias("pos")), "cuts")
    n = cuts.count()
    top = max(n - 1, 1).bit_length()
    at = r.join(cuts.select(F.col("cut").alias("lo"), F.col("pos").alias("a")), "lo")
    at = at.join(cuts.select(F.col("cut").alias("hi"), F.col("pos").alias("b")), "hi", "left").select("a", F.coalesce("b", F.lit(n)).alias("b"), "first")
    nodes = at.select(F.explode(_dyadic("a", "b")).alias("node"), "first").groupBy("node.l", "node.k").agg(F.min("first").alias("first"))
    low = max(top - TOP, 0)
    if low:  # read twice then
        nodes = materialize(nodes, "nodes")

    def above(levels, found: DataFrame) -> DataFrame:
        x = cuts.select("cut", F.explode(F.sequence(*map(F.lit, levels))).alias("l"), "pos").withColumn("k", _right(F.col("pos"), F.col("l")))
        return x.join(found.where(F.col("l").between(*levels)), ["l", "k"], "left").select("cut", "first")
    both = above((low, top), F.broadcast(nodes.where(F.col("l") >= low)))
    if low:
        both = both.union(above((0, low - 1), nodes))
    return both.groupBy("cut").agg(F.min("first").alias("first")).select("cut", F.col("first._value").alias(value))


def asof_lookup(df: DataFrame, key_col: str, curve: DataFrame, curve_key: str,
                curve_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """As-of lookup: the curve row with the largest key <= the row's key (same ``by`` values), or NULLs.

    The distinct (by, key) pairs of the rows are unioned with the curve,
    range-partitioned and written once (see ``ranking.ranged``): keys and curve
    columns only, no column of the rows.  Within a range a running
    ``last(ignorenulls)`` carries the latest curve row forward; keys at the start
    of a range take the carry from earlier ranges, found on a small per-range
    table.  Rows then join their answer by (by, key); a hot pair is one row of the
    answers, so the join can be split.  For equal keys the curve row sorts first.
    NULL keys and NULL ``by`` values match nothing; of curve rows with one key any
    may answer.
    """
    by, cols = list(by), [curve_key, *curve_cols]
    keys = [f"_by_{b}" for b in by]
    named = lambda x, key: x.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(key).alias("_k"), *(
        [F.struct(*cols).alias("_cur")] if x is curve else [])).dropna(subset=[*keys, "_k"])
    right = named(curve, curve_key).withColumn("_side", F.lit(0))
    asked = named(df, key_col).distinct().withColumn("_side", F.lit(1)).withColumn("_cur", F.lit(None).cast(right.schema["_cur"].dataType))
    u = ranged(asked.unionByName(right), [*keys, "_k"], "asof").drop("_at")
    w = Window.partitionBy("_bk", *keys).orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = u.withColumn("_run", F.last("_cur", ignorenulls=True).over(w)).where("_side = 1").drop("_cur", "_side")
    # one row per range and group: the carry is the last curve row of any earlier range
    lasts = u.groupBy("_bk", *keys).agg(F.max(F.when(F.col("_side") == 0, F.struct("_k", "_cur"))).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select("_bk", *keys, F.last("_m._cur", ignorenulls=True).over(before).alias("_carry"))
    found = join_null_safe(run, carry, ["_bk", *keys], "left").select(*keys, "_k", F.coalesce("_run", "_carry").alias("_cur"))
    match = F.col(key_col) == F.col("_k")
    for b, k in zip(by, keys, strict=True):
        match = match & (F.col(b) == F.col(k))
    return df.join(found, match, "left").select(*[df[c] for c in df.columns], *[F.col("_cur")[c].alias(c) for c in cols])
