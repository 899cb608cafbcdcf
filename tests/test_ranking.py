"""Exact order statistics and positions: golden cases, brute force, invariance."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchlens.operators import ranking


def test_upper_median_golden(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (5, 1, 3)],
                               "g string, v double")
    got = {r.g: r.median for r in ranking.ordinal_median(df, ["g"], "v").collect()}
    assert got == {"a": 3.0, "b": 3.0}


def _data(seed=1):
    rnd = random.Random(seed)
    rows = [("hot", float(rnd.randint(0, 5000))) for _ in range(6000)]           # a third of the rows, many ties
    rows += [(f"g{i % 40}", rnd.random() * 100) for i in range(12000)]
    rows += [("one", 7.0)]
    return rows


def test_kth_brute_force_both_paths(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    med = {r.g: r.m for r in ranking.ordinal_median(df, ["g"], "v", "m").collect()}
    p99 = {r.g: r.p for r in ranking.percentile_cont(df, ["g"], "v", 0.99, "p").collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    for g, vs in groups.items():
        s = sorted(vs)
        assert med[g] == s[len(s) // 2]
        assert p99[g] == pytest.approx(float(np.percentile(s, 99)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("bins", [2, 7, 1 << 16])
def test_kth_values_of_any_doubles(spark, bins):
    """Infinities, NaN, subnormal and largest numbers, ties, NULLs, a group of one value; few bins, so that many passes run."""
    inf, nan = float("inf"), float("nan")
    rnd = random.Random(bins)
    odd = [inf, -inf, nan, 0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0000000000000002, None]
    rows = [("odd", x) for x in odd * 3] + [("huge", rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(300, 308)) for _ in range(60)]
    rows += [("tiny", 5e-324 * rnd.randrange(9)) for _ in range(50)] + [("one", 4.5)] * 7 + [("null", None)] * 3 + [("nan", nan)] * 4
    rows += [(None, float(rnd.randrange(1000))) for _ in range(200)] + [("inf", x) for x in (inf, 5.0, inf, -inf)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ranks = {"low": lambda n: F.lit(1), "mid": lambda n: F.floor(n / 2) + 1, "top": lambda n: n}
    got = {r.g: r for r in ranking.kth_values(df, ["g"], "v", ranks, {"least": lambda v, c: F.min(v)}, bins=bins).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = sorted(vs, key=lambda x: (x != x, x))
        want = [s[0], s[len(s) // 2], s[-1], s[0]]
        assert got[g].n == len(s) and repr([got[g].low + 0.0, got[g].mid + 0.0, got[g].top + 0.0, got[g].least + 0.0]) == repr([x + 0.0 for x in want])
    none = ranking.kth_values(df.where("false"), ["g"], "v", ranks)
    assert none.count() == 0 and none.columns == ["g", "n", "low", "mid", "top"]


def test_row_positions_matches_row_number(spark):
    rows = [("hot", i) for i in range(5000)] + [(f"k{i % 13}", i) for i in range(3000)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long").repartition(5)
    got = ranking.row_positions(df, ["k"], ["o"], "pos", num_partitions=9).collect()
    by = {}
    for k, o in rows:
        by.setdefault(k, []).append(o)
    expect = {(k, o): i + 1 for k, os_ in by.items() for i, o in enumerate(sorted(os_))}
    assert {(r.k, r.o): r.pos for r in got} == expect


def test_global_positions_invariant_to_partitioning(spark):
    base = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).alias("o"))
    a = {r.o: r.pos for r in ranking.row_positions(base.coalesce(1), [], ["o"], "pos").collect()}
    b = {r.o: r.pos for r in ranking.row_positions(base.repartition(8), [], ["o"], "pos", num_partitions=5).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 3001))


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_asof_brute_force(spark, partitions):
    """J5/J4 against plain Python, with NULL keys and groups, for any number of shuffle partitions."""
    from benchlens.operators import joins
    rnd = random.Random(5)
    lrows = [(i, rnd.choice(["a", "b", "hot", "hot", None]), rnd.choice([None, *[rnd.randint(-50, 5000) for _ in range(9)]])) for i in range(1500)]
    crows = [(s, k * 37, float(k)) for s in ("a", "hot", "c", None) for k in range(120)] + [("a", None, 1.0)]
    left = spark.createDataFrame(lrows, "id long, s string, x long").repartition(6)
    curve = spark.createDataFrame(crows, "s string, ck long, v double")

    def best(s, x, by):
        ks = [(k, v) for t, k, v in crows if k is not None and x is not None and k <= x and (not by or (s is not None and t == s))]
        return max(ks, default=(None, None))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: (r.ck, r.v) for r in joins.asof_lookup(left, "x", curve, "ck", ["v"], by=["s"]).collect()}
        assert got == {i: best(s, x, True) for i, s, x in lrows}
        hot = curve.where("s = 'hot'").drop("s")
        got = {r.id: (r.ck, r.v) for r in joins.asof_lookup(left, "x", hot, "ck", ["v"]).collect()}
        assert got == {i: best(s, x, False) for i, s, x in lrows}
        ranges = [(0, 100, "s"), (50, 200, "m"), (100, 1000, "l"), (2000, None, "xl")]
        table = spark.createDataFrame(ranges, "lo long, hi long, class string")
        a = {r.id: r["class"] for r in joins.size_class(left, "x", table).collect()}
        b = {r.id: r["class"] for r in left.withColumn("class", joins.size_class_fixed(F.col("x"), ranges)).collect()}
        assert a == b
        for i, _, x in lrows:
            assert a[i] == next((c for lo, hi, c in ranges if x is not None and lo <= x and (hi is None or x < hi)), None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_global_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2, 9)], "v double")
    assert ranking.ordinal_median(df, [], "v", "m").collect() == [(3.0,)]


def test_row_positions_null_group_spanning_buckets(spark):
    rows = [(None, i) for i in range(3000)] + [("a", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long").repartition(4)
    got = ranking.row_positions(df, ["k"], ["o"], "pos", num_partitions=8).collect()
    assert sorted(r.pos for r in got if r.k is None) == list(range(1, 3001))
    assert sorted(r.pos for r in got if r.k == "a") == list(range(1, 501))


def test_median_null_group(spark):
    rows = [(None, float(x)) for x in (4, 1, 3, 2)] + [("a", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in ranking.ordinal_median(df, ["g"], "v", "m").collect()}
    assert got == {None: 3.0, "a": 5.0}


def test_group_joins_keep_null_groups(spark):
    from benchlens.operators import agg, windows
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "g string, v double")
    assert sorted((r.g or "", r.group_size) for r in windows.with_group_size(df, ["g"]).collect()) == \
        [("", 2), ("", 2), ("a", 1)]
    assert sorted(r.v for r in agg.comparison(df, ["g"]).collect()) == [1.0, 2.0]
    lat = {r.g: (r.avg_latency_ms, r.p99_latency_ms) for r in agg.latency_summary(df, ["g"], "v").collect()}
    assert lat[None][0] == 1.5 and lat["a"] == (3.0, 3.0)
