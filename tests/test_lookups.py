"""Range, prefix and pattern tables of any size against nested loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from benchlens.operators import intervals, joins, patterns


def with_partitions(spark, n):
    class Conf:
        def __enter__(self):
            self.before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", n)

        def __exit__(self, *_):
            spark.conf.set("spark.sql.shuffle.partitions", self.before)
    return Conf()


def first_range(ranges, x):
    """(lo, hi, class) in the table's order."""
    if x is None:
        return None
    return next((c for lo, hi, c in ranges if lo is not None and lo <= x and (hi is None or x < hi)), None)


@pytest.mark.parametrize("parts", ["1", "8"])
def test_nested_ranges(spark, parts):
    ranges = [(10, 20, "inner"), (0, 100, "outer"), (15, 30, "late"), (10, 20, "again"), (90, 200, "over"), (500, None, "open"), (600, 700, "hidden"),
              (300, 300, "empty"), (310, 300, "turned"), (None, 50, "no start")]
    xs = [None, -1, 0, 9, 10, 15, 19, 20, 29, 30, 50, 89, 90, 99, 100, 199, 200, 300, 305, 499, 500, 650, 10**12]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "ord int, lo long, hi long, class string")
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    with with_partitions(spark, parts):
        got = {r.x: r["class"] for r in joins.size_class(df, "x", table, order="ord").collect()}
    assert got == {x: first_range(ranges, x) for x in xs}
    fixed = {r.x: r.c for r in df.select("x", joins.size_class_fixed(F.col("x"), [r for r in ranges if r[0] is not None]).alias("c")).collect()}
    assert fixed == got


@pytest.mark.parametrize("n,seed", [(1, 1), (2, 2), (60, 3), (3000, 4)])
def test_random_ranges(spark, n, seed):
    rnd = random.Random(seed)
    ranges = []
    for _ in range(n):
        lo = rnd.randrange(5000)
        ranges.append((lo, None if rnd.random() < 0.02 else lo + rnd.choice([0, 1, 7, 300, 4000]), f"r{rnd.randrange(40)}"))
    # the early ranges are the narrow ones in half of the cases, so that many nest
    if seed % 2:
        ranges.sort(key=lambda r: (r[1] is None, (r[1] or 0) - r[0]))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "ord int, lo long, hi long, class string").repartition(4)
    cuts = {r.cut: r["class"] for r in intervals.stab(table, "lo", "hi", ["ord"], "class").collect()}
    assert set(cuts) == {b for lo, hi, _ in ranges if hi is None or lo < hi for b in (lo, hi) if b is not None}
    assert cuts == {x: first_range(ranges, x) for x in cuts}


def test_levels_below_the_broadcast_ones(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TOP", 2)
    test_random_ranges(spark, 300, 7)


def test_range_table_without_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "c", 5)], "x long, class string, l int")
    none = spark.createDataFrame([], "lo long, hi long, class string")
    assert joins.size_class(df, "x", none, out="size").collect() == [(1, "c", 5, None)]
    one = spark.createDataFrame([(0, 2, "s")], "lo long, hi long, class string")
    assert joins.size_class(df, "x", one, out="size").collect() == [(1, "c", 5, "s")]


def test_asof_writes_keys_only(spark, monkeypatch):
    seen = []
    real = intervals.ranged
    monkeypatch.setattr(intervals, "ranged", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    df = spark.createDataFrame([(1, 5, "wide text")], "id int, x long, text string")
    curve = spark.createDataFrame([(3, 1.5)], "k long, v double")
    assert intervals.asof_lookup(df, "x", curve, "k", ["v"]).collect() == [(1, 5, "wide text", 3, 1.5)]
    assert [sorted(c) for c in seen] == [["_cur", "_k", "_side"]]


def test_prefix_table(spark):
    rnd = random.Random(2)
    stems = [None, "", "a", "hpl_1", "hpl_x_2", "hp", "hplx"] + ["".join(rnd.choice("ab_") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    rules = [(5, "hpl_", "H"), (3, "hpl_x", "X"), (9, "hp", "P")] + [(20 + i, "".join(rnd.choice("ab_") for _ in range(rnd.randrange(1, 6))), f"b{i}") for i in range(60)]
    df = spark.createDataFrame([(i, s, stems[-i]) for i, s in enumerate(stems)], "i int, stem string, folder string")

    def first(*names):
        for s in names:
            hit = min(((o, p, b) for o, p, b in rules if s is not None and s.startswith(p)), default=None)
            if hit:
                return hit
        return None, None, None
    table = spark.createDataFrame(rules, "reg_ord int, prefix string, bench string")
    for reg in (table, rules):
        for cols in (["stem"], ["stem", "folder"]):
            got = {r.i: (r.reg_ord, r.prefix, r.bench) for r in joins.classify(df, cols, reg).collect()}
            assert got == {i: first(*[{"stem": s, "folder": stems[-i]}[c] for c in cols]) for i, s in enumerate(stems)}
            assert joins.classify(df, cols, reg, "inner").count() == sum(g[0] is not None for g in got.values())
    plan = joins.classify(df, "stem", table)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan


def test_an_empty_prefix_and_an_empty_registry(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "stem string")
    reg = spark.createDataFrame([(2, "", "all"), (1, "x", "one")], "reg_ord int, prefix string, bench string")
    assert {r.stem: r.bench for r in joins.classify(df, "stem", reg).collect()} == {"x": "one", "": "all", None: None}
    assert {r.bench for r in joins.classify(df, "stem", reg.where("false")).collect()} == {None}


PATTERNS = ["h100.*sxm", "^B300", "a100|h200", "L4$", "(rtx|gtx) ?[0-9]+", "x?yz+abc", r"foo\.bar\d+", r"\bwhole\b", "ab{0,2}cdef", "[hg]h200",
            "q*", "", "GB\\d{3} nvl", "colou?r", "no such thing", "a+?bcd", "tesla.v100", r"\x41bc", "ünï", "[[a]bc]def", "k{2}lmn", "zzz|", "(?s)dot.all"]
NAMES = ["NVIDIA H100 80GB SXM5", "nvidia b300 sxm6", "B300", "A100-PCIE", "GH200 480GB", "L40", "NVIDIA L4", "RTX 4090", "gtx1080", "yzabc", "xyzzzabc", "foo.bar7",
         "fooxbar7", "the whole thing", "wholesale", "acdef", "abbcdef", "abbbcdef", "GB200 NVL", "color", "COLOUR", "colouur", "aaabcd", "TESLA-V100", "Abc", "ÜNÏ", "ünï",
         "adef", "kklmn", "dot\nall", "", "a", "ab", "K", "K"]


def test_patterns_against_every_pair(spark):
    rnd = random.Random(1)
    order = list(range(len(PATTERNS)))
    for _ in range(3):
        rnd.shuffle(order)
        use = order[:rnd.randrange(5, len(order))]
        table = spark.createDataFrame([(n, PATTERNS[i], float(i)) for n, i in enumerate(use)], "ord int, pattern string, v double")
        df = spark.createDataFrame([(s,) for s in [*NAMES, None, NAMES[0]]], "name string")
        got = [(r["name"], r.v) for r in joins.lookup_first_match(df, "name", table, "v").collect()]
        # the engine's own regex on every pair is the reference
        pairs = df.distinct().join(table).where(F.regexp_like("name", F.concat(F.lit("(?i)"), "pattern")))
        want = {r["name"]: r.v for r in pairs.groupBy("name").agg(F.min_by("v", "ord").alias("v")).collect()}
        assert sorted(got, key=repr) == sorted([(s, want.get(s)) for s in [*NAMES, None, NAMES[0]]], key=repr)


def test_literals(spark):
    got = {r.p: r.l for r in spark.createDataFrame([(p,) for p in PATTERNS], "p string").select("p", patterns.literals(F.col("p")).alias("l")).collect()}
    assert got["h100.*sxm"] == ["h100"] and got["a100|h200"] == ["a100", "h200"] and got["x?yz+abc"] == ["abc"]
    assert got["(rtx|gtx) ?[0-9]+"] is None and got[r"\x41bc"] is None and got["[[a]bc]def"] is None and got["(?s)dot.all"] is None
    assert got["ab{0,2}cdef"] == ["cdef"] and got["colou?r"] == ["colo"] and got["GB\\d{3} nvl"] == [" nvl"] and got["zzz|"] == ["zzz", ""]
    for p, lits in got.items():  # every literal that is read is in every name the pattern matches
        for s in NAMES:
            if lits is not None and p not in ("ünï",) and re.search(p, s, re.I | re.A):
                assert any(x in s.lower() for x in lits)


def test_pattern_plan_has_no_product(spark):
    table = spark.createDataFrame([(1, "h100", 1.0)], "ord int, pattern string, v double")
    df = spark.createDataFrame([(s,) for s in NAMES], "name string")
    plan = joins.lookup_first_match(df, "name", table, "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "collect_list" not in plan


def test_repeated_patterns_and_orders(spark):
    """Rows of equal patterns, equal and missing orders, missing patterns and values: as one pass over all pairs, NULL order first, then by pattern."""
    rnd = random.Random(7)
    for trial in range(3):
        rows = [(rnd.choice([None, *range(12)]) if rnd.random() < trial / 3 else n + 20, rnd.choice([*PATTERNS, None])) for n in range(150)]
        value = {r: None if i % 9 == 4 else float(i) for i, r in enumerate(sorted(set(rows), key=repr))}  # by row: equal rows have equal values
        df = spark.createDataFrame([(s,) for s in [*NAMES, None]], "name string")
        for kind, as_ in (("double", float), ("string", str)):
            table = spark.createDataFrame([(*r, None if value[r] is None else as_(value[r])) for r in rows], f"ord int, pattern string, v {kind}")
            got = [(r["name"], r.v) for r in joins.lookup_first_match(df, "name", table, "v").collect()]
            pairs = df.distinct().join(table).where(F.regexp_like("name", F.concat(F.lit("(?i)"), "pattern")))
            want = {r["name"]: r.v for r in pairs.groupBy("name").agg(F.min_by("v", F.struct("ord", "pattern")).alias("v")).collect()}
            assert sorted(got, key=repr) == sorted([(s, want.get(s)) for s in [*NAMES, None]], key=repr)


def test_repeated_patterns_are_tried_once_and_nothing_is_sorted_by_pair(spark):
    names = spark.createDataFrame([(s,) for s in NAMES], "_name string")
    table = spark.range(6000).select(F.col("id").cast("int").alias("ord"), F.element_at(F.array(*map(F.lit, PATTERNS)), (F.col("id") % len(PATTERNS) + 1).cast("int")).alias("pattern"),
                                     F.col("id").cast("double").alias("v"))
    found = patterns.first_matches(names, table, "v")
    rows, made, todo = found.collect(), [], [found._jdf.queryExecution().executedPlan()]
    assert "SortAggregate" not in todo[0].toString()
    while todo:  # the rows that each exploding step made
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        elif p.nodeName() == "Generate":
            made.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert rows and made and max(made) < 1000


def test_heavy_groups_are_salted_by_their_size(spark):
    from benchlens.operators import agg
    rows = [("hot", 1)] * 4000 + [(f"k{i % 900}", i) for i in range(8000)] + [(None, 1)] * 30 + [("single", 1)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    n = {}
    for k, _ in rows:
        n[k] = n.get(k, 0) + 1
    got = agg.with_group_count(df, ["k"]).collect()
    assert len(got) == len(rows) and all(r.group_size == n[r.k] for r in got)
    assert sorted((r.k or "", r.v) for r in agg.comparison(df, ["k"]).collect()) == sorted((k or "", v) for k, v in rows if n[k] > 1)
    assert agg.with_group_count(df.where("false"), ["k"]).count() == 0


def test_hot_rows_of_one_value_go_to_many_tasks(spark):
    """Equal rows of a heavy key are spread by their input partition."""
    from benchlens.operators import agg
    df = spark.range(0, 30000, numPartitions=16).select(F.lit("hot").alias("k"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = agg.with_group_count(df, ["k"]).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in x.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert sum(sizes) == 30000 and max(sizes) <= 15000 and len(sizes) >= 4


def test_merged_sketches_keep_the_bound(spark):
    from benchlens.operators import agg
    rnd = random.Random(9)
    rows = [("hot", i % 50, rnd.gauss(0, 1)) for i in range(20000)] + [("few", 0, float(i)) for i in range(10)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, run int, v double").repartition(5)
    runs = [agg.latency_sketches(df.where(F.col("run") % 3 == k), ["g"], "v") for k in range(3)]
    every = runs[0].union(runs[1]).union(runs[2])
    got = {r.g: r for r in agg.sketch_quantiles(agg.merge_sketches(every, ["g"]), ["g"], {"p50": 0.5, "p99": 0.99}).collect()}
    assert set(got) == {"hot", "few"} and got["hot"].n == 20000
    hot = sorted(v for g, _, v in rows if g == "hot")
    for p in ("p50", "p99"):
        rank = sum(v <= got["hot"][p] for v in hot) / len(hot)
        assert abs(rank - {"p50": 0.5, "p99": 0.99}[p]) <= agg.KLL_RANK_ERROR + 1e-3
    assert got["few"].p99 == 9.0 and got["few"].avg_latency_ms == pytest.approx(4.5)
    a = {r.g: r.p99_latency_ms for r in agg.latency_summary(df, ["g"], "v", approx=True).collect()}
    assert abs(sum(v <= a["hot"] for v in hot) / len(hot) - 0.99) <= agg.KLL_RANK_ERROR + 1e-3
