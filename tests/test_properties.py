"""Property tests: size parsing and formatting against a plain statement of the rule."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from benchlens.functions import format_size, parse_size

UNITS = {"k": 1024, "m": 1024 ** 2, "g": 1024 ** 3, "": 1}


def rule_parse(label):
    """A whole number with an optional single k/m/g suffix, any case; else None."""
    m = re.fullmatch(r"([0-9]+)([kmg]?)", label.lower())
    if not m:
        return None
    v = int(m.group(1)) * UNITS[m.group(2)]
    return v if v < 2 ** 63 else None


def rule_format(n):
    return f"{n // 1024 ** 2}m" if n >= 1024 ** 2 else f"{n // 1024}k"


labels = st.one_of(
    st.builds(lambda n, u, up: f"{n}{u.upper() if up else u}", st.integers(0, 10 ** 6),
              st.sampled_from(["", "k", "m", "g"]), st.booleans()),
    st.text(alphabet="0123456789kmgKMGb.- ", max_size=6))


@settings(max_examples=5, deadline=None)
@given(st.lists(labels, min_size=1, max_size=200))
def test_parse_size_rule(spark, xs):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "s string")
           .select(parse_size("s")).collect()]
    assert got == [rule_parse(x) for x in xs]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2 ** 40), min_size=1, max_size=200))
def test_format_size_rule(spark, ns):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long").select(format_size("n")).collect()]
    assert got == [rule_format(n) for n in ns]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-50, 50)), min_size=1, max_size=300))
def test_upper_median_rule(spark, rows):
    from benchlens.operators import ranking
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    got = {r.g: r.m for r in ranking.ordinal_median(df, ["g"], "v", "m").collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(float(v))
    assert got == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items()}
