"""Same answer whatever the partitioning and row order of the input."""

import pytest
from pyspark.sql import functions as F

from benchlens.operators import agg, ranking, windows

from .conftest import SF_SMALL


def layouts(df):
    return [df.coalesce(1), df.repartition(8), df.repartition(3, F.rand(7)).orderBy(F.rand(11))]


def as_set(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "event_type", "user_id", "value")


def test_a1_median(events):
    res = [as_set(ranking.ordinal_median(d, ["event_type"], "value", "m"), ["event_type", "m"]) for d in layouts(events)]
    assert res[0] == res[1] == res[2]


def test_a13_first_params(spark):
    c = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role")
    res = [as_set(agg.first_params(d, ["conv_id"], "turn", ["role"]), ["conv_id", "role"]) for d in layouts(c)]
    assert res[0] == res[1] == res[2]


def test_w1_iteration(events):
    res = [as_set(windows.with_iteration(d, ["event_type"], "event_id"), ["event_id", "iteration"])
           for d in layouts(events)]
    assert res[0] == res[1] == res[2]
    first = dict(res[0])
    assert sorted(first.values())[:5] == [0, 0, 0, 0, 0]
