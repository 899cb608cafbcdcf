"""The shared checkpoint folder rule."""

import pytest

from benchlens.session import ensure_checkpoint_dir


class _SC:
    def __init__(self, master, d=None):
        self.master, self._d = master, d

    def getCheckpointDir(self):
        return self._d

    def setCheckpointDir(self, d):
        self._d = d


class _Conf:
    def __init__(self, v):
        self.v = v

    def get(self, k, default=None):
        return self.v if k == "spark.checkpoint.dir" else default


class _Spark:
    def __init__(self, master, conf_dir=None, sc_dir=None):
        self.sparkContext, self.conf = _SC(master, sc_dir), _Conf(conf_dir)


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(_Spark("yarn"))


def test_cluster_folder_is_used_as_is():
    assert ensure_checkpoint_dir(_Spark("yarn", sc_dir="hdfs:///ckpt")) == "hdfs:///ckpt"
    assert ensure_checkpoint_dir(_Spark("k8s://x", conf_dir="s3a://b/ckpt")) == "s3a://b/ckpt"


def test_local_mode_gets_a_private_folder():
    assert ensure_checkpoint_dir(_Spark("local[4]"))


def test_cleanup_removes_written_tables(spark):
    from benchlens.operators import ranking
    from benchlens.session import cleanup
    cleanup(spark)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    assert ranking.ordinal_median(df, ["k"], "v", "m").collect() == [("a", 2.0)]
    assert cleanup(spark) > 0 and cleanup(spark) == 0
