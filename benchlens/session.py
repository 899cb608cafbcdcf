"""Session helpers: a tuned builder for local runs and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every benchlens job wants, whatever the cluster size.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "benchlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a local session with benchlens defaults (tests, bench)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it the library refuses to run rather than write to each
    machine's own disk.  Only in local mode (tests) an unset folder is
    replaced by a private temporary one.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("benchlens needs spark.checkpoint.dir set to a folder shared by all "
                             "executors (for example on HDFS or an object store)")
        d = tempfile.mkdtemp(prefix="benchlens-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


_WORK: dict[str, list[str]] = {}  # folders written by each application


def shared_subdir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _WORK.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote so far; returns how many folders were there.

    Results that were not yet written or collected read those tables, so call it
    when they are done.
    """
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for path in _WORK.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n
