"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_subdir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of 4 MB, unless the session sets a size of its own."""
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, "4m")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts are empty; every other column is left behind."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class Stages:
    """Intermediate tables of one job, in the shared folder of spark.checkpoint.dir.

    ``write`` cuts the lineage by a Parquet table and lets Spark remove that
    job's shuffle files at once; ``drop`` deletes a table that no later step
    reads.  Tables of one job lie below one folder with a unique name.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, shared_subdir(spark, f"llm-{name}"), 0
        self.paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path, conf = self.path(name), self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return lambda pad: 0


def release() -> None:
    """Give freed memory back to the system: Python workers live on for the next stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def gathered(batches, max_bytes: int):
    """Arrow batches put together until they hold about ``max_bytes``, for work that is paid per distinct word."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= max_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 2 << 20):
    """Cut an Arrow batch into runs of rows whose texts take at most ``max_bytes`` (or one row)."""
    col = batch.column(column)
    size = np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64)
    block = np.cumsum(size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    release()


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, idx: np.ndarray):
    """Concatenate ``flat[start[i] : start[i] + length[i]]`` for i in idx; also the new offsets."""
    n = length[idx]
    off = np.zeros(len(idx) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    return flat[np.arange(off[-1]) + np.repeat(start[idx] - off[:-1], n)], off


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array without nulls, and the offsets of its rows."""
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]
