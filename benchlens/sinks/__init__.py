"""Sinks (K1-K3): written by executors, parents created.

Tables partitioned by benchmark are replaced benchmark by benchmark: a run with other
benchmarks leaves a benchmark as it was.  Every folder of a benchmark gets a marker
once the write that made it has been committed; ``read_committed`` reads marked
folders only.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_COMMITTED"


class _Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway, self.path = spark.sparkContext._gateway, path.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def names(self, below: str = "", folders: bool = False) -> list[str]:
        where = self.at(below)
        if not self.fs.exists(where):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(where) if s.isDirectory() == folders]

    def touch(self, below: str) -> None:
        self.fs.create(self.at(below), True).close()

    def delete(self, below: str) -> None:
        self.fs.delete(self.at(below), True)

    def move(self, below: str, to: str) -> None:
        """Replaces the target in one step where the file system can."""
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.at(below), self.at(to), options)

    def escaped(self, value: str) -> str:
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def unescaped(self, value: str) -> str:
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value)


def write_results(df: DataFrame, path: str) -> None:
    """K1: result records as JSON lines (one file per task), replacing old output."""
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str, name_col: str, text_col: str, suffix: str = ".json") -> int:
    """K1: one file a record, named by ``name_col``; returns the number of files.

    Tasks write below a staging folder; when the job is committed its files are
    moved into place one by one, each replacing an older one of its name, and other
    files stay.  A job that fails leaves nothing.  A name that is empty, NULL or
    given twice, or that holds a ``/``, ends the job.
    """
    folder, staging = _Folder(df.sparkSession, path), "_staging"
    named = df.groupBy(F.col(name_col).alias("_name")).agg(F.count("*").alias("_n"), F.max(text_col).alias("value"))
    good = F.coalesce((F.col("_n") == 1) & (F.col("_name") != "") & (F.instr("_name", "/") == 0), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("not a file name of one record: "), F.coalesce("_name", F.lit("NULL"))))
    rows = named.select(F.when(good, F.col("_name")).otherwise(bad.cast("string")).alias("_name"), F.coalesce("value", F.lit("")).alias("value"))
    rows.write.mode("overwrite").partitionBy("_name").text(f"{folder.path}/{staging}")

    def place(sub: str) -> None:
        part = next(n for n in folder.names(f"{staging}/{sub}") if n.startswith("part-"))
        folder.move(f"{staging}/{sub}/{part}", folder.unescaped(sub.split("=", 1)[1]) + suffix)
    subs = folder.names(staging, folders=True)
    with ThreadPoolExecutor(8) as pool:  # names only; the bytes stay where they are
        list(pool.map(place, subs))
    folder.delete(staging)
    return len(subs)


def replace_benchmarks(df: DataFrame, path: str, bench_col: str = "bench", covered: Iterable[str] | None = None, fmt: str = "parquet") -> list[str]:
    """Write a table partitioned by benchmark over the benchmarks that it holds, and no other.

    ``covered`` names benchmarks that the run is about: those without any row
    now lose their old rows.  Returns the folders that were replaced.
    """
    folder = _Folder(df.sparkSession, path)
    files = lambda: {f: set(folder.names(f)) for f in folder.names(folders=True) if f.startswith(f"{bench_col}=")}
    before = files()
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bench_col).format(fmt).save(path)
    new = [f for f, names in files().items() if names != before.get(f)]
    for f in new:
        folder.touch(f"{f}/{MARKER}")
    for bench in covered or ():
        f = f"{bench_col}={folder.escaped(bench)}"
        if f not in new and f in before:
            folder.delete(f)
    return sorted(new)


def read_committed(spark: SparkSession, path: str, bench_col: str = "bench") -> DataFrame:
    """The table's rows of benchmarks whose write was committed."""
    folder = _Folder(spark, path)
    good = [f for f in folder.names(folders=True) if f.startswith(f"{bench_col}=") and MARKER in folder.names(f)]
    if not good:
        raise FileNotFoundError(f"no committed benchmark under {path}")
    return spark.read.option("basePath", folder.path).parquet(*[str(folder.at(f)) for f in good])


def write_scalars(df: DataFrame, path: str, bench_col: str = "bench", covered: Iterable[str] | None = None) -> None:
    """K2: long metric points, one folder per benchmark (partition pruning on read)."""
    replace_benchmarks(df, path, bench_col, covered)


def write_summary(df: DataFrame, path: str, bench_col: str = "bench", covered: Iterable[str] | None = None) -> None:
    """K3: wide summary rows, one folder per benchmark."""
    replace_benchmarks(df, path, bench_col, covered)


def wide_folder(bench: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in bench)


def write_wide(df: DataFrame, path: str, bench: str) -> None:
    """K3: a benchmark's wide comparison table (file, then its metric keys) in a folder of its own."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{wide_folder(bench)}")


def drop_wide(spark: SparkSession, path: str, bench: str) -> None:
    """K3: a benchmark that has nothing to compare any more."""
    _Folder(spark, path).delete(wide_folder(bench))
