"""Report plan: result files -> classified, validated documents ->
long metric points, first-row parameters, comparison tables, one-line text.

S1 -> S2/J1 -> S3 -> P1 -> P2/P3 -> W1 -> (K2), A13 + P5, A12 + P6 -> (K3),
F13, F14, A16.  The registry's metric and parameter keys are a small fixed
set, so each is extracted from the VARIANT document once, and a CASE on the
benchmark keeps the keys it declares, all within the row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, sinks
from ..functions import task_label
from ..operators import agg, joins, windows
from ..operators.ranking import materialize as write_once
from ..session import shared_subdir
from ..sources import documents as D


class DocumentPoints:
    """The part of a report that lies within a document: also what a stream of documents can have.

    documents   bench, file, doc (VARIANT), of a batch or a stream
    """

    def __init__(self, documents: DataFrame, reg_rows: list):
        self.documents, self._reg_rows = documents, reg_rows

    def _of_bench(self, per_bench: dict):
        """The benchmark's own expression: a CASE over the registry's benchmarks."""
        pick = F.lit(None)
        for bench, expr in reversed(per_bench.items()):
            pick = F.when(F.col("bench") == bench, expr).otherwise(pick)
        return pick

    @cached_property
    def _keyed(self) -> DataFrame:
        """(bench, file, m): every declared metric key of a document, as VARIANT, in one struct.

        The struct comes out of a generator of one element: a projection would be
        merged with those above it, which then extract a key at each use.
        """
        keys = _registry_keys(self._reg_rows, 2)
        m = F.struct(*[F.col(f"_{i}").alias(k) for i, k in enumerate(keys)])
        return self._read_keys(keys).select("bench", "file", F.explode(F.array(m)).alias("m"))

    def _read_keys(self, keys: list[str]) -> DataFrame:
        """(bench, file, _0, _1, ...): those keys of a document as VARIANT, right above the scan, which then reads their columns alone."""
        return self.documents.select("bench", "file", *[F.variant_get("doc", f"$.{k}", "variant").alias(f"_{i}") for i, k in enumerate(keys)])

    @cached_property
    def points(self) -> DataFrame:
        """P1 + P2 + P3: (bench, file, points): the declared, non-NULL metric points of each
        document (an alias fills a missing canonical key), in declared order."""
        def point(i, key, label, aliases):
            vals, texts = [], []
            for k in [key, *aliases]:
                v = F.try_variant_get(F.col("m")[k], "$", "double")
                # display text as the producer prints the value: a JSON integer as its
                # digits ('8'), any other number as a double ('18.0', '6.55'); very small
                # or very large doubles use Java's exponent format, not Python's
                is_int = F.schema_of_variant(F.col("m")[k]).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
                vals.append(v)
                texts.append(F.when(is_int, F.to_json(F.col("m")[k])).otherwise(v.cast("string")))
            text = texts[0]
            for v, t in reversed(list(zip(vals, texts, strict=True))):
                text = F.when(v.isNotNull(), t).otherwise(text)
            return F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.lit(label).alias("label"), F.coalesce(*vals).alias("value") if len(vals) > 1
                            else vals[0].alias("value"), text.alias("text"))
        pick = self._of_bench({bench: F.array(*[point(i, *m) for i, m in enumerate(metrics)]) for _, bench, metrics, _ in self._reg_rows})
        return self._keyed.select("bench", "file", F.filter(pick, lambda p: p["value"].isNotNull()).alias("points"))


class Report(DocumentPoints):
    """The report's tables, each built on first use (so asking for one table
    does not run the jobs another one needs).

    documents   file, stem, prefix, bench, doc (valid, known files)
    rejected    known files whose JSON did not parse to an object
    unknown     files whose name and folder match no registry prefix
    scalars     bench, title, series (file), value, iteration
    params      bench, param, value (JSON text), is_null (first file only)
    comparison  bench, file, ord, key, display (benchmarks with > 1 file)
    lines       bench, file, text
    tasks       bench, n_files, first_file, ord, cluster_name, host, task_name

    Declared keys are read from a document once, in the row; no table joins
    points back to documents.  ``listing`` names the files without their text, for
    ``unknown``; without it the documents' own rows do.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, cluster: str, extensions: bool, at,
                 materialize: bool = False, host: str | None = None, listing: DataFrame | None = None):
        self._spark, self._cluster, self._at, self._host = spark, cluster, at, host
        self._reg_rows = dims.REGISTRY + (dims.REGISTRY_EXTENSIONS if extensions else [])
        rules = dims.registry_rules(extensions)

        def classified(x: DataFrame) -> DataFrame:
            return joins.classify(x, ["stem", "folder"] if "folder" in x.columns else "stem", rules, "left")
        c = classified(files)
        names = c if listing is None else classified(listing)
        self.unknown = names.where(F.col("bench").isNull()).select("file", "stem")
        parsed = D.parse_documents(c.where(F.col("bench").isNotNull()))
        valid, rejected = D.split_valid(parsed)
        self.documents = valid.select("file", "stem", "prefix", "bench", "doc")
        self.rejected = rejected.select("file", "bench")
        self._written, self._shown = False, None
        if materialize:
            self.materialize()

    def materialize(self) -> None:
        """Parse once: every table reads the parsed documents from a written table afterwards.

        The VARIANT is written in shreds, a column for each key that many documents
        have, so that a table reads the columns of its own keys.
        """
        if not self._written:
            with D.shredded(self._spark):
                self.documents = write_once(self.documents, "report-documents")
            self._written = True

    def show_once(self) -> list[str]:
        """Write the display text of every declared key once, a folder for each benchmark; returns the benchmarks.

        The comparison tables, one for each benchmark, then read their own folder.
        """
        self.materialize()
        keys = _registry_keys(self._reg_rows, 2)
        x = self._keyed.select("bench", "file", *[display_text(F.col("m")[k]).alias(k) for k in keys])
        path = shared_subdir(self._spark, "report-display")
        x.write.partitionBy("bench").parquet(path)
        text = ", ".join(f"`{k}` STRING" for k in ["file", *keys, "bench"])
        self._shown = self._spark.read.schema(text).parquet(path)
        return sorted(r["bench"] for r in self._shown.select("bench").distinct().collect())  # at most the registry's

    @cached_property
    def _compared(self) -> DataFrame:
        """The benchmarks with more than one file (at most the registry's)."""
        rows = self.documents if self._shown is None else self._shown
        return F.broadcast(rows.groupBy("bench").agg(F.count("*").alias("n")).where("n > 1").select("bench"))

    def _display(self) -> tuple[DataFrame, Callable[[str], Column]]:
        """Rows of (bench, file, ...) and the display text of a key in them."""
        if self._shown is not None:
            return self._shown, F.col
        return self._keyed, lambda k: display_text(F.col("m")[k])

    @cached_property
    def scalars(self) -> DataFrame:
        """Points numbered per benchmark by file name (0-based iteration).

        Documents are numbered while they carry their points; no join back.
        """
        # written first: range partitioning reads its input twice, to sample and to deal
        x = windows.with_iteration(write_once(self.points, "report-points"), ["bench"], "file")
        return x.select("bench", F.col("file").alias("series"), "iteration", F.explode("points").alias("p")).select(
            "bench", F.col("p.label").alias("title"), "series", "p.value", "iteration")

    @cached_property
    def params(self) -> DataFrame:
        """A13 + P5: parameters of the first file of each benchmark, by key presence."""
        keys = _registry_keys(self._reg_rows, 3)
        row = F.struct(*[F.col(f"_{i}").alias(k) for i, k in enumerate(keys)])
        first = self._read_keys(keys).groupBy("bench").agg(F.min_by(row, F.col("file")).alias("m"))

        def param(key, aliases):
            vals = [F.col("m")[k] for k in [key, *aliases]]
            v = F.coalesce(*vals) if len(vals) > 1 else vals[0]
            return F.struct(F.lit(key).alias("param"), F.when(~F.is_variant_null(v), F.to_json(v)).alias("value"),
                            F.is_variant_null(v).alias("is_null"), v.isNotNull().alias("has"))
        pick = self._of_bench({bench: F.array(*[param(*p) for p in ps]) for _, bench, _, ps in self._reg_rows})
        x = first.select("bench", F.explode(pick).alias("p")).where("p.has")
        return x.select("bench", "p.param", "p.value", "p.is_null")

    @property
    def comparison(self) -> DataFrame:
        """A12 + P6: comparison cells for benchmarks with more than one file ('—' when absent)."""
        rows, text = self._display()

        def cell(i, key):
            return F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), text(key).alias("display"))
        pick = self._of_bench({bench: F.array(*[cell(i, k) for i, (k, _, _) in enumerate(ms)]) for _, bench, ms, _ in self._reg_rows})
        x = rows.join(self._compared, "bench", "left_semi")
        return x.select("bench", "file", F.explode(pick).alias("c")).select("bench", "file", "c.ord", "c.key", "c.display")

    def comparison_of(self, bench: str) -> DataFrame:
        """A12 + P6 as one wide table: file, then a column for each declared metric key of the benchmark."""
        keys = next([k for k, _, _ in ms] for _, b, ms, _ in self._reg_rows if b == bench)
        rows, text = self._display()
        x = rows.where(F.col("bench") == bench).join(self._compared, "bench", "left_semi")
        return x.select("file", *[text(k).alias(k) for k in keys])

    @property
    def compared(self) -> DataFrame:
        return self._compared

    @property
    def benchmarks(self) -> list[str]:
        return [b for _, b, _, _ in self._reg_rows]

    @cached_property
    def lines(self) -> DataFrame:
        """one line of text per file, metrics in declared order; put together in the row."""
        text = F.array_join(F.transform("points", lambda p: F.concat(p["label"], F.lit(": "), p["text"])), "  ")
        return self.points.select("bench", "file", F.explode(F.filter(F.array(text), lambda t: t != "")).alias("text"))

    @cached_property
    def tasks(self) -> DataFrame:
        """A5 + F13: one task per benchmark, ordered by first file."""
        ts = F.lit(self._at).cast("timestamp") if self._at is not None else F.current_timestamp()
        return agg.group_results(self.documents.select("bench", "file"), "bench", "file").select(
            "*", F.lit(self._cluster).alias("cluster_name"), F.lit(self._host).cast("string").alias("host"),
            task_label("bench", F.lit(self._cluster), ts).alias("task_name"))


def display_text(v):
    """A VARIANT value shown as the producer prints it: SQL NULL (key absent)
    -> '—', JSON null -> 'None', integer -> digits, other number -> double
    text, string -> the string, anything else -> its JSON text."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit("—"))
             .when(F.is_variant_null(v), F.lit("None"))
             .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.to_json(v))
             .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
                   F.try_variant_get(v, "$", "double").cast("string"))
             .when(t == "STRING", F.try_variant_get(v, "$", "string"))
             .otherwise(F.to_json(v)))


def _registry_keys(registry_rows, field: int) -> list[str]:
    out = []
    for row in registry_rows:
        for item in row[field]:
            for k in [item[0], *item[-1]]:
                if k not in out:
                    out.append(k)
    return out


def report(spark: SparkSession, results_dir: str, cluster: str = "cluster",
           recursive: bool = False, extensions: bool = True, at=None,
           require_results: bool = True, materialize: bool = False, host: str | None = None) -> Report:
    """The report over every ``*.json`` file under ``results_dir``."""
    files = D.read_results(spark, results_dir, recursive, [p for _, p, _ in dims.registry_rules(extensions)])
    listing = D.list_results(spark, results_dir, recursive)
    return report_documents(spark, files, cluster, extensions, at, require_results, materialize, host, listing)


def report_documents(spark: SparkSession, files: DataFrame, cluster: str = "cluster",
                     extensions: bool = True, at=None, require_results: bool = True,
                     materialize: bool = False, host: str | None = None, listing: DataFrame | None = None) -> Report:
    """The report on documents already in a DataFrame of (file, stem, raw).

    ``require_results`` refuses an empty result set up front (A16) with a
    one-row probe rather than a count.  ``materialize=True`` writes the parsed,
    valid documents once to the shared checkpoint folder, so several tables do
    not parse every document again (worth it when most tables are built).
    """
    rep = Report(spark, files, cluster, extensions, at, materialize, host, listing)
    if require_results and rep.documents.isEmpty():
        raise ValueError(agg.NO_RESULTS)
    return rep


def write_report(rep: Report, path: str) -> None:
    """K1-K3: points, parameters and comparison tables, text lines and tasks, all
    partitioned by benchmark and written by executors under ``path``.

    Only the benchmarks of this report are replaced; what an earlier report
    wrote about others stays.  Documents are parsed once and their display
    texts written once; the wide table of a benchmark reads its own folder of those.
    """
    spark = rep.documents.sparkSession
    here = rep.show_once()
    sinks.write_scalars(rep.scalars, f"{path}/scalars", covered=here)
    sinks.write_summary(rep.comparison, f"{path}/comparison", covered=here)
    sinks.write_summary(rep.params, f"{path}/params", covered=here)
    compared = {r["bench"] for r in rep.compared.collect()}  # at most the registry's
    for bench in here:
        if bench in compared:
            sinks.write_wide(rep.comparison_of(bench), f"{path}/comparison_wide", bench)
        else:
            sinks.drop_wide(spark, f"{path}/comparison_wide", bench)
    sinks.replace_benchmarks(rep.lines, f"{path}/lines", covered=here, fmt="json")
    sinks.replace_benchmarks(rep.tasks, f"{path}/tasks", covered=here, fmt="json")
