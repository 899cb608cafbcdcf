"""Sinks: a benchmark at a time, markers, one named file a record; and reading only known files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from benchlens import dims, sinks
from benchlens.operators import joins
from benchlens.plans import report as R
from benchlens.sources import list_results, read_results


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "bench string, title string, value double")


def test_a_rerun_leaves_other_benchmarks(spark, tmp_path):
    path = str(tmp_path / "points")
    sinks.write_scalars(points(spark, ("A", "x", 1.0), ("A", "y", 2.0), ("B=/ π", "x", 3.0)), path)
    new = sinks.replace_benchmarks(points(spark, ("A", "x", 5.0)), path)
    assert new == ["bench=A"]
    got = sorted((r.bench, r.title, r.value) for r in sinks.read_committed(spark, path).collect())
    assert got == [("A", "x", 5.0), ("B=/ π", "x", 3.0)]
    # a run about B that finds nothing empties B and no other
    sinks.write_scalars(points(spark).where("false"), path, covered=["B=/ π"])
    assert {r.bench for r in sinks.read_committed(spark, path).collect()} == {"A"}


def test_a_write_that_failed_is_not_read(spark, tmp_path):
    path = str(tmp_path / "points")
    sinks.write_scalars(points(spark, ("A", "x", 1.0), ("B", "x", 2.0)), path)
    os.remove(f"{path}/bench=B/_COMMITTED")  # as a writer leaves it that ends between its commit and its marker
    assert {r.bench for r in sinks.read_committed(spark, path).collect()} == {"A"}
    sinks.write_scalars(points(spark, ("A", "x", 7.0)), path)  # another benchmark's write does not vouch for it
    assert {r.bench for r in sinks.read_committed(spark, path).collect()} == {"A"}
    sinks.write_scalars(points(spark, ("B", "x", 3.0)), path)
    assert sorted(r.value for r in sinks.read_committed(spark, path).collect()) == [3.0, 7.0]
    bad = points(spark, ("A", "x", 1.0)).withColumn("value", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_scalars(bad, path)
    assert sorted(r.value for r in sinks.read_committed(spark, path).collect()) == [3.0, 7.0]


def test_named_documents(spark, tmp_path):
    path = str(tmp_path / "res")
    rows = [("hpl_1", '{"tflops": 1.5}'), ("a b=c%π", "{}"), ("mlperf_x", None)]
    df = spark.createDataFrame(rows, "name string, text string")
    assert sinks.write_documents(df, path, "name", "text") == 3
    assert sorted(os.path.splitext(f) for f in os.listdir(path) if not f.startswith(".")) == sorted((n, ".json") for n, _ in rows)
    assert json.loads((tmp_path / "res" / "hpl_1.json").read_text()) == {"tflops": 1.5}
    # a second run replaces its own files and leaves the others
    sinks.write_documents(spark.createDataFrame([("hpl_1", '{"tflops": 2}'), ("hpl_2", "{}")], "name string, text string"), path, "name", "text")
    assert json.loads((tmp_path / "res" / "hpl_1.json").read_text()) == {"tflops": 2}
    assert len([f for f in os.listdir(path) if f.endswith(".json")]) == 4
    for bad in ([("x", "1"), ("x", "2")], [(None, "1")], [("", "1")], [("a/b", "1")]):
        with pytest.raises(Exception, match="not a file name"):
            sinks.write_documents(spark.createDataFrame(bad, "name string, text string"), path, "name", "text")
    assert len([f for f in os.listdir(path) if f.endswith(".json")]) == 4
    assert sinks.write_documents(df.where("false"), path, "name", "text") == 0


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "res"
    (d / "hpl_run").mkdir(parents=True)
    (d / "other").mkdir()
    for name in ("hpl_1", "misc_1", "hpl_run/out", "other/hpl_2", "other/thing", "nccl_a+b c%25"):
        (d / f"{name}.json").write_text('{"tflops": 1}')
    (d / "notes.txt").write_text("no")
    return d


KNOWN = {"hpl_1.json", "hpl_run/out.json", "other/hpl_2.json", "nccl_a+b c%25.json"}
PREFIXES = [p for _, p, _ in dims.registry_rules()]


def test_unknown_files_are_listed_and_not_opened(spark, folder):
    listed = {r.file: r.bytes for r in list_results(spark, str(folder), recursive=True).collect()}
    assert set(listed) == KNOWN | {"misc_1.json", "other/thing.json"} and set(listed.values()) == {13}
    files = read_results(spark, str(folder), recursive=True, prefixes=PREFIXES)
    # listed, then taken away: a reader that opens them fails
    os.remove(folder / "misc_1.json")
    os.remove(folder / "other" / "thing.json")
    assert {r.file for r in files.collect()} == KNOWN
    benches = {r.file: r.bench for r in joins.classify(files, ["stem", "folder"], dims.registry_rules()).collect()}
    assert set(benches) == KNOWN and None not in benches.values()


def test_the_report_does_not_open_unknown_files(spark, folder):
    rep = R.report(spark, str(folder), recursive=True)
    unknown = {r.file for r in rep.unknown.collect()}
    os.remove(folder / "misc_1.json")
    os.remove(folder / "other" / "thing.json")
    assert {r.file for r in rep.documents.collect()} == KNOWN
    assert unknown == {"misc_1.json", "other/thing.json"}


def test_reports_one_after_the_other(spark, tmp_path):
    a, b, out = tmp_path / "a", tmp_path / "b", str(tmp_path / "out")
    a.mkdir(), b.mkdir()
    for i in (1, 2):
        (a / f"hpl_{i}.json").write_text(json.dumps({"tflops": float(i)}))
    (a / "nccl_1.json").write_text(json.dumps({"busbw_gb_s": 5.0}))
    (b / "hpl_9.json").write_text(json.dumps({"tflops": 9.0}))
    R.write_report(R.report(spark, str(a)), out)
    names = {p: b_ for _, p, b_ in dims.registry_rules()}
    wide = f"{out}/comparison_wide/{sinks.wide_folder(names['hpl_'])}"
    assert {r.file for r in spark.read.parquet(wide).collect()} == {"hpl_1.json", "hpl_2.json"}
    # a later report about one benchmark: the other one's points, lines and task stay, the comparison of one file goes
    R.write_report(R.report(spark, str(b)), out)
    got = {(r.bench, r.series) for r in sinks.read_committed(spark, f"{out}/scalars").collect()}
    assert got == {(names["hpl_"], "hpl_9.json"), (names["nccl_"], "nccl_1.json")}
    for table in ("lines", "tasks"):
        assert {r.bench for r in spark.read.json(f"{out}/{table}").collect()} == {names["hpl_"], names["nccl_"]}
    assert not os.path.exists(wide)


def test_a_written_report_reads_the_columns_of_its_keys(spark, tmp_path):
    """VARIANT in shreds: the scan asks for the declared keys, and the file has them as columns of their own."""
    import glob

    import pyarrow.parquet as pq
    d = tmp_path / "res"
    d.mkdir()
    for i in range(40):
        (d / f"hpl_{i}.json").write_text(json.dumps({"tflops": i + 0.5, "nodes": i, "log": ["long text"] * 50, "other": {"deep": i}}))
    setting = spark.conf.get("spark.sql.variant.writeShredding.enabled")
    plain = R.report(spark, str(d))
    want = sorted(map(tuple, plain.lines.collect())), sorted(map(tuple, plain.params.collect()))
    rep = R.report(spark, str(d), materialize=True)
    assert spark.conf.get("spark.sql.variant.writeShredding.enabled") == setting
    for table in (rep.lines, rep.params, rep.comparison):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "doc:variant" not in plan and "doc:struct<0:variant" in plan
    assert (sorted(map(tuple, rep.lines.collect())), sorted(map(tuple, rep.params.collect()))) == want
    files = [f for x in rep.documents.inputFiles() for f in glob.glob(x.removeprefix("file://"))]
    columns = {c for f in files for c in str(pq.ParquetFile(f).schema).split()}
    assert {"tflops", "typed_value"} <= columns
