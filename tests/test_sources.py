"""Sources on real files written to a temp folder: documents, config text, inventory."""

import json
import os

import pytest

from benchlens.sources import (file_inventory, inventory_totals, parse_documents, read_param_configs, read_results,
                               split_valid)


@pytest.fixture
def results_dir(tmp_path):
    d = tmp_path / "results"
    (d / "sub").mkdir(parents=True)
    (d / "hpl_1.json").write_text(json.dumps({"tflops": 8.1, "nodes": 1}))
    (d / "bad_1.json").write_text("{not json")
    (d / "arr_1.json").write_text("[1, 2, 3]")
    (d / "nan_1.json").write_text("NaN")
    (d / "notes.txt").write_text("{}")
    (d / "sub" / "mlperf_x_1.json").write_text(json.dumps({"samples_per_sec": 3.0}))
    return str(d)


def test_read_results_and_quarantine(spark, results_dir):
    docs = parse_documents(read_results(spark, results_dir))
    valid, rejected = split_valid(docs)
    assert sorted(r.file for r in valid.collect()) == ["hpl_1.json"]
    assert sorted(r.file for r in rejected.collect()) == ["arr_1.json", "bad_1.json", "nan_1.json"]
    rec = read_results(spark, results_dir, recursive=True)
    assert "sub/mlperf_x_1.json" in {r.file for r in rec.collect()}
    assert {r.stem for r in rec.collect()} >= {"hpl_1", "mlperf_x_1"}


CONFIG = """Linpack-style input
made-up layout for tests
out.txt      output file name (if any)
6            device out (6=stdout,7=stderr,file)
3            # of problems sizes (N)
1000 2000 4000   Ns
2            # of NBs
336 512      NBs
16.0         threshold
-1.5e2 .5 3.  signed, dotted and exponent values
"""


def test_config_leading_values(spark, tmp_path):
    d = tmp_path / "cfg"
    d.mkdir()
    (d / "a.dat").write_text(CONFIG)
    rows = {r.line: r for r in read_param_configs(spark, str(d)).collect()}
    assert rows[3].values == [] and rows[3].comment.startswith("out.txt")
    assert rows[4].values == [6.0] and rows[4].comment == "device out (6=stdout,7=stderr,file)"
    assert rows[5].values == [3.0] and rows[5].comment == "# of problems sizes (N)"
    assert rows[6].values == [1000.0, 2000.0, 4000.0] and rows[6].comment == "Ns"
    assert rows[9].values == [16.0]
    assert rows[10].values == [-150.0, 0.5, 3.0]
    assert rows[1].values == [] and rows[1].file == "a.dat"


def test_inventory_counts_each_file_once(spark, tmp_path):
    d = tmp_path / "ckpt"
    (d / "a" / "b").mkdir(parents=True)
    sizes = {"x.bin": 1000, "a/y.bin": 2500, "a/b/z.bin": 7}
    for name, n in sizes.items():
        (d / name).write_bytes(b"\0" * n)
    inv = file_inventory(spark, str(d))
    got = {r.file_name: r.length for r in inv.collect()}
    assert got == {os.path.basename(k): v for k, v in sizes.items()}
    t = inventory_totals(inv).first()
    assert (t.n_files, t.total_bytes) == (3, sum(sizes.values()))
    assert "content" not in inv.columns
