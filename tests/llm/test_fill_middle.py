"""Fill-in-the-middle transformation (12)."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from benchlens.llm import fill_middle as fim
from benchlens.llm._common import flat_bytes

from .conftest import ODD, rows

MORE = [(20 + i, t, None, None, None) for i, t in enumerate([
    "a <P> b", "<S>", "x <M", "tabs\tand\x0b\x0c breaks\r\nhere \r\n\r\n", "  lead and trail  ", "é", " é ", "日 本 語 x", "one", "\n",
    "a\x1fb c\x85d e", "<P>" + "y " * 50, "emoji 😀 😀😀 end"])]


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    t = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    a, z = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, s = "".join(t[:a]), "".join(t[a:z]), "".join(t[z:])
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= rate:
        return doc_id, len(t), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 50), (0, 0), (100, 0)])
def test_brute_force(spark, rate, spm):
    docs = spark.createDataFrame([r[:2] for r in ODD + MORE], "doc_id long, text string")
    x = fim.transform(docs, rate=rate, spm=spm)
    want = sorted((brute(*r[:2], rate=rate, spm=spm) for r in ODD + MORE), key=repr)
    assert rows(x.drop("text")) == want
    back = x.select("text", fim.restore(x["output"], x["form"]).alias("again")).collect()
    assert all(r.text == r.again for r in back)
    if rate == 100:
        assert {r[2] for r in want} > {"plain"}


def test_digest_columns(spark, odd_docs, clash_docs, empty_docs):
    want = sorted(((*b[:5], hashlib.sha256(b[5].encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
                   for r in ODD for b in [brute(*r[:2])]), key=repr)
    for df in (odd_docs, clash_docs, odd_docs.repartition(5)):
        assert rows(fim.digest(df)) == want
    assert fim.digest(empty_docs).count() == 0


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        s = rng.integers(0, 10, n).astype(np.uint8)
        wm, at = fim.WaveletMatrix(s), np.arange(n + 1)
        for c in range(16):
            assert wm.rank(c, at).tolist() == [int((s[:i] == c).sum()) for i in at]


def test_boundaries_of_lines():
    texts = ["one\ntwo\r\nthree", "", "\n\n", "end\r", "日本\n語", "a b"]
    data, off = flat_bytes(pa.array(texts))
    wm = fim.WaveletMatrix(fim.classes(data, off))
    for unit, split in ((fim.LINE, lambda t: t.splitlines(keepends=True)), (fim.TOKEN, lambda t: re.findall(r"\s*\S+|\s+", t))):
        for i, t in enumerate(texts):
            parts, a, z = split(t), off[i:i + 1], off[i + 1:i + 2]
            assert wm.ranks(unit, z)[0] - wm.ranks(unit, a)[0] == len(parts)
            for k in range(len(parts) + 1):
                assert wm.after(unit, np.array([k]), a, z)[0] - a[0] == len("".join(parts[:k]).encode())


def test_lines_as_units(spark):
    text = "".join(f"line {i} of it\n" for i in range(50))
    got = fim.transform(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string"), rate=100, unit=fim.LINE).collect()
    assert {r.n for r in got} == {50}
    for r in got:
        assert r.form in ("psm", "spm") and (r.prefix_chars == 0 or text[r.prefix_chars - 1] == "\n")


def test_a_very_long_text(spark):
    rng = random.Random(5)
    text = "".join(rng.choice(["ab ", "é", "  ", "\n", "日本"]) for _ in range(2_000_000)) + "x" * 3_000_000
    for i in range(4):
        df = spark.createDataFrame([(i, text)], "doc_id long, text string")
        assert rows(fim.transform(df, rate=100).drop("text")) == [brute(i, text, rate=100)]
