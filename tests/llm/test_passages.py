"""Quality by attention over passages (13)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from benchlens.llm import passages as ps
from benchlens.llm.queries import QUERIES

from .conftest import ODD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return ps.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op13_passages"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95
    # any good document above any bad one
    good, bad = ([r.score for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_attention_is_a_distribution_and_follows_the_bad_passage(model):
    good = "The house stands by the river and the people of the town go there on foot when the weather is fine. " * 20
    assert model.attention(good).sum() == pytest.approx(1) and model.attention("").tolist() == [1.0]
    clean, mixed = model.score(pa.array([good, good + "spam spam spam spam " * 300]))
    assert clean > mixed
    weights = model.attention(good + "BUY!! NOW!! " * 300)
    assert len(weights) > 5 and weights.sum() == pytest.approx(1)


def test_gradients_by_differences():
    rng = np.random.default_rng(4)
    x, at, y = rng.normal(0, 1, (11, ps.WIDTH)), np.array([0, 1, 4, 11]), np.array([1.0, 0.0, 1.0])
    h, g = 5, 3
    w = {"W": rng.normal(0, 0.1, (ps.WIDTH, h)), "b": rng.normal(0, 0.1, h), "V": rng.normal(0, 1, (h, g)), "U": rng.normal(0, 1, (h, g)),
         "w": rng.normal(0, 1, g), "u": rng.normal(0, 1, h), "c": np.array(0.3)}
    m = ps.Model(w, np.zeros(ps.WIDTH), np.ones(ps.WIDTH))

    def loss():
        z = m.forward(x, at)["logit"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))
    for name, grad in ps.gradients(m, x, at, y).items():
        for _ in range(4):
            at_ = tuple(rng.integers(0, n) for n in w[name].shape)
            keep = float(w[name][at_])
            w[name][at_] = keep + 1e-5
            up = loss()
            w[name][at_] = keep - 1e-5
            down = loss()
            w[name][at_] = keep
            assert (up - down) / 2e-5 == pytest.approx(float(grad[at_]), abs=1e-6)


def test_words_and_figures_by_brute_force():
    texts = [(r[1] or "")[:3000] for r in ODD] + ["", " ", "Aa aA b", "x\ny\tz", "é É", "a" * 300]
    col = pa.array(texts, pa.string())
    data, off = ps.flat_bytes(col)
    starts, ends, h = ps.words_of(data, off)
    raw, names = data.tobytes(), {}
    found = [(int(np.searchsorted(off, a, side="right") - 1), raw[a:z].lower(), int(k)) for a, z, k in zip(starts, ends, h, strict=True)]
    want = [(i, w.lower()) for i, t in enumerate(texts) for w in t.encode().split()]
    assert [(i, w) for i, w, _ in found] == want
    for _, w, k in found:
        assert names.setdefault(w, k) == k
    assert len(set(names.values())) == len(names)
    x, at = ps.encode(col)
    assert np.diff(at).tolist() == [max(-(-len(t.encode().split()) // ps.WORDS), 1) for t in texts]
    f = x[:, 64:70]
    i = at[texts.index("Aa aA b")]
    assert f[i].tolist() == pytest.approx([np.log(4), np.log1p(5 / 3), np.log(3), 2 / 3, 1 / 3, 2 / 3])
    assert (x[:, :64] ** 2).sum(axis=1) == pytest.approx([0 if not len(t) else 1 for i, t in enumerate(texts) for _ in range(at[i + 1] - at[i])], abs=1e-5)


def test_batches_do_not_matter(model):
    texts = [r[1] or "" for r in ODD]
    together = model.score(pa.array(texts))
    for t, s in zip(texts, together, strict=True):
        assert model.score(pa.array([t]))[0] == pytest.approx(s, abs=1e-9)
    assert model.score(pa.array([], pa.string())).tolist() == []


def test_odd_rows(spark, model, odd_docs, clash_docs, empty_docs):
    for df in (odd_docs, clash_docs):
        got = ps.scores(df, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        by_text = {}
        for r, (i, t, *_) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score)),
                                 sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
            if i in (5, 6):
                by_text.setdefault(t, set()).add(round(r.score, 12))
        assert all(len(s) == 1 for s in by_text.values())
    assert ps.scores(empty_docs, model).count() == 0


def test_little_to_learn_from(spark, odd_docs, empty_docs):
    some = "doc_id long, quality int, toxic int"
    none = ps.fit(odd_docs, spark.createDataFrame([], some))
    assert {r.score for r in ps.scores(odd_docs, none).collect()} == {0.5}
    odd = ps.fit(odd_docs, spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], some))
    assert not odd.weights
    one = ps.fit(odd_docs, spark.createDataFrame([(i, 1, 0) for i in range(1, 13)] * 2, some))
    got = {r.score for r in ps.scores(odd_docs, one).collect()}
    assert len(got) == 1 and got.pop() > 0.5
    assert ps.fit(empty_docs, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], some)).weights == {}
    # both labels for one document, and two texts for one id
    both = ps.fit(odd_docs, spark.createDataFrame([(i, k, 0) for i in range(1, 13) for k in (0, 1)], some), holdout=False)
    assert all(0 <= r.score <= 1 for r in ps.scores(odd_docs, both).collect())


def test_the_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = []
    real = ps.train
    ps.train = lambda bags, y, share: seen.append((len(bags), y)) or real(bags, y, share)
    try:
        ps.fit(docs, labels, per_class=20)
    finally:
        ps.train = real
    n, y = seen[0]
    assert n <= 40 and (y == 0).sum() <= 20 and (y == 1).sum() <= 20


def test_a_very_long_text(model):
    text = "some words of a long text. " * 200_000
    s = model.score(pa.array([text, "x" * 5_000_000]))
    assert ((0 <= s) & (s <= 1)).all()
