"""Language identification (10)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from benchlens.llm import language_id
from benchlens.llm.queries import QUERIES

from .conftest import ODD


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.95
    assert sum(r.rejected for r in got) < 0.01 * len(got)


def test_batches_do_not_matter(model):
    texts = [r[1] or "" for r in ODD]
    together = model.predict(pa.array(texts))
    for k, t in enumerate(texts):
        best, score, ok = model.predict(pa.array([t]))
        assert ok[0] == together[2][k]
        if ok[0]:
            assert best[0] == together[0][k] and score[0] == pytest.approx(together[1][k], abs=1e-6)


def test_odd_rows(spark, model, odd_docs, clash_docs, empty_docs):
    for df in (odd_docs, clash_docs):
        got = language_id.identify(df, model).collect()
        assert len(got) == len(ODD)
        for r in got:
            assert r.lang_pred in {*model.langs, "und"} and 0 <= r.score <= 1
        assert sum(r.lang_pred == "und" for r in got) == sum(not any(c.isalpha() for c in x[1] or "") for x in ODD)
    assert language_id.identify(empty_docs, model).count() == 0
    kept = language_id.keep_identified(clash_docs, model)
    assert kept.columns == clash_docs.columns
    assert all(any(c.isalpha() for c in r.text or "") for r in kept.collect())


def test_nothing_to_learn_from(spark, odd_docs, empty_docs):
    m = language_id.fit(empty_docs)
    assert {r.lang_pred for r in language_id.identify(odd_docs, m).collect()} == {"und"}
    one = language_id.fit(odd_docs.where("lang = 'fr'"), holdout=False)
    assert one.langs == ["fr"]


SYLLABLES = ["ba be bi bo", "ka ke ki ko", "ma me mi mo", "ta te ti to", "za ze zi zo", "la le li lo", "ра ре ри ро", "να νε νι νο", "さ せ し そ"]


def sample_in(n, each=30):
    """Texts of ``n`` made languages in the order of ``fit``: one of each language by turns."""
    rng = np.random.default_rng(n)
    word = lambda s: "".join(rng.choice(s, 3))
    rows = [(" ".join(word(SYLLABLES[k].split()) for _ in range(25)), f"l{k}") for _ in range(each) for k in range(n)]
    return [t for t, _ in rows], [x for _, x in rows]


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9])
def test_every_language_is_trained_and_calibrated(n):
    texts, langs = sample_in(n)
    y = np.array([int(x[1:]) for x in langs])
    cal = language_id.held_third(y, np.ones(len(y), bool))
    assert np.bincount(y[cal], minlength=n).tolist() == [10] * n and np.bincount(y[~cal], minlength=n).tolist() == [20] * n
    m = language_id.train(texts, langs)
    best, _, ok = m.predict(pa.array(texts))
    assert ok.all() and (best == y).mean() > 0.95 and set(best) == set(range(n))


def test_small_classes_and_texts_without_letters_are_not_held():
    y, usable = np.array([0, 0, 1, 1, 1, 1, 2]), np.array([True, True, False, True, True, True, True])
    assert np.flatnonzero(language_id.held_third(y, usable)).tolist() == [5]


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9])
def test_rejection_comes_from_the_held_third(n):
    """Half way from chance to the worst accepted example, whatever that is, and mixtures of two languages stay."""
    texts, langs = sample_in(n)
    m = language_id.train(texts, langs)
    y = np.array([int(x[1:]) for x in langs])
    held = np.flatnonzero(language_id.held_third(y, np.ones(len(y), bool)))
    best, score, _ = m.predict(pa.array([texts[i] for i in held]))
    pairs = [f"{texts[i]} {texts[j]}" for i in held[:20] for j in held if y[i] != y[j]]
    _, mixed, _ = m.predict(pa.array(pairs))
    chance = 1 / n
    assert m.reject_below > chance
    assert (score >= m.reject_below).all() and (mixed >= m.reject_below).mean() > 0.99
    low = min(score[best == y[held]].min(), mixed.min())
    assert m.reject_below - chance == pytest.approx((low - chance) / 2, abs=0.03)


def test_a_language_that_was_not_learned_is_rejected_more_often_than_by_a_constant():
    texts, langs = sample_in(4, each=60)
    known = [(t, x) for t, x in zip(texts, langs, strict=True) if x != "l3"]
    m = language_id.train([t for t, _ in known], [x for _, x in known])
    _, score, _ = m.predict(pa.array([t for t, x in zip(texts, langs, strict=True) if x == "l3"]))
    assert m.reject_below > 0.35 and (score < m.reject_below).sum() > (score < 0.35).sum()


def test_the_sample_is_bounded_and_follows_the_hash(spark):
    """Exactly the smallest hashes of each language, from few rows; rare languages and long texts stay out."""
    import pyspark.sql.functions as F
    rows = [(i, f"text {i}", "hot" if i % 3 else f"l{i % 5}") for i in range(6000)] + [(9000 + i, "x", f"rare{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9).withColumn("hash", F.xxhash64("doc_id", "text"))
    key = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    got = language_id.pick(df, 50, 6, 1000).collect()
    n = {}
    for i, _, x in rows:
        n.setdefault(x, []).append(i)
    langs = sorted(n, key=lambda x: (-len(n[x]), x))[:6]
    unsigned = lambda k: k & (1 << 64) - 1
    for x in langs:
        mine = [r for r in got if r.lang == x]
        assert len(mine) == min(50, len(n[x]))
        kept = {r.doc_id for r in mine}
        few = [i for i in n[x] if (unsigned(key[i]) >> 11) / 2 ** 53 < (2 * 50 + 64) / len(n[x])]
        assert kept == set(sorted(few, key=lambda i: key[i])[:50])
    assert {r.lang for r in got} == set(langs)
    assert max(sum(r.lang == x for r in language_id.pick(df, 50, 6, 60).collect()) for x in langs) == 10


def test_windows_are_characters():
    """A plain reading of the windows of every text, for scripts of one to four bytes a character."""
    texts = ["ab", "日本語 テキスト", "éa", "", "12", "😀a𝒳𝒴 b", "x"]
    found, offs, letters = language_id.subwords(pa.array(texts))
    import regex
    for i, t in enumerate(texts):
        clean = " " + regex.sub(r"[^\p{L}]+", " ", t.lower()).strip(" ") + " "
        assert letters[i] == len(clean) - 2
        for n, h, off in zip(language_id.SIZES, found, offs, strict=True):
            want = []
            for a in range(len(clean) - n + 1):
                v = n
                for ch in clean[a:a + n]:
                    v = (v ^ ord(ch)) * 0x01000193 & 0xFFFFFFFF
                    v ^= v >> 13
                want.append((v ^ v >> 15) & language_id.BUCKETS - 1)
            assert h[off[i]:off[i + 1]].tolist() == want


def test_prediction_by_brute_force(model):
    for t in [r[1] or "" for r in ODD if len(r[1] or "") < 3000]:
        found, _, letters = language_id.subwords(pa.array([t]))
        rows = [model.table[b].astype(float) for h in found for b in h]
        z = (np.sum(rows, axis=0) / max(len(rows), 1) + model.bias) / model.temperature if rows else model.bias / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best, score, ok = model.predict(pa.array([t]))
        assert ok[0] == (letters[0] > 0) and best[0] == p.argmax() and score[0] == pytest.approx(p.max(), abs=1e-9)


def test_a_long_text_is_summed_in_runs(model):
    text = "the house of the people and the river " * 150_000
    best, score, ok = model.predict(pa.array([text, text[:len(text) // 150_000 * 1000]]))
    assert ok.all() and best[0] == best[1] and score[0] == pytest.approx(score[1], abs=1e-3)
