"""SentencePiece sampling (3), ORC tokens (5), token counts (8)."""

from __future__ import annotations

import collections
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest

from benchlens.llm import piece_sampling, token_counts, token_orc

from .conftest import ODD, rows

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = ["", "a  b\n\n c", "<|endoftext|> x <|endoftext|>", "naïve 日本語 テスト  x　y", "\x1c\x1d a", "x" * 3000, " ", "\n", "'s it's don't  ''ll",
         "the " * 700, "é́ ​z ½ ²", "  lead", "trail  ", "▁▁ literal ▁", "\x00 nul", "<s> </s> <unk> <0x0A>", "tab\tand\r\nreturn", "😀 emoji ẞß İı ǅ"]


def tokenizer(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def test_orc_equals_the_library(spark, odd_docs, clash_docs, empty_docs, tmp_path):
    tok = tokenizer(WORD)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(r[0], r[1]) for r in ODD]
    path = str(tmp_path / "orc")
    token_orc.write(token_orc.encode(spark.createDataFrame(docs, "doc_id long, text string"), WORD), path)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_orc.offsets(token_orc.read(spark, path)).collect()}
    start, want = 0, {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, start] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    # a lookup by id reads the same ids, through the pushed filter
    one = token_orc.read(spark, path).where("doc_id = 9")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in one._jdf.queryExecution().toString()
    assert {tuple(r.ids) for r in one.collect()} == {(*tok.encode(t or "", add_special_tokens=False).ids, 1) for i, t in docs if i == 9}
    for k, df in enumerate((empty_docs, clash_docs)):
        token_orc.write(token_orc.encode(df, WORD), f"{path}{k}")
        assert token_orc.offsets(token_orc.read(spark, f"{path}{k}")).count() == df.count()


def test_counts_equal_the_library(spark, clash_docs, empty_docs):
    tok = tokenizer(BYTE)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(r[0], r[1]) for r in ODD]
    want = sorted(((i, len((t or "").encode()), n, n > 512) for i, t in docs for n in [len(tok.encode(t or "", add_special_tokens=False).ids)]), key=repr)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(token_counts.count(df, BYTE)) == want
    assert rows(token_counts.count(df.repartition(3), BYTE, groups=3, slice_bytes=500)) == want
    assert token_counts.count(empty_docs, BYTE).count() == 0
    assert token_counts.count(clash_docs, BYTE).count() == len(ODD)


def test_frequency_above_a_byte():
    base, words, posts, off = token_counts.postings(["qzxqzx " * 1000, "qzxqzx"], token_counts.PieceCounter(BYTE))
    p = posts.reshape(-1, 3)
    assert p[:, 2].sum() + base.sum() >= 1001 and (p[:, 2] <= 255).all()


def test_sampling_round_trip(spark, odd_docs, clash_docs, empty_docs):
    got = piece_sampling.encode(odd_docs, PIECE).cache()
    assert all(r.lossless for r in got.collect())
    back = piece_sampling.decode(got, PIECE)
    assert rows(back) == sorted(((r[0], r[1] or "") for r in ODD), key=repr)
    got.unpersist()
    assert piece_sampling.encode(empty_docs, PIECE).count() == 0
    assert rows(piece_sampling.encode(clash_docs.repartition(7), PIECE)) == rows(piece_sampling.encode(odd_docs, PIECE))
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert rows(piece_sampling.decode(piece_sampling.encode(texts, PIECE), PIECE)) == sorted(enumerate(TEXTS), key=repr)


def test_library_decodes_the_ids():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [t for t in TEXTS if "▁" not in t and "\x00" not in t]
    ids, off = piece_sampling.encode_batch(texts, np.arange(len(texts)), PIECE, 3, 1.0)
    assert [sp.decode(ids[a:z].tolist()) for a, z in itertools.pairwise(off)] == texts


def test_seed_and_key_decide():
    t = ["the quick brown fox jumps over it"] * 3
    one, off = piece_sampling.encode_batch(t, np.array([1, 1, 2]), PIECE, 0, 0.3)
    a, b, c = (one[x:y].tolist() for x, y in itertools.pairwise(off))
    assert a == b != c
    other, off2 = piece_sampling.encode_batch(t[:1], np.array([1]), PIECE, 1, 0.3)
    assert other.tolist() != a


LONG_UNITS = [" " * 300 + "word", " " * 400 + "word", " " * 5000 + "word", "x" * 5000, "ab" + " " * 5000, "a" + " " * 400 + "b" + " " * 300 + "the" * 200]


def test_long_units(spark):
    texts = spark.createDataFrame(list(enumerate(LONG_UNITS)), "doc_id long, text string")
    got = piece_sampling.encode(texts, PIECE)
    assert all(r.lossless for r in got.collect())
    assert rows(piece_sampling.decode(got, PIECE)) == sorted(enumerate(LONG_UNITS), key=repr)
    # the same ids alone as beside others
    both, off = piece_sampling.encode_batch(LONG_UNITS, np.zeros(len(LONG_UNITS), np.int64), PIECE, 0, 1.0)
    for t, (a, z) in zip(LONG_UNITS, itertools.pairwise(off), strict=True):
        assert piece_sampling.encode_batch([t], np.zeros(1, np.int64), PIECE, 0, 1.0)[0].tolist() == both[a:z].tolist()


@pytest.mark.parametrize("unit", [" " * 400 + "word", "x" * 700, "the" * 300])
def test_odds_of_a_long_unit_against_fractions(unit):
    from fractions import Fraction
    m = piece_sampling._model(PIECE, 1.0)
    lattice = piece_sampling.Lattice([unit], m)
    assert np.isfinite(lattice.odds).all()
    paths = [Fraction(1)]
    for t in range(1, len(unit) + 1):
        sums, total = [], Fraction(0)
        for n in range(1, len(lattice.piece) + 1):
            if n <= t:
                total += paths[t - n] * Fraction(float(m["scaled"][n - 1][lattice.piece[n - 1][t - n]]))
            sums.append(total)
        paths.append(total)
        assert lattice.odds[t] == pytest.approx([float(s / total) for s in sums], rel=1e-6, abs=1e-12)


def test_no_two_steps_of_a_row_have_the_same_key(monkeypatch):
    seen, mix = [], piece_sampling.mix
    monkeypatch.setattr(piece_sampling, "mix", lambda x: (seen.append(np.array(x)), mix(x))[1])
    piece_sampling.encode_batch(["日" * 300 + " " + "本" * 300 + " c"], np.array([7]), PIECE, 0, 1.0)
    steps = np.concatenate(seen[2:])  # the first two make the row's own key
    assert len(steps) > 600 and len(np.unique(steps)) == len(steps)


@pytest.mark.parametrize("word", ["ther", "日x"])
def test_samples_follow_the_lattice(word):
    """Frequencies of whole segmentations against all paths and their weights."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    n, text = 4000, " " + word
    weight = {}

    def walk(at, path, w):
        if at == len(text):
            weight[path] = w
            return
        for z in range(at + 1, len(text) + 1):
            i = sp.piece_to_id(text[at:z].replace(" ", "▁"))
            if i != sp.unk_id() and not sp.is_byte(i):
                walk(z, (*path, i), w / (2 - sp.get_score(i)))
            elif z == at + 1:
                walk(z, (*path, *[3 + b for b in text[at].encode()]), w / (2 + sp.get_piece_size()))
    walk(0, (), 1.0)
    ids, off = piece_sampling.encode_batch([word] * n, np.arange(n), PIECE, 0, 1.0)
    seen = collections.Counter(tuple(ids[a:z].tolist()) for a, z in itertools.pairwise(off))
    assert set(seen) <= set(weight)
    total = sum(weight.values())
    for path, w in weight.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
