"""One text of five megabytes through the operators that tests elsewhere hold to shorter ones."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from benchlens.llm import decontaminate, fingerprint, near_dups, piece_sampling, token_counts, token_orc
from benchlens.llm._common import Stages

rng = random.Random(17)
VOCABULARY = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéü", k=rng.randrange(1, 12))) for _ in range(20_000)]
LONG = " ".join(rng.choices(VOCABULARY, k=750_000))
assert len(LONG) > 5_000_000
ITEM = " ".join(LONG.split()[500_000:500_020])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, LONG), (2, "a short one"), (3, LONG + " and a few words more")], "doc_id long, text string")


def test_token_ids(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = Stages(spark, "test").path("tokens")
    token_orc.write(token_orc.encode(docs, path), out)
    got = {r.doc_id: r for r in token_orc.offsets(token_orc.read(spark, out)).collect()}
    ids = Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids + [1]
    assert got[1].n_tokens == len(ids) and got[2].start == len(ids)
    assert got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in token_counts.count(docs, path).collect()}
    assert got[1] == len(Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids)


def test_sampled_pieces_are_lossless(spark, docs):
    got = piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "lossless", "n_bytes").collect()
    assert {r.doc_id: (r.lossless, r.n_bytes) for r in got}[1] == (True, len(LONG.encode()))


def test_near_copies(spark, docs):
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dups.groups(docs).collect()}
    assert got[3][0] == 1 and got[2][0] == 2 and got[1][1] > 700_000


def test_fingerprint(spark, docs):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs.where("doc_id < 3")).collect()}
    assert got[1].n_chars == len(LONG) and got[1].fingerprint != got[2].fingerprint


def test_an_item_inside(spark, docs):
    items = spark.createDataFrame([(7, ITEM), (8, "not in it at all, this one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 7), (3, 7)}
    assert decontaminate.remove_contaminated(docs, items).select(F.max("doc_id")).first()[0] == 2
