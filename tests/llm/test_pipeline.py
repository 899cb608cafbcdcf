"""The pipeline against plain Python versions of its stages."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from benchlens.llm import language_id, piece_sampling
from benchlens.llm.queries import SQL

from . import brute
from .conftest import ODD

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(table)
    docs = sorted((r.doc_id, r.text) for r in table.collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    _, score, ok = model.predict(pa.array([t or "" for _, t in docs]))
    docs = [d for d, s, x in zip(docs, score, ok, strict=True) if x and s >= model.reject_below]
    groups = brute.near_groups(docs, 5, 80, 100)
    docs = [d for d in docs if groups[d[0]] == d[0]]
    docs = brute.without_repeats(docs)
    bad = {a for a, _ in brute.leaks(docs, items)}
    docs = [d for d in docs if d[0] not in bad]
    ids, off = piece_sampling.encode_batch([t for _, t in docs], np.array([i for i, _ in docs]), public_tokenizers.path("piece_bpe_32k.model"), 0, 1.0)
    want = {i: ids[off[k]:off[k + 1]].tolist() for k, (i, _) in enumerate(docs)}
    got = {r.doc_id: (r.ids, r.lossless) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: x for i, (x, _) in got.items()} == want
    assert all(x for _, x in got.values())


def test_stages_take_odd_rows(spark, clash_docs, empty_docs):
    model_docs = clash_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, model_docs, SF)
        assert out.count() <= len(ODD)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == clash_docs.columns
        assert stage(spark, empty_docs, SF).count() == 0


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dups", "suffix_dedup", "decontaminate", "piece_sampling"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in SQL
