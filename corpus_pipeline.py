"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, encode.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame.  ``run`` writes each stage's rows as Parquet in the shared
folder of spark.checkpoint.dir and reads them back as the next stage's documents,
so a lost executor costs at most the running stage.  All but the last stage return
the columns of ``documents``; the last returns the sampled piece ids.

Nulls: documents whose text is null or has no letter leave in the first stage;
null ids, languages and sources go through every stage.  An empty table gives an
empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from benchlens.llm import decontaminate, language_id, near_dups, piece_sampling, suffix_dedup
from benchlens.llm._common import Stages, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, trained on a bounded sample of them, does not reject."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group at 0.8 similarity of five-word shingles."""
    return near_dups.keep_one(docs, words=5, num=80, den=100)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes and more that a document with a smaller id has."""
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_bytes, n_pieces, ids_crc32, lossless) of every document left."""
    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language_id", identify_language), ("near_dups", drop_near_duplicates), ("suffix_dedup", drop_repeated_passages),
          ("decontaminate", drop_contaminated), ("piece_sampling", encode_pieces)]

#: Trained classification and sampled encoding have no SQL; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    st = Stages(spark, "pipeline")
    for name, stage in STAGES:
        docs = st.write(stage(spark, docs, sf_dir), name)
    return docs
