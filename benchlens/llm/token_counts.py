"""Token counts without ids (operator 8).

Texts are cut into pre-tokens.  Each slice of documents becomes one row per
distinct pre-token with its postings (document in the slice, frequency).  Slices
fall into groups; a group's rows are dealt by pre-token to ``SPREAD`` tasks and
sorted, so every distinct pre-token of a group is one run of rows, its pieces are
counted there once by the tokenizer's merges, and the count is multiplied into the
postings.  The sums go back to the documents by a partial aggregation, at most
``SPREAD`` rows for a document.  No ids are made.

Hot pre-tokens never travel: those that are vocabulary entries (at most 50,257,
a proven bound) are counted once per worker into a table and summed where they
are read.  What is dealt is pre-aggregated to one row per slice, and a pre-token of
a third of all documents is spread over all groups (there are as many as shuffle
partitions, divided by ``SPREAD``).

Pre-tokens come from the tokenizer's own pattern.  Texts with characters outside
Latin, digits and common punctuation, whose classes could differ between Unicode
versions, are cut by the library's pre-tokenizer instead; texts that contain a
special string are encoded whole by the library.

Nulls: a null text is empty and has no tokens; rows with null or repeated doc_ids
are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import gathered, id_text, slices
from .token_orc import byte_alphabet

# fixed value: the byte-level pre-tokenizer's pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-¬®-ɏ‐-‧‰-›]")
ROWS = 1 << 16
SPREAD = 16
DEALT = "pretoken string, block long, posts binary, idx int, doc_id long, n_bytes long, base long"
BYTES = {b: c for b, c in byte_alphabet().items()}


def byte_level(pretoken: str) -> str:
    return pretoken.encode().decode("latin-1").translate(BYTES)


class PieceCounter:
    """A byte-level BPE tokenizer's pre-tokens and their numbers of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.find = regex.compile(PATTERN).findall
        with open(path) as f:
            spec = json.load(f)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        merge = self.tok.model.tokenize
        self.known = {v: len(merge(v)) for v in spec["model"]["vocab"] if v}
        self.back = {c: b for b, c in BYTES.items()}

    def cut(self, text: str) -> list[str] | None:
        """Pre-tokens of a text; None if the library has to take it whole."""
        if self.special and self.special.search(text):
            return None
        if OTHER.search(text):
            return [bytes(self.back[c] for c in s).decode() for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def pieces(self, pretoken: str) -> int:
        return len(self.tok.model.tokenize(byte_level(pretoken)))

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)


def postings(texts: list[str], counter: PieceCounter) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(tokens per text that need no counting, the other distinct pre-tokens, their postings, offsets of these).

    A posting is three bytes: the text's number (two) and the frequency; a
    frequency above 255 takes several.
    """
    base = np.zeros(len(texts), np.int64)
    cut = []
    for i, t in enumerate(texts):
        c = counter.cut(t)
        if c is None:
            base[i], c = counter.whole(t), []
        cut.append(c)
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
    d = pa.array([x for c in cut for x in c], pa.string()).dictionary_encode()
    # (pre-token, text) pairs and their frequencies
    pair, freq = np.unique(np.asarray(d.indices, dtype=np.int64) * len(texts) + of, return_counts=True)
    word, doc = pair // max(len(texts), 1), pair % max(len(texts), 1)
    known = np.fromiter((counter.known.get(byte_level(x), 0) for x in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
    np.add.at(base, doc, known[word] * freq)
    rare = known[word] == 0
    word, doc, freq = word[rare], doc[rare], freq[rare]
    times = -(-freq // 255)
    if len(times) and times.max() > 1:
        last = np.cumsum(times) - 1
        word, doc = np.repeat(word, times), np.repeat(doc, times)
        f = np.full(len(word), 255)
        f[last] = freq - 255 * (times - 1)
        freq = f
    posts = np.empty((len(word), 3), np.uint8)
    posts[:, 0], posts[:, 1], posts[:, 2] = doc & 255, doc >> 8, freq
    left, n = np.unique(word, return_counts=True)
    return base, d.dictionary.take(pa.array(left)), posts.ravel(), np.concatenate([[0], np.cumsum(3 * n)])


def deal(docs: DataFrame, tokenizer: str, slice_bytes: int) -> DataFrame:
    """Rows of pre-tokens with postings, and one row per document with what is known already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, block = PieceCounter(tokenizer), TaskContext.get().partitionId() << 32
        for batch in gathered(batches, slice_bytes):
            for whole in slices(batch, max_bytes=slice_bytes + (4 << 20)):
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    base, words, posts, off = postings(b.column("text").to_pylist(), counter)
                    w, n = len(words), b.num_rows
                    blocks = lambda k: pa.array(np.full(k, block))  # noqa: B023, E731
                    none = lambda k, t: pa.nulls(k, t)
                    yield pa.RecordBatch.from_arrays([
                        words, blocks(w),
                        pa.Array.from_buffers(pa.binary(), w, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(posts)]),
                        none(w, pa.int32()), none(w, pa.int64()), none(w, pa.int64()), none(w, pa.int64())], names=NAMES)
                    yield pa.RecordBatch.from_arrays([
                        none(n, pa.string()), blocks(n), none(n, pa.binary()),
                        pa.array(np.arange(n, dtype=np.int32)), b.column("doc_id"),
                        pc.binary_length(b.column("text")).cast(pa.int64()), pa.array(base)], names=NAMES)
                    block += 1

    return id_text(docs).mapInArrow(run, DEALT)


NAMES = [x.split()[0] for x in DEALT.split(", ")]
SUMS = "block long, idx int, doc_id long, n_bytes long, n long"


def multiply(dealt: DataFrame, tokenizer: str) -> DataFrame:
    """Sorted rows of pre-tokens to (block, idx, n): pieces times frequency, counted once per run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, before, count = PieceCounter(tokenizer), None, 0
        for b in batches:
            mine = b.filter(b.column("idx").is_valid())
            if mine.num_rows:
                yield pa.RecordBatch.from_arrays([mine.column(x) for x in ("block", "idx", "doc_id", "n_bytes", "base")],
                                                 names=["block", "idx", "doc_id", "n_bytes", "n"])
            b = b.filter(b.column("pretoken").is_valid())
            if not b.num_rows:
                continue
            d = b.column("pretoken").dictionary_encode()
            words = d.dictionary.to_pylist()
            counts = np.array([count if w == before else counter.pieces(w) for w in words])
            ids = np.asarray(d.indices)
            before, count = words[ids[-1]], counts[ids[-1]]
            posts = b.column("posts")
            off = np.frombuffer(posts.buffers()[1], np.int32)[posts.offset:posts.offset + len(posts) + 1]
            flat = np.frombuffer(posts.buffers()[2], np.uint8)[off[0]:off[-1]].reshape(-1, 3).astype(np.int64)
            times = np.diff(off) // 3
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.asarray(b.column("block")), times)), pa.array((flat[:, 0] | flat[:, 1] << 8).astype(np.int32)),
                pa.nulls(len(flat), pa.int64()), pa.nulls(len(flat), pa.int64()),
                pa.array(np.repeat(counts[ids], times) * flat[:, 2])], names=["block", "idx", "doc_id", "n_bytes", "n"])

    return dealt.mapInArrow(run, SUMS)


def count(docs: DataFrame, tokenizer: str, limit: int = 512, groups: int | None = None, slice_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every whole text."""
    groups = groups or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SPREAD)
    n = groups * SPREAD
    group = F.pmod(F.xxhash64("block"), F.lit(groups))
    to = F.when(F.col("pretoken").isNotNull(), group * SPREAD + F.pmod(F.xxhash64("pretoken"), F.lit(SPREAD))).otherwise(
        F.pmod(F.xxhash64("block", "idx"), F.lit(n)))
    dealt = deal(docs, tokenizer, slice_bytes).repartitionById(n, to.cast("int")).sortWithinPartitions("pretoken")
    sums = multiply(dealt, tokenizer).groupBy("block", "idx").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
