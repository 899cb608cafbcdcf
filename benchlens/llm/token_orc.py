"""Token ids as ORC files (operator 5).

Documents are ordered by id, encoded in Arrow batches and written as ORC: the
ids column is run-length encoded (RLEv2), ``doc_id`` carries a Bloom filter and
row indexes, so a reader takes stripes in parallel and a lookup by id skips
stripes and row groups from metadata alone.

Encoding cost is paid per distinct word.  A text is cut at ASCII white space;
every tokenizer whose pre-tokenizer never joins characters across white space
(and drops white space) gives the same ids for the pieces as for the whole.
Inside a piece, a run of Latin letters followed by a run of plain punctuation is
two pre-tokens, so the library encodes each distinct word once per batch; any
other piece goes to the library as it is.

Nulls: a null text is empty (only the end id); a null doc_id sorts first.
Repeated doc_ids are kept, ordered by text.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import gather, gathered, id_text, slices

SCHEMA = "doc_id long, part int, pos long, n_tokens long, ids array<int>"
WORD = r"^(?P<w>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<p>[-.,!?;:%$&*#\"()\[\]{}/+=@^~_]*)$"


def byte_alphabet() -> dict[int, str]:
    """Byte-level pre-tokenizing: printable Latin-1 stands for itself, the other bytes for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(own))
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class WordEncoder:
    """Whole-text ids of a white-space-dropping tokenizer, encoding each distinct word once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def library(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each string as one flat array, and their counts."""
        ids = [e.ids for e in self.tok.encode_batch_fast(items.to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for one in ids for x in one), np.int32, int(n.sum())), n

    def words(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``library``, of single lower-case words: the library's merges without its text handling."""
        merge, table = self.tok.model.tokenize, byte_alphabet()
        ids = [[t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(table))] for w in items.to_pylist()]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for one in ids for x in one), np.int32, int(n.sum())), n

    def pieces(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct white-space-free pieces: flat, and offsets."""
        m = pc.extract_regex(items, WORD)
        plain = np.asarray(m.is_valid())
        word = pc.utf8_lower(m.field("w").filter(pa.array(plain))).dictionary_encode()
        mark = m.field("p").filter(pa.array(plain)).dictionary_encode()
        rest = items.filter(pa.array(~plain))
        parts = [self.words(word.dictionary), self.library(mark.dictionary), self.library(rest)]
        flat = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        start = np.cumsum(n) - n
        # each piece is two parts; the second of a piece outside WORD is an empty one
        flat, n, start = flat, np.append(n, 0), np.append(start, len(flat))
        two = np.full((len(items), 2), len(n) - 1)
        two[plain, 0] = np.asarray(word.indices)
        two[plain, 1] = np.asarray(mark.indices) + len(word.dictionary)
        two[~plain, 0] = np.arange(len(rest)) + len(word.dictionary) + len(mark.dictionary)
        out, off = gather(flat, start, n, two.ravel())
        return out, off[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts: flat int32, and the offsets of the texts."""
        lists = pc.ascii_split_whitespace(texts)
        d = lists.flatten().dictionary_encode()
        flat, off = self.pieces(d.dictionary)
        ids, word_off = gather(flat, off[:-1], np.diff(off), np.asarray(d.indices))
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
        return ids, word_off[ends]


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = 1, partitions: int | None = None) -> DataFrame:
    """Documents in ascending doc_id with their ids; one range of doc_ids per partition."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, pos = WordEncoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 12 << 20):
            for b in slices(batch, max_bytes=16 << 20):
                ids, off = enc.encode(b.column("text"))
                if end_id is not None:
                    ends = off[1:] + np.arange(b.num_rows)
                    out = np.full(len(ids) + b.num_rows, end_id, np.int32)
                    body = np.ones(len(out), bool)
                    body[ends] = False
                    out[body] = ids
                    ids, off = out, np.concatenate([[0], ends + 1])
                yield pa.record_batch({
                    "doc_id": b.column("doc_id"), "part": pa.array(np.full(b.num_rows, part, np.int32)),
                    "pos": pa.array(np.arange(pos, pos + b.num_rows)), "n_tokens": pa.array(np.diff(off)),
                    "ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))})
                pos += b.num_rows

    d = id_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return d.mapInArrow(run, SCHEMA)


def write(encoded: DataFrame, path: str, stripe_bytes: int = 16 << 20, row_index: int = 1000) -> None:
    """ORC with RLEv2 integers, row indexes and a Bloom filter on doc_id; atomic per job."""
    (encoded.write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
     .option("orc.row.index.stride", row_index).option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", 0.01).orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on doc_id prune files, stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def offsets(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written rows, from the ids themselves.

    ``start`` is the sum within the file plus the sums of all earlier files: a
    table of one row per file, and a window over narrow rows of one file.
    """
    def run(batches):
        for b in batches:
            ids = b.column("ids")
            flat, off = np.asarray(ids.flatten()).astype("<u4"), np.asarray(ids.offsets)
            off = off - off[0]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "part": b.column("part"), "pos": b.column("pos"),
                "n_tokens": pa.array(np.diff(off).astype(np.int64)),
                "ids_crc32": pa.array([zlib.crc32(flat[a:z].tobytes()) for a, z in zip(off, off[1:], strict=False)], pa.int64())})

    rows = tokens.select("doc_id", "part", "pos", "ids").mapInArrow(
        run, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    files = tokens.groupBy(F.col("part").alias("of_part")).agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("of_part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(base, F.col("part") == F.col("of_part"))
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
