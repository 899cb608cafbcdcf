"""Language identification by averaged hashed subword embeddings (operator 10).

A text is lower-cased and reduced to its letters with single spaces between
words; every window of 2, 3 and 4 characters that touches a letter is hashed into
one of ``BUCKETS`` embeddings.  The text's embedding is their mean, and a linear
softmax over it gives the languages.  Embeddings and softmax are trained together
by stochastic gradient descent in numpy on a bounded sample: ``per_class``
documents of each of the ``max_langs`` languages with the most documents (fewer
where that is over ``total``), the smallest by a hash of their id among those of
at most ``max_chars`` characters.
Every third text of each language is left out of training and calibrates a
temperature and the score below which a prediction is rejected.

Prediction needs one table, embeddings times softmax (BUCKETS x languages), so a
batch is hashing, a table lookup and a sum per text, over whole texts, at about
30 + 12 * languages bytes of memory for each character of a slice of 512 KB, or of
one longer text (by runs of ``RUN`` windows).

Nulls: a text that is null or has no letter is ``und`` with score 0; null
languages are not learned from.  Without any labelled text everything is
``und``.  Ties go to the first language by name; repeated rows are judged alike;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Stages, flat_bytes, id_text, slices, small_batches

BUCKETS, DIM = 1 << 16, 16
SIZES = (2, 3, 4)
UND = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a string array without nulls as numbers, and the offsets of its rows."""
    data, off = flat_bytes(texts)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), starts[off]


def subwords(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per window size: the bucket of every window and the offsets of the texts; and the letters per text."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    clean = pc.binary_join_element_wise(" ", pc.utf8_trim(clean, " "), " ", "")
    x, off = code_points(clean)
    letters = np.diff(off) - 2
    found, offs = [], []
    for n in SIZES:
        m = max(len(x) - n + 1, 0)
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ x[k:k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        h ^= h >> np.uint32(15)
        found.append(h & np.uint32(BUCKETS - 1))
        # a window belongs to the text that it starts in; those that reach over the text's end are left out
        size = np.maximum(np.diff(off) - n + 1, 0)
        keep, at = np.zeros(m + n, bool), off[:-1]
        mark = np.zeros(m + n + 1, np.int32)
        np.add.at(mark, at, (size > 0).astype(np.int32))
        np.add.at(mark, at + size, -(size > 0).astype(np.int32))
        keep = np.cumsum(mark)[:m] > 0
        found[-1] = found[-1][keep]
        offs.append(np.concatenate([[0], np.cumsum(size)]))
    return found, offs, letters


RUN = 1 << 18


def sums(table: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the windows' rows of ``table`` per text, number of windows, letters."""
    found, offs, letters = subwords(texts)
    total = np.zeros((len(texts), table.shape[1]))
    count = np.zeros(len(texts))
    for h, off in zip(found, offs, strict=True):
        for a in range(0, len(h), RUN):
            z = min(a + RUN, len(h))
            run = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[h[a:z]], axis=0, dtype=np.float64)])
            cut = np.clip(off, a, z) - a
            total += run[cut[1:]] - run[cut[:-1]]
        count += np.diff(off)
    return total, count, letters


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages, float32: embeddings times softmax
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, has letters)."""
        if not self.langs:
            return np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
        total, n, letters = sums(self.table, texts)
        z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1), letters > 0


def chunks(texts: list[str], chars: int = 1 << 19):
    """The texts in runs of about so many characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[at:i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def held_third(y: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Every third usable text of each class, so that a class of three and more is in both parts."""
    cal = np.zeros(len(y), bool)
    for c in np.unique(y):
        cal[np.flatnonzero((y == c) & usable)[2::3]] = True
    return cal


def train(texts: list[str], langs: list[str], epochs: int = 8, rate: float = 0.2, seed: int = 1) -> Model:
    """SGD over single texts; every third text of each language (by the caller's order) calibrates."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    y = np.array([names.index(x) for x in langs])
    feats, letters = [], []
    for part in chunks(texts):
        found, offs, n = subwords(pa.array(part, pa.string()))
        letters.append(n)
        for i in range(len(part)):
            h = np.concatenate([f[o[i]:o[i + 1]] for f, o in zip(found, offs, strict=True)])
            u, c = np.unique(h, return_counts=True)
            feats.append((u, (c / max(c.sum(), 1)).astype(np.float32)))
    letters = np.concatenate(letters)
    cal = held_third(y, letters > 0)
    use = np.flatnonzero(~cal & (letters > 0))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    soft, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    steps, step = max(epochs * len(use), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(use):
            lr = rate * (1 - step / steps)
            step += 1
            u, w = feats[i]
            v = w @ emb[u]
            z = v @ soft + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = soft @ g
            soft -= lr * np.outer(v, g)
            bias -= 0.1 * lr * g
            emb[u] -= (lr * len(u)) * np.outer(w, back)
    model = Model(names, (emb @ soft).astype(np.float32), bias)
    return calibrate(model, [t for t, c in zip(texts, cal, strict=True) if c], y[cal])


def mixtures(z: np.ndarray, y: np.ndarray, each: int = 32, seed: int = 1) -> np.ndarray:
    """Scores of texts that are one half each of two texts in different languages: their logits are the mean of the two.

    Every text is put together with ``each`` others drawn at random; pairs in one language are left out.
    """
    a = np.repeat(np.arange(len(z)), each)
    b = np.random.default_rng(seed).integers(0, len(z), len(a))
    a, b = a[y[a] != y[b]], b[y[a] != y[b]]
    best = np.empty(len(a))
    for i in range(0, len(a), 1 << 14):
        both = (z[a[i:i + (1 << 14)]] + z[b[i:i + (1 << 14)]]) / 2
        best[i:i + len(both)] = 1 / np.exp(both - both.max(axis=1, keepdims=True)).sum(axis=1)
    return best


def calibrate(model: Model, texts: list[str], y: np.ndarray, lost: float = 0.001) -> Model:
    """Temperature by log loss; the rejection score: half way from chance (1 / languages) to the score below which
    ``lost`` of the accepted examples fall.  Those are the right predictions and, on their own, even mixtures of two
    of them in different languages; the lower of the two scores counts."""
    parts = [sums(model.table, pa.array(part, pa.string())) for part in chunks(texts)]
    if not parts:
        return model
    total, n, letters = (np.concatenate(x) for x in zip(*parts, strict=True))
    ok = letters > 0
    if not ok.any():
        return model
    z, y = (total / np.maximum(n, 1)[:, None] + model.bias)[ok], y[ok]
    grid = 2.0 ** np.arange(-3, 4, 0.25)
    soft = [(lambda e: e / e.sum(axis=1, keepdims=True))(np.exp((z - z.max(axis=1, keepdims=True)) / t)) for t in grid]
    loss = [-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean() for p in soft]
    k = int(np.argmin(loss))
    model.temperature = float(grid[k])
    right = soft[k].argmax(axis=1) == y
    if right.any() and len(model.langs) > 1:
        chance = 1 / len(model.langs)
        accepted = [soft[k][right].max(axis=1), mixtures(z[right] / model.temperature, y[right])]
        low = min(np.sort(x)[int(lost * len(x))] for x in accepted if len(x))
        model.reject_below = float(low - chance) / 2 + chance
    return model


def pick(rows: DataFrame, per_class: int, max_langs: int, total: int) -> DataFrame:
    """(doc_id, hash, lang, at): the rows with the smallest hashes of each of the most frequent languages.

    A cut-off of the hash for each language, from its number of rows, leaves about
    twice as many rows as are wanted; only those are ordered.
    """
    key = F.xxhash64("doc_id")
    place = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    n = rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "of").limit(max_langs).collect()
    per = min(per_class, total // max(len(n), 1))
    cuts = rows.sparkSession.createDataFrame([(r["of"], (2 * per + 64) / r["rows"]) for r in n], "of string, cut double")
    few = rows.select("doc_id", "lang", "hash").join(F.broadcast(cuts), F.col("lang") == F.col("of")).where(place < F.col("cut")).distinct()  # max_langs rows
    order = Window.partitionBy("lang").orderBy(key, "doc_id", "hash")
    return few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per).select("doc_id", "hash", "lang", "at")


def fit(docs: DataFrame, per_class: int = 600, lang_col: str = "lang", holdout: bool = True, max_langs: int = 100, max_chars: int = 16_000,
        total: int = 8000) -> Model:
    """Train on at most ``per_class`` documents of each of ``max_langs`` languages, ``total`` in all, the smallest by a hash of the id.

    The sample is picked on narrow rows (key and language); only its texts are
    read into the driver, at most total * max_chars characters.  Documents without
    an id or with a longer text are not sampled.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= max_chars)
    if holdout:
        rows = rows.where(~held_out())
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    chosen = Stages(docs.sparkSession, "language").write(pick(rows, per_class, max_langs, total), "sample")
    keys = F.broadcast(chosen.withColumnRenamed("lang", "chosen"))  # at most per_class * max_langs rows
    got = rows.join(keys, ["doc_id", "hash"]).where("lang = chosen").dropDuplicates(["doc_id", "hash", "lang"])
    got = got.orderBy("at", "lang", "doc_id").select("text", "lang").collect()
    return train([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, max_bytes=1 << 19):
                best, score, ok = model.predict(b.column("text"))
                names = np.array([*model.langs, UND], dtype=object)
                yield pa.record_batch({
                    "doc_id": b.column("doc_id"), "lang_pred": pa.array(names[np.where(ok, best, len(model.langs))], pa.string()),
                    "score": pa.array(np.where(ok, score, 0.0)), "rejected": pa.array(~ok | (score < model.reject_below))})

    return id_text(docs, id_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is not rejected, all columns as they were."""
    schema = docs.schema
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                for part in slices(b, max_bytes=1 << 19):
                    texts = part.column("text").cast(pa.string()).fill_null("")
                    _, score, ok = model.predict(texts)
                    yield part.filter(pa.array(ok & (score >= model.reject_below)))

    return docs.mapInArrow(run, schema)
