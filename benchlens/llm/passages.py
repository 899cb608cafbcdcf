"""Text quality by attention over passages (operator 13): multiple-instance learning from document labels.

A text is a bag of passages, runs of about ``WORDS`` words with the space around them.
Every passage of the whole text is encoded: how often each pair of neighbouring
character classes occurs, figures of its words (length, share of distinct words, of
repeats of the word before, of the most frequent one), and its words hashed into
``HASHED`` signed sums.  A dense layer h = tanh(W x + b) gives its representation;
gated attention weighs the passages of a document by the softmax of
w . (tanh(V h) * sigmoid(U h)); and a logistic score is taken of the weighted
representation.  All weights are learned together, by Adam in numpy, from labels
of documents alone.

The sample: at most ``per_class`` documents for each label, those with the
smallest hash of the id among labelled documents that are not held out, of at most
``max_chars`` characters each.  Spark encodes it in tasks and sends passage features
(bounded by the two) to the driver.  Every third sampled document of a label is
left out of training and calibrates the score (slope and intercept), weighted to
the shares of the labels among all usable rows.

Prediction is one pass over whole texts: about 60 bytes of memory for each byte of a
slice of 512 KB, or of one longer text.

Nulls: a null text is empty; a text without words is one passage without
features and gets the score of that.  Labels other than 0 and 1 and rows without id
teach nothing; a document with both labels teaches both; of texts with one id the
one with the smallest hash is sampled.  Without labels the score is 0.5, with one
label the same for all.  Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stages, flat_bytes, id_text, slices
from .language_id import held_out

WORDS, HASHED = 64, 64
# classes of bytes: space, line break, digit, lower case, upper case, end of a clause, other ASCII, above ASCII
CLASSES = 8
FIGURES = 6
WIDTH = CLASSES * CLASSES + FIGURES + HASHED
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _class_table() -> np.ndarray:
    t = np.full(256, 6, np.uint8)
    t[128:] = 7
    t[[0x20, 0x09]] = 0
    t[0x0A:0x0E] = 1
    for first, last, c in (("0", "9", 2), ("a", "z", 3), ("A", "Z", 4)):
        t[ord(first):ord(last) + 1] = c
    t[[ord(c) for c in ".,;:!?"]] = 5
    return t


CLASS = _class_table()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash (letter case kept out for ASCII) of every word, none across two texts."""
    c = CLASS[data]
    word = c > 1
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    low = data + np.uint8(32) * (c == 4)
    # sum of byte * STEP ** place, moved back to place 0: equal words have equal sums wherever they stand
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(STEP, len(data)), dtype=np.uint64)])
    h = (run[ends] - run[starts]) * _powers(BACK, len(data) + 1)[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return starts, ends, h ^ (h >> np.uint64(32))


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x WIDTH) of texts without nulls, and the offsets of the texts' passages (at least one each)."""
    data, off = flat_bytes(texts)
    starts, ends, h = words_of(data, off)
    doc = np.searchsorted(off, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=len(texts))
    bags = np.maximum(-(-per_doc // WORDS), 1)  # passages of a text, as even as can be
    at = np.concatenate([[0], np.cumsum(bags)])
    nth = np.arange(len(starts)) - (np.cumsum(per_doc) - per_doc)[doc]
    passage = at[doc] + nth * bags[doc] // np.maximum(per_doc, 1)[doc]
    n = int(at[-1])
    count = np.bincount(passage, minlength=n)
    some = np.maximum(count, 1)
    # a text's first passage begins with the text, the others with their first word
    first_word = np.cumsum(count) - count
    begin = np.repeat(off[:-1], bags)
    later = np.ones(n, bool)
    later[at[:-1]] = False
    begin[later] = starts[first_word[later]]
    size = np.diff(np.concatenate([begin, [len(data)]]))
    of = np.repeat(np.arange(n, dtype=np.int32), size)
    c = CLASS[data]
    follows = np.concatenate([c[1:], np.zeros(min(len(c), 1), np.uint8)])
    follows[off[1:][np.diff(off) > 0] - 1] = 0
    pairs = np.bincount(of * np.int64(CLASSES * CLASSES) + (c * np.uint8(CLASSES) + follows), minlength=n * CLASSES * CLASSES)
    x = np.zeros((n, WIDTH), np.float32)
    x[:, :CLASSES * CLASSES] = np.sqrt(pairs.reshape(n, -1) / np.maximum(size, 1)[:, None])
    if len(starts):
        length = (ends - starts).astype(np.float64)
        same = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        kinds, first, times = np.unique(h * STEP + passage.astype(np.uint64) * BACK, return_index=True, return_counts=True)
        top = np.zeros(n)
        np.maximum.at(top, passage[first], times)
        longest = np.zeros(n)
        np.maximum.at(longest, passage, length)
        figures = [np.log1p(count), np.log1p(np.bincount(passage, length, n) / some), np.log1p(longest),
                   np.bincount(passage[first], minlength=n) / some, np.bincount(passage[1:][same], minlength=n) / some, top / some]
        x[:, CLASSES * CLASSES:-HASHED] = np.stack(figures, axis=1)
        sign = 1.0 - 2.0 * (h >> np.uint64(6) & np.uint64(1)).astype(np.float64)
        hashed = np.bincount(passage * HASHED + (h & np.uint64(HASHED - 1)).astype(np.int64), sign, n * HASHED)
        x[:, -HASHED:] = hashed.reshape(n, HASHED) / np.sqrt(some)[:, None]
    return x, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights by name, the features' mean and scale, and the calibrated score: sigmoid(slope * logit + shift)."""
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Bags x[at[i]:at[i + 1]], none empty: passage representations, attention, bag representation and logit."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["w"]
        size = np.diff(at)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), size))
        a /= np.repeat(np.add.reduceat(a, at[:-1]), size)
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ w["u"] + w["c"]}

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if not self.weights:
            return np.full(len(texts), _sigmoid(np.float64(self.shift)))
        x, at = encode(texts)
        return _sigmoid(self.slope * self.forward(x, at)["logit"] + self.shift)

    def attention(self, text: str) -> np.ndarray:
        """The weight of every passage of one text."""
        return self.forward(*encode(pa.array([text], pa.string())))["a"]


def gradients(m: Model, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over bags."""
    w, f, size = m.weights, m.forward(x, at), np.diff(at)
    bag = np.repeat(np.arange(len(size)), size)
    g = (_sigmoid(f["logit"]) - y) / len(y)
    dz = g[:, None] * w["u"]
    da = (dz[bag] * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at[:-1]), size))
    dgate = de[:, None] * w["w"]
    dt = dgate * f["s"] * (1 - f["t"] ** 2)
    ds = dgate * f["t"] * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    return {"W": f["x"].T @ dpre, "b": dpre.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de,
            "u": f["z"].T @ g, "c": g.sum()}


def train(bags: list[np.ndarray], y: np.ndarray, share: float, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 16,
          rate: float = 0.004, decay: float = 1e-4, seed: int = 1) -> Model:
    """Adam over bags of passage features; ``share`` is that of label 1 among all usable rows."""
    y = np.asarray(y, np.float64)
    if len(np.unique(y)) < 2:  # nothing to tell apart: smoothed share of what there is
        odds = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return Model({}, np.zeros(WIDTH), np.ones(WIDTH), shift=odds)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[2::3]] = True
    use, rng = np.flatnonzero(~held), np.random.default_rng(seed)
    of_use = np.concatenate([bags[i] for i in use])
    m = Model({"W": rng.normal(0, WIDTH ** -0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden ** -0.5, (hidden, gate)),
               "U": rng.normal(0, hidden ** -0.5, (hidden, gate)), "w": rng.normal(0, gate ** -0.5, gate), "u": np.zeros(hidden), "c": np.zeros(())},
              of_use.mean(axis=0, dtype=np.float64), np.maximum(of_use.std(axis=0, dtype=np.float64), 1e-2))
    one, two = ({k: np.zeros_like(v) for k, v in m.weights.items()} for _ in range(2))
    # bags of a label are drawn as often as those of the other
    by_label = [use[y[use] == label] for label in (0, 1)]
    steps = max(epochs * len(use) // batch, 1)
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(i, batch // 2) for i in by_label])
        at = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
        for k, g in gradients(m, np.concatenate([bags[i] for i in pick]), at, y[pick]).items():
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            move = (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
            m.weights[k] = m.weights[k] - rate * (1 - step / (steps + 1)) * (move + decay * m.weights[k])
    rest = np.flatnonzero(held)
    if len(np.unique(y[rest])) == 2:
        z = np.concatenate([m.forward(bags[i], np.array([0, len(bags[i])]))["logit"] for i in rest])
        m.slope, m.shift = calibrate(z, y[rest], share)
    return m


def calibrate(z: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of logits z by weighted logistic regression with smoothed targets (Newton steps)."""
    ones, n = y.sum(), len(y)
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    weight = np.where(y == 1, share / ones, (1 - share) / (n - ones)) * n
    spread = max(float(z.std()), 1e-6)
    a = np.stack([z / spread, np.ones(n)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(a @ w)
        grad = a.T @ (weight * (p - target)) + 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    # more of label 1 never lowers the score
    return max(float(w[0]), 0.0) / spread, float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 600, max_chars: int = 100_000, holdout: bool = True) -> Model:
    """Learn from at most ``per_class`` documents a label, the smallest by a hash of the id, of at most ``max_chars`` characters."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("doc_id IS NOT NULL AND label IN (0, 1)")
    if holdout:
        rows = rows.where(~held_out())
    of = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not of:
        return Model({}, np.zeros(WIDTH), np.ones(WIDTH))
    # a cut-off of the hash leaves few more rows than are wanted, so no task sorts more than those
    hash_ = F.xxhash64("doc_id")
    part = F.shiftrightunsigned(hash_, 11) / F.lit(float(1 << 53))
    picks = []
    for label, n in of.items():
        few = rows.where((F.col("label") == label) & (part < 2 * per_class / n + 64 / n)).distinct()
        picks.append(few.orderBy(hash_, "doc_id").limit(per_class))
    pick = picks[0].union(picks[1]) if len(picks) == 2 else picks[0]
    pick = Stages(docs.sparkSession, "quality").write(pick, "sample")
    text = id_text(docs).where(F.length("text") <= max_chars)
    got = (text.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "label")  # at most two times per_class rows
           .agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    def run(batches):
        for batch in batches:
            for b in slices(batch, max_bytes=1 << 19):
                x, at = encode(b.column("text"))
                yield pa.record_batch({"doc_id": b.column("doc_id"), "label": b.column("label"),
                                       "x": pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())})

    found = sorted(got.mapInArrow(run, "doc_id long, label int, x binary").collect(), key=lambda r: (r["doc_id"], r["label"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in found]
    return train(bags, np.array([r["label"] for r in found]), of.get(1, 0) / sum(of.values()))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, max_bytes=1 << 19):
                s = model.score(b.column("text"))
                yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
