"""Exact substring deduplication over a sampled suffix array (operator 1).

Every byte covered by a ``SPAN``-byte string that also starts in a document with a
smaller id is removed.  Suffixes are ranked at growing lengths, Spark sorting
(rank, document) pairs and dropping what has become unique or is past the
threshold.  Two things differ from textbook prefix doubling: only sampled suffixes
are ranked, and a rank is a hash of the bytes, which a task can compute for any
length from the text, so that no rank is looked up at an offset.

1. ``ANCHOR`` = 24 bytes, at sampled positions only.  A position is an anchor if the
   hash of its 24 bytes is the smallest within some 50-byte window; each window's
   anchors depend on its 50 bytes alone, so equal windows have equal anchors.  About
   one byte in 14 is one.
2. 76 bytes: the anchor's context, all windows that hold it.  Rows are sorted by
   (24-byte rank, context rank, document).  A context that a smaller document has
   too is past the threshold: it is a repeat as a whole.  An anchor with one
   context in the corpus needs no more.  Only the first document of a context,
   where its 24 bytes have several contexts, goes on.
3. 50 bytes: the windows of those anchors that lie in no repeated context, sorted by
   (window rank, document); all but the first document's are repeats.

Equal windows meet under the same anchor, so nothing is lost by sampling.  Rank
keys are hashes of 96 bits in all.  Texts meet their ranks again by joins on the row.

Hot strings.  One document in ``SAMPLED`` shows which 24-byte ranks, contexts and
windows are frequent (at most ``HOT`` of each; what it misses is only sorted like the
rest).  Rows of a frequent rank are dealt by rank and context instead of rank alone,
and its contexts count as several.  Of a frequent context a task gives one row, the
smallest document's; the first document of each then goes to all tasks, which find
the repeats in their own texts.  Frequent windows are not sorted, but take the smallest
document by a partial aggregate.  So no task gets the documents of a hot string.

Memory: a slice is 512 KB of texts, and a longer text goes in pieces of that size
that overlap, at about 100 bytes for each byte of a slice (300 where all its bytes
are one character).  A text is whole only when its repeats are cut out.

Nulls: a null text is empty; a null id ranks after all others.  Texts under 50 bytes
keep everything.  Rows with the same id are the same document to each other (never
smaller) and are otherwise judged by their own text: those share their ranks only if
id and text (by a 63-bit hash) are equal.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stages, flat_bytes, release, slices, small_batches

SPAN, ANCHOR = 50, 24
WIDTH = SPAN - ANCHOR + 1  # anchors to choose from in a window
BEFORE = SPAN - ANCHOR  # context bytes before an anchor; SPAN after its start
PAD = 128
LAST = (1 << 63) - 1  # the rank of a null id
MUL = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                                  0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
PIECE, OVERLAP = 1 << 19, 128
SAMPLED, HOT = 64, 20_000
HOT_RANK, HOT_CONTEXT = 1 << 62, 1 << 61  # marks on a rank of 48 bits
LENGTH_BITS = 24


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= MUL[4]
    h ^= h >> np.uint64(29)
    h *= MUL[5]
    h ^= h >> np.uint64(32)
    return h


class Ranked:
    """Hashes of the texts of one slice (or of one piece of a long text), laid out with padding between them.

    ``base`` is where the piece starts in its text; what starts before ``core`` or
    after it belongs to the pieces next to it.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, base: int = 0, core: tuple[int, int] | None = None):
        size = np.diff(off)
        n = len(size)
        self.start = off[:-1] + PAD * (np.arange(n) + 1)
        self.end = self.start + size
        self.base = base
        self.lo, self.hi = (0, len(data) + PAD * (n + 1)) if core is None else (PAD + core[0], PAD + core[1])
        buf = np.zeros(len(data) + PAD * (n + 1) + 8, np.uint8)
        for a, z, o in zip(self.start.tolist(), self.end.tolist(), off.tolist(), strict=False):
            buf[a:z] = data[o:o + z - a]
        self.n = len(buf) - 8
        eight = np.ndarray((self.n,), "<u8", buffer=buf, strides=(1,))
        self.t = eight * MUL[0]
        self.t ^= self.t >> np.uint64(29)
        # 24 bytes at every position; positions outside a text never win
        m = self.n - ANCHOR
        h = self.t[:m] * MUL[1]
        h += self.t[8:m + 8] * MUL[2]
        h += self.t[16:m + 16] * MUL[3]
        h = _mix(h)
        inside, window = np.zeros(m, bool), np.zeros(m, bool)
        for a, z in zip(self.start.tolist(), self.end.tolist(), strict=True):
            inside[a:max(a, z - ANCHOR + 1)] = True
            window[a:max(a, z - SPAN + 1)] = True
        h[~inside] = ~np.uint64(0)
        self.h = h
        # the smallest of each window, then the largest of those around each position
        low = _slide(h, WIDTH, np.minimum)
        self.low = np.where(window[:len(low)], low, np.uint64(0))
        high = _slide(np.concatenate([np.zeros(WIDTH - 1, np.uint64), self.low]), WIDTH, np.maximum)
        self.at = np.flatnonzero((high == h[:len(high)]) & (high > 0))
        self.doc = np.searchsorted(self.start, self.at, side="right") - 1

    def core(self, at: np.ndarray) -> np.ndarray:
        return (at >= self.lo) & (at < self.hi)

    def place(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Positions in the whole text."""
        return at - self.start[doc] + self.base

    def contexts(self) -> np.ndarray:
        """Hash of the 76 bytes around each anchor, cut at the text's ends (padding and what is missing are hashed too)."""
        at, doc = self.at, self.doc
        c = np.zeros(len(at), np.uint64)
        for k, o in enumerate([*range(-BEFORE, SPAN - 8, 8), SPAN - 8]):
            c += self.t[at + o] * MUL[k % 10] * np.uint64(2 * k + 1)
        c += np.minimum(at - self.start[doc], BEFORE).astype(np.uint64) * MUL[7]
        c += np.minimum(self.end[doc] - at, SPAN).astype(np.uint64) * MUL[9]
        return _mix(c)

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that have one of these anchors, in order."""
        found = [np.zeros(0, np.int64)]
        for i in range(0, len(at), 1 << 14):
            s = at[i:i + (1 << 14), None] - np.arange(BEFORE, -1, -1)
            found.append(np.unique(s[self.low[s] == self.h[at[i:i + (1 << 14)]][:, None]]))
        return np.unique(np.concatenate(found))

    def spans(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes (64 and 32 bits) of the 50 bytes from each start."""
        w, v = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for k, o in enumerate([*range(0, SPAN - 8, 8), SPAN - 8]):
            x = self.t[start + o]
            w += x * MUL[k]
            v += x * MUL[9 - k] * np.uint64(2 * k + 3)
        return _mix(w), _mix(v) >> np.uint64(32)


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[:len(a) - (width - span)], a[width - span:]) if span < width else a


def _ranked(batches: Iterator[pa.RecordBatch], max_bytes: int | None = None):
    """(rows, Ranked) of slices of about ``max_bytes``; a longer text comes as several pieces of its row."""
    max_bytes = max_bytes or PIECE
    for batch in batches:
        for b in slices(batch, max_bytes=max_bytes):
            data, off = flat_bytes(b.column("text"))
            if len(off) == 2 and len(data) > max_bytes:
                for a in range(0, len(data), max_bytes):
                    first, z = max(a - OVERLAP, 0), min(a + max_bytes, len(data))
                    piece = data[first:min(z + OVERLAP, len(data))]
                    yield b, Ranked(piece, np.array([0, len(piece)]), first, (a - first, z - first))
                    release()
            else:
                yield b, Ranked(data, off)


class Frequent:
    """A set of keys of at most ``HOT``, with a value each, for lookups of whole arrays."""

    def __init__(self, keys=(), values=()):
        keys, values = np.array(keys, np.uint64), np.array(values if len(values) else [0] * len(keys), np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the set, -1 where it is not."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def both(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One key of a rank and its context."""
    return (h * MUL[6] ^ c) * MUL[8]


def rank_anchors(docs: DataFrame, hot_ranks: Frequent | None = None, hot_contexts: Frequent | None = None) -> DataFrame:
    """(h, c, rid, tag): 24-byte rank (48 bits), context rank (48 bits) and row of every anchor, once per row (or piece of it).

    Frequent ranks carry a mark; of a frequent context only the smallest row of the task is given out, with another.
    """
    hot_ranks, hot_contexts = hot_ranks or Frequent(), hot_contexts or Frequent()

    def rows(h, c, rid, tag):
        return pa.record_batch({"h": pa.array(h.astype(np.int64)), "c": pa.array(c.astype(np.int64)), "rid": pa.array(rid), "tag": pa.array(tag)})

    def run(batches):
        n = len(hot_contexts.keys)
        seen, best = np.zeros(n, bool), np.zeros((4, n), np.int64)  # rid, tag, h, c of the smallest row
        for b, r in _ranked(batches):
            own = r.core(r.at)
            c, h, doc = (r.contexts() >> np.uint64(16))[own], (r.h[r.at] >> np.uint64(16))[own], r.doc[own]
            key = both(h, c)
            _, one = np.unique(key + doc.astype(np.uint64), return_index=True)
            one.sort()
            c, h, doc, key = c[one], h[one], doc[one], key[one]
            rid, tag = (np.asarray(b.column(x))[doc] for x in ("rid", "tag"))
            if len(hot_ranks.keys):
                h = np.where(hot_ranks.find(h) >= 0, h | np.uint64(HOT_RANK), h)
            if n:
                at = hot_contexts.find(key)
                is_hot = at >= 0
                k = np.flatnonzero(is_hot)
                k = k[np.lexsort((tag[k], rid[k], at[k]))]
                k = k[np.diff(at[k], prepend=-1) != 0]  # the smallest of this slice
                i = at[k]
                less = ~seen[i] | (rid[k] < best[0, i]) | ((rid[k] == best[0, i]) & (tag[k] < best[1, i]))
                k, i = k[less], i[less]
                seen[i] = True
                best[:, i] = rid[k], tag[k], (h[k] | np.uint64(HOT_RANK | HOT_CONTEXT)).astype(np.int64), c[k].astype(np.int64)
                c, h, rid, tag = c[~is_hot], h[~is_hot], rid[~is_hot], tag[~is_hot]
            yield rows(h, c, rid, tag)
        if seen.any():
            rid, tag, h, c = best[:, seen]
            yield rows(h, c, rid, tag)

    return docs.select("rid", "tag", "text").mapInArrow(run, "h long, c long, rid long, tag long")


def frequent(docs: DataFrame, st: Stages) -> tuple[Frequent, Frequent]:
    """The ranks and contexts that one in a hundred documents of a sample has; fewer than 16 are not looked at."""
    some = F.pmod(F.xxhash64(F.when(F.col("tag") == 0, F.col("rid")).otherwise(F.col("tag"))), F.lit(SAMPLED)) == 0
    sample = st.write(rank_anchors(docs.where(some)).groupBy("h", "c").agg(F.count("*").alias("n")), "sample")
    least = max(16, docs.where(some).count() // 100)
    ranks = sample.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n")).limit(HOT).collect()
    pairs = sample.where(F.col("n") >= least).orderBy(F.desc("n")).limit(HOT).collect()
    st.drop(sample)
    h = {r["h"] for r in ranks}
    pairs = [r for r in pairs if r["h"] in h]
    keys = both(np.array([r["h"] for r in pairs], np.uint64), np.array([r["c"] for r in pairs], np.uint64))
    return Frequent(sorted(h)), Frequent(keys)


def rerank_contexts(ranked: DataFrame) -> DataFrame:
    """(rid, tag, c, repeat, hot) of the contexts that are not settled as unique, from rows sorted by (h, c, rid, tag).

    ``repeat``: a smaller document has the context.  Else it is of the first
    document of one of several contexts of the same 24 bytes (for rows with that document's
    id but another text, whether several or not).  ``hot`` is the rank of a
    frequent context, on the row of its first document.  The rows are read as
    a stream; between batches only one row of the last group is held.
    """
    def run(batches):
        h0 = c0 = first0 = r0 = t0 = None
        held = None  # the first row of the last group while the group has one context
        for b in batches:
            h, c, rid, tag = (np.asarray(b.column(x)) for x in ("h", "c", "rid", "tag"))
            if not len(h):
                continue
            new_h = np.concatenate([[h[0] != h0], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[c[0] != c0], c[1:] != c[:-1]])
            again = ~new_c & np.concatenate([[rid[0] == r0 and tag[0] == t0], (rid[1:] == rid[:-1]) & (tag[1:] == tag[:-1])])
            at = np.flatnonzero(new_c)
            group = np.cumsum(new_c)  # 0: goes on from the batch before
            first = np.concatenate([[first0 if first0 is not None else 0], rid[at]])[group]
            repeat = ~new_c & (rid != first)
            same_id = ~new_c & (rid == first)
            # contexts per 24 bytes; the first group may have begun in an earlier batch
            of_h = np.cumsum(new_h)
            contexts = np.bincount(of_h, weights=new_c, minlength=of_h[-1] + 1)
            goes_on = not new_h[0]
            if goes_on:
                contexts[0] += 1 if held is not None else 2
            marked = h >= HOT_RANK
            several = new_c & ((contexts[of_h] >= 2) | marked)
            if goes_on and held is not None and contexts[0] >= 2:
                yield rows([held[0]], [held[1]], [held[2]], [False], [None])
                held = None
            if contexts[of_h[-1]] >= 2 or marked[-1]:
                held = None
            elif new_h.any():
                k = at[-1]
                held = (int(rid[k]), int(tag[k]), int(c[k]))
            h0, c0, first0, r0, t0 = h[-1], c[-1], first[-1], rid[-1], tag[-1]
            out = np.flatnonzero((repeat | several | same_id) & ~again)
            lead = new_c[out] & (h[out] & HOT_CONTEXT > 0)
            yield rows(rid[out], tag[out], c[out], repeat[out], pa.array(h[out] & ~(HOT_RANK | HOT_CONTEXT), mask=~lead))

    def rows(rid, tag, c, repeat, hot):
        return pa.record_batch({"rid": pa.array(rid, pa.int64()), "tag": pa.array(tag, pa.int64()), "c": pa.array(c, pa.int64()),
                                "repeat": pa.array(repeat, pa.bool_()), "hot": pa.array(hot, pa.int64()) if isinstance(hot, list) else hot})

    deal = F.when(F.col("h") >= HOT_RANK, F.xxhash64("h", "c")).otherwise(F.col("h"))
    return (ranked.repartition(deal).sortWithinPartitions("h", "c", "rid", "tag")
            .mapInArrow(run, "rid long, tag long, c long, repeat boolean, hot long"))


def settle(docs: DataFrame, contexts: DataFrame, hot_contexts: Frequent) -> DataFrame:
    """(w, v, rid, tag, place, length): repeated runs (w null), and the windows that still have to be ranked.

    Equal windows that follow each other are one row, as long as all of them.
    ``hot_contexts`` has the first document of each frequent context.
    """
    lists = contexts.groupBy(F.col("rid").alias("of"), F.col("tag").alias("of_tag")).agg(
        F.collect_set(F.when(F.col("repeat"), F.col("c"))).alias("repeats"),
        F.collect_set(F.when(~F.col("repeat"), F.col("c"))).alias("firsts"))
    how = "left" if len(hot_contexts.keys) else "inner"
    rows = docs.join(lists, (F.col("rid") == F.col("of")) & (F.col("tag") == F.col("of_tag")), how).select("rid", "tag", "text", "repeats", "firsts")

    def member(r, c, lists):
        size = np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)
        doc = np.repeat(np.arange(len(lists)), size).astype(np.uint64)
        have = np.asarray(lists.flatten()).astype(np.uint64) * MUL[6] + doc * MUL[8]
        return np.isin(c * MUL[6] + r.doc.astype(np.uint64) * MUL[8], have)

    def run(batches):
        for b, r in _ranked(batches):
            c = r.contexts() >> np.uint64(16)
            rid, tag = (np.asarray(b.column(x)) for x in ("rid", "tag"))
            old, new = member(r, c, b.column("repeats")), member(r, c, b.column("firsts"))
            if len(hot_contexts.keys):
                at = hot_contexts.find(both(r.h[r.at] >> np.uint64(16), c))
                first = hot_contexts.values[at]
                old |= (at >= 0) & (rid[r.doc] > first)
                new |= (at >= 0) & (rid[r.doc] == first)
            # a repeated context is a repeat as a whole: every window in it is
            own = old & r.core(r.at)
            a, z = join_runs(np.maximum(r.at[own] - BEFORE, r.start[r.doc[own]]), np.minimum(r.at[own] + SPAN, r.end[r.doc[own]]))
            d = np.searchsorted(r.start, a, side="right") - 1
            yield pa.record_batch({"w": pa.nulls(len(a), pa.int64()), "v": pa.nulls(len(a), pa.int32()), "rid": pa.array(rid[d]), "tag": pa.array(tag[d]),
                                   "place": pa.array(r.place(a, d)), "length": pa.array((z - a).astype(np.int32))})
            s = r.windows(r.at[new & ~old])
            s = s[r.core(s)]
            s = s[np.searchsorted(r.at[old], s + BEFORE, side="right") == np.searchsorted(r.at[old], s)]
            d = np.searchsorted(r.start, s, side="right") - 1
            w, v = r.spans(s)
            run_start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1] + 1) | (d[1:] != d[:-1])])[:len(s)])
            length = SPAN - 1 + np.diff(run_start, append=len(s))
            s, d, w, v = s[run_start], d[run_start], w[run_start], v[run_start]
            yield pa.record_batch({"w": pa.array(w.astype(np.int64)), "v": pa.array(v.astype(np.uint32).view(np.int32)), "rid": pa.array(rid[d]),
                                   "tag": pa.array(tag[d]), "place": pa.array(r.place(s, d)), "length": pa.array(length.astype(np.int32))})

    return rows.mapInArrow(run, "w long, v int, rid long, tag long, place long, length int")


def join_runs(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the intervals [a, z)."""
    if not len(a):
        return a, z
    o = np.argsort(a, kind="stable")
    a, far = a[o], np.maximum.accumulate(z[o])
    new = np.concatenate([[True], a[1:] > far[:-1]])
    return a[new], far[np.concatenate([new[1:], [True]])]


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(rid, tag, place, length) of the windows that a smaller document has too, from rows sorted by (w, v, rid)."""
    def run(batches):
        w0 = v0 = first0 = None
        for b in batches:
            w, v, rid = (np.asarray(b.column(x)) for x in ("w", "v", "rid"))
            if not len(w):
                continue
            new = np.concatenate([[w[0] != w0 or v[0] != v0], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
            first = np.concatenate([[first0 if first0 is not None else 0], rid[new]])[np.cumsum(new)]
            w0, v0, first0 = w[-1], v[-1], first[-1]
            out = pa.array(rid != first)
            yield pa.record_batch([b.column(x).filter(out) for x in FOUND], names=FOUND)

    return (windows.repartition("w").sortWithinPartitions("w", "v", "rid")
            .mapInArrow(run, "rid long, tag long, place long, length int"))


FOUND = ["rid", "tag", "place", "length"]


def prepare(docs: DataFrame, st: Stages, keep: list[str], id_col: str = "doc_id") -> DataFrame:
    """(row, text, rid, tag): ``rid`` is the rank of the id (null last), ``tag`` tells rows with one id apart, ``row`` has the columns to keep.

    An id of one row has tag 0; other rows take a hash of their text, so that only equal ones share it.
    """
    small_batches(docs.sparkSession)
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("rid")
    shared = st.write(docs.select(rid).groupBy(F.col("rid").alias("shared")).agg(F.count("*").alias("n")).where(
        (F.col("n") > 1) | (F.col("shared") == LAST)).select("shared"), "ids")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), text.alias("text"), rid).join(shared, F.col("rid") == F.col("shared"), "left")
    tag = F.when(F.col("shared").isNotNull(), F.xxhash64("text").bitwiseAND(F.lit(LAST)).bitwiseOR(F.lit(1))).otherwise(F.lit(0))
    return rows.select("row", "text", "rid", tag.cast("long").alias("tag"))


def repeats(docs: DataFrame, st: Stages) -> DataFrame:
    """(rid, tag, place, length): byte ranges of prepared documents that smaller documents repeat."""
    ranks, hot = frequent(docs, st)
    contexts = st.write(rerank_contexts(rank_anchors(docs, ranks, hot)), "contexts")
    if len(hot.keys):
        first = contexts.where("hot IS NOT NULL").select("hot", "c", "rid").collect()  # one row for each frequent context
        hot = Frequent(both(np.array([r["hot"] for r in first], np.uint64), np.array([r["c"] for r in first], np.uint64)), [r["rid"] for r in first])
    settled = st.write(settle(docs, contexts, hot), "settled")
    st.drop(contexts)
    todo = settled.where("w IS NOT NULL")
    some = F.pmod(F.xxhash64("rid", "tag"), F.lit(SAMPLED)) == 0
    often = todo.where(some).groupBy("w", "v").agg(F.count("*").alias("n")).where("n >= 16").orderBy(F.desc("n")).limit(HOT)
    often = st.write(often.select("w", "v"), "often")
    parts = [settled.where("w IS NULL").select(*FOUND)]
    if often.isEmpty():
        cold = todo
    else:  # at most HOT rows
        cold = todo.join(F.broadcast(often), ["w", "v"], "left_anti")
        mine = todo.join(F.broadcast(often), ["w", "v"])
        first = st.write(mine.groupBy("w", "v").agg(F.min("rid").alias("first")), "first")
        parts.append(todo.join(F.broadcast(first), ["w", "v"]).where("rid > first").select(*FOUND))
    parts.append(st.write(repeated_windows(cold.select("w", "v", *FOUND)), "windows"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def _with_ranges(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each row's ranges as a set of numbers, place and length; rows that are equal share theirs."""
    packed = F.shiftleft("place", LENGTH_BITS).bitwiseOR(F.col("length").cast("long"))
    lists = found.groupBy(F.col("rid").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_set(packed).alias("ranges"))
    return docs.join(lists, (F.col("rid") == F.col("of")) & (F.col("tag") == F.col("of_tag")), "left").drop("of", "of_tag")


def _runs(ranges) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of one row's ranges (an Arrow list scalar, or null)."""
    if not ranges.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = np.asarray(ranges.values).astype(np.int64)
    a = v >> LENGTH_BITS
    return join_runs(a, a + (v & ((1 << LENGTH_BITS) - 1)))


def _kept(data: bytes, a: np.ndarray, z: np.ndarray) -> bytes:
    return b"".join(data[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(data)], strict=True))


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    st = Stages(docs.sparkSession, "suffixes")
    p = prepare(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text"), st, ["doc_id"])

    def run(batches):
        for b in batches:
            rows = []
            for text, ranges in zip(b.column("text"), b.column("ranges"), strict=True):
                data = text.as_buffer().to_pybytes()
                a, z = _runs(ranges)
                rows.append((len(data), int((z - a).sum()), len(a), hashlib.sha256(_kept(data, a, z)).hexdigest()))
            n, gone, spans, sha = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                                   "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _with_ranges(p, repeats(p, st)).select(F.col("row.doc_id").alias("doc_id"), "text", "ranges").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated runs, all columns as they were (``n_chars`` follows the text).

    A run is narrowed to whole characters, so texts stay valid UTF-8.
    """
    schema = docs.schema
    st = Stages(docs.sparkSession, "suffixes")
    p = prepare(docs, st, docs.columns)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            row = b.column("row")
            cols = [row.field(i) for i in range(row.type.num_fields)]
            out = []
            for text, ranges in zip(cols[at], b.column("ranges"), strict=True):
                a, z = _runs(ranges)
                if not text.is_valid or not len(a):
                    out.append(text.as_py())
                    continue
                data = text.as_buffer().to_pybytes()
                inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80  # noqa: B023, E731  within a character
                for i in range(len(a)):
                    while a[i] < z[i] and inner(a[i]):
                        a[i] += 1
                    while z[i] > a[i] and inner(z[i]):
                        z[i] -= 1
                out.append(_kept(data, a, z).decode())
            cols[at] = pa.array(out, schema_types[at])
            if chars is not None:
                n = pc.utf8_length(cols[at]).cast(schema_types[chars])
                cols[chars] = pc.if_else(pc.equal(cols[at], row.field(at).cast(schema_types[at])).fill_null(True), cols[chars], n)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None
    from pyspark.sql.pandas.types import to_arrow_type
    schema_types = [to_arrow_type(f.dataType) for f in schema.fields]
    return _with_ranges(p.select("row", "rid", "tag"), repeats(p, st)).select("row", "ranges").mapInArrow(run, schema)
