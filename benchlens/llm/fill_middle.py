"""Fill-in-the-middle transformation over a wavelet matrix of character classes (operator 12).

A text is cut into units (``TOKEN``: spaces and the word after them, or the spaces
that end the text; ``LINE``: a line with its break) and two seeded cuts between units
make prefix, middle and suffix, which are put together again with the middle last.

The bytes of a slice of texts become classes (``WORD`` ... ``BREAK_LAST``), each byte's
class saying whether a word or the text ends there and whether the byte starts a
code point.  The classes are stored as a wavelet matrix: four bit planes with
counts per 64-bit word, so that the rank of a class before any place takes four
lookups.  A unit ends at a byte of some classes (``TOKEN``, ``LINE``), a code point
starts at a byte of all classes but ``CONT``; sums of ranks therefore count units
or code points before any place.  The k-th boundary is found by bisection on
those counts, for all texts of a slice at once.

Memory: about 12 bytes for each byte of a slice of 2 MB, or of one longer text.

Nulls: a null text is empty; a null id is an empty number in the seed.  An empty
text has no unit and stays plain, as do texts that hold a marker.  Rows with the
same id are cut with the same random numbers; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import flat_bytes, slices, small_batches

# classes of bytes; _LAST is the last byte of a text
WORD, CONT, WORD_END, CONT_END, WORD_LAST, CONT_LAST, SPACE, BREAK, SPACE_LAST, BREAK_LAST = range(10)
LEVELS = 4
LAST_BYTE = (WORD_LAST, CONT_LAST, SPACE_LAST, BREAK_LAST)
#: Classes at which a unit ends.
TOKEN = (WORD_END, CONT_END, *LAST_BYTE)
LINE = (BREAK, *LAST_BYTE)
#: Classes of bytes that go on with a code point.
CONTINUED = (CONT, CONT_END, CONT_LAST)
MARKERS = ("<P>", "<S>", "<M>")


class WaveletMatrix:
    """Ranks of symbols below 2 ** LEVELS in a sequence: bit planes, highest bit first, each stably sorted by the one above."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.words, self.before, self.zeros = [], [], []
        for level in reversed(range(LEVELS)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            bits = np.packbits(bit, bitorder="little")
            packed[:len(bits)] = bits
            words = packed.view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(self.n - int(ones.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(low)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        lo, hi = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level in range(LEVELS):
            a, z = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (LEVELS - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + z
            else:
                lo, hi = lo - a, hi - z
        return hi - lo

    def ranks(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)

    def after(self, symbols: tuple[int, ...], k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest place in [lo, hi] with k of these symbols between lo and it, by bisection (hi where there are fewer)."""
        base, lo, hi = self.ranks(symbols, lo), lo.copy(), hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            enough = self.ranks(symbols, mid) - base >= k
            hi = np.where(enough, mid, hi)
            lo = np.where(enough, lo, np.minimum(mid + 1, hi))
        return lo


def classes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The class of every byte of texts laid out one after the other."""
    brk = data - np.uint8(0x0A) < 4  # line feed to carriage return; unsigned, so smaller bytes wrap
    space = brk | (data == 0x20) | (data == 0x09)
    last = np.zeros(len(data), bool)
    last[off[1:][np.diff(off) > 0] - 1] = True
    out = ((data & 0xC0) == 0x80).astype(np.uint8)  # WORD or CONT
    out[:-1] += np.uint8(2) * space[1:]
    out[last] = WORD_LAST + (out[last] & 1)
    out[space] = SPACE + brk[space] + np.uint8(2) * last[space]
    # a carriage return before a line feed is no break of its own
    out[:-1][(data[:-1] == 0x0D) & (data[1:] == 0x0A) & ~last[:-1]] = SPACE
    return out


def seeds(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of eight hexadecimal digits of sha256('seed:id')."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80,
              unit: tuple[int, ...] = TOKEN) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of every document.

    ``rate`` of 100 texts that can be cut are cut, ``spm`` of 100 of those have the
    suffix first.  Cuts lie after whole units.
    """
    small_batches(docs.sparkSession)
    doc_id = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2, h3, h4 = seeds(doc_id, seed)
    plain = (text == "") | (h3 % 100 >= rate)
    for m in MARKERS:
        plain = plain | text.contains(m)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                data, off = flat_bytes(b.column("text"))
                wm = WaveletMatrix(classes(data, off))
                start, end = off[:-1], off[1:]
                n = wm.ranks(unit, end) - wm.ranks(unit, start)
                cuts = np.sort([np.asarray(b.column(h)) % (n + 1) for h in ("h1", "h2")], axis=0)
                a, z = (wm.after(unit, k, start, end) for k in cuts)
                chars = [y - x - (wm.ranks(CONTINUED, y) - wm.ranks(CONTINUED, x)) for x, y in ((start, a), (a, z))]
                forms = b.column("form").to_pylist()
                raw, out = data.tobytes(), []
                for f, s, i, j, e in zip(forms, start.tolist(), a.tolist(), z.tolist(), end.tolist(), strict=True):
                    p, m, t = raw[s:i], raw[i:j], raw[j:e]
                    out.append(raw[s:e] if f == "plain" else b"<S>" + t + b"<P>" + p + b"<M>" + m if f == "spm"
                               else b"<P>" + p + b"<S>" + t + b"<M>" + m)
                cut = np.array([f == "plain" for f in forms], bool)
                yield pa.record_batch({"doc_id": b.column("doc_id"), "text": b.column("text"), "n": pa.array(n, pa.int64()), "form": b.column("form"),
                                       "prefix_chars": pa.array(chars[0], pa.int64(), mask=cut), "middle_chars": pa.array(chars[1], pa.int64(), mask=cut),
                                       "output": pa.array(out, pa.binary()).cast(pa.string())})

    return rows.mapInArrow(run, "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text again: parts between markers in their first order (a text that is cut holds no marker)."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(part[2], part[3], part[1]))


def digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    x = transform(docs, **options)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                    sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
