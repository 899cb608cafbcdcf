"""Sampled SentencePiece encoding and lossless decoding (operator 3).

The text's lattice holds every vocabulary piece at every position (bytes stand
for characters that have no piece).  A segmentation is drawn from all paths with
probability proportional to the product of its pieces' weights: forward
filtering sums the weights of the paths to each position, backward sampling then
walks from the end, choosing each piece in proportion to the paths through it.
Every choice takes its random number from a hash of (seed, row key, place in the
row), so a row's segmentation depends on nothing but its text, its key and the
seed: not on partitions, batches or retries.

The model file is a merge list, so a piece's weight is Zipf's law on its merge
rank, 1 / (rank + 2), to the power ``alpha``.  Pieces hold a space only at their
start (or are all spaces): the lattice falls apart into units, a run of spaces and
the characters up to the next space, and the forward pass runs once per distinct
unit of a batch.  Units are never cut, however long they are.

Decoding puts the pieces' bytes together and takes off the space that encoding
put before the text; the ids always give the text back, byte for byte, whatever
characters it holds (a literal U+2581 is encoded as bytes, never as a space).

Nulls: a null text is empty and has no pieces; a null key counts as 0; rows with
the same key and text get the same segmentation; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import flat_bytes, gather, id_text, slices

CHAR_BITS, SLOT_BITS = 21, 19
SCALE = 50.0
ALONE = (1 << 16) - 1  # no vocabulary that this reads has so many pieces
FAR = 300  # binary digits that forward sums may be away from 1
units_of = re.compile(r" *[^ ]+| +$").findall


@functools.cache
def _model(path: str, alpha: float):
    import sentencepiece as spm
    sp = spm.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    text = [sp.id_to_piece(i).replace("▁", " ") for i in range(n)]
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    byte_ids = np.zeros(256, np.int64)
    out = [b""] * n
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(text[i][3:5], 16)] = i
            out[i] = bytes([int(text[i][3:5], 16)])
        elif plain[i]:
            out[i] = text[i].encode()
    # the trie of all pieces: (node, character) -> node, exact and sorted for binary search
    child: dict[tuple[int, int], int] = {}
    piece = [-1]
    for i in range(n):
        if plain[i]:
            at = 0
            for c in text[i]:
                to = child.setdefault((at, ord(c)), len(piece))
                if to == len(piece):
                    piece.append(-1)
                at = to
            piece[at] = i
    keys = np.array([a << CHAR_BITS | c for a, c in child], np.int64)
    slots, probes = np.full((1 << SLOT_BITS) + len(keys), -1, np.int64), 0
    for k, (key, slot) in enumerate(zip(keys.tolist(), slot_of(keys).tolist(), strict=True)):
        at = slot
        while slots[at] >= 0:
            at += 1
        slots[at], probes = k, max(probes, at - slot + 1)
    slot_key = np.where(slots >= 0, keys[np.maximum(slots, 0)], -1)
    slot_to = np.array(list(child.values()), np.int64)[np.maximum(slots, 0)]
    weight = (2.0 - np.minimum(np.array([sp.get_score(i) for i in range(n)]), 0.0)) ** -alpha
    least = (2.0 + n) ** -alpha  # of a character that has no piece
    if n >= ALONE:
        raise ValueError("the vocabulary has too many pieces")
    longest = max(len(t) for t, ok in zip(text, plain, strict=True) if ok)
    weight = np.concatenate([np.where(np.arange(n) > 0, weight, 0.0), np.zeros(ALONE + 1 - n)])
    weight[ALONE] = least
    scaled = [(weight * SCALE ** size).astype(np.float32) for size in range(1, longest + 1)]
    size = np.array([len(b) for b in out], np.int64)
    return {"slot_key": slot_key, "slot_to": slot_to, "probes": probes, "piece": np.array(piece),
            "longest": longest, "scaled": scaled, "byte_ids": byte_ids, "size": size,
            "flat": np.frombuffer(b"".join(out), np.uint8), "start": np.cumsum(size) - size, "n": n}


def slot_of(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def step_down(m: dict, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the trie has these (node, character) keys, and the nodes they lead to."""
    slot = slot_of(key)
    found = m["slot_key"][slot] == key
    for _ in range(1, m["probes"]):
        miss = np.flatnonzero(~found & (m["slot_key"][slot] >= 0))
        if not len(miss):
            break
        slot[miss] += 1
        found[miss] = m["slot_key"][slot[miss]] == key[miss]
    return found, m["slot_to"][slot[found]]


class Lattice:
    """Lattices of distinct units, long ones first, and at each position the odds of the piece that ends there.

    Positions are laid out one after the other over all units: character t of
    unit u is ``chars[t] + u``, the node before it ``nodes[t] + u``, so a step of
    the forward pass reads and writes whole slices.  Weights carry a factor
    ``SCALE`` per character, which leaves all odds as they are.  A unit whose sum
    gets ``FAR`` from 1 has the sums that later pieces start from multiplied by a
    power of two: odds stay as they are to the last bit, whatever else is in the
    batch, and sums stay within a double for units of any length.  Every eighth
    character is looked at.
    """

    def __init__(self, units: list[str], m: dict):
        self.length = length = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        first = np.cumsum(length) - length
        count = [int(np.searchsorted(-length, -t, side="right")) for t in range(int(length[0]) + 1)]
        self.nodes = np.concatenate([[0], np.cumsum(count)])
        self.chars = chars = np.concatenate([[0], np.cumsum(count[1:])])
        code = np.concatenate([flat[first[:k] + t] for t, k in enumerate(count[1:])])
        # the pieces that start at each character, by their number of characters; 0 is none
        unit = np.concatenate([np.arange(k) for k in count[1:]])
        place = np.repeat(np.arange(len(count) - 1), count[1:])
        self.piece = []
        at, node, left, size = np.arange(len(code)), np.zeros(len(code), np.int64), length[unit] - place, 1
        while len(at) and size <= m["longest"]:
            found, node = step_down(m, node << CHAR_BITS | code[chars[place + size - 1] + unit])
            at, left, unit, place = at[found], left[found], unit[found], place[found]
            p = m["piece"][node]
            self.piece.append(np.zeros(len(code), np.uint16))
            self.piece[-1][at] = np.maximum(p, 0)
            go = left > size
            at, node, left, unit, place, size = at[go], node[go], left[go], unit[go], place[go], size + 1
        self.piece[0][self.piece[0] == 0] = ALONE
        self.code = code
        # forward filtering: all units of at least t characters at once
        paths = np.ones(self.nodes[-1])
        self.odds = np.ones((len(paths), len(self.piece)), np.float32)
        for t, k in enumerate(count[1:], 1):
            run, total = np.empty((k, len(self.piece))), 0.0
            for n in range(1, len(self.piece) + 1):
                if n <= t:
                    c, prev = chars[t - n], self.nodes[t - n]
                    total = total + paths[prev:prev + k] * m["scaled"][n - 1][self.piece[n - 1][c:c + k]]
                run[:, n - 1] = total
            here = self.nodes[t]
            paths[here:here + k] = total
            np.divide(run, run[:, -1:], out=self.odds[here:here + k], casting="same_kind")
            if t % 8 == 0:
                away = np.frexp(total)[1]
                far = np.flatnonzero(np.abs(away) > FAR)
                for back in range(max(t - len(self.piece) + 1, 0), t + 1) if len(far) else ():
                    at = self.nodes[back] + far
                    paths[at] = np.ldexp(paths[at], -away[far])

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path for each occurrence (its unit and random key): occurrence, step from the end, piece.

        A character that has no piece comes out as ``ALONE`` and its code point.
        """
        pieces = np.concatenate(self.piece)
        live = np.argsort(unit, kind="stable")
        of = unit[live]
        key, left = key[live], self.length[of]
        occ, step, ids, k = [], [], [], 0
        wide = np.min_scalar_type(int(self.length[0]))
        while len(live):
            u = (mix(key + np.uint64(k)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
            n = (self.odds[self.nodes[left] + of] <= u[:, None]).sum(axis=1) + 1
            left = left - n
            char = self.chars[left] + of
            p = pieces[(n - 1) * len(self.code) + char].astype(np.int32)
            lone = p == ALONE
            p[lone] += self.code[char[lone]].astype(np.int32)
            occ.append(live.astype(np.int32))
            step.append(np.full(len(live), k, wide))
            ids.append(p)
            go = left > 0
            live, key, of, left, k = live[go], key[go], of[go], left[go], k + 1
        return np.concatenate(occ), np.concatenate(step), np.concatenate(ids)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def encode_batch(texts: list[str], keys: np.ndarray, path: str, seed: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of the texts: flat, and offsets."""
    m = _model(path, alpha)
    cut = [units_of(" " + t) if t else [] for t in texts]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    d = pa.array([u for c in cut for u in c], pa.string()).dictionary_encode()
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    units = d.dictionary.to_pylist()
    order = np.argsort(-np.fromiter(map(len, units), np.int64, len(units)), kind="stable")
    lattice = Lattice([units[i] for i in order.tolist()], m)
    unit = np.argsort(order)[np.asarray(d.indices)]
    first = np.cumsum(n) - n
    # a unit's place is that of its first character: no two steps of a row have the same random key
    before = np.concatenate([[0], np.cumsum(lattice.length[unit])])
    place = (before[:-1] - np.repeat(before[first], n)).astype(np.uint64)
    with np.errstate(over="ignore"):
        row = mix(mix(keys.astype(np.uint64)) + np.uint64(seed))
        key = np.repeat(row, n) + place
    occ, step, ids = lattice.sample(unit, key)
    # pieces come from the end of each unit: put them in order of occurrence, last step first
    pieces = np.bincount(occ, minlength=len(unit))
    ends = np.cumsum(pieces)
    out = np.empty(len(ids), np.int64)
    out[ends[occ] - 1 - step] = ids
    off = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
    lone = np.flatnonzero(out >= ALONE)
    if len(lone):  # characters to bytes
        byts = [chr(c).encode() for c in (out[lone] - ALONE).tolist()]
        size = np.ones(len(out), np.int64)
        size[lone] = [len(b) for b in byts]
        at = np.cumsum(size) - size
        wide = np.zeros(int(size.sum()), np.int64)
        wide[at] = out
        where = np.repeat(at[lone], size[lone]) + np.concatenate([np.arange(len(b)) for b in byts])
        wide[where] = m["byte_ids"][np.frombuffer(b"".join(byts), np.uint8)]
        off = np.concatenate([at, [len(wide)]])[off]
        out = wide
    return out, off


def decode_batch(ids: np.ndarray, off: np.ndarray, path: str, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, and offsets: the pieces' bytes without each text's first space."""
    m = _model(path, alpha)
    flat, at = gather(m["flat"], m["start"], m["size"], ids)
    ends = at[off]
    has = np.diff(ends) > 0
    keep = np.ones(len(flat), bool)
    keep[ends[:-1][has]] = False
    return flat[keep], ends - np.concatenate([[0], np.cumsum(has)])


ENCODED = "doc_id long, ids array<int>, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean"


def encode(docs: DataFrame, model: str, seed: int = 0, alpha: float = 1.0, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids, n_bytes, n_pieces, ids_crc32, lossless): each row's sampled ids, and whether they decode to its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, max_bytes=1 << 20):
                keys = np.asarray(b.column("doc_id").fill_null(0))
                ids, off = encode_batch(b.column("text").to_pylist(), keys, model, seed, alpha)
                back, back_off = decode_batch(ids, off, model, alpha)
                data, data_off = flat_bytes(b.column("text"))
                if np.array_equal(back, data) and np.array_equal(back_off, data_off):
                    same = np.ones(b.num_rows, bool)
                else:
                    same = np.array([np.array_equal(back[x:y], data[p:q]) for x, y, p, q in
                                     zip(back_off, back_off[1:], data_off, data_off[1:], strict=False)], bool)
                four = ids.astype("<i4")
                yield pa.record_batch({
                    "doc_id": b.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(four)),
                    "n_bytes": pa.array(np.diff(data_off)), "n_pieces": pa.array(np.diff(off)),
                    "ids_crc32": pa.array([zlib.crc32(four[a:z].tobytes()) for a, z in zip(off, off[1:], strict=False)], pa.int64()),
                    "lossless": pa.array(same)})

    return id_text(docs, id_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encoded rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            off = np.asarray(ids.offsets).astype(np.int64)
            data, at = decode_batch(np.asarray(ids.flatten()).astype(np.int64), off - off[0], model)
            raw = data.tobytes()
            yield pa.record_batch({"doc_id": b.column("doc_id"),
                                   "text": pa.array([raw[x:y].decode() for x, y in zip(at, at[1:], strict=False)], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
