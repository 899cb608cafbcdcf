"""Near-duplicate groups by a signature-coordinate inverted join (operator 6).

A document is its set of word shingles; two are linked when their Jaccard
similarity reaches ``num / den``.

1. Features, map-side: the set's size and key (two 64-bit sums), and a MinHash
   signature of ``COORDS`` coordinates.  Documents with equal sets are one class.
2. Inverted join: every class is posted under each (coordinate, value) pair.
   Linked classes agree on ``matches`` coordinates and more, but for one link in
   10**10 by the exact binomial tail; ``matches=1`` asks for a single one and
   loses a link with probability (1 - num / den) ** COORDS, below 10**-44.  Classes
   with fewer shared pairs are done (skip).  The others keep their rarest pairs
   only: with a common order by rarity, two classes with ``matches`` collisions
   meet in the first COORDS - matches + 1 pairs of both (prefix).
3. A posting list names one leader, the class with the most shared pairs, so a
   list of g classes gives g pairs, not g * g.  Classes that meet in a list meet
   in their leader's group.  A group is cut into blocks (at most ``members``
   classes and about ``weight`` shingles each).  First every block is one task with
   the leader beside it: members are linked to the leader, and what is not is
   compared within the block.  Members that are still not connected to the leader
   then meet the group's other blocks, those members only.  A task counts
   collisions and confirms, on the full sets, pairs that are still in
   different components; it gives out a spanning forest, never all pairs.
4. Components by alternating large-star and small-star joins over those links.

A group whose members are near their leader costs as many rows as it has members.
Work is quadratic only in the classes of one group that are not connected to its
leader; memory is bounded by two blocks, and for one document by its shingles, at
about 40 bytes a word.

Nulls: documents without words have an empty set and link with nothing; with
fewer words than a shingle the whole sequence is one shingle; a row without id is
linked with nothing and has no component.  Rows with the same id are one document
to the links.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stages, id_text, slices

COORDS = 64
ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


MULTIPLY = _mix(np.arange(1, COORDS + 1, dtype=np.uint64) * ODD[0]) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: flat, and offsets.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    """
    import xxhash
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    d = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
    one = np.array([xxhash.xxh3_64_intdigest(w) for w in d.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    idx = np.asarray(d.indices).astype(np.int64)
    empty = d.dictionary.index("").as_py()
    if empty >= 0:  # white space at an end of a text gives an empty word
        real = idx != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        idx = idx[real]
    h = one[idx]
    n = np.diff(ends)
    run = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            run = run * ODD[1] + _mix(h[k:k + len(run)] + np.uint64(k))
        run = _mix(run)
        sets = []
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if z - a >= words:
                sets.append(np.unique(run[a:z - words + 1]))
            elif z > a:
                v = np.uint64(z - a)
                for x in h[a:z]:
                    v = v * ODD[2] + x
                sets.append(np.array([v], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>"


def features(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig); a document without words has no signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                flat, off = shingle_sets(b.column("text"), words)
                n = np.diff(off)
                full = np.flatnonzero(n)
                at = off[full]
                k = np.zeros((2, len(n)), np.uint64)
                sig = np.zeros((len(n), COORDS), np.uint32)
                if len(full):
                    with np.errstate(over="ignore"):
                        for i in range(2):
                            k[i, full] = np.add.reduceat(_mix(flat * ODD[3 + i]), at)
                        for i in range(COORDS):
                            sig[full, i] = np.minimum.reduceat((flat * MULTIPLY[i] >> np.uint64(32)).astype(np.uint32), at)
                size = np.where(n > 0, COORDS, 0)
                yield pa.record_batch({
                    "doc_id": b.column("doc_id"), "n_shingles": pa.array(n), "k1": pa.array(k[0].view(np.int64)), "k2": pa.array(k[1].view(np.int64)),
                    "sig": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(sig[full].ravel().view(np.int32)))})

    return id_text(docs).mapInArrow(run, FEATURES)


def least_matches(num: int, den: int, lost: float = 1e-10) -> int:
    """The most collisions that linked documents have with probability 1 - lost: the exact binomial tail at the threshold."""
    j, below = num / den, 0.0
    for m in range(COORDS + 1):
        below += math.comb(COORDS, m) * j ** m * (1 - j) ** (COORDS - m)  # fewer than m + 1 collisions
        if below > lost:
            return max(1, m)
    return COORDS


def stars(classes: DataFrame, st: Stages, matches: int) -> DataFrame:
    """(lead, rep): each posting list's classes beside its leader."""
    post = classes.select("rep", F.posexplode("sig").alias("at", "value"))
    post = post.select("rep", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    often = post.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("c")).where("c > 1")
    shared = post.join(often, F.col("key") == F.col("of")).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("pairs"))
    n = F.size("pairs")
    prefix = (COORDS - matches + 1) - (COORDS - n)  # pairs that no other class has are the rarest
    kept = shared.where(n >= matches).select("rep", n.alias("n"), F.explode(F.slice("pairs", 1, prefix)).alias("p"))
    kept = st.write(kept.select("rep", "n", F.col("p.key").alias("key")), "postings")
    lists = (kept.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "rep")).alias("lead"))
             .where("size > 1").select("of", F.col("lead.rep").alias("lead")))
    return kept.join(lists, F.col("key") == F.col("of")).select("lead", "rep").distinct()


class _Block:
    """The classes of one task: signatures and sets, and which component each is in so far."""

    def __init__(self, table: pa.Table):
        self.reps = np.asarray(table.column("rep"))
        self.sig = np.asarray(table.column("sig").combine_chunks().flatten()).reshape(len(self.reps), COORDS)
        lists = table.column("set").combine_chunks()
        self.n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        flat = np.asarray(lists.flatten())
        owner = np.repeat(np.arange(len(self.reps)), self.n)
        # only shingles of several members can be in an intersection: one bit for each
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        common = count > 1
        bit = (np.cumsum(common) - 1)[inverse]
        on = common[inverse]
        self.wide = np.zeros((len(self.reps), -(-int(common.sum()) // 64) or 1), np.uint64)
        np.bitwise_or.at(self.wide, (owner[on], bit[on] // 64), np.uint64(1) << (bit[on] % 64).astype(np.uint64))
        self.group = np.arange(len(self.reps))
        self.out: list[tuple[int, int]] = []

    def visit(self, x: int, matches: int, num: int, den: int, among: np.ndarray | None = None) -> None:
        """Link row x to the rows (of ``among``) that are like it and not yet connected to it."""
        mine = self.group != self.group[x]
        if among is not None:
            mine &= among
        c = np.flatnonzero(mine)
        small, large = np.minimum(self.n[c], self.n[x]), np.maximum(self.n[c], self.n[x])
        c = c[den * small >= num * large]
        c = c[(self.sig[c] == self.sig[x]).sum(axis=1) >= matches]
        if not len(c):
            return
        both = np.bitwise_count(self.wide[c] & self.wide[x]).sum(axis=1, dtype=np.int64)
        for y in c[den * both >= num * (self.n[c] + self.n[x] - both)]:
            if self.group[y] != self.group[x]:
                self.out.append((self.reps[x], self.reps[y]))
                self.group[self.group == self.group[y]] = self.group[x]

    def links(self, lone=()) -> pa.Table:
        a, b = zip(*self.out, strict=True) if self.out else ((), ())
        return pa.table({"a": pa.array([*a, *lone], pa.int64()), "b": pa.array([*b, *[None] * len(lone)], pa.int64())})


def _with_leader(table: pa.Table, matches: int, num: int, den: int) -> pa.Table:
    """Links of a block and its group's leader; members not connected to the leader come with an empty b."""
    t = _Block(table)
    lead = int(np.flatnonzero(t.reps == table.column("lead")[0].as_py())[0])
    t.visit(lead, matches, num, den)
    for x in np.flatnonzero(t.group != t.group[lead]):
        t.visit(x, matches, num, den)
    return t.links(t.reps[t.group != t.group[lead]].tolist())


def _across(table: pa.Table, matches: int, num: int, den: int) -> pa.Table:
    """Links of a part of the members that are not connected to the leader with another block; the latter's others are one component."""
    t = _Block(table)
    lone, joined = np.asarray(table.column("lone").combine_chunks()).astype(bool), np.asarray(table.column("joined").combine_chunks()).astype(bool)
    if joined.any():
        t.group[joined] = t.group[joined][0]
    for x in np.flatnonzero(lone):
        t.visit(x, matches, num, den, ~lone)
    return t.links()


def first_cells(star: DataFrame, sizes: DataFrame, st: Stages, members: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """(lead, rep, i): every member's block, the leader beside each; and (of, blocks) of every leader."""
    pairs = star.where("lead <> rep")
    sized = pairs.join(sizes, F.col("rep") == F.col("id")).drop("id")
    blocks = st.write(sized.groupBy(F.col("lead").alias("of")).agg(F.greatest(
        F.ceil(F.count("*") / members), F.ceil(F.sum("n") / weight)).cast("int").alias("blocks")), "blocks")
    mine = pairs.join(blocks, F.col("lead") == F.col("of")).select("lead", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("i"))
    heads = blocks.select(F.col("of").alias("lead"), F.col("of").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    return mine.union(heads.join(mine.select("lead", "i").distinct(), ["lead", "i"], "left_semi").select("lead", "rep", "i")), blocks


def second_cells(first: DataFrame, lone: DataFrame, blocks: DataFrame, st: Stages, members: int) -> DataFrame:
    """(lead, u, i, rep, lone, joined): parts u of the lone members beside every block i of their group, for groups of several blocks."""
    big = blocks.where("blocks > 1")
    mine = st.write(lone.join(big, F.col("lead") == F.col("of")).select("lead", "rep", "blocks"), "lone")
    parts = st.write(mine.groupBy(F.col("lead").alias("of")).agg(F.ceil(F.count("*") / members).cast("int").alias("parts")), "parts")
    mine = mine.join(parts, F.col("lead") == F.col("of")).select("lead", "rep", "blocks", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("parts")).cast("int").alias("u"))
    a = mine.select("lead", "u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "rep", F.lit(True).alias("lone"), F.lit(False).alias("joined"))
    other = first.where("lead <> rep").join(parts, F.col("lead") == F.col("of")).drop("of")
    other = other.join(mine.select(F.col("lead").alias("l"), F.col("rep").alias("r")), (F.col("lead") == F.col("l")) & (F.col("rep") == F.col("r")), "left")
    b = other.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("u"), "i", "rep", F.lit(False).alias("lone"), F.col("r").isNull().alias("joined"))
    return a.union(b)


def links(docs: DataFrame, star: DataFrame, classes: DataFrame, st: Stages, words: int, matches: int, num: int, den: int,
          members: int = 2000, weight: int = 1_000_000) -> DataFrame:
    """(a, b): confirmed links between classes, a spanning forest per task."""
    need = star.select(F.col("rep").alias("id")).union(star.select(F.col("lead").alias("id"))).distinct()
    need = need.join(classes.select(F.col("rep").alias("id"), "sig", "k1", "k2"), "id")

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                flat, off = shingle_sets(b.column("text"), words)
                yield pa.record_batch({"id": b.column("doc_id"), "sig": b.column("sig"), "n": pa.array(np.diff(off)),
                                       "set": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.view(np.int64)))})

    texts = id_text(docs).join(need, F.col("doc_id") == F.col("id")).select("doc_id", "text", "sig")
    sets = st.write(texts.mapInArrow(run, "id long, sig array<int>, n long, set array<long>"), "sets")

    def with_sets(cells: DataFrame) -> DataFrame:
        return cells.join(sets.select("id", "sig", "set"), F.col("rep") == F.col("id")).drop("id")
    first, blocks = first_cells(star, sets.select("id", "n"), st, members, weight)
    # a lone member's row has the leader in front
    found = with_sets(first).groupBy("lead", "i").applyInArrow(
        lambda t: (lambda o: o.append_column("lead", pa.array([t.column("lead")[0].as_py()] * len(o), pa.int64())))(_with_leader(t, matches, num, den)),
        "a long, b long, lead long")
    found = st.write(found, "links")
    lone = found.where("b IS NULL").select("lead", F.col("a").alias("rep"))
    cells = second_cells(first, lone, blocks, st, members)
    more = with_sets(cells).groupBy("lead", "u", "i").applyInArrow(lambda t: _across(t, matches, num, den), "a long, b long")
    return found.where("b IS NOT NULL").select("a", "b").union(st.write(more, "links"))


def components(edges: DataFrame, st: Stages) -> DataFrame:
    """(id, component): the smallest id reachable, by alternating star joins until nothing changes."""
    e = st.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        # large star: every larger neighbour moves to the smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low")).select("at", F.least("low", "at").alias("low"))
        big = both.where("v > u").join(low, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: every node and its smaller neighbours move to the smallest of them
        low = big.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low"))
        small = big.join(low, F.col("u") == F.col("at")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                                                                                 F.struct("u", F.col("low").alias("v")))).alias("x"))
        before, e = e, st.write(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        st.drop(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


def groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, members: int = 2000, weight: int = 1_000_000,
           matches: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; ``matches`` coordinates in common make a candidate."""
    st = Stages(docs.sparkSession, "near")
    f = st.write(features(docs, words), "features")
    matches = matches or least_matches(num, den)
    named = f.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = st.write(classes, "classes")
    star = st.write(stars(classes, st, matches), "stars")
    found = components(links(docs, star, classes, st, words, matches, num, den, members, weight), st)
    # every class and its component, for classes with several documents or with links
    c = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n_shingles").alias("cn"), "rep", "copies")
    c = c.join(found, F.col("rep") == F.col("id"), "left").where("copies > 1 OR component IS NOT NULL")
    c = st.write(c.select("c1", "c2", "cn", F.coalesce("component", "rep").alias("component_id")), "components")
    out = f.join(c, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")) & (F.col("n_shingles") > 0)
                 & F.col("doc_id").isNotNull(), "left")
    label = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with the smallest id of their groups, all columns as they were."""
    gone = groups(docs, words, num, den).where("NOT kept").select(F.col("doc_id").alias("_dropped_id")).distinct()
    gone = Stages(docs.sparkSession, "near").write(gone, "dropped")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_dropped_id"], "left_anti")
