"""Suffix-array deduplication (1), near duplicates (6), fingerprints (7), decontamination (2)."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from benchlens.llm import decontaminate, fingerprint, near_dups, suffix_dedup

from . import brute
from .conftest import CLASH, ODD, rows

PAIRS = [(r[0], r[1]) for r in ODD]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "été", "日本"]) + str(rng.randrange(9)) for _ in range(n))


def test_suffix_odd_rows(spark, odd_docs, clash_docs):
    want = sorted(brute.suffix_digest(PAIRS), key=repr)
    assert rows(suffix_dedup.digest(odd_docs)) == want
    assert rows(suffix_dedup.digest(clash_docs)) == want


def test_suffix_random_passages(spark):
    rng = random.Random(3)
    shared = [words(rng, 30) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [words(rng, rng.randrange(40))]
        for p in rng.sample(shared, rng.randrange(3)):
            a = rng.randrange(len(p) // 2)
            parts += [p[a:a + rng.randrange(30, len(p))], words(rng, rng.randrange(6))]
        docs.append((rng.choice([i, i, None]), "".join(parts)))
    docs += [(70, "z" * 120), (71, "z" * 49), (72, "z" * 50), (73, "z" * 51 + "y" + "z" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(suffix_dedup.digest(df)) == sorted(brute.suffix_digest(docs), key=repr)


def test_suffix_streams_across_batches(spark):
    """Groups longer than an Arrow batch: the state between batches decides."""
    docs = [(i, "p" * 10 + "The very common passage that each and every document of this table holds. " + str(i) * 3) for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(brute.suffix_digest(docs), key=repr)


P = "This passage stands in two documents, word for word, and it has more than fifty bytes. "
Q = "Nobody else has written down this other sentence, which has more than fifty bytes as well. "


def test_rows_with_one_id_are_told_apart(spark, monkeypatch):
    docs = [(1, P), (7, P + "a186505"), (7, Q + "b84"), (7, Q + "b84"), (None, P + "x"), (None, Q), (None, Q + P), (9, Q)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_dedup.digest(df)) == sorted(brute.suffix_digest(docs), key=repr)
    out = suffix_dedup.remove_repeats(df)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(brute.without_repeats(docs), key=repr)


def test_many_rows_without_id(spark):
    """None of them is smaller than another, and rows with ids are smaller than all."""
    rng = random.Random(11)
    shared = [words(rng, 14) for _ in range(30)]
    docs = [(None if i % 10 else i, words(rng, 3) + rng.choice(shared) + words(rng, 3)) for i in range(5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows(suffix_dedup.digest(df)) == sorted(brute.suffix_digest(docs), key=repr)


def test_an_id_whose_rows_share_a_context(spark):
    """Both rows of id 7 are first in the context; a window of it stands in document 1 in other surroundings."""
    core = "0123456789 abcdefghij ABCDEFGHIJ klmnopqrst KLMNOPQRST"
    docs = [(1, "left of it " * 5 + core + " right of it" * 5), (7, "other " * 9 + core + " end" * 20 + "one"), (7, "other " * 9 + core + " end" * 20 + "two"),
            (8, "other " * 9 + core + " end" * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_dedup.digest(df)) == sorted(brute.suffix_digest(docs), key=repr)


def hot_corpus(rng, n=700):
    line = "Licensed under the terms that are given in the file which comes with this work; all rights reserved. "
    short = "A line that is common but short, in sixty bytes or nearly so."
    docs = []
    for i in range(n):
        t = words(rng, rng.randrange(1, 12))
        if i % 3 == 0:
            t += line * rng.randrange(1, 3)
        if i % 4 == 0:
            t = t + words(rng, 2) + short + words(rng, 5)
        docs.append((rng.choice([i, i, i, None, 5]), t))
    return docs


@pytest.mark.parametrize("sampled", [1, 3])
def test_hot_strings(spark, monkeypatch, sampled):
    """With every or every third document in the sample the frequent ranks, contexts and windows take their own ways."""
    monkeypatch.setattr(suffix_dedup, "SAMPLED", sampled)
    docs = hot_corpus(random.Random(5 + sampled))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    st = suffix_dedup.Stages(spark, "test")
    ranks, contexts = suffix_dedup.frequent(suffix_dedup.prepare(df, st, ["doc_id"]), st)
    assert len(ranks.keys) and len(contexts.keys)
    assert rows(suffix_dedup.digest(df)) == sorted(brute.suffix_digest(docs), key=repr)


def test_no_task_sorts_a_hot_context(spark, monkeypatch):
    """Of a frequent context the shuffle gets a row for each input partition, not for each document."""
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    df = spark.createDataFrame([(i, str(i) * 30 + P * 2 + str(-i) * 30) for i in range(600)], "doc_id long, text string").repartition(4)
    st = suffix_dedup.Stages(spark, "test")
    p = suffix_dedup.prepare(df, st, ["doc_id"])
    per_context = suffix_dedup.rank_anchors(p, *suffix_dedup.frequent(p, st)).groupBy("h", "c").count()
    assert per_context.agg(F.max("count")).first()[0] <= 4
    assert suffix_dedup.rank_anchors(p).groupBy("h", "c").count().agg(F.max("count")).first()[0] == 600


@pytest.mark.parametrize("piece", [200, 777])
def test_long_texts_go_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(piece)
    shared = words(rng, 60)
    docs = [(i, words(rng, rng.randrange(200)) + shared[rng.randrange(100):] + "x" * rng.randrange(500) + words(rng, 30)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(suffix_dedup.digest(df)) == sorted(brute.suffix_digest(docs), key=repr)


def test_twenty_megabytes_of_one_character(spark):
    n = 20_000_000
    docs = [(1, "x" * 60), (2, "x" * n), (3, "y" + "x" * n + "z" * 49)]
    got = {r.doc_id: r for r in suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed, got[3].n_spans) == (0, n, n, 1)
    assert got[3].kept_sha256 == hashlib.sha256(b"y" + b"z" * 49).hexdigest()


def test_a_piece_takes_bounded_memory():
    """The peak of numpy memory for a text of one character and for prose, as the module states it."""
    import tracemalloc

    import numpy as np
    for data, bound in ((np.full(suffix_dedup.PIECE, 120, np.uint8), 300), (np.frombuffer((P * 6000).encode(), np.uint8)[:suffix_dedup.PIECE], 100),
                        (np.random.default_rng(1).integers(97, 122, suffix_dedup.PIECE).astype(np.uint8), 100)):
        tracemalloc.start()
        r = suffix_dedup.Ranked(data, np.array([0, len(data)]))
        r.contexts()
        r.spans(r.windows(r.at))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak <= bound * len(data)


def test_suffix_remove(spark, odd_docs, clash_docs, empty_docs):
    out = suffix_dedup.remove_repeats(odd_docs)
    assert out.schema == odd_docs.schema
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(brute.without_repeats(PAIRS), key=repr)
    assert suffix_dedup.remove_repeats(clash_docs).columns == clash_docs.columns
    assert suffix_dedup.remove_repeats(empty_docs).count() == 0
    assert suffix_dedup.digest(empty_docs).count() == 0


def near(df, **kw):
    return {r.doc_id: r.component_id for r in near_dups.groups(df, **kw).collect() if r.doc_id is not None}


def test_near_odd_rows(spark, odd_docs, clash_docs, empty_docs):
    want = brute.near_groups(PAIRS, 3, 85, 100)
    assert near(odd_docs, words=3, num=85) == want
    assert near(clash_docs, words=3, num=85) == want
    got = near_dups.groups(odd_docs, words=3, num=85).collect()
    assert len(got) == len(ODD)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert sorted(r.n_shingles for r in got) == sorted(len(brute.shingle_set(t, 3)) for _, t in PAIRS)
    assert near_dups.groups(empty_docs).count() == 0


@pytest.mark.parametrize("blocks", [{}, {"members": 4, "weight": 10 ** 6}, {"members": 2000, "weight": 300}])
def test_near_copies_of_copies(spark, blocks):
    """Groups around a base, chains that drift from it, and strangers with a shared passage; any block size."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    docs, passage = [], rng.choices(vocabulary, k=60)
    for g in range(6):
        base = rng.choices(vocabulary, k=rng.randrange(40, 160))
        for k in range(14):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(t)))
            if g % 2 and k % 3 == 0:
                base = t
    docs += [(len(docs) + i, " ".join(passage + rng.choices(vocabulary, k=40))) for i in range(12)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert near(df, words=3, num=85, **blocks) == brute.near_groups(docs, 3, 85, 100)


def test_least_matches_is_the_exact_binomial_tail():
    from fractions import Fraction
    from math import comb
    for num, den in ((80, 100), (85, 100), (1, 2), (99, 100)):
        m, j = near_dups.least_matches(num, den), Fraction(num, den)
        tail = lambda k: sum(comb(64, i) * j ** i * (1 - j) ** (64 - i) for i in range(k))  # noqa: B023, E731
        assert tail(m) <= Fraction(1, 10 ** 10) < tail(m + 1)
    assert near_dups.least_matches(80, 100) == 28 and near_dups.least_matches(85, 100) == 33


def test_any_collision_makes_a_candidate(spark, odd_docs):
    want = brute.near_groups(PAIRS, 3, 85, 100)
    assert near(odd_docs, words=3, num=85, matches=1) == want


def test_a_large_group_of_near_copies_costs_a_row_a_member(spark, monkeypatch):
    """Members linked to the leader stand in one cell each, and none meets another block."""
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(20_000):
        t = list(base)
        t[0] = f"x{i}"
        docs.append((i, " ".join(t)))
    seen = {}
    for name in ("first_cells", "second_cells"):
        def spy(*a, _real=getattr(near_dups, name), _name=name, **k):
            got = _real(*a, **k)
            seen[_name] = (got[0] if isinstance(got, tuple) else got).count()
            return got
        monkeypatch.setattr(near_dups, name, spy)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = near_dups.groups(df, words=3, num=85).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]
    assert seen["first_cells"] < 3 * len(docs) and seen["second_cells"] == 0


def test_members_away_from_the_leader_meet_the_other_blocks(spark):
    """Chains of edits: the ends are not like the leader, and blocks of five members part them."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(50)]
    docs, t = [], rng.choices(vocabulary, k=90)
    for _ in range(70):
        docs.append((len(docs), " ".join(t)))
        t = list(t)
        t[rng.randrange(len(t))] = rng.choice(vocabulary)
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert near(df, words=3, num=85, members=5) == brute.near_groups(docs, 3, 85, 100)


def test_keep_one(spark, odd_docs, clash_docs):
    out = near_dups.keep_one(clash_docs)
    assert out.columns == clash_docs.columns
    groups = brute.near_groups(PAIRS, 5, 80, 100)
    assert sorted(rows(near_dups.keep_one(odd_docs).select("doc_id")), key=repr) == sorted(
        [(i,) for i, _ in PAIRS if i is None or groups[i] == i], key=repr)


def edited(docs):
    d = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    for k, (i, t) in enumerate(d):
        t, nxt = t or "", d[(k + 1) % len(d)][1] or ""
        n = len(t) // 3
        yield i, len(t), hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest()


def test_fingerprint_rows(spark, odd_docs, clash_docs, empty_docs):
    for df in (odd_docs, clash_docs):
        got = fingerprint.fingerprints(df).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(edited(PAIRS), key=repr)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    for r, (_, t) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.n_chars)), sorted(PAIRS, key=lambda p: (repr(p[0]), len(p[1] or ""))), strict=True):
        by_text.setdefault(t or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.fingerprints(empty_docs).count() == 0
    one = fingerprint.fingerprints(odd_docs.where("doc_id = 1")).first()
    assert one.near_next == pytest.approx(1.0)


def test_fingerprint_is_a_multiset_hash(spark):
    a, b, c = "First line. Second one.\n", "Another paragraph!\n", "A third of them?\n"
    df = spark.createDataFrame([(a + b + c, c + a + b, a + b, c, a + a)], "x string, y string, ab string, c string, aa string")
    for n in df.columns:
        df = df.withColumn(n + "_p", fingerprint.elements(F.col(n))).withColumn(n + "_f", fingerprint.lanes(F.col(n + "_p")))
    r = df.select("*", fingerprint.combine(F.col("ab_f"), F.col("c_f")).alias("plus"), fingerprint.combine(F.col("x_f"), F.col("c_f"), -1).alias("minus")).first()
    assert r.x_f == r.y_f == r.plus
    assert r.minus == r.ab_f != r.aa_f


def test_fingerprint_likeness(spark):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(2000)]
    docs = [(i, "\n".join(". ".join(" ".join(rng.choices(vocabulary, k=8)) for _ in range(3)) for _ in range(10))) for i in range(60)]
    got = fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(0.4 < r.near_edited < 0.9 and r.near_next < 0.3 for r in got)


def plain_fingerprint(text):
    """Sums of one-bit lanes, three to a number, in plain Python."""
    import re

    import xxhash
    parts = ["P" + x for x in re.split("[\r\n]+", text) if x] + ["S" + x for x in re.split("[\r\n.!?,;:|$%&#*]+ *", text) if x]
    sums = [0] * (fingerprint.SEEDS * fingerprint.SHIFTS)
    for x in parts:
        for seed in range(fingerprint.SEEDS):
            # an engine hash of two columns: the first one's hash is the second one's seed
            h = xxhash.xxh64(x.encode(), seed=xxhash.xxh64(seed.to_bytes(4, "little"), seed=42).intdigest()).intdigest()
            for s in range(fingerprint.SHIFTS):
                sums[seed * fingerprint.SHIFTS + s] += h >> s & fingerprint.ONES
    packed = [len(parts) & fingerprint.WRAP, *[x & fingerprint.WRAP for x in sums]]
    lanes = [2 * (x >> k * fingerprint.BITS & fingerprint.LANE) - len(parts) for x in packed[1:] for k in range(3)]
    return "".join(f"{x:015x}" for x in packed), lanes


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(12)
    docs = [(i, "\n".join(". ".join(words(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    docs += [(50, ""), (51, "no end"), (52, "a, b; c!\r\n\r\na, b"), (53, None)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    d = sorted(((i, t or "") for i, t in docs), reverse=True)

    def cosine(a, b):
        x, y = sum(v * v for v in a) ** 0.5, sum(v * v for v in b) ** 0.5
        if not x or not y:
            return 1.0 if x == y else 0.0
        return min(1.0, max(0.0, sum(p * q for p, q in zip(a, b, strict=True)) / (x * y)))
    for k, (i, t) in enumerate(d):
        nxt = d[(k + 1) % len(d)][1]
        n = len(t) // 3
        (fp, a), (efp, b), (_, c) = (plain_fingerprint(x) for x in (t, t[:len(t) - n] + nxt[:n], nxt))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (fp, efp)
        assert got[i].near_edited == pytest.approx(cosine(a, b), abs=1e-9) and got[i].near_next == pytest.approx(cosine(a, c), abs=1e-9)


def test_contaminated(spark, odd_docs, clash_docs, empty_docs):
    rng = random.Random(2)
    items = [(k, words(rng, rng.randrange(6, 60))) for k in range(20)] + [(90, None), (91, ""), (92, "a"), (93, PAIRS[0][1]), (93, "more of the same item here")]
    docs = [*PAIRS]
    for k in range(20):
        t = items[k][1].split()
        cut = t[:max(5, int(len(t) * rng.choice([0.5, 0.9, 1.0])))]
        docs.append((100 + k, words(rng, 30) + " " + " ".join(cut).upper() + ", " + words(rng, 300)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    assert len(want) > 10
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i).collect()} == want
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert decontaminate.contaminated(empty_docs, i).count() == 0
    assert decontaminate.contaminated(d, i.limit(0)).count() == 0
    out = decontaminate.remove_contaminated(clash_docs, i.select("*", *[F.lit(1).alias(c) for c in CLASH if c != "text"]))
    assert out.columns == clash_docs.columns
    bad = {a for a, _ in brute.leaks(PAIRS, items)}
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((a for a, _ in PAIRS if a not in bad), key=repr)


def test_short_items_inside_long_documents(spark):
    items = [(1, "alpha beta gamma delta"), (2, "omega"), (3, "two words"), (4, "three short words"), (5, "Alpha, BETA"), (6, "one item"), (6, "of two texts, one of them longer")]
    filler = " ".join(f"w{i}" for i in range(400))
    docs = [(10, f"{filler} alpha beta gamma delta {filler}"), (11, "alpha beta gamma delta"), (12, f"{filler} omega"), (13, "two"), (14, f"two {filler} words"),
            (15, f"{filler} two words three short words"), (16, f"one item {filler} of two texts, one of them longer"), (17, "one item"), (18, None), (19, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    assert {(10, 1), (11, 1), (10, 5), (12, 2), (15, 3), (15, 4), (16, 6)} <= want and not {a for a, _ in want} & {13, 14, 17}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i).collect()} == want


def test_every_containing_document_is_a_candidate(spark):
    """Recall 1 of the sketches at the threshold, and few candidates beside the true pairs."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 70)))) for k in range(60)]
    docs = []
    for n in range(400):
        w = items[n % 60][1].split()
        a = rng.randrange(max(1, int(len(w) * 0.3)))
        docs.append((n, " ".join([*rng.choices(vocabulary, k=rng.randrange(200)), *w[a:], *rng.choices(vocabulary, k=rng.randrange(200))])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    sets = decontaminate.item_sets(i)
    assert sets.where("in_sketch").count() < 0.5 * sets.count()
    pairs = {tuple(r) for r in decontaminate.candidates(d, sets.where("in_sketch").select("h", "item_id"), [5]).collect()}
    assert want <= pairs and 100 < len(want) < len(pairs) <= 400
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i).collect()} == want


def test_decontamination_plan_probes_the_sketches(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = decontaminate.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
