"""Benchmark decontamination by size-partitioned MinHash containment search (operator 2).

Texts are words (letters and digits, lower case), sets of five-word shingles.  An item
of fewer words is one shingle, all of its words, and documents then have shingles
of that many words for it too, so that a short item is found inside a long
document.  A document is contaminated by an item when it holds at least 4/5 of the
item's shingles.

1. Items are partitioned by size, a power of two a partition.  Of an item of at
   most u shingles, u - ceil(0.8 u) + 1 make up its MinHash sketch: those smallest
   by hash.  A document that contains 4/5 of the item misses at most u - ceil(0.8 u)
   of its shingles, so it holds at least one of the sketch: probing the sketches
   alone, with (hash, item) rows, finds every containing document, however long it
   is, and no length or rank of the document is used.
2. Candidates, (document, item) pairs that share a sketched hash, are verified: only
   their documents are read again, and their shingles meet the whole sets of their
   own candidate items, as strings.

Sketches and candidates are written tables, so Spark knows their bytes: the join is
broadcast below the session's threshold and dealt by hash beyond it.  A shingle of many
items brings a document one row for each item that has it in its sketch, and no
more.

Nulls: null texts are empty and match nothing; repeated shingles count once;
rows with the same doc_id (or none) are one document, items with the same item_id one
item, made of all their shingles; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stages

WORDS = 5
NUM, DEN = 4, 5  # containment of at least NUM / DEN


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """The rows with the words ``w`` of their text instead of it."""
    w = F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return rows.withColumn("w", w).drop(text)


def runs(words: int):
    """Every run of so many words, as text (fewer words have none)."""
    of_place = F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.concat_ws(" ", *[F.get(F.col("w"), i + k) for k in range(words)]))
    return F.when(F.size("w") >= words, of_place).otherwise(F.array().cast("array<string>"))


def explode_shingles(rows: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """One row for each run of ``lengths`` words, the other columns kept, the text left behind."""
    every = runs(lengths[0]) if len(lengths) == 1 else F.concat(*[runs(n) for n in lengths])
    return with_words(rows, text).withColumn("shingle", F.explode(every)).drop("w")


def item_sets(items: DataFrame) -> DataFrame:
    """(h, shingle, words, item_id, n_shingles, in_sketch) of every item's distinct shingles."""
    x = with_words(items.select("item_id", F.col("text").alias("text")), "text")
    whole = F.when(F.size("w") > 0, F.array(F.array_join("w", " "))).otherwise(F.array().cast("array<string>"))
    s = x.select("item_id", F.least(F.size("w"), F.lit(WORDS)).alias("words"), F.explode(F.when(F.size("w") >= WORDS, runs(WORDS)).otherwise(whole)).alias("shingle"))
    # one row per item; an item's shingles are its own length at most
    sets = s.groupBy("item_id").agg(F.sort_array(F.collect_set(F.struct(F.xxhash64("shingle").alias("h"), "shingle", "words"))).alias("set"))
    n = F.size("set")
    bound = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")  # the size partition's largest size
    sketch = bound - F.ceil(bound * NUM / DEN) + 1
    return (sets.select("item_id", n.alias("n_shingles"), sketch.alias("sketch"), F.posexplode("set").alias("at", "s"))
            .select("s.h", "s.shingle", "s.words", "item_id", "n_shingles", (F.col("at") < F.col("sketch")).alias("in_sketch")))


def candidates(docs: DataFrame, sketches: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, item) pairs that share a hash of the item's sketch."""
    probe = explode_shingles(docs, "text", lengths).select("doc_id", F.xxhash64("shingle").alias("h"))
    return probe.join(sketches, "h").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_matched, containment) of every pair at or above the threshold."""
    st = Stages(docs.sparkSession, "bench")
    sets = st.write(item_sets(items), "sets")
    sketches = st.write(sets.where("in_sketch").select("h", "item_id").distinct(), "sketches")
    lengths = sorted(r["words"] for r in sets.select("words").distinct().collect()) or [WORDS]  # of 1 to WORDS
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    pairs = st.write(candidates(d, sketches, lengths), "candidates")
    # whole sets of the candidate pairs only: documents without any are not taken apart again
    named = pairs.select(F.col("doc_id").alias("of"), F.col("item_id").alias("item"))
    again = d.join(named.select("of").distinct(), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    have = explode_shingles(again, "text", lengths).distinct()
    want = named.join(sets.select("item_id", "shingle", "n_shingles"), F.col("item").eqNullSafe(F.col("item_id"))).drop("item").withColumnRenamed("shingle", "wanted")
    hits = have.join(want, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("shingle") == F.col("wanted")))
    found = hits.groupBy("doc_id", "item_id", "n_shingles").agg(F.count("*").alias("n_matched")).where(DEN * F.col("n_matched") >= NUM * F.col("n_shingles"))
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_matched",
                        (F.col("n_matched") / F.col("n_shingles")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item; columns as they were."""
    bad = contaminated(docs, items).select(F.col("doc_id").alias("_contaminated_id")).distinct()
    bad = Stages(docs.sparkSession, "leaks").write(bad, "ids")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_contaminated_id"]), "left_anti")
