"""Document fingerprints: a homomorphic multiset hash of paragraphs (operator 7).

A text is a multiset of elements: its paragraphs (lines) and the clauses in
them (cut at punctuation).  Each element hashes to a wide vector of 180 zero/one lanes (three 64-bit
hashes); the fingerprint is the sum of the vectors, lane by lane, modulo 2**20,
with the number of elements.  Sums do not depend on order, so equal multisets
have equal fingerprints, and adding or subtracting fingerprints inserts or
deletes paragraphs without rereading the text.  Three lanes of 20 bits travel in
one long (the packed sum is itself taken modulo 2**60, so the map stays a group
homomorphism at any length).

With a lane's expected half per element taken off, lanes are sums of +-1, and
the cosine of two fingerprints estimates that of the element counts: texts that
share two thirds of their clauses come out near 2/3, strangers near 0 (standard
error about 0.07).  Beyond 2**20 elements in one text equality still holds and
the likeness loses meaning.

Everything is column expressions; there is no Python on the data path.

Nulls: a null text is empty; a null doc_id sorts last (descending).  Repeated
doc_ids are ordered by text, descending.  Of a single document the next one is
itself.  Two empty texts have likeness 1, an empty and another one 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_text

SEEDS, SHIFTS, BITS = 3, 20, 20
LANE = (1 << BITS) - 1
ONES = 1 | 1 << BITS | 1 << 2 * BITS
WRAP = (1 << 3 * BITS) - 1


def elements(text: Column) -> Column:
    """Paragraphs and clauses of a text, told apart by a tag."""
    def cut(pattern, tag):
        return F.transform(F.array_remove(F.split(text, pattern), ""), lambda x: F.concat(F.lit(tag), x))
    return F.concat(cut("[\r\n]+", "P"), cut("[\r\n.!?,;:|$%&#*]+ *", "S"))


def lanes(parts: Column) -> Column:
    """Packed lanes of a multiset, the number of its elements first.  ``parts`` should be a plain column."""
    def summed(seed):
        hashes = F.transform(parts, lambda x: F.xxhash64(F.lit(seed), x))
        return F.aggregate(hashes, F.array_repeat(F.lit(0).cast("long"), SHIFTS), lambda acc, x: F.transform(
            acc, lambda a, s: (a + F.call_function("shiftrightunsigned", x, s).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(WRAP))))
    return F.concat(F.array(F.size(parts).cast("long").bitwiseAND(F.lit(WRAP))), *[summed(i) for i in range(SEEDS)])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets; with ``sign`` -1, a without b's elements."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(WRAP)))


def to_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 3 * BITS // 4, "0"))), "")


def _centred(fp: Column) -> Column:
    n = F.element_at(fp, 1)

    def one(x, k):
        return (2 * F.shiftright(x, k * BITS).bitwiseAND(F.lit(LANE)) - n).cast("double")
    return F.flatten(F.transform(F.slice(fp, 2, SEEDS * SHIFTS), lambda x: F.array(*[one(x, k) for k in range(3)])))


def likeness(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    """Cosine of two centred fingerprints, 0 to 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (F.when((norm_a == 0) & (norm_b == 0), 1.0).when((norm_a == 0) | (norm_b == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (norm_a * norm_b)))))


def _bucket(value: Column, cuts: list[int], x: DataFrame) -> DataFrame:
    """Number of cut points at or below the value, by binary search in a literal array."""
    x = x.withColumn("bucket", F.lit(0))
    step = 1 << max(len(cuts).bit_length() - 1, 0)
    while cuts and step:
        to = F.col("bucket") + step
        x = x.withColumn("bucket", F.when((to <= len(cuts)) & (F.get(F.lit(cuts), to - 1) <= value), to).otherwise(F.col("bucket")))
        step //= 2
    return x


def with_next(docs: DataFrame, derived: list[tuple[str, Column]], keep: list[str], per_partition: int = 4) -> DataFrame:
    """Each document with ``next_*`` of the next one in descending doc_id; after the last comes the first.

    ``derived`` columns are computed after the shuffle; those in ``keep`` are also given of the next document.

    Documents are cut into ranges of doc_id (``per_partition`` for each shuffle
    partition, so the ranges grow in number with the job); the first document of
    each range is also sent, as a guest, to the range before it.  One shuffle;
    the driver holds one number per range.
    """
    spark = docs.sparkSession
    ranges = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 10 * ranges))).first()[0] if at else []
    rows = _bucket(F.col("doc_id"), sorted(set(cuts or [])), docs)
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    first = [None] * (tops[-1][0] + 1 if tops else 1)
    to = [0] * len(first)
    for (b, top), (above, _) in zip(tops, [*tops[1:], *tops[:1]], strict=True):
        first[b], to[b] = top, above
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(F.lit(to), F.col("bucket")).alias("bucket"), F.lit(True).alias("guest"))
    tops_of = F.get(F.array(*[F.lit(x).cast("long") for x in first]), F.col("bucket"))
    rows = (rows.withColumn("place", F.explode(F.when(F.col("doc_id").eqNullSafe(tops_of), F.array(own, guest)).otherwise(F.array(own))))
            .select("doc_id", "text", "place.bucket", "place.guest").repartition("bucket"))
    for name, column in derived:
        rows = rows.withColumn(name, column)
    rows = rows.select("doc_id", "text", "bucket", "guest", *keep)
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    for c in ["text", *keep]:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(w))
    return rows.where(~F.col("guest")).drop("bucket", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside its edited text's and its likeness to that and to the next document.

    The edited text replaces the last third by the start of the next document
    in descending doc_id.
    """
    rows = with_next(id_text(docs), [("parts", elements(F.col("text"))), ("fp", lanes(F.col("parts")))], ["fp"])
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp",
                       F.concat(F.substring("text", 1, n - k), F.substring("next_text", 1, k)).alias("edited"))
    rows = rows.withColumn("parts", elements(F.col("edited"))).withColumn("edited_fp", lanes(F.col("parts")))
    for c in ("fp", "next_fp", "edited_fp"):
        rows = rows.withColumn(f"{c}_c", _centred(F.col(c)))
    for c in ("fp", "next_fp", "edited_fp"):
        rows = rows.withColumn(f"{c}_n", F.sqrt(F.aggregate(f"{c}_c", F.lit(0.0), lambda s, x: s + x * x)))
    near = lambda b: likeness(F.col("fp_c"), F.col("fp_n"), F.col(f"{b}_c"), F.col(f"{b}_n"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       to_text(F.col("fp")).alias("fingerprint"), to_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       near("edited_fp").alias("near_edited"), near("next_fp").alias("near_next"))
