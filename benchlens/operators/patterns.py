"""An inverted index over regular expressions.

A pattern can match a name only if the name holds the text that the pattern asks for
literally.  ``literals`` reads such a text out of a pattern, for each of its
branches: classes, escapes, wild cards and characters that may be missing end a run of
literal characters, and the longest run counts.  The pattern is posted under one trigram of each
branch, the one that the fewest names have, names are posted under all of
their trigrams, and only pairs that meet are tried.  Patterns without a literal of three
characters, or with a construct that is not read here (groups, other escapes), are
posted under the empty text, which every name has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "\u0001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """Letter case as ``(?i)`` sees it: ASCII only."""
    return F.translate(c, UPPER, LOWER)


def literals(pattern: Column) -> Column:
    """Per branch the longest literal text that a match must hold; NULL for a pattern that is not read."""
    p = pattern
    unread = p.rlike(r"[()]|\\[A-Za-z0-9&&[^sSdDwWbB]]|\[\^?\]|\[[^\]]*(\[|&&|\\)|" + GAP)
    for what in (r"\\.",                      # escapes, also of a character that stands for itself
                 r"\[[^\]]*\]",                # classes
                 r"\+[?+]?",                    # once or more: the character before it stays
                 r"(?s).(\{[^}]*\}|[?*])[?+]?",      # a character that may be missing
                 r"[.^$]"):
        p = F.regexp_replace(p, what, GAP)
    longest = lambda branch: F.array_max(F.transform(
        F.split(branch, GAP), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    return F.when(~unread, F.transform(F.split(p, r"\|"), lambda b: fold(longest(b))))


def trigrams(c: Column) -> Column:
    n = F.length(c) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>"))


def keys(c: Column) -> Column:
    """What a text is posted under: numbers of the empty text and of its trigrams; equal numbers of two trigrams only add tries."""
    return F.transform(F.concat(F.array(F.lit("")), trigrams(c)), lambda g: F.xxhash64(g))


def first_matches(names: DataFrame, table: DataFrame, value_col: str) -> DataFrame:
    """(_name, value): of each distinct name that a pattern matches, the value of the first one by ``ord``.

    Equal patterns count once, by their first row.  Patterns are numbered in the order of
    (ord, pattern), and the first match of a name is the least number, so that pairs are
    aggregated by hash as they come and not sorted by name first.
    """
    names = names.where(F.col("_name").isNotNull()).distinct()
    grams = names.select("_name", F.explode(keys(fold(F.col("_name")))).alias("gram"))
    # rows without ord come before all others, and have no least ord
    rows = table.select("ord", "pattern", F.col(value_col).alias("value"), F.col("ord").isNull().alias("unplaced")).where(F.col("pattern").isNotNull())
    rules = rows.groupBy("pattern", "unplaced").agg(
        F.min("ord").alias("ord"), F.when(F.col("unplaced"), F.any_value("value")).otherwise(F.min_by("value", "ord")).alias("value"))
    rules = rules.orderBy("ord", "pattern").select(F.monotonically_increasing_id().alias("place"), "pattern", "value", literals(F.col("pattern")).alias("needs"))
    short = F.col("needs").isNull() | F.exists("needs", lambda s: F.length(s) < 3)
    wanted = rules.select("place", "pattern", "value", F.posexplode(F.when(short, F.array(F.lit(""))).otherwise(F.col("needs"))).alias("branch", "need")).select(
        "place", "pattern", "value", "branch", F.explode(keys(F.col("need"))).alias("gram"))
    # a trigram that no name has: the branch matches nothing
    held = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (wanted.join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy("place", "pattern", "value", "branch")
              .agg(F.min("n").alias("n"), F.min_by("gram", "n").alias("gram")).where("n > 0"))
    posts = rarest.select("place", "pattern", "value", "gram").distinct()
    hits = grams.join(posts, "gram").where(F.regexp_like(F.col("_name"), F.concat(F.lit("(?i)"), F.col("pattern"))))
    return hits.groupBy("_name").agg(F.min_by("value", "place").alias("value"))
