"""URL filter by rules and a character language-model ratio (operator 9).

Rules judge a url first: a rule fits its host and all subdomains if the url's
path starts with the rule's path; the longest fitting rule wins.  The urls that
rules accept and reject train two character models over the whole url, from its
scheme to its fragment: Markov models of order 0 to 3 whose counts are
interpolated down the orders (each order adds ``weight`` pseudo-counts spread as
the next shorter context predicts).  A url's score is the mean log-likelihood
difference per character, less a threshold calibrated on a fifth of the labelled
urls that training leaves out (by host + path, so that urls which differ in their
tail alone are on one side).

Characters are folded to 48 classes, so the model has at most 48**4 (5.3
million) rows whatever the corpus: that is the proven bound under which it is
broadcast to the scorer.  Counting, smoothing and scoring are DataFrame
expressions and aggregations; only the totals of the model and the calibration
histogram (at most 2 x 401 rows) reach the driver.

Nulls: a url that is null or has no ``://`` has an empty host and path, so that
no rule fits; a null url is judged as the empty string, any other by all its
characters.  Without accepted or without rejected
urls every score is 0 and the verdict is allow.  Repeated rows are judged alike;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Stages

# fixed values: the rules (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LOWER + "0123456789./-?=&%_#:"  # 46 classes; class 0 pads the start, class 47 is any other character
CLASSES = 48
SPAN = 4


def split_url(url: str = "url") -> tuple[Column, Column]:
    """(host, path): host A-Z lower-cased; both empty without ``://``."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(u)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, else null."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, v).otherwise(verdict)
    return rule, verdict


def codes(text: Column) -> Column:
    """The classes of a text's characters after ``SPAN`` - 1 pads; null for an empty text."""
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    classes = F.transform(F.split(F.translate(text, UPPER, LOWER), ""), lambda c: F.when(at(c) > 0, at(c)).otherwise(CLASSES - 1))
    return F.when(text != "", F.concat(F.array(*[F.lit(0)] * (SPAN - 1)), classes))


def grams(code: str) -> Column:
    """Each character with the three before it, as one base-48 number; ``code`` names a column of ``codes``."""
    one = lambda i: sum(F.get(F.col(code), i + k).cast("long") * CLASSES ** (SPAN - 1 - k) for k in range(SPAN))
    return F.transform(F.sequence(F.lit(0), F.size(code) - SPAN), one)


def fit(labelled: DataFrame, weight: float = 4.0) -> DataFrame:
    """(gram, llr): log-likelihood difference of every gram that occurs.

    ``labelled``: (gram, label) rows, label 'allow', 'block' or null; null rows
    only add their gram to the table, so that every scored gram is in it.
    """
    counts = labelled.groupBy("gram").agg(*[F.sum(F.when(F.col("label") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")])
    counts = Stages(labelled.sparkSession, "urls").write(counts, "counts")
    totals = counts.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("allow", "block")]).first()
    if not (totals["allow"] and totals["block"]):
        return counts.select("gram", F.lit(0.0).alias("llr"))
    p = {v: F.lit(1.0 / CLASSES) for v in totals.asDict()}
    out = counts
    for k in range(1, SPAN + 1):  # grams of k characters: k-1 of context, then the character
        tail = F.col("gram") % CLASSES ** k
        for v in p:
            out = out.withColumn(f"{v}_n{k}", F.sum(v).over(Window.partitionBy(tail)))
            seen = F.lit(totals[v]) if k == 1 else F.sum(v).over(Window.partitionBy(F.floor(tail / CLASSES)))
            out = out.withColumn(f"{v}_c{k}", seen)
    for k in range(1, SPAN + 1):
        for v in p:
            p[v] = (F.col(f"{v}_n{k}") + weight * p[v]) / (F.col(f"{v}_c{k}") + weight)
    return out.select("gram", (F.log(p["allow"]) - F.log(p["block"])).alias("llr"))


def threshold(scored: DataFrame, step: float = 0.01, widest: int = 200) -> float:
    """The score from which on urls are allowed, with the best balanced accuracy on labelled rows."""
    bin_ = F.greatest(F.lit(-widest), F.least(F.lit(widest), F.floor(F.col("score") / step))).cast("int")
    rows = scored.groupBy(bin_.alias("bin")).agg(*[F.sum((F.col("label") == v).cast("long")).alias(v) for v in ("allow", "block")]).collect()
    a, b = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not (a and b):
        return 0.0
    best, at, kept, low = -1.0, 0.0, a, 0
    for r in [None, *sorted(rows, key=lambda r: r["bin"])]:
        if r is not None:
            kept, low = kept - r["allow"], low + r["block"]
        if (x := kept / a + low / b) > best:
            best, at = x, -widest * step if r is None else (r["bin"] + 1) * step
    return at


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the calibrated ratio, allow from 0 on."""
    st = Stages(pages.sparkSession, "urls")
    host, path = split_url()
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("label", by_rule)
    # repeated urls are scored once
    urls = rows.groupBy("url").agg(F.first("label").alias("label"), F.first("host").alias("host"), F.first("path").alias("path"))
    held = F.crc32(F.concat("host", "path").cast("binary")) % 5 == 0
    urls = st.write(urls.select("url", "label", held.alias("held")), "urls")
    pieces = urls.withColumn("codes", codes(F.col("url"))).select("url", "label", "held", F.explode_outer(grams("codes")).alias("gram"))
    model = fit(pieces.where("gram IS NOT NULL").select("gram", F.when(~F.col("held"), F.col("label")).alias("label")))
    scored = (pieces.join(F.broadcast(model), "gram", "left").groupBy("url")
              .agg(F.first("label").alias("label"), F.first("held").alias("held"),
                   F.coalesce(F.avg("llr"), F.lit(0.0)).alias("score")))
    scored = st.write(scored, "scored")
    cut = threshold(scored.where("held AND label IS NOT NULL"))
    scored = scored.select(F.col("url").alias("u"), (F.col("score") - cut).alias("score"))
    out = rows.join(scored, F.col("url") == F.col("u"), "left")
    verdict = F.coalesce("label", F.when(F.col("score") >= 0, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
