"""Lookup bindings: part names as device names (J2, F6, F18), events as
measurements against a spec (J3), documents curves against the published
curve (S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import mfu_pct
from ..operators import joins
from . import common as C
from . import query

# --- fixed values: a pattern table over part names whose patterns overlap, so
# the table order decides (binding fixture, not a reference table).
PART_PATTERNS = [(1, "standard.*brand#1[0-9]", 1.5e15), (2, "standard", 1.0e15), (3, "brand#2", 8.0e14),
                 (4, "polished|brushed", 6.0e14), (5, "large|medium", 4.0e14)]
# --- fixed values: GPU names handed to parts by p_partkey % 7
GPU_NAMES = ["NVIDIA H100 80GB HBM3", "NVIDIA H100 SXM5 80GB", "NVIDIA B300 SXM6 AC", "NVIDIA A100-SXM4-40GB",
             "NVIDIA H200 SXM 141GB", "NVIDIA B200", "NVIDIA A100 80GB PCIe"]

DEVICES_SQL = """
SELECT p_partkey, p_type || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) AS device FROM part"""


def _patterns_sql(rows, value="flops") -> str:
    vals = ", ".join(f"({o}, {C.sql_str(p)}, {v}::DOUBLE)" for o, p, v in rows)
    return f"(VALUES {vals}) AS t(ord, pattern, {value})"


def devices(spark, sf):
    p = C.table(spark, sf, "part")
    return p.select("p_partkey", F.concat_ws(" ", "p_type", "p_brand", F.col("p_size").cast("string")).alias("device"))


@query("j2_regex_first_match", f"""
SELECT d.p_partkey, d.device, coalesce(arg_min(t.flops, t.ord), 989e12) AS peak_flops
FROM ({DEVICES_SQL}) d LEFT JOIN {_patterns_sql(PART_PATTERNS)} ON regexp_matches(d.device, t.pattern, 'i')
GROUP BY d.p_partkey, d.device""")
def j2_regex_first_match(spark, sf):
    return joins.lookup_first_match(devices(spark, sf), "device", PART_PATTERNS, "flops", default=dims.DEFAULT_PEAK_FLOPS, out="peak_flops")


GPUS_SQL = f"""
SELECT p_partkey, p_size, p_retailprice, {C.sql_list(GPU_NAMES)}[p_partkey % {len(GPU_NAMES)} + 1] AS gpu_name FROM part"""


def gpus(spark, sf):
    p = C.table(spark, sf, "part")
    names = F.array(*[F.lit(n) for n in GPU_NAMES])
    return p.select("p_partkey", "p_size", "p_retailprice",
                    F.element_at(names, (F.col("p_partkey") % len(GPU_NAMES) + 1).cast("int")).alias("gpu_name"))


@query("j2_peak_lookup", f"""
SELECT g.p_partkey, g.gpu_name, coalesce(arg_min(t.flops, t.ord), {dims.DEFAULT_PEAK_FLOPS}::DOUBLE) AS peak_flops
FROM ({GPUS_SQL}) g LEFT JOIN {_patterns_sql(dims.PEAK_FLOPS)} ON regexp_matches(g.gpu_name, t.pattern, 'i')
GROUP BY g.p_partkey, g.gpu_name""")
def j2_peak_lookup(spark, sf):
    """J2 with the shipped peak-FLOPS table on device names."""
    return joins.lookup_first_match(gpus(spark, sf).select("p_partkey", "gpu_name"), "gpu_name",
                                    dims.PEAK_FLOPS, "flops", default=dims.DEFAULT_PEAK_FLOPS, out="peak_flops")


@query("f6_mfu", f"""
WITH g AS (SELECT g.p_partkey, g.p_size, g.p_retailprice, coalesce(arg_min(t.flops, t.ord), {dims.DEFAULT_PEAK_FLOPS}::DOUBLE) AS peak
           FROM ({GPUS_SQL}) g LEFT JOIN {_patterns_sql(dims.PEAK_FLOPS)} ON regexp_matches(g.gpu_name, t.pattern, 'i')
           GROUP BY ALL)
SELECT p_partkey, round_even(NULLIF((p_size % 10) * 1e15, 0) * (p_retailprice / 1000) / (peak * (p_partkey % 16 + 1)) * 100, 9) AS mfu_pct
FROM g""")
def f6_mfu(spark, sf):
    """MFU with flops/step = (size mod 10) PFLOP (zero -> NULL), steps/s = price / 1000."""
    g = joins.lookup_first_match(gpus(spark, sf), "gpu_name", dims.PEAK_FLOPS, "flops",
                                 default=dims.DEFAULT_PEAK_FLOPS, out="peak")
    m = mfu_pct((F.col("p_size") % 10) * F.lit(1e15), F.col("p_retailprice") / F.lit(1000.0), "peak",
                F.col("p_partkey") % 16 + 1)
    return g.select("p_partkey", F.bround(m, 9).alias("mfu_pct"))


@query("f18_block_size", f"""
SELECT g.p_partkey, arg_min(t.nb, t.ord) AS nb
FROM ({GPUS_SQL}) g LEFT JOIN (VALUES {", ".join(f"({o}, {C.sql_str(p)}, {nb})" for o, p, nb in dims.BLOCK_SIZES)}) AS t(ord, pattern, nb)
  ON regexp_matches(g.gpu_name, t.pattern, 'i')
GROUP BY g.p_partkey""")
def f18_block_size(spark, sf):
    """Linpack block size by device family (336 Hopper/Ampere, 512 Blackwell)."""
    g = joins.lookup_first_match(gpus(spark, sf).select("p_partkey", "gpu_name"), "gpu_name",
                                 dims.BLOCK_SIZES, "nb")
    return g.select("p_partkey", "nb")


def _baseline_sql() -> str:
    vals = ", ".join(f"({C.sql_str(m)}, {v}::DOUBLE, {C.sql_str(u)}, {p}::DOUBLE, "
                     f"{'NULL' if o is None else str(o) + '::DOUBLE'})" for m, v, u, p, o in dims.BASELINE)
    return f"(VALUES {vals}) AS b(metric, value, unit, peak, other_peak)"


@query("j3_efficiency", f"""
WITH m AS (SELECT event_id, {C.sql_list([b[0] for b in dims.BASELINE])}[user_id % {len(dims.BASELINE)} + 1] AS metric,
                  value * 20 AS measured FROM events)
SELECT m.event_id, m.metric, round_even(m.measured / b.peak * 100, 9) AS pct_of_peak,
       round_even(m.measured / NULLIF(b.other_peak, 0), 9) AS vs_other
FROM m LEFT JOIN {_baseline_sql()} ON m.metric = b.metric""")
def j3_efficiency(spark, sf):
    """Each event a measurement of one published metric (by user), against its spec."""
    e = C.table(spark, sf, "events")
    names = F.array(*[F.lit(b[0]) for b in dims.BASELINE])
    m = e.select("event_id", F.element_at(names, (F.col("user_id") % len(dims.BASELINE) + 1).cast("int")).alias("metric"),
                 (F.col("value") * 20).alias("measured"))
    x = joins.efficiency(m, "metric", "measured", dims.baseline(spark))
    return x.select("event_id", "metric", F.bround("pct_of_peak", 9).alias("pct_of_peak"),
                    F.bround("vs_other", 9).alias("vs_other"))


def _published_curve_sql() -> str:
    vals = ", ".join(f"({C.sql_str(l)}, {w}::DOUBLE, {r}::DOUBLE)" for l, w, r in dims.BASELINE_SWEEP)
    return f"(VALUES {vals}) AS pc(block_size, write_mbs, read_mbs)"


@query("s12_baseline", f"""
SELECT c.source, c.block_size, c.rate, pc.read_mbs AS published_read_mbs,
       round_even(c.rate / pc.read_mbs, 9) AS vs_published
FROM ({C.CURVE_SQL}) c LEFT JOIN {_published_curve_sql()} ON c.block_size = pc.block_size""")
def s12_baseline(spark, sf):
    """Every measured curve point next to the published read rate at its size (NULL without one)."""
    pub = (dims.baseline_sweep(spark).where(F.col("rw") == "read")
           .select("block_size", F.col("mbs").alias("published_read_mbs")))
    c = C.size_bucket_curve(spark, sf).join(F.broadcast(pub), "block_size", "left")
    return c.select("source", "block_size", "rate", "published_read_mbs",
                    F.bround(F.col("rate") / F.col("published_read_mbs"), 9).alias("vs_published"))


@query("j2_pattern_table", f"""
WITH t AS (SELECT min(p_partkey) AS ord, p_brand AS pattern, count(*) AS n FROM part GROUP BY p_brand)
SELECT d.p_partkey, d.device, arg_min(t.n, t.ord) AS n
FROM ({DEVICES_SQL}) d LEFT JOIN t ON regexp_matches(d.device, t.pattern, 'i')
GROUP BY d.p_partkey, d.device""")
def j2_pattern_table(spark, sf):
    """J2 with the pattern table built from the data: one pattern per brand, in order of first appearance."""
    t = C.table(spark, sf, "part").groupBy(F.col("p_brand").alias("pattern")).agg(
        F.min("p_partkey").alias("ord"), F.count("*").alias("n"))
    return joins.lookup_first_match(devices(spark, sf), "device", t, "n")


@query("j4_range_table", """
WITH r AS (SELECT DISTINCT p_size * 200 AS lo, CASE WHEN p_size < 50 THEN p_size * 200 + 150 END AS hi, 'size ' || p_size AS class FROM part)
SELECT d.doc_id, d.n_chars, r.class FROM documents d LEFT JOIN r ON d.n_chars >= r.lo AND (r.hi IS NULL OR d.n_chars < r.hi)""")
def j4_range_table(spark, sf):
    """J4 / F17 with ranges built from the data: one [200 size, 200 size + 150) range per part size, the last open."""
    s = F.col("p_size")
    r = C.table(spark, sf, "part").select((s * 200).cast("bigint").alias("lo"), F.when(s < 50, s * 200 + 150).cast("bigint").alias("hi"),
                                          F.concat(F.lit("size "), s.cast("string")).alias("class")).distinct()
    return joins.size_class(C.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", r)


@query("j5_curve_by", """
WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 <> 0 THEN source END AS source FROM documents),
     c AS (SELECT source, n_chars AS at_chars, min(doc_id) AS at_doc FROM d WHERE doc_id % 5 = 0 GROUP BY ALL)
SELECT d.doc_id, d.source, d.n_chars, c.at_chars, c.at_doc
FROM d ASOF LEFT JOIN c ON d.source = c.source AND d.n_chars >= c.at_chars""")
def j5_curve_by(spark, sf):
    """J5 with a curve per source built from the data; NULL sources match nothing."""
    d = C.table(spark, sf, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    c = d.where("doc_id % 5 = 0").groupBy("source", F.col("n_chars").alias("at_chars")).agg(F.min("doc_id").alias("at_doc"))
    return joins.asof_lookup(d, "n_chars", c, "at_chars", ["at_doc"], by=["source"]).select("doc_id", "source", "n_chars", "at_chars", "at_doc")


@query("j4_nested_ranges", """
WITH r AS (SELECT p_partkey AS ord, p_size * 60 AS lo,
                  CASE WHEN p_partkey % 97 <> 0 THEN p_size * 60 + (p_partkey % 41) * 150 END AS hi, p_brand AS class FROM part)
SELECT d.doc_id, d.n_chars, arg_min(r.class, r.ord) AS class
FROM documents d LEFT JOIN r ON d.n_chars >= r.lo AND (r.hi IS NULL OR d.n_chars < r.hi)
GROUP BY d.doc_id, d.n_chars""")
def j4_nested_ranges(spark, sf):
    """J4 / F17 with a range per part that nest, overlap, repeat, may be empty or open: the first part's decides."""
    k, lo = F.col("p_partkey"), F.col("p_size") * 60
    r = C.table(spark, sf, "part").select(k.alias("ord"), lo.cast("bigint").alias("lo"),
                                          F.when(k % 97 != 0, lo + (k % 41) * 150).cast("bigint").alias("hi"), F.col("p_brand").alias("class"))
    return joins.size_class(C.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", r, order="ord")


# every fourth part the head of its type, its brand's digit, a size, or nearly the whole name
PREFIX_ROWS_SQL = """
SELECT p_partkey, p_type || ' ' || p_brand AS device, substr(p_type || ' ' || p_brand, 1, 3 + p_partkey * 7 % 23) AS prefix FROM part"""


@query("j1_prefix_table", f"""
WITH d AS ({PREFIX_ROWS_SQL}), n AS (SELECT DISTINCT device FROM d),
     t AS (SELECT prefix, min(p_partkey) AS reg_ord, count(*) AS n FROM d WHERE p_partkey % 3 = 0 GROUP BY prefix),
     m AS (SELECT n.device, arg_min(t.prefix, t.reg_ord) AS prefix, arg_min(t.n, t.reg_ord) AS bench FROM n JOIN t ON starts_with(n.device, t.prefix) GROUP BY n.device)
SELECT d.p_partkey, d.device, m.prefix, CAST(m.bench AS VARCHAR) AS bench FROM d LEFT JOIN m USING (device)""")
def j1_prefix_table(spark, sf):
    """S2 / J1 with a registry built from the data: the heads, of many lengths, of a third of the part names."""
    p = C.table(spark, sf, "part")
    d = p.select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("device"))
    d = d.withColumn("head", F.substring("device", F.lit(1), (F.lit(3) + F.col("p_partkey") * 7 % 23).cast("int")))
    reg = d.where("p_partkey % 3 = 0").groupBy(F.col("head").alias("prefix")).agg(
        F.min("p_partkey").alias("reg_ord"), F.count("*").cast("string").alias("bench"))
    return joins.classify(d.drop("head"), "device", reg).drop("reg_ord")


PART_ROW_PATTERNS_SQL = """
SELECT p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN '^' || p_type || ' ' || p_brand || '$'
         WHEN 1 THEN replace(lower(p_type), ' ', '.+') || '.*[' || right(p_brand, 1) || ']$'
         WHEN 2 THEN p_brand || 'x?$|zz+top' WHEN 3 THEN 'no such ' || p_type ELSE substr(p_type, 1, 6) || '\\w* .*#' || right(p_brand, 2) END AS pattern
FROM part"""


@query("j2_pattern_rows", f"""
WITH t AS ({PART_ROW_PATTERNS_SQL}), u AS (SELECT pattern, min(ord) AS ord FROM t GROUP BY pattern),
     d AS (SELECT p_partkey, p_type || ' ' || p_brand AS device FROM part), n AS (SELECT DISTINCT device FROM d),
     m AS (SELECT n.device, min(u.ord) AS first_part FROM n JOIN u ON regexp_matches(n.device, u.pattern, 'i') GROUP BY n.device)
SELECT d.p_partkey, d.device, m.first_part FROM d LEFT JOIN m USING (device)""")
def j2_pattern_rows(spark, sf):
    """J2 / F18 with a pattern for each part, of several forms, in the order of the parts."""
    p = C.table(spark, sf, "part")
    k, brand, kind = F.col("p_partkey") % 5, F.col("p_brand"), F.col("p_type")
    pattern = (F.when(k == 0, F.concat(F.lit("^"), kind, F.lit(" "), brand, F.lit("$")))
               .when(k == 1, F.concat(F.replace(F.lower(kind), F.lit(" "), F.lit(".+")), F.lit(".*["), F.right(brand, F.lit(1)), F.lit("]$")))
               .when(k == 2, F.concat(brand, F.lit("x?$|zz+top"))).when(k == 3, F.concat(F.lit("no such "), kind))
               .otherwise(F.concat(F.substring(kind, 1, 6), F.lit("\\w* .*#"), F.right(brand, F.lit(2)))))
    t = p.select(F.col("p_partkey").alias("ord"), pattern.alias("pattern"), F.col("p_partkey").alias("first_part"))
    d = p.select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("device"))
    return joins.lookup_first_match(d, "device", t, "first_part")
