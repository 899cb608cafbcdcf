"""Report bindings: documents as result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import agg, joins, windows
from . import common as C
from . import query


def _classified(spark, sf, how="left"):
    return joins.classify(C.doc_files(spark, sf), "stem", dims.registry_rules(), how)


@query("s2_prefix_classify", f"""
SELECT doc_id, stem, prefix, bench FROM ({C.classified_sql()})""")
def s2_prefix_classify(spark, sf):
    return _classified(spark, sf).select("doc_id", "stem", "prefix", "bench")


@query("j1_prefix_join", f"""
SELECT doc_id, stem, bench FROM ({C.classified_sql()}) WHERE bench IS NOT NULL""")
def j1_prefix_join(spark, sf):
    return _classified(spark, sf, "inner").select("doc_id", "stem", "bench")


@query("j8_coverage_anti", f"""
SELECT 'unknown_file' AS kind, stem AS name FROM ({C.classified_sql()}) WHERE bench IS NULL
UNION ALL
SELECT 'missing_result' AS kind, reg.prefix AS name FROM {C.registry_sql()}
WHERE reg.prefix NOT IN (SELECT prefix FROM ({C.classified_sql()}) WHERE prefix IS NOT NULL)""")
def j8_coverage_anti(spark, sf):
    unknown, missing, _ = joins.coverage(C.doc_files(spark, sf), "stem", dims.registry(spark), dims.registry_rules())
    return (unknown.select(F.lit("unknown_file").alias("kind"), F.col("stem").alias("name"))
            .unionByName(missing.select(F.lit("missing_result").alias("kind"), F.col("prefix").alias("name"))))


@query("j8_known_semi", f"""
SELECT doc_id, stem FROM ({C.DOC_FILES_SQL}) f
WHERE EXISTS (SELECT 1 FROM ({C.classified_sql()}) c WHERE c.stem = f.stem AND c.bench IS NOT NULL)""")
def j8_known_semi(spark, sf):
    _, _, known = joins.coverage(C.doc_files(spark, sf), "stem", dims.registry(spark), dims.registry_rules())
    return known.select("doc_id", "stem")


@query("a5_group_bench", f"""
SELECT bench, count(*) AS n_files, min(file) AS first_file,
       row_number() OVER (ORDER BY min(file)) AS ord
FROM ({C.classified_sql()}) WHERE bench IS NOT NULL GROUP BY bench""")
def a5_group_bench(spark, sf):
    return agg.group_results(_classified(spark, sf, "inner"), "bench", "file")


@query("a12_having", f"""
SELECT doc_id, bench, bytes FROM ({C.classified_sql()}) c
WHERE bench IS NOT NULL AND (bench, bytes) IN (
  SELECT (bench, bytes) FROM ({C.classified_sql()}) WHERE bench IS NOT NULL
  GROUP BY bench, bytes HAVING count(*) > 1)""")
def a12_having(spark, sf):
    """Comparison rows only for (benchmark, size) groups seen more than once."""
    c = _classified(spark, sf, "inner").select("doc_id", "bench", "bytes")
    return agg.comparison(c, ["bench", "bytes"])


@query("a16_count", f"""
SELECT count(*) AS n_results FROM ({C.classified_sql()}) WHERE bench IS NOT NULL""")
def a16_count(spark, sf):
    return agg.count_results(_classified(spark, sf, "inner"))


@query("w1_iteration", f"""
SELECT doc_id, bench, file, row_number() OVER (PARTITION BY bench ORDER BY file) - 1 AS iteration
FROM ({C.classified_sql()}) WHERE bench IS NOT NULL""")
def w1_iteration(spark, sf):
    c = _classified(spark, sf, "inner").select("doc_id", "bench", "file")
    return windows.with_iteration(c, ["bench"], "file")


@query("w6_group_size", f"""
SELECT doc_id, bench, count(*) OVER (PARTITION BY bench) AS group_size
FROM ({C.classified_sql()}) WHERE bench IS NOT NULL""")
def w6_group_size(spark, sf):
    c = _classified(spark, sf, "inner").select("doc_id", "bench")
    return windows.with_group_size(c, ["bench"], bounded=True)


@query("o1_file_order", f"""
SELECT file, row_number() OVER (ORDER BY file) AS ord FROM ({C.DOC_FILES_SQL})""")
def o1_file_order(spark, sf):
    return windows.file_order(C.doc_files(spark, sf).select("file"), "file")


@query("o2_size_order", """
SELECT doc_id, CAST(n_chars AS VARCHAR) || 'k' AS label,
       row_number() OVER (ORDER BY n_chars * 1024, doc_id) AS ord
FROM documents""")
def o2_size_order(spark, sf):
    d = C.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("n_chars").cast("string"), F.lit("k")).alias("label"))
    return windows.size_order(d, "label", "doc_id")


def _registry_metrics_sql() -> str:
    rows = dims.REGISTRY + dims.REGISTRY_EXTENSIONS
    vals = ", ".join(f"({C.sql_str(p)}, {C.sql_str(b)}, CAST({j} AS BIGINT), {C.sql_str(k)}, {C.sql_str(lbl)})"
                     for p, b, ms, _ in rows for j, (k, lbl, _) in enumerate(ms))
    return f"(VALUES {vals}) AS m(prefix, bench, metric_ord, metric_key, metric_label)"


@query("s4_registry_explode", f"""
SELECT m.prefix, m.bench, m.metric_ord, m.metric_key, m.metric_label, coalesce(c.n_files, 0) AS n_files
FROM {_registry_metrics_sql()}
LEFT JOIN (SELECT prefix, count(*) AS n_files FROM ({C.classified_sql()}) WHERE prefix IS NOT NULL GROUP BY prefix) c
  ON c.prefix = m.prefix""")
def s4_registry_explode(spark, sf):
    """Registry in long form (one row per declared metric) with the files found for it."""
    reg = dims.registry(spark)
    long = reg.select("prefix", "bench", F.posexplode("metrics").alias("metric_ord", "m")).select(
        "prefix", "bench", F.col("metric_ord").cast("bigint").alias("metric_ord"),
        F.col("m.key").alias("metric_key"), F.col("m.label").alias("metric_label"))
    counts = (_classified(spark, sf).where(F.col("prefix").isNotNull())
              .groupBy("prefix").agg(F.count("*").alias("n_files")))
    return (long.join(counts, "prefix", "left")
            .withColumn("n_files", F.coalesce("n_files", F.lit(0)).cast("bigint")))


# --- events as result documents for the whole report -----------
# Every document carries all registry metric keys, valued event value + offset;
# MFU is null (as shipped) and peak memory is written under the producer's
# alias key.  (key in the document, offset or None for a JSON null)
DOC_KEYS = [("tflops", 0), ("busbw_gb_s", 1), ("algbw_gb_s", 2), ("samples_per_sec", 3),
            ("throughput_mb_s", 4), ("avg_latency_ms", 5), ("p99_latency_ms", 6), ("steps_per_sec", 7),
            ("peak_mem_gb", 8), ("mfu_pct", None), ("save_gb_s", 9), ("load_gb_s", 10),
            ("checkpoint_size_gb", 11), ("read_bw_median_mbs", 12), ("write_bw_median_mbs", 13)]


# Parameters: 'workers' is present as null, 'model' is absent, 'gpu' and
# 'batch_size_per_gpu' are the producer's alias keys.  (key, Spark expr, SQL expr, is text)
DOC_PARAMS = [
    ("nodes", "user_id % 4 + 1", "user_id % 4 + 1", False),
    ("msg_size_bytes", "event_id * 1024", "event_id * 1024", False),
    ("num_accelerators", "8", "8", False),
    ("batch_size", "32", "32", False),
    ("workers", "CAST(NULL AS INT)", None, False),
    ("world_size", "user_id % 16 + 1", "user_id % 16 + 1", False),
    ("batch_size_per_gpu", "32", "32", False),
    ("global_batch_size", "(user_id % 16 + 1) * 32", "(user_id % 16 + 1) * 32", False),
    ("gpu", "concat('NVIDIA B300 #', CAST(user_id % 3 AS STRING))",
     "'NVIDIA B300 #' || CAST(user_id % 3 AS VARCHAR)", True),
    ("passes", "3", "3", False),
]


def event_documents(spark, sf):
    e = C.table(spark, sf, "events")
    pre = F.array(*[F.lit(p) for p in C.STEM_PREFIXES])
    stem = F.concat(F.element_at(pre, (F.col("event_id") % len(C.STEM_PREFIXES) + 1).cast("int")),
                    F.col("event_id").cast("string"))
    doc = F.struct(*[(F.col("value") + F.lit(float(o))).alias(k) if o is not None
                     else F.lit(None).cast("double").alias(k) for k, o in DOC_KEYS],
                   *[F.expr(x).alias(k) for k, x, _, _ in DOC_PARAMS])
    return e.select(F.concat(stem, F.lit(".json")).alias("file"), stem.alias("stem"),
                    F.to_json(doc, {"ignoreNullFields": "false"}).alias("raw"))


def _declared_sql() -> str:
    offsets = dict(DOC_KEYS)
    rows = []
    for p, b, ms, _ in dims.REGISTRY + dims.REGISTRY_EXTENSIONS:
        for i, (k, lbl, aliases) in enumerate(ms):
            src = next((x for x in [k, *aliases] if x in offsets), None)
            off = offsets.get(src) if src else None
            rows.append(f"({C.sql_str(b)}, {i}, {C.sql_str(lbl)}, "
                        f"{'NULL' if off is None else str(float(off)) + '::DOUBLE'})")
    return f"(VALUES {', '.join(rows)}) AS m(bench, ord, title, off)"


def _params_sql() -> str:
    """(bench, param, JSON text of the value or NULL, is_null) for declared params present in the docs."""
    have = {k: (sql, text) for k, _, sql, text in DOC_PARAMS}
    rows = []
    for p, b, _, params in dims.REGISTRY + dims.REGISTRY_EXTENSIONS:
        for k, aliases in params:
            src = next((x for x in [k, *aliases] if x in have), None)
            if src is None:
                continue  # absent key: no row
            sql, text = have[src]
            if sql is None:
                val, isnull = "NULL", "true"
            elif text:
                val, isnull = f"'\"' || {sql} || '\"'", "false"
            else:
                val, isnull = f"CAST({sql} AS VARCHAR)", "false"
            rows.append((b, k, val, isnull))
    return rows


def _classified_events_sql() -> str:
    return f"""
WITH f AS (
  SELECT {C.sql_list(C.STEM_PREFIXES)}[event_id % {len(C.STEM_PREFIXES)} + 1] || CAST(event_id AS VARCHAR) AS stem,
         value, user_id, event_id
  FROM events)
SELECT f.stem || '.json' AS file, f.value, f.user_id, f.event_id, reg.bench
FROM f JOIN {C.registry_sql()} ON reg.prefix = NULLIF(regexp_extract(f.stem, '{C.prefix_regex()}', 1), '')"""


def _report_params_sql() -> str:
    parts = []
    for b, k, val, isnull in _params_sql():
        parts.append(f"SELECT {C.sql_str(b)} AS bench, {C.sql_str(k)} AS param, {val} AS value, {isnull} AS is_null "
                     f"FROM first WHERE bench = {C.sql_str(b)}")
    return f"""
WITH c AS ({_classified_events_sql()}),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY file) AS rn FROM c) WHERE rn = 1)
{" UNION ALL ".join(parts)}"""


@query("report_params", _report_params_sql())
def report_params(spark, sf):
    """SURVEY 3.1: parameters of each benchmark's first file, captured by key
    presence (present-null kept, absent not), aliases filling canonical keys."""
    from ..plans.report import report_documents
    return report_documents(spark, event_documents(spark, sf), cluster="driver").params


@query("report_lines", f"""
WITH c AS ({_classified_events_sql()})
SELECT c.bench, c.file, string_agg(m.title || ': ' || CAST(c.value + m.off AS VARCHAR), '  ' ORDER BY m.ord) AS text
FROM c JOIN {_declared_sql()} ON c.bench = m.bench
WHERE m.off IS NOT NULL
GROUP BY c.bench, c.file""")
def report_lines(spark, sf):
    """SURVEY 3.1: one line of 'label: value' per file, NULL metrics left out."""
    from ..plans.report import report_documents
    return report_documents(spark, event_documents(spark, sf), cluster="driver").lines


@query("report_scalars", f"""
WITH f AS (
  SELECT {C.sql_list(C.STEM_PREFIXES)}[event_id % {len(C.STEM_PREFIXES)} + 1] || CAST(event_id AS VARCHAR) AS stem, value
  FROM events),
c AS (
  SELECT f.stem || '.json' AS file, f.value, reg.bench,
         row_number() OVER (PARTITION BY reg.bench ORDER BY f.stem || '.json') - 1 AS iteration
  FROM f JOIN {C.registry_sql()} ON reg.prefix = NULLIF(regexp_extract(f.stem, '{C.prefix_regex()}', 1), ''))
SELECT c.bench, m.title, c.file AS series, c.value + m.off AS value, c.iteration
FROM c JOIN {_declared_sql()} ON c.bench = m.bench
WHERE m.off IS NOT NULL""")
def report_scalars(spark, sf):
    """SURVEY 3.1 end to end: events written as result documents, classified,
    validated, projected (alias fills the canonical key), unpivoted with NULL
    metrics dropped, and numbered per benchmark by file name."""
    from ..plans.report import report_documents
    return report_documents(spark, event_documents(spark, sf), cluster="driver").scalars


def _cells_sql() -> str:
    offsets = dict(DOC_KEYS)
    rows = []
    for _, b, ms, _ in dims.REGISTRY + dims.REGISTRY_EXTENSIONS:
        for i, (k, _, _) in enumerate(ms):
            kind = "'absent'" if k not in offsets else "'null'" if offsets[k] is None else "'value'"
            rows.append(f"({C.sql_str(b)}, {i}, {C.sql_str(k)}, {kind}, {float(offsets.get(k) or 0)}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) AS m(bench, ord, key, kind, off)"


@query("report_comparison", f"""
WITH c AS ({_classified_events_sql()}), n AS (SELECT bench FROM c GROUP BY bench HAVING count(*) > 1)
SELECT c.bench, c.file, m.ord, m.key,
       CASE m.kind WHEN 'absent' THEN '—' WHEN 'null' THEN 'None' ELSE CAST(c.value + m.off AS VARCHAR) END AS display
FROM c JOIN n USING (bench) JOIN {_cells_sql()} ON c.bench = m.bench""")
def report_comparison(spark, sf):
    """A12 + P6: every declared cell of the benchmarks with more than one file."""
    from ..plans.report import report_documents
    return report_documents(spark, event_documents(spark, sf), cluster="driver").comparison


@query("report_tasks", f"""
WITH c AS ({_classified_events_sql()})
SELECT bench, count(*) AS n_files, min(file) AS first_file, row_number() OVER (ORDER BY min(file)) AS ord,
       'driver' AS cluster_name, 'node-1' AS host
FROM c GROUP BY bench""")
def report_tasks(spark, sf):
    """A5 + F13: one task per benchmark with its cluster and host (the label carries the time, so it is left out here)."""
    from ..plans.report import report_documents
    return report_documents(spark, event_documents(spark, sf), cluster="driver", host="node-1").tasks.drop("task_name")


@query("report_unknown", f"""
SELECT stem || '.json' AS file, stem FROM (
  SELECT {C.sql_list(C.STEM_PREFIXES)}[event_id % {len(C.STEM_PREFIXES)} + 1] || CAST(event_id AS VARCHAR) AS stem FROM events)
WHERE NULLIF(regexp_extract(stem, '{C.prefix_regex()}', 1), '') IS NULL""")
def report_unknown(spark, sf):
    """Files that no registry prefix names."""
    from ..plans.report import report_documents
    return report_documents(spark, event_documents(spark, sf), cluster="driver").unknown


@query("report_rejected", f"""
WITH f AS (SELECT event_id, {C.sql_list(C.STEM_PREFIXES)}[event_id % {len(C.STEM_PREFIXES)} + 1] || CAST(event_id AS VARCHAR) AS stem FROM events)
SELECT stem || '.json' AS file, reg.bench
FROM f JOIN {C.registry_sql()} ON reg.prefix = NULLIF(regexp_extract(stem, '{C.prefix_regex()}', 1), '') WHERE event_id % 4 = 0""")
def report_rejected(spark, sf):
    """S3: every fourth document cut off in the middle is known but rejected."""
    from ..plans.report import report_documents
    docs = event_documents(spark, sf)
    cut = F.regexp_extract("file", r"([0-9]+)\.json$", 1).cast("bigint") % 4 == 0
    docs = docs.withColumn("raw", F.when(cut, F.substring("raw", 1, 40)).otherwise(F.col("raw")))
    return report_documents(spark, docs, cluster="driver").rejected


@query("trial_plan", f"""
SELECT s_suppkey, block_size, rw, pass
FROM supplier, {C.sweep_sizes_sql()}, (SELECT unnest(['write', 'read']) AS rw), (SELECT unnest([1, 2]) AS pass)
WHERE size_bytes <= 16777216""")
def trial_plan(spark, sf):
    """SURVEY 3.2: per cluster (supplier) two passes of every sweep size up to 16 MiB in both directions."""
    from ..plans.sweep import plan_trials
    return plan_trials(C.table(spark, sf, "supplier").select("s_suppkey"), passes=2, max_bytes=16 * 1024 ** 2)
