"""Result-document bindings: events.props as JSON result files (S1, S3, S5, P5),
embeddings as nested arrays (S6) and as config text (S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import project
from ..sources import documents as D
from . import common as C
from . import query

# Every 7th document is damaged (an extra '{'), so it is not valid JSON.
RAW_DOCS_SQL = """
SELECT event_id, 'evt_' || CAST(event_id AS VARCHAR) || '.json' AS file,
       CASE WHEN event_id % 7 = 0 THEN '{' || props ELSE props END AS raw
FROM events"""


def raw_docs(spark, sf):
    e = C.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return e.select("event_id", F.concat(F.lit("evt_"), F.col("event_id").cast("string"), F.lit(".json")).alias("file"),
                    raw.alias("raw"))


@query("s1_json_documents", f"""
SELECT file, regexp_replace(file, '\\.json$', '') AS stem,
       CASE WHEN json_valid(raw) THEN CAST(json_extract(raw, '$.k') AS BIGINT) END AS k
FROM ({RAW_DOCS_SQL})""")
def s1_json_documents(spark, sf):
    """Documents parsed to VARIANT and the declared key read (NULL where unparseable)."""
    d = D.parse_documents(raw_docs(spark, sf))
    return d.select("file", F.regexp_replace("file", r"\.json$", "").alias("stem"),
                    D.extract_path("doc", "$.k", "bigint").alias("k"))


@query("s3_quarantine", f"""
SELECT file, CASE WHEN json_valid(raw) THEN json_type(raw::JSON) = 'OBJECT' ELSE false END AS valid
FROM ({RAW_DOCS_SQL})""")
def s3_quarantine(spark, sf):
    """S3: every document with its verdict; bad ones go to quarantine, the rest load."""
    d = D.parse_documents(raw_docs(spark, sf))
    return d.select("file", F.col("doc").isNotNull().alias("valid"))


# Raw I/O-tester output: {"jobs":[{"read":{"bw_bytes":R},"write":{"bw_bytes":W}}]}
IO_SQL = """
SELECT event_id, event_type,
       '{"jobs":[{"read":{"bw_bytes":' || CAST(CAST(round(value * 1e6) AS BIGINT) AS VARCHAR) ||
       '},"write":{"bw_bytes":' || CAST(CAST(round(value * 5e5) AS BIGINT) AS VARCHAR) || '}}]}' AS raw
FROM events"""


@query("s5_json_path", f"""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'write' ELSE 'read' END AS rw,
       CAST(CASE WHEN event_id % 2 = 0 THEN json_extract(raw, '$.jobs[0].write.bw_bytes')
                 ELSE json_extract(raw, '$.jobs[0].read.bw_bytes') END AS BIGINT) AS bw_bytes
FROM ({IO_SQL})""")
def s5_json_path(spark, sf):
    """jobs[0].<rw>.bw_bytes out of raw tester JSON (direction by event parity)."""
    e = C.table(spark, sf, "events")
    job = F.struct(F.struct(F.round(F.col("value") * 1e6).cast("bigint").alias("bw_bytes")).alias("read"),
                   F.struct(F.round(F.col("value") * 5e5).cast("bigint").alias("bw_bytes")).alias("write"))
    raw = e.select("event_id", F.to_json(F.struct(F.array(job).alias("jobs"))).alias("raw"))
    d = D.parse_documents(raw)
    rw = F.when(F.col("event_id") % 2 == 0, "write").otherwise("read")
    bw = F.when(F.col("event_id") % 2 == 0, D.extract_path("doc", "$.jobs[0].write.bw_bytes")) \
          .otherwise(D.extract_path("doc", "$.jobs[0].read.bw_bytes"))
    return d.select("event_id", rw.alias("rw"), bw.alias("bw_bytes"))


@query("s6_explode_nested", """
SELECT vec_id, label, CAST(pos - 1 AS BIGINT) AS pos, round_even(x::DOUBLE, 6) AS x, pos % 8 AS block
FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos
      FROM embeddings)""")
def s6_explode_nested(spark, sf):
    """A header (vec_id, label) repeated for every element of a nested array of structs."""
    e = C.table(spark, sf, "embeddings")
    nested = e.select("vec_id", "label", F.transform(
        "embedding", lambda x, i: F.struct(F.bround(x.cast("double"), 6).alias("x"),
                                           ((i + 1) % 8).cast("bigint").alias("block"))).alias("sweep"))
    flat = D.flatten_sweep(nested, "sweep", ["vec_id", "label"])
    return flat.withColumn("pos", F.col("pos").cast("bigint"))


@query("p5_params_presence", """
WITH d AS (
  SELECT event_id,
         CASE WHEN event_id % 3 = 0 THEN '{"k": ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || ', "nodes": null}'
              WHEN event_id % 3 = 1 THEN '{"k": ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || ', "nodes": ' || CAST(user_id AS VARCHAR) || '}'
              ELSE props END AS raw
  FROM events),
p AS (SELECT event_id, unnest(['k', 'nodes', 'workers']) AS param, raw FROM d)
SELECT event_id, param,
       CASE WHEN json_type(raw::JSON, '$.' || param) <> 'NULL' THEN CAST(json_extract(raw, '$.' || param) AS VARCHAR) END AS value,
       json_type(raw::JSON, '$.' || param) = 'NULL' AS is_null
FROM p WHERE json_type(raw::JSON, '$.' || param) IS NOT NULL""")
def p5_params_presence(spark, sf):
    """P5: 'nodes' present as null on a third, present with a value on a third, absent
    on the rest; 'workers' always absent.  Present keys are captured, absent are not."""
    e = C.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    raw = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "nodes": null}')))
           .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"k": '), k, F.lit(', "nodes": '),
                                                      F.col("user_id").cast("string"), F.lit("}")))
           .otherwise(F.col("props")))
    d = D.parse_documents(e.select("event_id", raw.alias("raw")))
    return project.project_params(d, "doc", ["k", "nodes", "workers"], ["event_id"])


CONFIG_SQL = """
SELECT vec_id,
       'config for vector ' || CAST(vec_id AS VARCHAR) || chr(10) ||
       array_to_string(list_transform(generate_series(0, 7), lambda b:
           array_to_string(list_transform(embedding[b * 8 + 1: b * 8 + 8], lambda x: CAST(CAST(round(x::DOUBLE * 1000) AS BIGINT) AS VARCHAR)), ' ')
           || '    block ' || CAST(b AS VARCHAR) || ' (8 values x 1000)'), chr(10)) AS text
FROM embeddings"""


def config_texts(spark, sf):
    e = C.table(spark, sf, "embeddings")
    ints = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.concat(
        F.array_join(F.slice(ints, b * 8 + 1, 8), " "), F.lit("    block "), b.cast("string"),
        F.lit(" (8 values x 1000)")))
    text = F.concat(F.lit("config for vector "), F.col("vec_id").cast("string"), F.lit("\n"),
                    F.array_join(lines, "\n"))
    return e.select("vec_id", text.alias("text"))


@query("s8_leading_values", f"""
WITH l AS (SELECT vec_id AS file, unnest(string_split(text, chr(10))) AS l,
                  unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM ({CONFIG_SQL})),
p AS (SELECT file, line, l, regexp_extract(l, '{D.LEADING_NUMBERS}', 1) AS lead FROM l)
SELECT CAST(file AS VARCHAR) AS file, CAST(line AS INT) AS line,
       trim(substring(l, length(lead) + 1)) AS comment,
       len(list_filter(string_split_regex(trim(lead), '\\s+'), lambda t: t <> '')) AS n_values,
       list_sum(list_transform(list_filter(string_split_regex(trim(lead), '\\s+'), lambda t: t <> ''), lambda t: t::DOUBLE)) AS values_sum
FROM p""")
def s8_leading_values(spark, sf):
    """Each vector written as a config file: a title line, then 8 lines of
    8 numbers followed by a comment that has digits in it too."""
    c = D.parse_config_text(config_texts(spark, sf).withColumn("vec_id", F.col("vec_id").cast("string")),
                            "text", "vec_id")
    return c.select("file", "line", "comment", F.size("values").alias("n_values"),
                    F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("values_sum")).select(
        "file", "line", "comment", F.col("n_values").cast("bigint").alias("n_values"),
        F.when(F.col("n_values") > 0, F.col("values_sum")).alias("values_sum"))
