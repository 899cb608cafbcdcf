"""The numbered training-data operators over whole driver tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bit_planes, decontaminate, fill_middle, fingerprint, language_id, near_dups, passages, piece_sampling, suffix_dedup, token_counts,
               token_orc, url_filter, warc)
from ._common import Stages, table

QUERIES: dict = {}
SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = warc.archive(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op4_warc_revisit"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest FROM p),
     o AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS first FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM o"""


@query
def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stages(spark, "orc").path("tokens")
    token_orc.write(token_orc.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), path)
    return token_orc.offsets(token_orc.read(spark, path))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", F.col("rejected"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(table_: str, key: str) -> str:
    return f"""SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table_}"""


# an item of fewer than five words is one shingle, and documents have shingles of so many words for it
SQL["op2_decontaminate"] = f"""
WITH iw AS ({_words_sql("benchmark", "item_id")}), dw AS ({_words_sql("documents", "doc_id")}),
     l AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
     il AS (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
     ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM il),
     i AS (SELECT item_id, g, count(*) OVER (PARTITION BY item_id) AS n FROM ig),
     dl AS (SELECT doc_id, w, k FROM dw, l WHERE len(w) >= k),
     d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM dl)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, count(*) AS n_matched, count(*) / n::DOUBLE AS containment
FROM d JOIN i USING (g) GROUP BY doc_id, item_id, n HAVING 5 * count(*) >= 4 * n"""


@query
def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


# bytes are pairs of hex digits, so that strings of 50 bytes are substrings of 100 characters
SQL["op1_suffix_dedup"] = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
     s AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 49)) AS b, x FROM d),
     w AS (SELECT doc_id, b, substr(x, 2 * b + 1, 100) AS span FROM s),
     f AS (SELECT span, min(doc_id) AS first FROM w GROUP BY span HAVING min(doc_id) <> max(doc_id)),
     r AS (SELECT w.doc_id, b FROM w JOIN f ON w.span = f.span AND w.doc_id > f.first),
     g AS (SELECT doc_id, b, b - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY b), -1000) > 50 AS new FROM r),
     n AS (SELECT doc_id, b, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b) AS run FROM g),
     m AS (SELECT doc_id, run, min(b) AS a, max(b) + 50 AS z FROM n GROUP BY doc_id, run),
     k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM m),
     p AS (SELECT k.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head,
                  max(z) AS z, sum(z - a) AS gone, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head || substr(x, 2 * z + 1), x))) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)"""


@query
def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.groups(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


SQL["op6_near_dups"] = r"""
WITH RECURSIVE
     w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
     g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
     r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.to_id = p.a),
     c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""


@query
def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.cluster(table(spark, sf_dir, "embeddings"))[1]


def _centroids_sql(k: int = 16, rounds: int = 3) -> str:
    """Assignment and new means, one pair of tables a round."""
    nearest = """SELECT r, id, v, c AS cluster, d AS distance FROM (
        SELECT x.r, x.id, x.v, g.c, CAST(list_sum(list_transform(list_zip(x.v, g.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM x, g{0} g) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1"""
    parts = [f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, embedding FROM embeddings),
     x AS (SELECT r, id, list_transform(embedding, lambda t: CAST(floor(64 * CAST(t AS DOUBLE)) AS BIGINT)) AS v FROM e
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda t: t IS NOT NULL AND isfinite(t) AND abs(t) < 2097152)) = 64),
     f AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || CAST(id AS VARCHAR)), v) - 1 AS c FROM x WHERE id IS NOT NULL),
     g0 AS (SELECT c, v AS m FROM f WHERE c < {k})"""]
    for n in range(rounds):
        parts.append(f"""
     a{n} AS ({nearest.format(n)}),
     p{n} AS (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS t FROM a{n}),
     s{n} AS (SELECT cluster, i, CAST((CAST(sum(t) AS BIGINT) - ((CAST(sum(t) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
              FROM p{n} GROUP BY cluster, i),
     n{n} AS (SELECT cluster, list(q ORDER BY i) AS m FROM s{n} GROUP BY cluster),
     g{n + 1} AS (SELECT g.c, coalesce(n.m, g.m) AS m FROM g{n} g LEFT JOIN n{n} n ON n.cluster = g.c)""")
    parts.append(f"""
     z AS ({nearest.format(rounds)})
SELECT id AS vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(g.m, ',')) AS centroid_sha256
FROM z JOIN g{rounds} g ON g.c = z.cluster""")
    return ",".join(parts[:-1]) + "," + parts[-1]


SQL["op11_bit_planes"] = _centroids_sql()


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


SQL["op12_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     u AS (SELECT *, regexp_extract_all(text, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS t FROM d),
     k AS (SELECT *, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
     p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:z], '') AS middle, array_to_string(t[z + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""


@query
def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = passages.scores(docs, passages.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")
