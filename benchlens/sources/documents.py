"""Result documents and config text."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading numbers of a config line: numeric tokens each followed by blanks or the
# line end.  The same pattern runs in Java regex and RE2.
LEADING_NUMBERS = r"^\s*((?:[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?(?:\s+|$))*)"


def read_results(spark: SparkSession, path: str, recursive: bool = False, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Every ``*.json`` file under ``path`` as one document.

    One row per file: (file, stem, folder, raw).  ``file`` is the path below
    ``path`` (files of one name in several folders stay apart), ``folder`` its
    first folder, as a run that keeps its results in a folder of its own is named
    by it.  Files are read whole on executors; the glob filter prunes at listing,
    so other files are never opened.

    With ``prefixes`` (those of a registry) only files whose stem or folder starts
    with one are read.  That is a predicate on the files' names alone, so Spark
    drops the others from its listing, unopened; ``list_results`` still names them.
    """
    df = _json_files(spark, recursive).format("text").option("wholetext", "true").load(path)
    out = _named(df, path, "_metadata.file_path")
    if prefixes is not None:
        out = out.where(_starts("stem", prefixes) | _starts("folder", prefixes))
    return out.select("file", "stem", "folder", F.col("value").alias("raw"))


def list_results(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, stem, folder, bytes) of every ``*.json`` file under ``path``, from the listing: none is opened."""
    df = _json_files(spark, recursive).format("binaryFile").load(path)
    return _named(df, path, "_metadata.file_path").select("file", "stem", "folder", F.col("_metadata.file_size").alias("bytes"))


def _json_files(spark: SparkSession, recursive: bool):
    r = spark.read.option("pathGlobFilter", "*.json")
    return r.option("recursiveFileLookup", "true") if recursive else r


def _named(df: DataFrame, root: str, path_col: str) -> DataFrame:
    """The file's path below ``root``, its stem and its first folder."""
    full = F.try_url_decode(F.replace(F.col(path_col), F.lit("+"), F.lit("%2B")))
    rel = _below(full, root)
    name = F.substring_index(full, "/", -1)
    return df.select("*", "_metadata", rel.alias("file"), F.regexp_replace(name, r"\.json$", "").alias("stem"),
                     F.when(F.instr(rel, "/") > 0, F.substring_index(rel, "/", 1)).alias("folder"))


def _starts(col: str, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(col).startswith(p)
    return F.coalesce(hit, F.lit(False))


def _below(full: Column, path: str) -> Column:
    """The part of a full file path after the folder ``path`` (scheme and host left out)."""
    root = "/" + path.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    at = F.locate(root, full)
    return F.when(at > 0, full.substr(at + len(root), F.length(full))).otherwise(full)


def parse_documents(df: DataFrame, raw_col: str = "raw", out: str = "doc") -> DataFrame:
    """Parse JSON text to VARIANT; anything that is not a JSON object is NULL.

    Bad JSON (and the ``NaN`` literal) gives NULL via ``try_parse_json``;
    top-level arrays and scalars are rejected too, since a result is an object.
    """
    # A document that parses and starts with '{' is an object; the anchored
    # test is cheap, unlike deriving the whole schema of every document.
    is_obj = F.col(raw_col).rlike(r"^\s*\{")
    return df.withColumn(out, F.when(is_obj, F.try_parse_json(F.col(raw_col))))


@contextmanager
def shredded(spark: SparkSession):
    """While it lasts, VARIANT columns are written in shreds: typed columns for the keys that the rows have in common."""
    conf, keys = spark.conf, ["spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema"]
    before = {k: conf.get(k) for k in keys}
    for k in keys:
        conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v)


def split_valid(df: DataFrame, doc_col: str = "doc"):
    """S3: (valid, rejected) from one parsed scan; the load goes on without the bad ones."""
    return df.where(F.col(doc_col).isNotNull()), df.where(F.col(doc_col).isNull())


def extract_path(doc, path: str, type_: str = "bigint") -> Column:
    """Typed value at a JSON path of a VARIANT (NULL when absent or mistyped)."""
    d = doc if isinstance(doc, Column) else F.col(doc)
    return F.try_variant_get(d, path, type_)


def flatten_sweep(df: DataFrame, array_col: str, header: list[str], pos: str = "pos") -> DataFrame:
    """One row per element of a nested array of structs, header repeated.

    ``inline``-style: struct fields become columns; an empty or NULL array
    keeps the header row (outer).
    """
    x = df.select(*header, F.posexplode_outer(array_col).alias(pos, "_e"))
    return x.select(*header, pos, "_e.*")


def parse_config_text(df: DataFrame, text_col: str, file_col: str) -> DataFrame:
    """Fixed-layout config text -> (file, line, values ARRAY<DOUBLE>, comment).

    Line numbers are 1-based.  Only the *leading* numbers are values; digits
    inside the comment are not.  Lines without leading numbers keep an empty
    values array.
    """
    lines = df.select(F.col(file_col).alias("file"),
                      F.posexplode(F.split(F.col(text_col), "\n")).alias("_i", "_l"))
    lead = F.regexp_extract("_l", LEADING_NUMBERS, 1)
    toks = F.filter(F.split(F.trim(lead), r"\s+"), lambda t: t != "")
    return lines.select(
        "file", (F.col("_i") + 1).cast("int").alias("line"),
        F.transform(toks, lambda t: t.cast("double")).alias("values"),
        F.trim(F.substring(F.col("_l"), F.length(lead) + 1, 1 << 30)).alias("comment"))


def read_param_configs(spark: SparkSession, path: str, glob: str = "*.dat") -> DataFrame:
    """Every config file under ``path`` parsed line by line."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    df = df.select(F.col("_metadata.file_name").alias("_f"), F.col("value").alias("_t"))
    return parse_config_text(df, "_t", "_f")
