"""WARC archives with revisit records (operator 4).

Only headers (id, digest, length) are shuffled to find equal payloads; the
originals of groups with more than one member are written as a small table and
joined back by digest, so a digest that a third of the pages share is a skewed
join that Spark splits, never a group in one task.  Records are put together by
column expressions, exact WARC/1.1, and each becomes a gzip member of its own, so a
record can be read by its offset.  A task hands out chunks of whole members, of
``CHUNK`` bytes or of one larger record, and Spark's text writer (atomic commit, any
store) puts ``PER_FILE`` of them in a file: archives are bounded by bytes, not by
records.  The writer ends every chunk with a byte of its own; that is the last byte
of the member, 0, which is left to it.  (A member states its length in its last four
bytes; a record of ``PART`` bytes and more is cut into members below that.)

The reader takes an archive at a time, follows its members without unpacking more than one
record, and gives out rows in batches of about ``CHUNK`` bytes.  Memory: an archive, a
few chunks, and three times a record.

Nulls: a null payload is empty, a null url gives no target header, a null id
never becomes an original.  Rows that repeat the original's id and payload are
all responses.  An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Stages, release, small_batches

PARSED = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, target string, payload string, file string, offset long, length long")
CRLF = "\r\n"
CHUNK, PER_FILE = 8 << 20, 8
PART = 1 << 24  # the length of a member below this has 0 in its last byte
GZIP = 31  # zlib with a gzip header


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes): all that is needed to resolve revisits."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def originals(heads: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(digest, original): the largest id of every digest that several records share."""
    return (heads.where(F.col("bytes") >= min_bytes).groupBy(F.col("digest").alias("of_digest"))
            .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
            .where("n > 1 AND original IS NOT NULL").select("of_digest", "original"))


def _uuid(col):
    """A stable record id from a page id."""
    h = F.md5(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in
                    ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, first: DataFrame, min_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: whole WARC records."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
                     F.octet_length(html).cast("long").alias("bytes"))
    p = p.join(first, (F.col("digest") == F.col("of_digest")) & (F.col("bytes") >= min_bytes), "left")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _uuid("page_id")), line("WARC-Date", F.lit(date)),
        F.when(url.isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _uuid("original")),
            line("X-Refers-To-Page-Id", F.col("original").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    return p.select(F.concat(head, block, F.lit(CRLF * 2)).alias("value"))


def members(record: bytes) -> bytes:
    """A record as a gzip member (several for one of ``PART`` bytes and more); the last byte is 0."""
    out = []
    for at in range(0, len(record), PART - 1):
        z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        out.append(z.compress(record[at:at + PART - 1]) + z.flush())
    return b"".join(out)


def write(recs: DataFrame, path: str, chunk: int = CHUNK, per_file: int = PER_FILE) -> None:
    """Archives of at most ``per_file`` chunks."""
    small_batches(recs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.record_batch({"value": pa.array([b"".join(held)[:-1]], pa.large_binary()).cast(pa.binary())})
        held, size = [], 0
        for b in batches:
            for record in b.column("value"):
                held.append(members(record.as_buffer().to_pybytes()))
                size += len(held[-1])
                if size >= chunk:
                    yield out(held)
                    held, size = [], 0
            release()
        if held:
            yield out(held)

    rows = recs.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, "value binary")
    # bytes go through as they are: the text writer copies a string's bytes
    rows.select(F.col("value").cast("string").alias("value")).write.option("compression", "none").option(
        "maxRecordsPerFile", per_file).option("lineSep", "\0").text(path)


def unpack(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an archive, one record unpacked at a time; a record of several members is put together."""
    view, at = memoryview(data), 0
    while at < len(data):
        start, parts, need = at, [], None
        while need is None or sum(map(len, parts)) < need:
            z = zlib.decompressobj(GZIP)
            part = [z.decompress(view[at:at + (1 << 16)])]
            end = at + (1 << 16)
            while not z.eof:
                if end >= len(data):
                    raise ValueError(f"the archive ends within the member at byte {at}")
                part.append(z.decompress(view[end:end + (1 << 20)]))
                end += 1 << 20
            at = min(end, len(data)) - len(z.unused_data)
            parts.append(b"".join(part))
            if need is None:
                need = record_size(parts[0])
        yield start, at - start, parts[0] if len(parts) == 1 else b"".join(parts)


def record_size(record: bytes) -> int:
    """The size of a record by its headers."""
    end = record.index(b"\r\n\r\n")
    head = record[:end].decode().split(CRLF)
    return end + 8 + next(int(x.split(": ", 1)[1]) for x in head if x.startswith("Content-Length: "))


def parse(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4:end + 4 + n]
        if data[end + 4 + n:end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        at = end + 8 + n


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of the archives below ``path``, with each record's place; a response's digest is computed again from its payload."""
    small_batches(spark)

    def row(record: bytes):
        (head, block), = parse(record)
        http, _, body = block.partition(b"\r\n\r\n")
        revisit = head["WARC-Type"] == "revisit"
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        page, other = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
        size = int(http.rpartition(b"Content-Length: ")[2])
        return (page and int(page), size, digest, head["WARC-Type"], other and int(other),
                head.get("WARC-Target-URI"), body.decode() if with_payload and not revisit else None)

    names = [x.split()[0] for x in PARSED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        def out(held):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                held, size = [], 0
                for offset, length, record in unpack(content.as_buffer().to_pybytes()):
                    held.append((*row(record), file, offset, length))
                    size += len(record) if with_payload else 500
                    if size >= CHUNK:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)
                release()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "content").mapInArrow(run, PARSED)


def archive(pages: DataFrame, min_bytes: int = 1000, with_payload: bool = False) -> tuple[str, DataFrame]:
    """Write the archives of ``pages`` and read them back: (folder, rows)."""
    spark = pages.sparkSession
    st = Stages(spark, "warc")
    first = st.write(originals(headers(pages), min_bytes), "originals")
    path = st.path("archives")
    write(records(pages, first, min_bytes), path)
    return path, read(spark, path, with_payload)
