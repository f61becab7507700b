r"""WARC archives: writing records and assembling transactions.

Writing: every capture gives a request, a response (or a revisit of an earlier
response with the same payload) and a metadata record, which name the response in
``WARC-Concurrent-To``.  Spark's text writer, with ``\r\n\r\n`` as the line
separator, makes gzip-compressed WARC/1.1 files of them under its commit
protocol, so a task that is run again leaves no doubled records.

Reading: Spark hands whole archive files to the executors, which cut them into
records by ``Content-Length``.  A file gets as many records as pages of average size
fill ``FILE_BYTES``, which bounds a reading task.  Request and metadata records are then joined to the capture
they are concurrent to: one nested row for each capture.

Defined results: a null payload is empty.  Rows with one id give captures with one id,
told apart by a number in the record id.  Of rows that hold a payload's largest
id all are responses.  A null id ranks below all others.  A request or metadata record whose capture is
absent is dropped; a capture without one has null in its place; of several for
one capture that with the smallest record id is taken.  Text outside a record and a
truncated last record are ignored.  No captures: an archive without files, and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import new_path, small

#: Payload bytes that an archive file aims at.
FILE_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
RECORD = "kind string, record_id string, concurrent_to string, refers_to long, page_id long, uri string, payload_bytes long, payload_digest string, block binary"


def _record(kind: str, record_id: Column, extra: list[Column], content_type: str, block: Column) -> Column:
    """One WARC record without the two line ends that close it."""
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}WARC-Record-ID: <urn:page:"), record_id, F.lit(f">{CRLF}"), *extra]
    return F.concat(*head, F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def plan_captures(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, n, digest, refers_to): refers_to is null for responses.

    Only the largest id of each repeated payload meets the pages, by digest.  As
    long as those ids are counted to be few they are broadcast and no payload is
    shuffled; beyond that a shuffled join takes over, whose skew can be split.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    held = own.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select("digest", "n", "last")
    joined = own.join(small(held), ["digest", "n"], "left")
    return joined.select("page_id", "url", "html", "n", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Write the captures of ``pages`` (page_id, url, html) to WARC files below ``path``."""
    plan = plan_captures(pages, min_bytes)
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    # the number tells rows with one id apart; it need not be the same if a task runs again
    page = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.monotonically_increasing_id().cast("string"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    own = plan.withColumns({"at": page, "uri": uri})
    named = [header("WARC-Target-URI", F.col("uri")), header("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))]
    to = header("WARC-Concurrent-To", F.concat(F.lit("<urn:page:"), F.col("at"), F.lit(":capture>")))
    digest = header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    ok = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
    refers = header("WARC-Refers-To-Page", F.col("refers_to").cast("string"))
    profile = header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    capture_id = F.concat(F.col("at"), F.lit(":capture"))
    http = "application/http; msgtype=response"
    capture = F.when(F.col("refers_to").isNull(), _record("response", capture_id, [*named, digest], http, F.concat(F.lit(ok), F.col("html")))).otherwise(_record("revisit", capture_id, [*named, digest, refers, profile], http, F.lit(ok)))
    request = _record("request", F.concat(F.col("at"), F.lit(":request")), [*named, to], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    metadata = _record("metadata", F.concat(F.col("at"), F.lit(":metadata")), [*named, to], "application/warc-fields", F.concat(F.lit("payload-length: "), F.col("n").cast("string"), F.lit(CRLF)))
    records = own.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    pages_in_file = max(1, FILE_BYTES * total["rows"] // max(1, total["bytes"]))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_in_file).text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every whole record in an uncompressed archive."""
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = (line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        headers = {f[0].lower(): f[1] for f in fields if len(f) == 2}
        size = headers.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        yield headers, data[end + 4 : end + 4 + int(size)]
        at = data.find(b"WARC/", end + 4 + int(size))


def _unzip(data: bytes) -> bytes:
    """All members of a gzip file; of a truncated one what can be read; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return zlib.decompressobj(31).decompress(data)


def _parse(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows, held = [], 0
            for headers, block in _records(_unzip(bytes(content))):
                kind, digest, n, body = headers.get("warc-type"), None, None, None
                if kind == "response":
                    body = block[block.find(b"\r\n\r\n") + 4 :]
                    n, digest = len(body), hashlib.sha1(body).hexdigest()
                    body = body if payloads else None
                elif kind == "revisit":
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                else:
                    body = block
                page, refers = headers.get("warc-page-id") or None, headers.get("warc-refers-to-page")
                rows.append((kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), int(refers) if refers else None, int(page) if page else None, headers.get("warc-target-uri"), n, digest, body))
                held += len(block)
                if held > 4_000_000:
                    yield _frame(rows, names)
                    rows, held = [], 0
            if rows:
                yield _frame(rows, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("refers_to", "page_id", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record below ``path``, with the payload's length and digest for responses.

    Without ``payloads`` the responses' own bytes stay behind once they are digested.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(lambda batches: _parse(batches, payloads), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture, request, metadata)."""
    capture = records.where("kind IN ('response', 'revisit')")
    body = F.struct("record_id", "uri", F.col("block").cast("string").alias("text"))
    extra = records.where("kind IN ('request', 'metadata') AND concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("_to")).agg(
        F.min(F.when(F.col("kind") == "request", body)).alias("request"), F.min(F.when(F.col("kind") == "metadata", body)).alias("metadata")
    )
    nested = capture.join(extra, capture["record_id"] == extra["_to"], "left")
    return nested.select(F.struct(*capture.columns).alias("capture"), "request", "metadata")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back and assemble the captures."""
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    got = assemble(read_records(spark, path, payloads=False))
    told = F.regexp_extract("metadata.text", r"payload-length: (\d+)", 1).cast("long")
    return got.select(
        F.col("capture.page_id").alias("page_id"),
        F.coalesce("capture.payload_bytes", told).alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        F.col("capture.refers_to").alias("refers_to"),
    )


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), d AS (
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
