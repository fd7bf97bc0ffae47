"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

Every capture is three records: a request, a response (or a revisit of an equal earlier payload) and a metadata record;
request and metadata name the response in WARC-Concurrent-To. Files are gzip-compressed WARC 1.1, written by Spark's text
sink: a record's head and block are one value and the sink's line end is the CRLF CRLF that ends a record. They are read
by declared lengths, never by searching for ends, so a payload may hold anything.

Defined results: NULL html is an empty payload; payloads below 100 bytes are never revisits; of equal payloads the
smallest page_id is the response, so are rows that repeat that id, and a payload whose ids are all NULL; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, own_columns, table
from fleetlens.llm.registry import query
from fleetlens.session import shared_folder

SMALLEST_REVISIT = 100
RECORDS_PER_FILE = 30_000  # bounds the size of an archive file, which one task reads
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def captures(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, and for revisits the page referred to. Only digests are shuffled, not payloads."""
    base = own_columns(pages, "page_id", "url", "html").select(
        "page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("html"))
    groups = (base.filter(F.col("n_bytes") >= SMALLEST_REVISIT).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select(F.col("digest").alias("_digest"), "first"))
    joined = base.join(groups, F.col("digest") == F.col("_digest"), "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("_digest", "first")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write all captures of (page_id, url, html) as WARC files below ``path``."""
    rows = captures(pages).withColumn("capture", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
                                                             F.monotonically_increasing_id().cast("string")))
    # header values hold no line ends
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    host = F.regexp_extract(uri, r"^[^/]*//([^/?#]*)", 1)

    def record(kind: str, rid: Column, type_: str, block: Column, *more: Column) -> Column:
        head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:capture:"), rid, F.lit(">\r\nWARC-Date: " + DATE),
                        F.lit("\r\nWARC-Target-URI: "), uri, *more, F.lit(f"\r\nContent-Type: {type_}\r\nContent-Length: "),
                        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
        return F.concat(head, block)

    def named(suffix: str) -> Column:
        return F.concat("capture", F.lit(suffix))

    concurrent = F.concat(F.lit("\r\nWARC-Concurrent-To: <urn:capture:"), named(":response"), F.lit(">"))
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"))
    refers = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    response = F.when(F.col("refers_to").isNull(), record(
        "response", named(":response"), "application/http; msgtype=response", F.concat(F.lit(HTTP), F.col("html")), digest)).otherwise(record(
            "revisit", named(":response"), "application/http; msgtype=response", F.lit(HTTP), digest, refers))
    request = record("request", named(":request"), "application/http; msgtype=request",
                     F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")), concurrent)
    metadata = record("metadata", named(":metadata"), "application/warc-fields", F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayload-length: "),
        F.col("n_bytes").cast("string"), F.lit("\r\n")), concurrent)
    (rows.select(F.explode(F.array(request, response, metadata)).alias("value")).write
     .option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record is cut off")
        yield head, block


RECORD = ("kind string, record_id string, concurrent_to string, uri string, refers_to string, digest string, "
          "payload_digest string, payload_bytes bigint, page_id bigint, payload string")


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives; ``payloads=False`` leaves the payload text NULL (its digest and length are kept)."""
    def make():
        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for blob in batch.column("content"):
                with gzip.open(pa.BufferReader(blob.as_buffer())) as stream:
                    for head, block in records_of(stream):
                        kind, body, page, size = head["warc-type"], None, None, None
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            size = len(body)
                        elif kind == "metadata":
                            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                            size = int(fields["payload-length"])
                            page = int(fields["page-id"]) if fields.get("page-id") else None
                        yield (kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-target-uri"),
                               head.get("warc-refers-to"), (head.get("warc-payload-digest") or ":").partition(":")[2] or None,
                               None if body is None else hashlib.sha256(body).hexdigest(), size, page,
                               body.decode("utf-8", "replace") if payloads and body is not None else None)

        names = [x.split()[0] for x in RECORD.split(", ")]

        def step(batch: pa.RecordBatch) -> dict | None:
            found = list(rows(batch))
            return dict(zip(names, map(list, zip(*found)))) if found else None
        return step

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_map(files, make, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: structs ``request``, ``response`` and ``metadata``, joined through concurrent-to.

    A request or metadata record without its response is left out, a response without them has NULL structs.
    """
    body = F.struct("record_id", "kind", "uri", "refers_to", "digest", "payload_digest", "payload_bytes", "payload")
    responses = records.filter("kind IN ('response', 'revisit')").select("record_id", body.alias("response"))
    requests = records.filter("kind = 'request'").select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", "uri").alias("request"))
    metadata = records.filter("kind = 'metadata'").select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", "page_id", "payload_bytes").alias("metadata"))
    return responses.join(requests, "record_id", "left").join(metadata, "record_id", "left")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {SMALLEST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head IS DISTINCT FROM page_id THEN head END AS refers_to, url
FROM f
"""


@query("op7_warc", ORACLE)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = assemble(read_records(spark, path, payloads=False))
    revisit = F.col("response.kind") == "revisit"
    return rows.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.when(revisit, F.col("response.digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(revisit, F.regexp_extract("response.refers_to", r"<urn:page:(-?\d+)>", 1).cast("bigint")).alias("refers_to"),
        F.col("response.uri").alias("url"))
