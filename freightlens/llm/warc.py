"""WARC archives with revisit records for repeated payloads.

1. Headers (id, digest and length of each payload) are shuffled by digest; of
   equal payloads the one with the greatest id is the original. Minima and
   maxima combine map-side, and the table of repeated digests is written
   before it is joined back, so a payload that very many records share is
   split over tasks.
2. Archives are written with fresh headers: the original as a response, the
   others as revisits that refer to it and carry no payload. Each archive is a
   file of Spark's text writer, one record a row, with the record separator as
   line separator; the files go to the shared folder, gzipped unless told
   otherwise. Each writing task deals its records to files by the running sum
   of their bytes: no file holds more than ``FILE_BYTES`` and one record.
3. Archives are read back file by file and cut by their Content-Length, never
   by searching for separators, so payloads may hold anything.

Defined results: a null payload is empty; a null url is left out of the
header; rows that share an id and a payload are written as equal records of
the same type; payloads shorter than ``min_bytes`` are always responses;
columns other than the three named are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.plans.session import checkpoint_dir, materialise

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

FILE_BYTES = 64 << 20  # of records, before compression
RECORD_ID = "<urn:page:"  # of the record: this, the id and ">"


def sha1_base32(payload: Column) -> Column:
    """The upper-case base32 form of the SHA-1: eight digits per five bytes."""
    hexed = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def payload_headers(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``(id, digest, n_bytes)`` of every row."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    return pages.select(
        F.col(id_col).cast("long").alias("id"),
        sha1_base32(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(id, digest, original)`` for the headers that revisit another."""
    spark = headers.sparkSession
    headers = materialise(spark, headers.where("id is not null"), "warc-headers")
    groups = headers.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes")
    groups = groups.agg(F.min("id").alias("least"), F.max("id").alias("original"))
    groups = groups.where("least < original").drop("least")
    groups = materialise(spark, groups, "warc-originals")
    revisits = headers.join(groups, ["digest", "n_bytes"]).where("id < original")
    return materialise(spark, revisits.select("id", "digest", "original").distinct(), "warc-revisits")


def records(
    pages: DataFrame, revisits: DataFrame, date: str, id_col: str, url_col: str, payload_col: str
) -> DataFrame:
    """One column ``record``: the text of each page's WARC record."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        sha1_base32(F.encode(payload, "UTF-8")).alias("digest"),
    ).join(revisits, ["id", "digest"], "left")
    n_bytes = F.octet_length("payload")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        n_bytes.cast("string"),
        F.lit(END),
    )
    revisit = F.col("original").isNotNull()
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(n_bytes)
    named_url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    empty = F.lit("")
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"\r\nWARC-Record-ID: {RECORD_ID}"),
        F.coalesce(F.col("id").cast("string"), empty),
        F.lit(f">\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), named_url), empty),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: {RECORD_ID}"),
                F.col("original").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(empty),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        block_bytes.cast("string"),
        F.lit(END),
    )
    body = F.when(revisit, empty).otherwise(F.col("payload"))
    return rows.select(F.concat(head, http, body).alias("record"))


def dealt(rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``(file, record)``: the number of the record's file within its task, from
    the bytes of the records before it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            file = pa.array(starts // file_bytes, pa.int64())
            yield pa.RecordBatch.from_arrays([file, batch.column(0)], ["file", "record"])

    return rows.select("record").mapInArrow(deal, "file long, record string")


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    date: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    compression: str = "gzip",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write every row of ``pages`` as a record of deduplicated archives, dated
    now unless told otherwise."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisits = resolve_revisits(payload_headers(pages, id_col, payload_col), min_bytes)
    rows = dealt(records(pages, revisits, date, id_col, url_col, payload_col), file_bytes)
    writer = rows.write.partitionBy("file").option("lineSep", END)
    writer.option("compression", compression).text(path)


def _headers_of(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _record_id(named: str | None) -> int | None:
    digits = (named or "")[len(RECORD_ID) : -1]
    return int(digits) if digits else None


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, each as its headers and its block."""
    while True:
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                if head.strip():
                    raise ValueError("an archive ends inside a header")
                return
            head += line
        headers = _headers_of(head)
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != END.encode():
            raise ValueError("a record does not end after its length")
        yield headers, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(id, url, record_type, refers_to, digest, own_digest, n_bytes)`` per
    record: ``digest`` is the header's, ``own_digest`` that of the payload in
    the record (null for revisits) and ``n_bytes`` the full payload's length."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                stream = pa.BufferReader(data)
                if bytes(data[:2]) == b"\x1f\x8b":
                    stream = gzip.GzipFile(fileobj=stream)
                found = []
                for headers, block in parse_records(io.BufferedReader(stream, 1 << 20)):
                    http, _, payload = block.partition(END.encode())
                    revisit = headers["warc-type"] == "revisit"
                    own = None if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    found.append(
                        {
                            "id": _record_id(headers["warc-record-id"]),
                            "url": headers.get("warc-target-uri"),
                            "record_type": headers["warc-type"],
                            "refers_to": _record_id(headers.get("warc-refers-to")),
                            "digest": headers["warc-payload-digest"].removeprefix("sha1:"),
                            "own_digest": own,
                            "n_bytes": int(_headers_of(http)["content-length"]) if revisit else len(payload),
                        }
                    )
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=kinds)

    text, long = pa.string(), pa.int64()
    kinds = pa.schema(
        [("id", long), ("url", text), ("record_type", text), ("refers_to", long), ("digest", text),
         ("own_digest", text), ("n_bytes", long)]
    )
    schema = (
        "id long, url string, record_type string, refers_to long, digest string, "
        "own_digest string, n_bytes long"
    )
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(parse, schema)


def resolved(read: DataFrame) -> DataFrame:
    """Read records with the digest and length of the payload itself: a
    response's own, a revisit's from the response that it refers to. A revisit
    whose response is missing or has another digest has null there."""
    spark = read.sparkSession
    read = materialise(spark, read, "warc-read")
    full = read.where("record_type = 'response' and id is not null").groupBy("id", "own_digest")
    full = full.agg(F.max("n_bytes").alias("full_bytes"))
    full = full.select(F.col("id").alias("refers_to"), F.col("own_digest").alias("digest"), "full_bytes")
    wanted = read.where("record_type = 'revisit'").select("refers_to").distinct()
    full = materialise(spark, full.join(wanted, "refers_to", "left_semi"), "warc-full")
    revisits = read.where("record_type = 'revisit'").join(full, ["refers_to", "digest"], "left")
    revisits = revisits.select(
        "id", "url", "record_type", "refers_to", F.when(F.col("full_bytes").isNotNull(), F.col("digest"))
        .alias("digest"), F.col("full_bytes").alias("n_bytes"),
    )
    own = read.where("record_type = 'response'")
    own = own.select("id", "url", "record_type", "refers_to", F.col("own_digest").alias("digest"), "n_bytes")
    return own.unionByName(revisits)


def archive_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/archives/{name}"
