"""Content-addressed web archive.

Two written tables make an archive: ``payloads`` holds each distinct payload
once, under a strong digest (SHA-256 and length), and ``records`` holds the
exact header bytes of every WARC/1.1 record with the digest of its payload.
Records whose payload another record holds already are ``revisit`` records.
Reading back recomputes each stored payload's digest, and joins headers and
payloads to the original record bytes.  All of it is built-in functions; the
payload bytes are shuffled once, to store one copy of each, and header rows
are small.

Cases: null html is the empty payload; null url gives an empty target, and line
ends in a url are percent-encoded, as a header line can't hold them; a null
page_id is an ordinary record that never is another's original unless no id is
known, when the payload's records all are responses; repeated rows with one
page_id give the same record once each; an empty table gives empty archives;
other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

# Digits of base 32 as Java's conv writes them, and as RFC 4648 does; fixed parts of records.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 160 bits are eight groups of twenty, each four digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def record_id(page_id: Column, url: Column) -> Column:
    """A name-based id, the same each time the same record is written."""
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), url))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3),
                    F.lit("-"), part(21, 12), F.lit(">"))


@dataclass(frozen=True)
class Archive:
    """Paths of the two tables of an archive."""

    payloads: str
    records: str


def _headers(kind: Column, date: str) -> Column:
    """Header block of a record, with the HTTP head that its block begins with."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit(HTTP_HEAD + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = kind == "revisit"
    body = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"))),
        F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"),
                                 line("WARC-Refers-To", F.col("first_record")),
                                 line("X-Refers-To-Page", F.col("first_page").cast("string")))).otherwise(F.lit("")),
        line("X-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.length(http) + body).cast("string")), F.lit("\r\n"), http)


def write_archive(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", path: str | None = None) -> Archive:
    """Write the archive of ``pages`` (page_id, url, html) and give its paths.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one
    with the smallest page_id is the response and the others revisit it.
    """
    spark = pages.sparkSession
    base = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    out = Archive(f"{base}/payloads", f"{base}/records")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    keyed = (pages.select("page_id", url.alias("url"), payload.alias("payload"))
             .withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("key", F.sha2("payload", 256)))
    # bytes: one copy per digest, whatever the number of records
    (keyed.groupBy("key", "payload_bytes").agg(F.first("payload").alias("payload"))
     .write.option("compression", "zstd").parquet(out.payloads))
    small = keyed.select("page_id", "url", "payload_bytes", "key", sha1_base32(F.col("payload")).alias("payload_digest"))
    named = (small.where("page_id is not null").groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("f"))
             .select("key", F.col("f.page_id").alias("first_page"), record_id(F.col("f.page_id"), F.col("f.url")).alias("first_record")))
    joined = small.join(named, "key", "left")
    kind = F.when((F.col("payload_bytes") >= min_bytes) & F.col("first_page").isNotNull()
                  & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_page"))), F.lit("revisit")).otherwise(F.lit("response"))
    (joined.select("page_id", F.encode(_headers(kind, date), "UTF-8").alias("header"), "key")
     .write.option("compression", "zstd").parquet(out.records))
    return out


def verified_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """The stored payloads with their recomputed digest; ``intact`` says whether it is the one they are stored under."""
    p = spark.read.parquet(archive.payloads)
    return p.select("key", "payload", F.length("payload").cast("long").alias("stored_bytes"), sha1_base32(F.col("payload")).alias("stored_digest"),
                    ((F.sha2("payload", 256) == F.col("key")) & (F.length("payload") == F.col("payload_bytes"))).alias("intact"))


def _header(name: str) -> Column:
    return F.regexp_extract(F.decode(F.col("header"), "UTF-8"), rf"(?md)^{name}: ([^\r\n]*)\r?$", 1)


def read_index(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record from the archived headers, joined to the verified size and digest of its payload (no payload bytes)."""
    records = spark.read.parquet(archive.records)
    refers = _header("X-Refers-To-Page")
    parsed = records.select(
        "page_id", "key", _header("WARC-Type").alias("record_type"), _header("WARC-Target-URI").alias("url"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"),
        F.when(refers != "", refers).cast(records.schema["page_id"].dataType).alias("refers_to"))
    stored = verified_payloads(spark, archive).drop("payload")
    return parsed.join(stored, "key").select(
        "page_id", "url", "record_type", "refers_to", F.col("stored_bytes").alias("payload_bytes"), F.col("stored_digest").alias("payload_digest"),
        (F.col("intact") & (F.col("stored_digest") == F.col("header_digest"))).alias("intact"))


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The exact bytes of each record and its full payload (a revisit's comes from the record it refers to)."""
    records = spark.read.parquet(archive.records)
    joined = records.join(verified_payloads(spark, archive), "key")
    tail = F.lit("\r\n\r\n").cast("binary")
    body = F.when(_header("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.select("page_id", F.concat("header", body, tail).alias("record"), "payload", "intact")


def read_pages(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, url, html and payload's size and digest of every page, with its record_type and refers_to, all taken from rebuilt records.

    A response's record is put together from its headers and the stored bytes and taken apart
    again; a revisit's has no payload, its page has that of the payload's
    own verified record (``html`` is null there, so that a payload isn't copied for each revisit).
    """
    records = spark.read.parquet(archive.records)
    kind = records.schema["page_id"].dataType
    text = lambda name: F.when(_header(name) != "", _header(name))
    parsed = records.select(
        text("X-Page").cast(kind).alias("page_id"), _header("WARC-Target-URI").alias("url"), text("WARC-Type").alias("record_type"),
        text("X-Refers-To-Page").cast(kind).alias("refers_to"), F.regexp_replace(text("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"),
        text("Content-Length").cast("long").alias("block"), "header", "key")
    revisit = F.col("record_type") == "revisit"
    stored = verified_payloads(spark, archive)
    record = F.concat("header", "payload", F.lit("\r\n\r\n").cast("binary"))
    whole = parsed.where(~revisit).join(stored, "key").withColumn("record", record)
    # behind the headers, up to the two line ends that close a record
    html = F.expr("substring(record, length(header) + 1, length(record) - length(header) - 4)")
    head = F.length("header") - F.length(F.regexp_extract(F.decode("header", "UTF-8"), "(?s)^.*?\r\n\r\n", 0).cast("binary"))
    responses = whole.withColumn("html", html).select(
        "page_id", "url", "html", "record_type", "refers_to", F.length("html").cast("long").alias("payload_bytes"), sha1_base32(F.col("html")).alias("payload_digest"),
        (F.col("intact") & (sha1_base32(F.col("html")) == F.col("header_digest")) & (F.col("block") == head + F.length("html"))).alias("intact"))
    revisits = parsed.where(revisit).join(stored.drop("payload"), "key").select(
        "page_id", "url", F.lit(None).cast("binary").alias("html"), "record_type", "refers_to", F.col("stored_bytes").alias("payload_bytes"),
        F.col("stored_digest").alias("payload_digest"), (F.col("intact") & (F.col("stored_digest") == F.col("header_digest")) & (F.col("block") == head)).alias("intact"))
    return responses.unionByName(revisits)
