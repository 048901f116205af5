"""Content-addressed web archive: payload bytes once, record headers apart, records by join."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.llm import common

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The digits of base 32 in Java's conversion and in RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hex digits make eight base-32 digits."""
    hex_ = F.sha1(data)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(hex_, 1 + 10 * i, 10), 16, 32), 8, "0"), DIGITS, BASE32) for i in range(4)])


def record_id(key: Column) -> Column:
    """A urn:uuid from the id's MD5, so that a second run writes the same records."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


@dataclass
class Archive:
    """headers: content_sha256 and the record's exact header block; payloads: content_sha256 and the bytes."""

    spark: SparkSession
    path: str

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.schema("content_sha256 string, header string").parquet(f"{self.path}/headers")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.schema("content_sha256 string, payload binary").parquet(f"{self.path}/payloads")

    def verified(self) -> DataFrame:
        """The payloads, each checked against its address; a wrong byte fails the read."""
        ok = F.sha2("payload", 256) == F.col("content_sha256")
        return self.payloads.select("content_sha256", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "content_sha256")).cast("binary")).alias("payload"))

    def records(self) -> DataFrame:
        """The original records: header block, payload (for a revisit nothing) and the closing blank lines."""
        stored = F.instr("header", f"{CRLF}WARC-Type: response{CRLF}") > 0
        body = F.when(stored, F.col("payload")).otherwise(F.lit(b""))
        joined = self.headers.join(self.verified(), "content_sha256")
        return joined.select(F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))


def _named(header: Column, name: str) -> Column:
    """A header field's value, null where the record has none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.instr(header, f"{CRLF}{name}: ") > 0, found)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes a record per row into `path`, a folder that all nodes share.

    Of records with equal payloads of at least `least_bytes` bytes the one with the
    smallest id is a response and the others are revisits that refer to it; smaller
    payloads are responses all. A null payload is empty; a null url has no
    WARC-Target-URI; a null id counts as greatest and its record has no X-Source-Id.
    Rows that repeat an id with the same payload are of one type. Line breaks inside a url
    are percent-encoded in the header.

    One shuffle carries payloads, and copies are folded before it, so a payload that a
    third of all rows share crosses the network once a task. The shuffle that gives each
    row its response's id carries ids and digests only."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("content_sha256", F.sha2("payload", 256))
    stored = rows.groupBy("content_sha256").agg(F.first("payload").alias("payload"), F.min("id").alias("keeper"))
    stored.write.parquet(f"{path}/payloads")
    keepers = pages.sparkSession.read.schema(stored.schema).parquet(f"{path}/payloads").select("content_sha256", "keeper")
    slim = rows.select("id", "url", "content_sha256", F.octet_length("payload").cast("long").alias("size"), sha1_base32(F.col("payload")).alias("sha1"))
    joined = slim.join(keepers, "content_sha256")
    revisit = (F.col("size") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("keeper"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    none = F.lit("")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("keeper"))), F.coalesce(line("X-Refers-To-Source-Id", F.col("keeper")), none), line("WARC-Profile", F.lit(PROFILE)))).otherwise(none),
        F.coalesce(line("X-Source-Id", F.col("id")), none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
        F.lit(CRLF),
    )
    joined.select("content_sha256", header.alias("header")).write.parquet(f"{path}/headers")
    return Archive(pages.sparkSession, path)


def read(archive: Archive, id_type: str = "bigint") -> DataFrame:
    """What the archive holds, a row per record: page_id, payload_bytes, payload_digest,
    record_type, refers_to, all from the records that `records` rebuilds. A response's
    bytes and digest are computed anew from its body, whose length and digest must equal
    the header's; a revisit, whose body is empty, has those of the response with its digest."""
    record, text = F.col("record"), F.col("record").cast("string")
    h = F.substring_index(text, CRLF + CRLF, 1)  # urls have no line breaks, so the first blank line ends it
    cut = archive.records().select(record, F.concat(h, F.lit(CRLF)).alias("header"))
    start = F.octet_length("header") + 2
    body = F.substring(record, start + 1, F.octet_length(record) - start - 4)
    cut = cut.select("header", body.alias("body"))
    h, size = F.col("header"), F.octet_length("body").cast("long")
    said = F.substring(_named(h, "WARC-Payload-Digest"), 6, 32)
    response = _named(h, "WARC-Type") == "response"
    wrong = lambda text: F.raise_error(F.lit(text)).cast("string")
    digest = F.when(_named(h, "Content-Length").cast("long") != size, wrong("a record's length differs from its body's")).when(response & (said != sha1_base32(F.col("body"))), wrong("a record's digest differs from its payload's")).otherwise(said)
    found = cut.select(
        _named(h, "X-Source-Id").cast(id_type).alias("page_id"), F.when(response, size).alias("size"), digest.alias("payload_digest"),
        _named(h, "WARC-Type").alias("record_type"), _named(h, "X-Refers-To-Source-Id").cast(id_type).alias("refers_to"),
    )
    found = common.written(found, "archive-records")
    stored = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("size").alias("stored"))
    joined = found.join(stored, "payload_digest", "left")
    bytes_ = F.coalesce("size", "stored", wrong("a revisit's response is missing").cast("long"))
    return joined.select("page_id", bytes_.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the pages into a new archive in the shared folder and reads it back."""
    path = f"{common.shared_dir(pages.sparkSession).rstrip('/')}/archive-{uuid.uuid4().hex}"
    return read(write(pages, path, id_col, url_col, payload_col, least_bytes), pages.schema[id_col].dataType.simpleString())
