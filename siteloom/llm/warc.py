"""Operator 10: a content-addressed WARC archive, in DataFrame operations only.

Two tables under one folder: `payloads` holds each distinct payload once under its SHA-256, `records` holds every record's exact
header block, its type and the digest of its payload. `records_with_payload` joins them to the original record bytes. An address
is verified twice: at writing, rows that share it must agree in length, SHA-1 and a 64-bit hash; at reading, the stored bytes must
give the address again. A failure raises.

Defined results: null html is an empty payload; a null url has no target line and is read back as null; CR, LF and the escape sign
\\ of a url are written as \\r, \\n and \\\\, as a header line can't hold them, and read back as they were; records that tie in payload and
largest page_id are all responses; null page_ids are written as 'null' and read back as null; payloads of any length are one value;
other columns are never read and may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, release, scratch_path

#: Payloads from this many bytes on are revisited; smaller ones cost less than the revisit record.
REVISIT_FROM = 1000
CRLF = "\r\n"
_NULL_ID = -(1 << 63)
LINE_ESCAPES = [("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n")]


def _payload(col: str) -> Column:
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


def _record_id(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))


def http_head(n_bytes: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n_bytes.cast("string"), F.lit(CRLF * 2))


def header_block(record_type: Column, page_id: Column, url: Column, sha1: Column, n_bytes: Column, refers_to: Column, date: str) -> Column:
    """All of a record before its payload: WARC header, blank line, HTTP head."""
    target = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), LINE_ESCAPES, url)
    http = http_head(n_bytes)
    revisit = record_type == "revisit"
    content = F.length(http).cast("long") + F.when(revisit, F.lit(0)).otherwise(n_bytes)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), record_type,
        F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(page_id),
        F.lit(f"{CRLF}WARC-Date: {date}"), F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), target), F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), sha1,
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _record_id(refers_to))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), content.cast("string"),
        F.lit(CRLF * 2), http,
    )


def write_archive(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", revisit_from: int = REVISIT_FROM) -> None:
    """Write the records of pages (page_id, url, html) under path."""
    p = _payload("html")
    rows = pages.select("page_id", "url", F.sha2(p, 256).alias("address"), F.sha1(p).alias("sha1"), F.octet_length(p).cast("long").alias("n"), F.xxhash64(p).alias("x"))
    one = [F.min(c).eqNullSafe(F.max(c)) for c in ("sha1", "n", "x")]
    groups = checkpointed(
        rows.groupBy("address")
        .agg(F.max("page_id").alias("holder"), F.assert_true(one[0] & one[1] & one[2], "payloads differ under one digest").alias("_ok"))
        .filter("_ok is null")
        .select("address", "holder")
    )
    held = rows.join(groups, "address")
    first = F.col("page_id").eqNullSafe(F.col("holder"))
    typed = held.withColumn("record_type", F.when(first | (F.col("n") < revisit_from), "response").otherwise("revisit"))
    refers = F.when(F.col("record_type") == "revisit", F.col("holder"))
    typed.select(
        "page_id", "record_type", "address",
        header_block(F.col("record_type"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("n"), refers, date).alias("header"),
    ).write.parquet(f"{path}/records")
    # A payload is stored by the row that holds it. What rows of equal page_id would store twice is dropped by the join's own keys,
    # so payloads are shuffled once.
    row = F.coalesce(F.col("page_id"), F.lit(_NULL_ID))
    holders = groups.select(F.coalesce(F.col("holder"), F.lit(_NULL_ID)).alias("_row"), "address")
    bodies = pages.select(row.alias("_row"), F.sha2(p, 256).alias("address"), p.alias("payload"))
    kept = bodies.join(holders, ["_row", "address"]).dropDuplicates(["_row", "address"])
    kept.select("address", "payload").write.parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """address, payload; raises where the bytes don't give their address."""
    stored = spark.read.parquet(f"{path}/payloads")
    return stored.filter(F.assert_true(F.sha2("payload", 256) == F.col("address"), "a stored payload doesn't match its digest").isNull())


def _target() -> Column:
    """The url of a header block; a backslash pair is set aside while the other signs are restored."""
    line = F.nullif(F.regexp_extract("header", "\r\nWARC-Target-URI: [^\r\n]*\r\n", 0), F.lit(""))
    parts = F.split(F.substring(line, 20, F.length(line) - 21), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\r"), F.lit("\r")), F.lit("\\n"), F.lit("\n"))), "\\")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records, parsed from their header blocks: page_id, url, record_type, refers_to, sha1, address, header."""
    rec = spark.read.parquet(f"{path}/records")
    field = lambda name, what: F.regexp_extract("header", f"\r\n{name}: {what}\r\n", 1)
    number = lambda s: F.expr(f"try_cast({s} as bigint)")
    return rec.select(
        field("WARC-Record-ID", "<urn:page:([^>]*)>").alias("_id"), _target().alias("url"),
        F.regexp_extract("header", "^WARC/1\\.1\r\nWARC-Type: (\\w+)\r\n", 1).alias("record_type"),
        field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("_ref"), field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})").alias("sha1"),
        "address", "header",
    ).select(number("_id").alias("page_id"), "url", "record_type", number("_ref").alias("refers_to"), "sha1", "address", "header")


def records_with_payload(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, sha1, address, header and record: the original record bytes, that is header block, payload, two line
    ends. A revisit has no payload, so only responses meet theirs: no payload of REVISIT_FROM bytes or more is copied."""
    rec, end = read_records(spark, path), F.lit(b"\r\n\r\n")
    head = F.encode("header", "UTF-8")
    own = ["page_id", "record_type", "refers_to", "sha1", "address", "header"]
    responses = rec.filter("record_type = 'response'").join(read_payloads(spark, path), "address").select(*own, F.concat(head, F.col("payload"), end).alias("record"))
    return responses.unionByName(rec.filter("record_type <> 'response'").select(*own, F.concat(head, end).alias("record")))


def archive_digest(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the rebuilt records.

    A response's payload is what stands behind the headers of its record; a revisit, which has none, is given length and digest of the
    payload at its address. Each record must be as long as its own header says, and its payload must give the digest that the header
    names.
    """
    head = F.octet_length(F.encode("header", "UTF-8"))
    block = F.octet_length("record") - 4 - F.octet_length(F.encode(F.substring_index("header", CRLF * 2, 1), "UTF-8")) - 4
    said = F.regexp_extract("header", "msgtype=response\r\nContent-Length: ([0-9]+)\r\n", 1).cast("long")
    long = F.assert_true(block.cast("long") == said, "a record's length isn't its header's").isNull()
    own = ["page_id", "record_type", "refers_to", "sha1", "address"]
    records = records_with_payload(spark, path).filter(long).select(*own, F.substring("record", head + 1, F.octet_length("record") - head - 4).alias("_body"))
    sized = lambda df, body: df.select(*[c for c in own if c in df.columns], F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    responses = sized(records.filter("record_type = 'response'"), "_body")
    # Rows of fixed size on both sides, and both are scans: an address that many revisits share is split.
    revisits = records.filter("record_type <> 'response'").select(*own).join(sized(read_payloads(spark, path), "payload"), "address")
    same = F.assert_true(F.col("sha1") == F.col("payload_digest"), "a header's digest isn't its payload's").isNull()
    return responses.unionByName(revisits.select(*responses.columns)).filter(same).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    release(pages.sparkSession)
    return archive_digest(pages.sparkSession, path)
