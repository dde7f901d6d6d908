"""Web archives without repeated payloads: one response a payload, revisit records for its other captures.

Only headers (digest, length, page) are shuffled by payload digest to choose the response and to make revisit records;
payloads of equal pages meet before their shuffle, so a payload is moved about once. Archives are WARC/1.1 files of Spark's
own text writer, compressed with gzip: a record ends with two line ends, of which the writer's line separator is the second.
So a lost executor repeats a task and no half file is left. Reading cuts a file by the lengths in its headers, checks each
payload against its digest, and joins revisits to the response they name.

Which capture is the response: that with the largest page_id (then url; null is smallest) of those with equal payload.
Rows with equal page_id, url and payload are records of their own, all but one of them revisits. A null payload is empty, a null url or
page_id leaves its header out and is null again when read. Extra columns are ignored, a table without rows gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace.llm.common import small_batches
from sugartrace.session import materialize, scratch_path

LINE = "\r\n"
FILE_BYTES = 16 << 20  # about as much is written to a file; a reader holds one file
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT = ["digest", "payload_bytes", "mark"]  # equal payloads; mark tells texts made to collide in SHA-1 apart


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base 32: ten hexadecimal digits are eight of base 32, whose digits then get their letters."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*parts: Column | str) -> Column:
    """An identifier that a repeated task makes again."""
    digits = F.md5(F.to_json(F.struct(*parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _one_line(url: Column) -> Column:
    for character in "\r\n\t ":
        url = F.replace(url, F.lit(character), F.lit(f"%{ord(character):02X}"))
    return url


def _record(kind: str, made: str, own: Column, block: Column, *extra: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: {kind}{LINE}"),
        _field("WARC-Record-ID", own),
        _field("WARC-Date", F.lit(made)),
        _field("WARC-Target-URI", _one_line(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("X-Page-ID", F.col("page_id").cast("string")),
        *extra,
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(LINE),
        block,
        F.lit(LINE),
    )


def write(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0) -> None:
    """A record for each row. Payloads of fewer than `at_least` bytes are never replaced by a revisit."""
    made = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.select(
        "page_id",
        "url",
        "body",
        payload_digest(F.col("body")).alias("digest"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.xxhash64("body").alias("mark"),
    )
    shared = F.col("payload_bytes") >= at_least
    headers = rows.where(shared) if at_least > 0 else rows
    # Repeated rows are counted where they are read, so none of them gathers in one task.
    headers = headers.groupBy(*CONTENT, "page_id", "url", F.spark_partition_id().alias("part"))
    headers = materialize(headers.agg(F.count("*").alias("rows")))
    chosen = F.max(F.struct("page_id", "url", "part")).alias("first")
    groups = headers.groupBy(*CONTENT).agg(chosen, F.sum("rows").alias("all")).where(F.col("all") > 1)
    groups = materialize(groups.select(*CONTENT, "first"))

    response = record_id(F.lit("response"), "page_id", "url", *CONTENT)
    first = F.struct("page_id", "url", "part").eqNullSafe(F.col("first"))
    revisits = headers.join(groups, CONTENT).withColumn("more", F.col("rows") - first.cast("long")).where("more > 0")
    revisits = revisits.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("more"))))
    original = record_id(F.lit("response"), F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), *CONTENT)
    head = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(2 * LINE))
    revisits = revisits.select(
        _record(
            "revisit",
            made,
            record_id(F.lit("revisit"), "page_id", "url", *CONTENT, "part", "number"),
            head,
            _field("WARC-Profile", F.lit(PROFILE)),
            _field("WARC-Refers-To", original),
            _field("WARC-Refers-To-Target-URI", _one_line(F.col("first.url"))),
            _field("WARC-Refers-To-Date", F.lit(made)),
        ).alias("value")
    )
    whole = F.concat(head, F.col("body"))
    responses = rows.where(shared).groupBy(*CONTENT).agg(F.max(F.struct("page_id", "url")).alias("of"), F.first("body").alias("body"))
    responses = responses.select("of.page_id", "of.url", "body", *CONTENT).select(_record("response", made, response, whole).alias("value"))
    records = responses.unionAll(revisits)
    if at_least > 0:
        small = rows.where(~shared).withColumn("place", F.monotonically_increasing_id())
        own = record_id(F.lit("small"), "page_id", "url", *CONTENT, "place")
        records = records.unionAll(small.select(_record("response", made, own, whole).alias("value")))
    mean = rows.agg(F.avg(F.octet_length("body"))).first()[0] or 0
    a_file = max(1, int(FILE_BYTES // (mean + 1024)))
    records.write.option("lineSep", LINE).option("maxRecordsPerFile", a_file).option("compression", "gzip").text(path)


COLUMNS = (
    "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_record string, payload binary"
)
FIELDS = ("WARC-Record-ID", "WARC-Type", "X-Page-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To")
FORMAT = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("refers_to_record", pa.string()),
        ("payload", pa.binary()),
    ]
)


def cut(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, compressed or not; one that does not follow its lengths is refused."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split(LINE)
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers.get("Content-Length", -1))
        at = end + 4 + size
        if end < 0 or size < 0 or version not in ("WARC/1.0", "WARC/1.1") or content[at : at + 4] != b"\r\n\r\n":
            raise ValueError("not a WARC file, or cut off")
        yield headers, content[end + 4 : at]
        at += 4


def _entry(headers: dict[str, str], block: bytes) -> tuple:
    """A record as a row. A response holds its payload after the HTTP headers, and must match its digest."""
    own, kind, page, url, digest, refers = map(headers.get, FIELDS)
    payload = block[block.find(b"\r\n\r\n") + 4 :] if kind == "response" else None
    digest = (digest or "").removeprefix("sha1:")
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {own} does not match its digest")
    return own, kind, None if page is None else int(page), url, digest, refers, payload


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of all archives in a folder; a revisit has no payload of its own."""
    small_batches(spark, 2)
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [_entry(h, b) for h, b in cut(content.as_py()) if h.get("WARC-Type") in ("response", "revisit")]
                columns = zip(*rows) if rows else [[]] * len(FORMAT)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FORMAT)], schema=FORMAT)

    return files.mapInArrow(parse, COLUMNS)


def resolve(records: DataFrame) -> DataFrame:
    """Headers of all records, revisits with length and page of the response they refer to.

    Headers alone are shuffled, by payload digest and record. A response that most revisits name is one row, and adaptive
    execution splits the revisits that meet it. A revisit whose response is missing keeps nulls.
    """
    own = ["record_id", "record_type", "page_id", "url", "payload_digest"]
    heads = materialize(records.select(*own, "refers_to_record", F.octet_length("payload").cast("long").alias("payload_bytes")))
    responses = heads.where("record_type = 'response'")
    revisits = heads.where("record_type = 'revisit'").drop("payload_bytes")
    originals = responses.select(
        "payload_digest",
        F.col("record_id").alias("refers_to_record"),
        F.col("page_id").alias("refers_to"),
        "payload_bytes",
    )
    found = revisits.join(originals, ["payload_digest", "refers_to_record"], "left")
    columns = [*own, "payload_bytes", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionAll(found.select(*columns))


def rewrite(spark: SparkSession, source: str, target: str, at_least: int = 0) -> None:
    """Archives of `source`, revisits resolved, as deduplicated archives with fresh headers in `target`.

    Revisits are joined to the payload of their response, which is moved once for each of them; a revisit without its response cannot be written and raises.
    """
    records = read(spark, source)
    originals = records.where("record_type = 'response'")
    payloads = originals.select("payload_digest", F.col("record_id").alias("refers_to_record"), F.col("payload").alias("found"))
    revisits = records.where("record_type = 'revisit'").drop("payload").join(payloads, ["payload_digest", "refers_to_record"], "left")
    missing = F.raise_error(F.concat(F.lit("no response for "), F.col("record_id"))).cast("binary")
    revisits = revisits.select("page_id", "url", F.when(F.col("found").isNull(), missing).otherwise(F.col("found")).alias("payload"))
    captures = materialize(originals.select("page_id", "url", "payload").unionAll(revisits))
    write(captures, target, payload="payload", at_least=at_least)


def page_rows(pages: DataFrame) -> DataFrame:
    """Write all pages as deduplicated archives, read them back and resolve them."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    rows = resolve(read(spark, path))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
