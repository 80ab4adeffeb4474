"""WARC archives of pages: one gzip member per record, written and read sequentially."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.session import ship_package
from terraloom.sources.files import scratch

#: Payloads below this size are never recorded as revisits.
REVISIT_BYTES = 100
#: Compressed bytes that the reader feeds to the decompressor at a time.
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The date that records of one input carry, so that a repeated run writes the same bytes.
DATE = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """A record that breaks framing, compression or a digest."""


def record(page_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: the WARC header, the HTTP header and, unless the record is a revisit, the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    block = HTTP if refers_to is not None else HTTP + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean_value(v)}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def clean_value(value: str) -> str:
    """Header values hold no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def records(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, in order.

    Members are decompressed piece by piece; a member must hold one record, framed by its Content-Length. Zero bytes
    between members are padding.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        unpacker, out = zlib.decompressobj(31), bytearray()
        while not unpacker.eof:
            if at >= len(view):
                raise ArchiveError("archive ends inside a record")
            piece = view[at:at + CHUNK]
            try:
                out += unpacker.decompress(piece)
            except zlib.error as error:
                raise ArchiveError(f"bad gzip member: {error}") from None
            at += len(piece) - len(unpacker.unused_data)
        end = out.find(b"\r\n\r\n")
        lines = out[:max(end, 0)].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ArchiveError("no WARC header")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        if len(out) != end + 4 + size + 4 or out[-4:] != b"\r\n\r\n":
            raise ArchiveError("record length differs from Content-Length")
        block = bytes(out[end + 4:end + 4 + size])
        if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ArchiveError("block digest differs")
        yield head, block


def parsed(head: dict[str, str], block: bytes) -> tuple[str, str, bytes | None, int, str, str, str | None]:
    """(page_id, url, payload, payload_bytes, digest, record type, refers_to); a response's payload is checked against its digest."""
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["WARC-Payload-Length"])):
        raise ArchiveError("payload digest differs")
    return head["WARC-Page-ID"], head["WARC-Target-URI"], payload, int(head["WARC-Payload-Length"]), digest, kind, head.get("WARC-Refers-To-Page-ID")


def write_archives(pages: DataFrame, folder: str) -> None:
    """Archives of about one input partition each, a record per row of `pages` (page_id, url, html).

    Of the rows with an equal payload of at least REVISIT_BYTES, those with the smallest page_id are responses and the
    others revisits of it. Digests alone are grouped (minima combine map-side) and only the revisits' ids are joined back,
    so a payload that a third of the pages share is never gathered.

    Null html is an empty payload, a null url an empty one; a row without page_id is a response that names no page and
    that nothing refers to. Repeated rows give a record each; other columns are ignored; no rows give no records.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    large = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= REVISIT_BYTES)).select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"))
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    again = large.join(first, "digest").where("page_id > refers_to").select(
        "page_id", "refers_to", F.substring("digest", 1, 8).alias("start")).distinct()
    again = again.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("start", "refers_to"))).alias("seen"))
    joined = rows.join(again, "page_id", "left").withColumn("refers_to", F.try_element_at("seen", F.substring(F.unhex(F.sha2("html", 256)), 1, 8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    body = record("" if page_id is None else str(page_id), url, html.encode(), None if refers_to is None else str(refers_to))
                    # the writer puts a zero byte after each value: the last byte of a member of less than 16 MB, padding after others
                    out.append(body[:-1] if body[-1] == 0 else body)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    packed = joined.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, url, html]) of every record; bad records raise ArchiveError.

    A file is one row to Spark and its records stream through one decompressor each, so memory is a file and a record.
    """
    names = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    number = lambda v: int(v) if v else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for head, block in records(data.as_buffer()):
                    page_id, url, payload, size, digest, kind, refers_to = parsed(head, block)
                    row = (number(page_id), size, digest, kind, number(refers_to))
                    rows.append(row + (url, None if payload is None else payload.decode()) if payloads else row)
                    if len(rows) == 2000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"][:len(rows[0])])

    ship_package(spark)
    files = spark.read.format("binaryFile").load(folder)
    return files.where("length > 0").select("content").mapInArrow(run, names + (", url string, html string" if payloads else ""))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to shared storage and read them back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder)
