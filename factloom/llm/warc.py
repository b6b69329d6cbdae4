r"""WARC archives with revisit records for repeated payloads.

Writing: the headers (page_id, SHA-1 of the payload) are grouped by digest,
without their payloads; the smallest page_id of a repeated digest is its
response and the others become revisit records with fresh headers and no
payload. Up to BROADCAST_DIGESTS repeated digests are broadcast to the pages;
beyond, only pages whose digest may be a repeated one (by a Bloom filter of
bounded size) are shuffled to be joined with them, and all others, in most
crawls nearly all, are written from where they were read.

Every record is a gzip member of its own, so that a reader can start at any
record, and the `\r\n\r\n` that ends a record is a constant member after it.
That constant is the line separator of Spark's text writer and reader: archives
land in any file system that Spark writes to, and are read in splits, record by
record. No file is ever held whole, whatever its size.

Reading: each record is unpacked and held against its digest. Revisits are
resolved by shuffling the headers by digest and joining each revisit to the
response that it refers to.

Defined results: a null payload is empty; payloads below min_bytes are always
responses; rows of a page_id that is the smallest of its digest are all
responses; null page_ids are responses unless their digest also has an id;
a null url is left out of the header, control characters in urls are
percent-encoded; repeated rows are repeated records, each with an id of its
own, and then revisits name their response by digest and page alone; other
columns are not looked at; an empty table gives an empty archive, which reads
as no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.bits import filter_of
from factloom.llm.common import join_hot, materialize

#: The end of a record as a gzip member, and as text of one character a byte, for Spark's option.
_END = gzip.compress(b"\r\n\r\n", 9, mtime=0)
SEPARATOR, ENCODING = _END.decode("latin-1"), "ISO-8859-1"
#: Repeated digests of up to so many rows (of about 40 bytes) are broadcast.
BROADCAST_DIGESTS = 1 << 17
_EMPTY_DIGEST = hashlib.sha1(b"").digest()
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs in RFC 4122


def _pages(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return chosen.withColumn("digest", F.unhex(F.sha1("payload")))


def repeated_payloads(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The digests that several rows have: digest, original (its smallest page_id; null: all are responses) and whether a page has it twice. pages: page_id, payload, digest."""
    by_page = pages.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max(F.length("payload")).alias("bytes"))
    groups = by_page.groupBy("digest").agg(F.min("page_id").alias("original"), F.sum("n").alias("rows"), (F.max("n") > 1).alias("twice"), F.max("bytes").alias("bytes"))
    return groups.where("rows > 1").select("digest", F.when(F.col("bytes") >= min_bytes, F.col("original")).alias("original"), "twice")


def _key(digest: Column) -> Column:
    """The first eight bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long")


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload, digest) with record_type, refers_to and whether a page has its digest twice; revisits lose their payload."""
    spark = pages.sparkSession
    repeated = materialize(repeated_payloads(pages, min_bytes), "repeated")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    decided = {
        "payload": F.when(~again, F.col("payload")),
        "record_type": F.when(again, "revisit").otherwise("response"),
        "refers_to": F.when(again, F.col("original")),
        "twice": F.coalesce("twice", F.lit(False)),
    }
    if repeated.count() <= BROADCAST_DIGESTS:
        return pages.join(F.broadcast(repeated), "digest", "left").withColumns(decided).drop("original")
    shared = spark.sparkContext.broadcast(filter_of(repeated.select(_key(F.col("digest")))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = np.frombuffer(b"".join(b"\0" + d[:7] for d in batch.column("digest").to_pylist()), ">u8").astype(np.uint64)
            maybe = np.zeros(len(head), bool)
            maybe[shared.value.passing(head)] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*batch.schema.names, "maybe"])

    marked = pages.mapInArrow(mark, T.StructType([*pages.schema.fields, T.StructField("maybe", T.BooleanType())]))
    looked_up = marked.where("maybe").drop("maybe").join(repeated, "digest", "left").withColumns(decided).drop("original")
    single = marked.where("NOT maybe").drop("maybe").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long"), "twice": F.lit(False)})
    return looked_up.unionByName(single)


def record_id(page_id: int | None, digest: bytes, extra: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest.hex()}{extra}')}>"


_URI_SAFE = ":/?#[]@!$&'()*+,;=%-._~ "


def _header(row: dict, size: int, date: str, number: str) -> bytes:
    own = record_id(row["page_id"], row["digest"], number if row["twice"] else "")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if row["url"]:
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe=_URI_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(row['digest']).decode()}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        if not row["twice"]:
            lines.append(f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'])}")
        lines.append(f"X-Refers-To-Page-ID: {row['refers_to']}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def pack(record: bytes) -> bytes:
    """A gzip member that does not hold the separator."""
    for level in (6, 9, 1, 0):
        member = gzip.compress(record, level, mtime=0)
        if _END not in member:
            return member
    raise ValueError("a record that no level packs without the separator")


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z"
) -> None:
    """Writes a deduplicated archive of all pages: a folder of WARC files, a gzip member for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            records, held = [], 0
            for row in batch.to_pylist():
                payload = row["payload"] or b""
                records.append(pack(_header(row, len(payload), date, f":{task}:{n}") + payload))
                n += 1
                held += len(records[-1])
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])
                    records, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    records = decide(_pages(pages, id_col, url_col, payload_col), min_bytes).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("encoding", ENCODING).text(path)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, from its gzip member."""
    record = zlib.decompress(member, 31)
    head, mark, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record is not as long as it says")
    return fields, block


RECORDS = "page_id long, record_id string, url string, record_type string, payload_digest string, refers_to long, block_bytes long, block binary"


def read_archive(spark: SparkSession, path: str, with_blocks: bool = False) -> DataFrame:
    """One row a record of an archive that write_archive wrote; the digest is checked against the block of every response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for member in batch.column(0):
                fields, block = parse_record(member.as_py())
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(block).digest() if block else _EMPTY_DIGEST).decode() != digest:
                    raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                rows.append((int(page) if page else None, fields["warc-record-id"], fields.get("warc-target-uri"), kind, digest, int(refers) if refers else None, len(block), block if with_blocks else None))
                held += len(block) * with_blocks
                if len(rows) >= 2000 or held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    members = spark.read.schema("value string").option("lineSep", SEPARATOR).option("encoding", ENCODING).text(path)
    return members.select(F.col("value").cast("binary")).where(F.length("value") > 0).mapInArrow(run, RECORDS)


def join_revisits(records: DataFrame) -> DataFrame:
    """records with payload_bytes: a revisit's from the response with its digest that it refers to, joined by digest."""
    headers = records.select("page_id", "record_type", "payload_digest", "refers_to", "block_bytes")
    is_revisit: Column = F.col("record_type") == "revisit"
    responses = headers.where(~is_revisit).groupBy("payload_digest").agg(F.max("block_bytes").alias("original_bytes"))
    revisits = join_hot(headers.where(is_revisit), responses, ["payload_digest"], "left")
    # lengths are equal wherever digests are, so responses keep their own
    own = headers.where(~is_revisit).withColumn("payload_bytes", F.col("block_bytes"))
    return own.unionByName(revisits.withColumn("payload_bytes", F.col("original_bytes")).drop("original_bytes"))
