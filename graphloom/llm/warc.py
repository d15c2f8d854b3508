"""WARC archives with revisit records.

Headers (id, address, payload digest, size) are shuffled by digest, repeated payloads become revisits of the record
with the smallest id, and archives are written with fresh headers by Spark's text writer, each record a gzip member of
its own, as usual for such archives. Reading back parses records by their Content-Length and resolves revisits
by a join with the responses of their digest. Payloads are shuffled once, by id, never by digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FILE_BYTES = 16 << 20  # before compression
#: Spark's text writer wants something between rows: an empty gzip member, which decompresses to nothing.
BETWEEN = gzip.compress(b"", mtime=0)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text: 20 bits of the hex digest become four digits of base 32."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(key.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * bool(k) + [F.substring(h, a, n)])], F.lit(">"))


def write_archives(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each row: a response with its payload or, from `least` payload bytes on, a revisit of the row with the smallest key.

    A null payload is empty; a null key comes after all others; rows that repeat key and payload are written alike (the
    smallest key's are all responses). Line ends within an address are percent-encoded. Files hold about file_bytes.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("u"), F.coalesce(F.col(payload), F.lit("")).alias("p"))
    rows = rows.withColumn("d", base32_sha1(F.col("p")))
    heads = rows.select("k", "u", "d", F.octet_length("p").alias("n"))  # read again where needed: it costs less than keeping it
    firsts = heads.where(F.col("n") >= least).groupBy("d").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("k").isNull().alias("none"), "k", "u")).alias("first")).where(F.col("times") > 1)
    again = heads.where(F.col("n") >= least).join(firsts.select("d", F.col("first.k").alias("fk"), F.col("first.u").alias("fu")), "d").where(~F.col("k").eqNullSafe(F.col("fk")))
    same = F.concat_ws(" ", F.coalesce(F.col("k").cast("string"), F.lit("")), "d").alias("same")
    again = again.select(same, "fk", "fu", F.lit(True).alias("again")).distinct()
    total = heads.agg(F.sum(F.col("n") + 600)).first()[0] or 0
    files = max(1, -(-int(total) // file_bytes))
    rows = rows.withColumn("same", same).repartition(files, "same").join(again, "same", "left")  # dealt to files and joined at once
    revisit = F.col("again").isNotNull()
    body = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("p")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("fk"), F.col("d"))), line("WARC-Refers-To-Target-URI", F.col("fu")))
    head = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("k"), F.col("d"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("u")),
        line("WARC-Source-Key", F.coalesce(F.col("k").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    ]
    records = rows.select(F.concat(*head, body, F.lit("\r\n\r\n")).cast("binary").alias("record")).mapInArrow(_members, "record binary")
    records.select(F.col("record").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).text(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            made = [gzip.compress(x.as_py(), 4, mtime=0) for x in batch.column(0).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])


def members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The gzip members of an archive, one by one; what follows a member is copied a step at most."""
    at = 0
    while at < len(data):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            chunk = data[at : at + step]
            if not chunk:
                raise ValueError("an archive is cut short")
            parts.append(reader.decompress(chunk))
            at += len(chunk) - len(reader.unused_data)
        yield b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"a WARC record is cut short at byte {at}")
        yield head, block
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, record_type, digest, url, payload_bytes, payload): of responses as found, digest computed anew; of revisits the payload's columns are null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in (x for member in members(content.as_py()) for x in parse_records(member)):
                    response = head["warc-type"] == "response"
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if response else None
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else head["warc-payload-digest"].removeprefix("sha1:")
                    if response and f"sha1:{digest}" != head["warc-payload-digest"]:
                        raise ValueError(f"the payload of {head['warc-record-id']} does not have its digest")
                    rows.append((int(head["warc-source-key"]) if head["warc-source-key"] else None, head["warc-type"], digest, head["warc-target-uri"], payload and len(payload) if response else None, payload))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = pa.schema([("key", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        cols[4] = [None if p is None else len(p) for p in cols[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(work, "key long, record_type string, digest string, url string, payload_bytes long, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records (key, record_type, digest, payload_bytes, ...) with payload_bytes of the response of their digest, and refers_to, its key, for revisits.

    Leave out payloads: what is given is kept for the join. Where several responses share a digest, the smallest key counts.
    """
    heads = settle(records)
    rest = [c for c in heads.columns if c not in ("key", "record_type", "digest", "payload_bytes", "refers_to")]
    heads = heads.select("key", "record_type", "digest", *rest, "payload_bytes")
    found = heads.where(F.col("record_type") == "response").groupBy("digest").agg(F.min("key").alias("_first"), F.first("payload_bytes").alias("_bytes"))
    revisits = heads.where(F.col("record_type") == "revisit").join(found, "digest", "left")
    revisits = revisits.select("key", "record_type", "digest", *rest, F.col("_bytes").alias("payload_bytes"), F.col("_first").alias("refers_to"))
    return heads.where(F.col("record_type") != "revisit").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
