"""WARC archives: writing pages as transactions, reading records, assembling captures.

Writing: each page is a request, a response (or, for a payload of at least REVISIT_BYTES that another page
has too, a revisit) and a metadata record, the first and last naming the second as WARC-Concurrent-To.
Of pages with equal payloads that with the largest page_id holds the response and the others refer to it.
Every record is a gzip member of its own. Tasks pack members into archives of about ARCHIVE_BYTES; each
archive is one row that Spark's text sink writes to a file of its own (the sink ends it with a NUL, which
gzip readers take as padding), so archives can be written to any store that Spark writes to.

Reading: archives are read as binary files, member by member; payload length and SHA-1 are taken anew from
the payload read. Assembly joins request, response or revisit, and metadata records through the
concurrent-to identifiers, of which a record may have several, into one nested row per capture; it takes
links of either direction, so archives of other writers are assembled too.

Edge cases: null html is an empty payload; null urls have no target URI; null page_id is no field; among
equal payloads a null page_id refers to the largest that is there, and if all are null all are responses;
several rows with the same page_id and payload are captures each, all responses if that page_id is the
largest; captures may lack the request or metadata, or have several; other columns are ignored; a task holds an
archive and a record in memory, so a very long page takes memory in proportion; an empty table writes no archive and
reads back as no record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REVISIT_BYTES, ARCHIVE_BYTES = 1000, 8 << 20
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f3c1f6e-64a5-4d5e-9d0a-3a6c1c1f8b57")
_WINDOW, _BATCH_BYTES = 1 << 14, 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, type string, uri string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, payload_sha1 string, fields map<string,string>, payload binary"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, key)}>"


def _member(kind: str, own: str, headers: list[tuple[str, str | None]], content: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", _DATE), *headers, ("Content-Length", str(len(content)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + content + b"\r\n\r\n") + packer.flush()


def transaction(page_id: int | None, key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The gzip members of one page."""
    uri = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    own = record_id(key)
    shared = [("WARC-Target-URI", uri)]
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    request = _member("request", record_id(f"request|{key}"), [*shared, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode())
    digests = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        main = _member("response", own, [*shared, *digests], status + payload)
    else:
        main = _member("revisit", own, [*shared, ("WARC-Refers-To", refers_to), ("WARC-Profile", _PROFILE), *digests], status)
    fields = f"page-id: {page_id}\r\n" if page_id is not None else ""
    meta = _member("metadata", record_id(f"metadata|{key}"), [*shared, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], fields.encode())
    return request + main + meta


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    size = 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])
    for batch in batches:
        for i in range(batch.num_rows):
            parts.append(transaction(*(c[i].as_py() for c in batch.columns)))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
                parts, size = [], 0
    if parts:
        yield flush()


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages(page_id, url, html) as archives under path."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("pid"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    light = base.groupBy("page_id", "pid", "digest", F.octet_length("payload").alias("bytes")).agg(F.lit(1).alias("one"))
    same = light.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.concat_ws("|", "keeper", "digest", F.lit("0")))
    types = light.join(same, "digest", "left").select("pid", "digest", refers.alias("refers"))
    # payloads move once, keyed by page and digest, so that many copies of one payload do not meet
    turn = F.row_number().over(Window.partitionBy("pid", "digest").orderBy("url")) - 1
    keyed = base.join(types, ["pid", "digest"]).withColumn("key", F.concat_ws("|", "pid", "digest", turn))
    rows = keyed.select("page_id", "key", "url", "payload", "digest", _record_id("refers").alias("refers"))
    archives = rows.mapInArrow(_pack, "value binary").select(F.col("value").cast("string"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def _record_id(name: str) -> Column:
    """The record id of a key column, as uuid5 of the key in the name space of this writer."""
    raw = F.sha1(F.concat(F.lit(_SPACE.bytes), F.col(name).cast("binary")))
    # version 5 and the variant take the place of six bits of the hash
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    text = F.concat(F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3), F.lit("-"), variant, F.substring(raw, 19, 2), F.lit("-"), F.substring(raw, 21, 12))
    return F.when(F.col(name).isNotNull(), F.concat(F.lit("<urn:uuid:"), text, F.lit(">")))


def _members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of an archive; NULs between or after them are padding."""
    at, view = 0, memoryview(data)
    while True:
        while at < len(view) and view[at] == 0:
            at += 1
        if at >= len(view):
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            part = view[at : at + _WINDOW]
            parts.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> tuple:
    """One record as a row of RECORD."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = [(k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    h = dict(headers)
    content = rest[: int(h["content-length"])]
    fields, payload = None, None
    if h.get("content-type", "").startswith("application/http"):
        payload = content.partition(b"\r\n\r\n")[2]
    elif h.get("content-type") == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in content.decode().split("\r\n")) if k]
    own = h["warc-type"] == "response"
    return (
        h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), [v for k, v in headers if k == "warc-concurrent-to"], h.get("warc-refers-to"), h.get("warc-payload-digest"),
        len(payload) if own else None, hashlib.sha1(payload).hexdigest() if own else None, fields, payload if own else None,
    )


_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _unpack(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        for batch in batches:
            for i in range(batch.num_rows):
                for member in _members(batch.column(0)[i].as_py()):
                    row = parse(member)
                    rows.append(row if with_payload else (*row[:-1], None))
                    size += len(member) if with_payload else 500
                    if size >= _BATCH_BYTES:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records under path, with the columns of RECORD; payload is null unless with_payload."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpack(with_payload), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: struct response (the response or revisit record), and arrays of the request and
    metadata records that name it as concurrent to them, or that it names (empty if there are none). Records of null
    or unknown identifiers are in no capture."""
    body = F.struct(*records.columns)
    main = records.where(F.col("type").isin("response", "revisit"))
    others = records.where(F.col("type").isin("request", "metadata"))
    linked = others.select(F.explode(F.array_distinct("concurrent_to")).alias("of"), body.alias("record"))
    named = main.select("record_id", F.explode("concurrent_to").alias("to"))
    if not named.isEmpty():  # responses that name their request: in archives of other writers
        back = named.alias("m").join(others.alias("o"), F.col("m.to") == F.col("o.record_id")).select(F.col("m.record_id").alias("of"), F.struct(*[F.col(f"o.{c}") for c in records.columns]).alias("record"))
        linked = linked.union(back.where(~F.array_contains("record.concurrent_to", F.col("of"))))
    of = {k: F.collect_list(F.when(F.col("record.type") == k, F.col("record"))).alias(k) for k in ("request", "metadata")}
    beside = linked.where("of is not null").groupBy("of").agg(*of.values())
    joined = main.select("record_id", body.alias("response")).join(beside, F.col("record_id") == F.col("of"), "left")
    empty = F.array().cast(joined.schema["request"].dataType)
    return joined.select("record_id", "response", *[F.coalesce(k, empty).alias(k) for k in of])
