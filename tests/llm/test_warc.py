import gzip
from collections import Counter

from pyspark.sql import functions as F

from samewise.llm import q_warc
from samewise.llm import warc as W
from samewise.sources.shared import new_path

BIG = "<p>WARC/1.1\r\n\r\nhé</p>" * 80


def test_record_id_column_is_uuid5(spark):
    got = spark.createDataFrame([("3|ab|0",), (None,)], "k string").select(W._record_id("k").alias("r")).collect()
    assert [r.r for r in got] == [W.record_id("3|ab|0"), None]


def test_round_trip_and_edge_cases(spark):
    rows = [
        (1, "http://a/?q=1 2\r\n", BIG), (2, "http://b/", BIG), (5, "http://c/", BIG), (5, "http://c/", BIG), (5, "http://d/", BIG), (None, "http://e/", BIG),
        (3, None, "x" * 1000), (4, "http://f/", None), (6, "", ""), (7, "http://g/", "short"), (8, "http://h/", "short"), (None, None, "y" * 2000), (None, None, "y" * 2000),
    ]
    path = new_path(spark, "warc")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = W.read_archives(spark, path)
    assert records.count() == 3 * len(rows) == records.select("record_id").distinct().count()
    caps = W.captures(records).collect()
    assert len(caps) == len(rows) and all(len(c.request) == len(c.metadata) == 1 for c in caps)
    got = Counter()
    by_id = {c.record_id: c for c in caps}
    page = lambda c: int(c.metadata[0].fields["page-id"]) if "page-id" in c.metadata[0].fields else None
    for c in caps:
        full = by_id[c.response.refers_to] if c.response.type == "revisit" else c
        got[page(c), bytes(full.response.payload), c.response.type, page(full) if full is not c else None] += 1
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        keeper = max((x for x, _, y in rows if y == h and x is not None), default=None)
        revisit = len(b) >= 1000 and keeper is not None and p != keeper
        want[p, b, "revisit" if revisit else "response", keeper if revisit else None] += 1
    assert got == want
    files = spark.read.format("binaryFile").load(path).collect()
    text = b"".join(gzip.decompress(bytes(f.content)) for f in files)
    assert text.count(b"WARC-Type: request") == len(rows)  # a standard reader takes the archives


def test_empty(spark):
    path = new_path(spark, "warc")
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.captures(W.read_archives(spark, path)).count() == 0


def test_small_archives(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2000)
    path = new_path(spark, "warc")
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.repeat(F.col("id").cast("string"), 400).alias("html"))
    W.write_archives(pages, path)
    assert W.read_archives(spark, path).where("type = 'response'").count() == 300


def test_query(spark):
    assert q_warc.op6_warc(spark, "/root/testdata/sf0.001").where("not digest_matches").count() == 0


def test_archives_of_other_writers(spark, tmp_path):
    """Several metadata records, a repeated header, links from the response, missing requests, null and unknown identifiers."""
    def record(kind, own, to=(), body=b"HTTP/1.1 200 OK\r\n\r\nhello", content="application/http"):
        head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", own), *[("WARC-Concurrent-To", x) for x in to], ("Content-Type", content), ("Content-Length", len(body))])
        return gzip.compress(f"WARC/1.0\r\n{head}\r\n".encode() + body + b"\r\n\r\n")

    fields = {"body": b"a: 1\r\n", "content": "application/warc-fields"}
    parts = [
        record("warcinfo", "<i>", **fields), record("request", "<q1>", ["<r1>", "<r2>"]), record("response", "<r1>"), record("metadata", "<m1>", ["<r1>"], **fields), record("metadata", "<m2>", ["<x>", "<r1>", "<r1>"], **fields),
        record("revisit", "<r2>", ["<q2>", "<m3>", "<q1>"]), record("request", "<q2>"), record("metadata", "<m3>", **fields), record("response", "<r3>", ["<gone>"]), record("request", "<q9>", ["<unknown>"]), record("metadata", "<m9>", **fields),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:6]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts[6:]))
    got = {c.record_id: (sorted(x.record_id for x in c.request), sorted(x.record_id for x in c.metadata)) for c in W.captures(W.read_archives(spark, f"file://{tmp_path}")).collect()}
    assert got == {"<r1>": (["<q1>"], ["<m1>", "<m2>"]), "<r2>": (["<q1>", "<q2>"], ["<m3>"]), "<r3>": ([], [])}


def test_long_page_and_other_columns(spark):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame([(1, "http://a/", 7, "d")], "page_id long, url string, pid int, digest string").withColumn("html", F.repeat(F.lit("<p>é</p>"), 2_000_000))
    W.write_archives(pages, path)
    assert [r.payload_bytes for r in W.read_archives(spark, path, with_payload=False).where("type = 'response'").collect()] == [18_000_000]
