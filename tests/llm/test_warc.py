import base64
import gzip
import hashlib
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc as X

PAGES = "page_id long, url string, html string"


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == b and p is not None]
        first = min(same, default=None)
        revisit = len(b) >= least and first is not None and page != first
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


ROWS = [(5, "http://a/\r\nX: y", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "u", "line\r\n\r\nWARC/1.1\r\n\r\n tail \r\n\r\n"), (None, "n", "same"), (7, "u", "é" * 70000), (8, "u", "é" * 70000), (3, "http://b", "same")]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'x' AS payload", "'x' AS record", "'x' AS uri", "'x' AS refers_to")
    assert Counter(map(tuple, X.deduplicated_archive(df).collect())) == brute(ROWS)
    assert Counter(map(tuple, X.deduplicated_archive(df, min_bytes=5).collect())) == brute(ROWS, 5)


def test_payloads_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    X.write_deduplicated(X.records_of_pages(spark.createDataFrame(ROWS, PAGES)), path)
    records = X.read_warc(spark, path, payloads=True)
    got = Counter((r.page_id, bytes(r.payload)) for r in X.restore_payloads(records).collect())
    assert got == Counter((p, (h or "").encode()) for p, _, h in ROWS)
    again = X.read_warc(spark, path)
    assert {r.uri for r in again.where("page_id = 5").collect()} == {"http://a/X: y"}


def test_archives_as_input(spark, tmp_path):
    """An archive of responses only is read, deduplicated and written with fresh headers."""
    rows = X.records_of_pages(spark.createDataFrame([r for r in ROWS if r[0]], PAGES))
    X.write_warc(X.response_records(rows), f"file://{tmp_path}/a", 1000)
    read = X.read_warc(spark, f"file://{tmp_path}/a", payloads=True)
    assert read.where("record_type <> 'response'").count() == 0
    X.write_deduplicated(read, f"file://{tmp_path}/b", date="2026-01-01T00:00:00Z")
    got = X.read_warc(spark, f"file://{tmp_path}/b").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == brute([r for r in ROWS if r[0]])


def test_empty_table(spark):
    assert X.deduplicated_archive(spark.createDataFrame([], PAGES)).count() == 0


def test_one_gzip_member_per_record(spark, tmp_path):
    rows = X.records_of_pages(spark.createDataFrame([r for r in ROWS if r[0]], PAGES))
    records = [r.record for r in X.response_records(rows).collect()]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r) + b"\r\n\r\n") for r in records))
    read = X.read_warc(spark, f"file://{tmp_path}/m", payloads=True)
    assert Counter((r.page_id, bytes(r.payload)) for r in read.collect()) == Counter((p, (h or "").encode()) for p, _, h in ROWS if p)


def test_written_files(spark, tmp_path):
    """A member for each record, files bounded by their bytes, readable without Spark."""
    rows = X.records_of_pages(spark.createDataFrame([(k, "u", os.urandom(400).hex()) for k in range(60)], PAGES)).coalesce(1)
    X.write_warc(X.response_records(rows), f"file://{tmp_path}/w", 3000)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 5 and all(f.stat().st_size < 4500 for f in files)
    assert not [x for x in (tmp_path / "w").iterdir() if x.is_dir()]
    found = []
    for f in files:
        raw = f.read_bytes()
        while raw:
            one = zlib.decompressobj(31)
            text = one.decompress(raw)
            raw = one.unused_data
            if text:
                assert text.count(b"WARC/1.1\r\n") == 1 and text.endswith(b"\r\n\r\n")
                found.append(text)
    assert len(found) == 60
    assert X.read_warc(spark, f"file://{tmp_path}/w").count() == 60


def test_one_large_record(spark, tmp_path):
    big = 200 << 20
    pages = spark.createDataFrame(ROWS[:3], PAGES).union(spark.range(1).select(F.lit(50).cast("long"), F.lit("big"), F.repeat(F.concat(F.lit("0123456789abcde"), F.hex("id")), F.lit(big // 16))))
    got = {r.page_id: r for r in X.deduplicated_archive(pages, path=f"file://{tmp_path}/w").collect()}
    assert got[50].payload_bytes == big and got[50].record_type == "response" and len(got) == 4
    assert got[50].payload_digest == base64.b32encode(hashlib.sha1(b"0123456789abcde0" * (big // 16)).digest()).decode()


def test_rows_of_a_file():
    def record(block, kind="response"):
        return b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), len(block), block)

    blocks = [b"", b"a", b"\r\n\r\nWARC/1.1\r\n\r\n", b"x\r\n\r\nWARC/1.", b"\r\n", b"\r\n\r\n", b"y" * 50]
    r = random.Random(4)
    for _ in range(200):
        own = [r.choice(blocks) for _ in range(r.randrange(1, 6))]
        raw = b"".join(map(record, own))
        rows = raw.split(X._NEXT)
        # A reader may also miss separators; what isn't cut is parsed all the same.
        while len(rows) > 1 and r.random() < 0.5:
            k = r.randrange(len(rows) - 1)
            rows[k : k + 2] = [X._NEXT.join(rows[k : k + 2])]
        assert [b for _, b in X.parse([(1, x) for x in rows] + [(2, x) for x in raw.split(X._NEXT)])] == own + own
    for cut in (10, 60, -5):
        with pytest.raises(ValueError):
            list(X.parse([(1, (record(b"z" * 40))[:cut]), (2, record(b""))]))


def test_other_records(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 8\r\n\r\nsoft: x\n\r\n\r\n"
    resource = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://r\r\nContent-Length: 7\r\n\r\na\r\n\r\nbc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(resource))
    got = {r.record_type: r for r in X.read_warc(spark, f"file://{tmp_path}", payloads=True).collect()}
    assert got["warcinfo"].payload_bytes == 8 and got["resource"].uri == "http://r" and bytes(got["resource"].payload) == b"a\r\n\r\nbc"
