"""WARC archives on Spark: writing, reading, and revisit resolution.

Records are built as DataFrame expressions. Each is packed as a gzip member of its own, as WARC
readers that seek expect, and Spark's text sink writes the members; its separator is an empty
member, which unpacks to nothing. A file is closed once it holds ``FILE_BYTES``, so that only a single
longer record makes a longer one. Files are named part-*.warc.gz by a rename when all are written.

Archives are read with the text source, whose separator is the blank line and the start of the next
record's first line. It streams any file through the gzip codec, all members of it, and a
record is a row. Content-Length decides where a record ends: a payload that holds the separator is put
together again from its rows. Both go through Hadoop paths.

Revisit resolution shuffles headers only: page id, digest and length are grouped by
digest (pre-aggregated, so that a hot payload is no hot task), groups of one drop
out, and the others are joined back to their members under another key, where adaptive
execution splits a hot digest. Payloads move once, by page id, to leave out the
revisits, which are written from their headers.

Defined results: a null payload is empty; payloads shorter than ``min_bytes`` are never
revisits; of equal payloads the record with the least page id is the response, and
rows that repeat that page id are responses too; a null page id is written without
the header, reads back as null, and is never preferred; line breaks in a URL are dropped; a
null URL has no header. An empty table gives an empty archive. A file that ends inside a record is an
error. Records of other types are read with their block as payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, shared_dir, small_batches

#: Packed bytes after which a file of an archive is closed.
FILE_BYTES = 256 << 20
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
_NEXT = b"\r\n\r\nWARC/1."
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1, 32 characters: every five hexadecimal digits give four."""
    sha = F.sha1(payload)
    out = []
    for g in range(8):
        twenty = F.conv(F.substring(sha, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(twenty, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """page_id, uri, payload, payload_bytes, payload_digest from page_id, url, html."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\r\n]+", "").alias("uri"), payload.alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))


def _same_page(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, payload_bytes, uri, refers_to, refers_uri of the records that revisit another one.

    headers: page_id, uri, payload_bytes, payload_digest; payloads are not needed.
    """
    usable = headers.where(F.col("payload_bytes") >= min_bytes).select("page_id", "uri", "payload_bytes", "payload_digest")
    seen = usable.where("page_id is not null").select("payload_digest", "page_id", "uri")
    first = usable.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("refers_to")).where("n > 1 and refers_to is not null")
    first = first.select(F.reverse("payload_digest").alias("reversed"), "refers_to")
    revisits = usable.join(first, F.reverse("payload_digest") == F.col("reversed")).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).drop("reversed")
    uris = seen.groupBy("page_id", "payload_digest").agg(F.min("uri").alias("refers_uri"))
    originals = first.withColumn("payload_digest", F.reverse("reversed")).join(uris.withColumnRenamed("page_id", "refers_to"), ["refers_to", "payload_digest"])
    originals = originals.select(F.col("reversed"), "refers_uri")
    return revisits.join(originals, F.reverse("payload_digest") == F.col("reversed"), "left").drop("reversed")


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines, without those whose value is null."""
    return F.concat_ws("\r\n", *(F.concat(F.lit(f"{name}: "), value) for name, value in pairs))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def _http(n: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(_END))


def _common(kind: str, http: Column, body: Column, date: str) -> list[tuple[str, Column]]:
    return [
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("Page-ID", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length(http) + body).cast("string")),
    ]


def response_records(rows: DataFrame, date: str = DATE) -> DataFrame:
    """One column, the whole record (without its end) of rows with page_id, uri, payload, payload_bytes, payload_digest."""
    http = _http(F.col("payload_bytes"))
    head = F.concat(F.lit("WARC/1.1\r\n"), _lines(*_common("response", http, F.col("payload_bytes"), date)), F.lit(_END), http)
    return rows.select(F.concat(head.cast("binary"), F.col("payload")).alias("record"))


def revisit_records(revisits: DataFrame, date: str = DATE) -> DataFrame:
    """Records of the rows of resolve_revisits; the block keeps the HTTP header, with the payload's length."""
    http = _http(F.col("payload_bytes"))
    more = [
        ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))),
        ("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        ("WARC-Refers-To-Date", F.lit(date)),
        ("Refers-To-Page-ID", F.col("refers_to").cast("string")),
    ]
    return revisits.select(F.concat(F.lit("WARC/1.1\r\n"), _lines(*_common("revisit", http, F.lit(0), date), *more), F.lit(_END), http).cast("binary").alias("record"))


def _members(file_bytes: int):
    """Each record as a gzip member, and the number of the task's file that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        for batch in batches:
            members, numbers = [], []
            for record in batch["record"]:
                members.append(gzip.compress(record.as_py() + b"\r\n\r\n", 6, mtime=0))
                numbers.append(number)
                size += len(members[-1])
                if size >= file_bytes:
                    number, size = number + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(numbers, pa.int32())], ["member", "file_no"])

    return run


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes records (a binary column without their end) as files of gzip members."""
    spark = records.sparkSession
    small_batches(spark)
    members = records.select("record").mapInArrow(_members(file_bytes), "member binary, file_no int")
    separator = {"lineSep": _EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"}
    members.select(F.col("member").cast("string"), "file_no").write.options(**separator).partitionBy("file_no").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    top = hadoop(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(hadoop(f"{path}/file_no=*")) or []:
        number = folder.getPath().getName().partition("=")[2]
        for file in fs.listStatus(folder.getPath()):
            name = file.getPath().getName().partition(".")[0]
            if not fs.rename(file.getPath(), hadoop(f"{path}/{name}-{number}.warc.gz")):
                raise OSError(f"can't name {file.getPath()}")
        fs.delete(folder.getPath(), True)


def write_deduplicated(rows: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Writes the archive of rows (page_id, uri, payload, payload_bytes, payload_digest) with revisit records for repeated payloads and fresh headers."""
    headers = materialise(rows.select("page_id", "uri", "payload_bytes", "payload_digest"))
    revisits = materialise(resolve_revisits(headers, min_bytes))
    gone = revisits.select(F.col("page_id").alias("gone_id"), F.col("payload_digest").alias("gone_digest")).distinct()
    kept = rows.join(gone, _same_page("page_id", "gone_id") & (F.col("payload_digest") == F.col("gone_digest")), "left_anti")
    write_warc(response_records(kept, date).unionByName(revisit_records(revisits, date)), path)


def parse(rows: Iterable[tuple[int, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record, from the rows of files in their order: a key of the file and what stands between two separators."""
    file, parts, have, need, headers, head = None, [], 0, None, {}, 0
    for key, value in rows:
        if key != file:
            if parts:
                raise ValueError("a file ends inside a record")
            file = key
            parts = [value if value.startswith(b"WARC/") else _NEXT[4:] + value]
        else:
            parts += [_NEXT, value] if parts else [_NEXT[4:] + value]
        have = sum(map(len, parts)) if len(parts) < 3 else have + len(_NEXT) + len(value)
        while parts:
            if need is None:
                parts = [b"".join(parts)]
                head = parts[0].find(b"\r\n\r\n")
                if head < 0:
                    break
                lines = parts[0][:head].decode(errors="replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record: {lines[0][:80]!r}")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                need = head + 4 + int(headers["content-length"])
            if have < need:
                break
            whole = b"".join(parts)
            yield headers, whole[head + 4 : need]
            rest = whole[need:]
            if rest and not rest.startswith(b"\r\n\r\n"):
                raise ValueError("a record is longer than it says")
            parts = [rest[4:]] if len(rest) > 4 else []
            have, need = len(rest) - 4, None
    if parts:
        raise ValueError("a file ends inside a record")


_READ = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind = headers["warc-type"]
    http, _, payload = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
    row = {"page_id": _number(headers.get("page-id")), "uri": headers.get("warc-target-uri"), "record_type": kind, "refers_to": _number(headers.get("refers-to-page-id"))}
    if kind == "revisit":
        length = next((x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0")
        return row | {"payload_bytes": int(length), "payload_digest": headers.get("warc-payload-digest", "").partition(":")[2] or None, "payload": None}
    return row | {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload}


def _read(payloads: bool):
    schema = _READ if payloads else pa.schema([f for f in _READ if f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for headers, block in parse((k.as_py(), v.as_py()) for batch in batches for k, v in zip(batch["file"], batch["value"], strict=True)):
            row = _row(headers, block)
            if not payloads:
                del row["payload"]
            held.append(row)
            size += len(row.get("payload") or b"") + 200
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, uri, record_type, payload_bytes, payload_digest, refers_to, and the payload if asked for, of the records of the .gz files of an archive."""
    small_batches(spark)
    columns = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    rows = spark.read.option("lineSep", _NEXT.decode()).option("pathGlobFilter", "*.gz").text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(_read(payloads), columns)


def restore_payloads(records: DataFrame) -> DataFrame:
    """page_id, uri, payload of every record: revisits are joined to their original responses by digest."""
    original = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max_by("payload", F.struct(-F.col("page_id"))).alias("original"))
    original = original.select(F.reverse("payload_digest").alias("reversed"), "original")
    joined = records.where("record_type = 'revisit'").join(original, F.reverse("payload_digest") == F.col("reversed"), "left").select("page_id", "uri", F.col("original").alias("payload"))
    return records.where("record_type = 'response'").select("page_id", "uri", "payload").unionByName(joined)


def deduplicated_archive(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the pages as a deduplicated archive, below the shared folder unless a path is given, and returns what it reads back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc"
    write_deduplicated(records_of_pages(pages), path, min_bytes)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first_id,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST(('0x' || substr(h, 1 + 5 * (k // 4), 5)) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS digest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM d"""
