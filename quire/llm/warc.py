"""WARC archives with a two-level capture index.

Captures are range-partitioned by their reversed-host URL key, so every partition writes one archive of compressed records in key
order, and its part of the index: lines of key, page, place and length, packed into compressed blocks. The sparse directory
keeps one row per block (first and last key, where it lies). A lookup binary-searches the archives' key ranges and an archive's
part of the directory, reads the range of a block, binary-searches its lines and reads the range of a record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_dir, written

BLOCK_LINES = 256
#: Index blocks that one task reads back.
BLOCKS_A_TASK = 4
LEVEL = 5
MIN_REVISIT_BYTES = 0
#: Pages carry no time of capture, so all records state this one.
CAPTURED = "1970-01-01T00:00:00Z"

DIRECTORY = "first_key string, last_key string, n_lines int, archive string, index_file string, index_offset long, index_length long"
_DIRECTORY = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("n_lines", pa.int32()), ("archive", pa.string()), ("index_file", pa.string()), ("index_offset", pa.int64()), ("index_length", pa.int64())])
CAPTURES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CAPTURES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def url_key(url: Column) -> Column:
    """Key with the host reversed: http://www.A.com:80/x?y -> com,a,www:80)/x?y. Null or without :// gives )text."""
    rest = F.regexp_extract(url, "(?s)^[^:]*://(.*)$", 1)
    authority = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, ":\\d*$", ""))
    port = F.regexp_extract(authority, "(:\\d+)$", 1)
    tail = F.regexp_extract(rest, "(?s)^[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), port, F.lit(")"), tail)
    return F.when(url.contains("://"), key).otherwise(F.concat(F.lit(")"), F.coalesce(url, F.lit(""))))


def _header(lines: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + f"Content-Length: {len(body)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record, compressed by itself. A revisit keeps the HTTP header (with the payload's length) and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", CAPTURED)]
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~-._")))
        lines.append(("X-Source-URI", json.dumps(url)))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if is_revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines.append(("Content-Type", "application/http;msgtype=response"))
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(_header(lines, http if is_revisit else http + payload)) + packer.flush()


def parsed(member: bytes) -> dict:
    """A compressed record read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload."""
    raw = zlib.decompress(member, 47)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    page = lambda x: None if x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    out = {"page_id": page(fields["WARC-Record-ID"]), "url": json.loads(fields["X-Source-URI"]) if "X-Source-URI" in fields else None, "record_type": fields["WARC-Type"]}
    if out["record_type"] == "response":
        digest_now = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest_now != digest or len(payload) != length:
            raise ValueError(f"record of page {out['page_id']} is damaged")
        return out | {"payload_bytes": len(payload), "payload_digest": digest_now, "refers_to": None, "payload": payload}
    return out | {"payload_bytes": length, "payload_digest": digest, "refers_to": page(fields["WARC-Refers-To"]), "payload": None}


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes archives and index blocks below `folder` and returns the directory, itself written there.

    Of rows with equal payloads of min_revisit_bytes or more, those with the largest page_id are responses and the others
    revisit it. Null html is an empty payload; a row with a null page_id revisits a row that has one. Repeated rows get a record
    each. A task that runs again writes files of new names; the directory only names those of the tasks that Spark committed.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    copies = rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keeper is not null")
    copies = written(copies.select("digest", "keeper"), folder, "copies")
    marked = rows.join(copies, "digest", "left").withColumn("is_revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(False)))
    keyed = marked.select(url_key(F.col("url")).alias("key"), "page_id", "url", "payload", "keeper", "is_revisit")
    ordered = keyed.repartitionByRange(F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        archive, index_file = f"{folder}/archives/{name}.warc.gz", f"{folder}/index/{name}.cdx.gz"
        out = index = None
        place = index_place = 0
        lines: list[str] = []

        def block() -> pa.RecordBatch:
            nonlocal index_place
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), LEVEL)
            index.write(data)
            first, last = json.loads(lines[0])[0], json.loads(lines[-1])[0]
            row = [[first], [last], [len(lines)], [archive], [index_file], [index_place], [len(data)]]
            index_place += len(data)
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _DIRECTORY.types)], schema=_DIRECTORY)

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    where, path = _at(archive)
                    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = where.open_output_stream(path, compression=None)
                    where, path = _at(index_file)
                    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    index = where.open_output_stream(path, compression=None)
                data = record(r["page_id"], r["url"], r["payload"], r["keeper"], r["is_revisit"])
                out.write(data)
                lines.append(json.dumps([r["key"], r["page_id"], place, len(data)], ensure_ascii=False))
                place += len(data)
                if len(lines) == BLOCK_LINES:
                    yield block()
        if lines:
            yield block()
        for f in (out, index):
            if f is not None:
                f.close()

    return written(ordered.mapInArrow(run, DIRECTORY), folder, "directory")


def _block_lines(index_file: str, offset: int, length: int) -> list[list]:
    where, path = _at(index_file)
    with where.open_input_file(path) as f:
        data = f.read_at(length, offset)
    return [json.loads(x) for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]


def read_archives(directory: DataFrame) -> DataFrame:
    """Every capture, read back block by block of the index and range by range of the archives."""
    prepare(directory.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.to_pylist():
                where, path = _at(d["archive"])
                found = []
                with where.open_input_file(path) as f:
                    for _, _, place, length in _block_lines(d["index_file"], d["index_offset"], d["index_length"]):
                        r = parsed(f.read_at(length, place))
                        found.append([r[n] for n in _CAPTURES.names])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _CAPTURES.types)], schema=_CAPTURES)

    # the directory's rows are few and small, what they stand for isn't: the number of tasks follows from the blocks
    tasks = max(1, -(-directory.count() // BLOCKS_A_TASK))
    dealt = directory.repartition(tasks, F.col("index_file"), F.col("index_offset"))
    return dealt.mapInArrow(run, CAPTURES)


def _reaching(rows: list, key: str) -> list:
    """Of rows sorted by their key ranges, those whose range holds the key, by binary search."""
    at = bisect_left(rows, key, key=lambda r: r.last_key)
    end = at
    while end < len(rows) and rows[end].first_key <= key:
        end += 1
    return rows[at:end]


def lookup(directory: DataFrame, urls: list[str]) -> list[dict]:
    """The captures of a few URLs by binary search: among the archives, in the directory of an archive, in the lines of a block.

    What reaches the driver is one row per archive, the directory rows of the archives that may hold a key, and the blocks and records
    of the keys.
    """
    spark = directory.sparkSession
    keys = sorted({r.key for r in spark.createDataFrame([(u,) for u in urls], "url string").select(url_key(F.col("url")).alias("key")).collect()})
    order = ["first_key", "last_key"]
    archives = directory.groupBy("archive").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).orderBy(*order).collect()
    asked = {r.archive for k in keys for r in _reaching(archives, k)}
    rows: dict[str, list] = {}
    for r in directory.filter(F.col("archive").isin(sorted(asked))).orderBy("archive", "index_offset").collect():
        rows.setdefault(r.archive, []).append(r)
    found = []
    for key in keys:
        for d in (d for a in _reaching(archives, key) for d in _reaching(rows[a.archive], key)):
            lines = _block_lines(d.index_file, d.index_offset, d.index_length)
            where, path = _at(d.archive)
            with where.open_input_file(path) as f:
                for line_key, _, place, length in lines[bisect_left(lines, key, key=lambda x: x[0]) :]:
                    if line_key != key:
                        break
                    found.append(parsed(f.read_at(length, place)))
    return [r for r in found if r["url"] in set(urls)]


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of all pages to the shared folder and returns what they hold."""
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession)))


def oracle() -> str:
    """What the archives of all pages hold, as DuckDB SQL: digests by sha1, base32 by groups of five bits."""
    return """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
 d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest FROM p),
 k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keeper FROM d),
 bits AS (SELECT digest, array_to_string(list_transform(string_split_regex(digest, ''), lambda c: CASE WHEN c = '' THEN '' ELSE right(bin(('0x' || c)::INT + 16), 4) END), '') AS b FROM (SELECT DISTINCT digest FROM d)),
 base AS (SELECT digest, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(string_split_regex(substr(b, 5 * i + 1, 5), ''), lambda c: coalesce(try_cast(c AS INT), 0)), lambda x, y: 2 * x + y), 1)), '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM k JOIN base USING (digest)"""
