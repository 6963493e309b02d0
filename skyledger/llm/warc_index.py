"""WARC archives with a two-level capture index.

Pages are written as gzip members, one for each record, in archives of some ``ARCHIVE_BYTES`` bytes; pages
of equal payload share one response and the others revisit it. The index is built from the archives: captures are sorted
by reversed-host key into compressed blocks of ``BLOCK`` lines, and each index part has a sparse
directory with the first key of every block. A lookup finds the part and then the block by binary
search, and reads the record's own bytes from the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import map_arrow, new_path, portions, written

#: Lines of an index block, captures of an index part, about, and the most parts.
BLOCK, PART, MOST_PARTS = 300, 20_000, 20_000
#: Bytes at which an archive is closed; it is longer by one record at most.
ARCHIVE_BYTES = 16_000_000
#: A digest of over this share of the repeated pages is hot; there are at most as many as its inverse.
HOT = 1 / 1000
#: An empty gzip member: what Spark's writer puts behind each archive, and gzip readers skip.
_GAP = zlib.compress(b"", wbits=31)
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", re.S)


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest: ``http://www.a.com:80/b?c#d`` is ``com,a)/b?c``. Null and empty: as ``target``."""
    host, port, rest = _URL.match(target(url).strip()).groups()
    host = host.lower().removeprefix("www.").rstrip(".")
    port = f":{port}" if port and port not in ("80", "443") else ""
    return re.sub(r"\s", "%20", f"{','.join(reversed(host.split('.')))}{port}){rest if rest.startswith('/') else '/' + rest}".lower())


def target(url: str | None) -> str:
    """The url as a record keeps it: without line breaks, and ``about:blank`` for none."""
    return re.sub(r"[\r\n]", "", url or "") or "about:blank"


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _member(lines: list[str], block: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return zlib.compress(head + block + b"\r\n\r\n", 1, wbits=31)


def _lines(kind: str, page: int | None, url: str | None, size: int, digest: str, date: str) -> list[str]:
    return [f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"X-Page-Id: {'' if page is None else page}"]


def response(page: int | None, url: str | None, payload: bytes, digest: str, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member([*_lines("response", page, url, len(payload), digest, date), "Content-Type: application/http;msgtype=response"], http + payload)


def revisit(page: int | None, url: str | None, size: int, digest: str, date: str, refers_to: int) -> bytes:
    more = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return _member([*_lines("revisit", page, url, size, digest, date), *more], b"")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, payload) of one record; a response whose payload has another length or digest raises ValueError."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a record")
    if fields["WARC-Type"] == "revisit":
        return fields, b""
    payload = block.partition(b"\r\n\r\n")[2]
    if len(payload) != int(fields["X-Payload-Length"]) or f"sha1:{payload_digest(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError("a payload differs from its digest")
    return fields, payload


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", path: str | None = None) -> str:
    """Writes one record for every row of ``pages`` and returns the folder of the archives.

    Of equal payloads of at least ``least_bytes`` bytes the row of the largest id is the response (rows
    that repeat it too), the others revisit it; a payload whose ids are all null is never revisited.
    Null html is an empty payload, one of any length is one record. An empty table gives no archives. Only
    digests that repeat are joined to the pages, the few hot ones by broadcast, so that their pages stay
    spread; the joined partitions are cut into archives by bytes: one shuffle of the pages.
    """
    folder = path or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    again = rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.max("id").alias("latest"), F.count("*").alias("n"))
    again = written(again.filter("n > 1 and latest is not null"), "latest")
    hot = F.col("n") > (again.agg(F.sum("n")).first()[0] or 0) * HOT
    named = again.filter(hot).select("sha1", F.col("latest").alias("hot_latest"))  # at most 1 / HOT rows
    rows = rows.join(F.broadcast(named), "sha1", "left").withColumn("key", F.when(F.col("hot_latest").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("id", "url")))))
    cold = again.filter(~hot).select(F.col("sha1").alias("key"), "latest")
    rows = rows.join(cold, "key", "left").withColumn("latest", F.coalesce("hot_latest", "latest"))

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, size = [], 0
        for b in batches:
            for part in portions(b, 200, 4_000_000, "html"):
                for page, url, payload, sha1, latest in zip(*(part.column(c).to_pylist() for c in ("id", "url", "html", "sha1", "latest"))):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    first = latest is None or latest == page or len(payload) < least_bytes
                    out.append(response(page, url, payload, digest, date) if first else revisit(page, url, len(payload), digest, date, latest))
                    size += len(out[-1])
                    if size >= ARCHIVE_BYTES:
                        yield {"archive": [b"".join(out)]}
                        out, size = [], 0
        if out:
            yield {"archive": [b"".join(out)]}

    archives = map_arrow(rows.select("id", "url", "html", "sha1", "latest"), {"archive": "binary"}, archived)
    gap = _GAP.decode("latin-1")
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", gap).option("encoding", "ISO-8859-1").text(folder)
    return folder


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that is not empty."""
    at, step = 0, 1 << 16
    while at < len(data):
        engine, out, fed = zlib.decompressobj(wbits=31), [], at
        while not engine.eof:
            piece = data[fed : fed + step]
            if not piece:
                raise ValueError("the last member is cut off")
            out.append(engine.decompress(piece))
            fed += len(piece)
        end = fed - len(engine.unused_data)
        content = b"".join(out)
        if content:
            yield at, end - at, content
        at = end


@dataclass
class CaptureIndex:
    """``blocks``: (part, directory with the first key of each block, compressed blocks); ``bounds``: (part, first, last key), in order."""

    blocks: DataFrame
    bounds: list[tuple[int, str, str]]


def build_index(spark: SparkSession, folder: str) -> CaptureIndex:
    """Indexes the archives of ``folder``. Parts are ranges of (key, place), so the captures of one key
    may fill several; only the bounds of the parts, ``MOST_PARTS`` at most, reach the driver."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for path, cell in zip(b.column("path").to_pylist(), b.column("content")):
                found = [(at, size, re.search(rb"\r\nWARC-Target-URI: ([^\r]*)", content)[1].decode()) for at, size, content in members(cell.as_py())]
                yield {"key": [url_key(u) for _, _, u in found], "path": [path] * len(found), "offset": [x for x, _, _ in found], "size": [x for _, x, _ in found]}

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    found = written(map_arrow(files, {"key": "string", "path": "string", "offset": "long", "size": "long"}, captures), "captures")
    order = ["key", "path", "offset"]
    n = found.count()
    dealt = found.repartitionByRange(1 + n // max(PART, n // MOST_PARTS), *order).sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        lines = [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in order), b.column("size").to_pylist())]
        blocks = [lines[i : i + BLOCK] for i in range(0, len(lines), BLOCK)]
        if blocks:
            body = [zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in block).encode(), 6) for block in blocks]
            yield {"part": [TaskContext.get().partitionId()], "first": [lines[0][0]], "last": [lines[-1][0]], "directory": [[x[0][0] for x in blocks]], "blocks": [body]}

    columns = {"part": "int", "first": "string", "last": "string", "directory": "array<string>", "blocks": "array<binary>"}
    parts = written(map_arrow(dealt, columns, packed), "index")
    bounds = sorted((r.part, r.first, r.last) for r in parts.select("part", "first", "last").collect())
    return CaptureIndex(parts, bounds)


def lookup(index: CaptureIndex, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(key, path, offset, size) of every capture of the urls' keys; equal keys are looked up once."""
    bounds = index.bounds
    firsts, lasts = [x[1] for x in bounds], [x[2] for x in bounds]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = [(bounds[p][0], k) for k in {url_key(u) for u in b.column("url").to_pylist()} for p in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield {"part": [p for p, _ in out], "key": [k for _, k in out]}

    keys = map_arrow(urls.select(F.col(url_col).cast("string").alias("url")), {"part": "int", "key": "string"}, routed).distinct()

    def searched(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for directory, blocks in zip(table.column("directory").to_pylist(), table.column("blocks").to_pylist()):
            opened: dict[int, list] = {}
            for key in asked.column("key").to_pylist():
                i = max(0, bisect_left(directory, key) - 1)
                while i < len(directory) and directory[i] <= key:
                    if i not in opened:
                        opened[i] = [json.loads(x) for x in zlib.decompress(blocks[i]).decode().split("\n")]
                    lines = opened[i]
                    at = bisect_left(lines, [key])
                    while at < len(lines) and lines[at][0] == key:
                        out.append(lines[at])
                        at += 1
                    i += 1
        return pa.table({"key": pa.array([x[0] for x in out], pa.string()), "path": pa.array([x[1] for x in out], pa.string()), "offset": pa.array([x[2] for x in out], pa.int64()), "size": pa.array([x[3] for x in out], pa.int64())})

    parts = index.blocks.select("part", "directory", "blocks")
    return parts.groupBy("part").cogroup(keys.groupBy("part")).applyInArrow(searched, "key string, path string, offset long, size long")


def read_captures(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each capture, from a read of its own
    bytes in the archive. Each response's payload is tested against its digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyarrow.fs import FileSystem

        name, file = None, None
        number = lambda x: int(x) if x else None
        for b in batches:
            out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for path, offset, size in zip(b.column("path").to_pylist(), b.column("offset").to_pylist(), b.column("size").to_pylist()):
                if path != name:
                    store, place = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                    name, file = path, store.open_input_file(place)
                file.seek(offset)
                fields, _ = parse(file.read(size))
                for k, v in zip(out, (number(fields["X-Page-Id"]), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number(fields.get("X-Refers-To-Page")))):
                    out[k].append(v)
            yield out

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are small but reads are not: the number is kept
    dealt = captures.repartition(parts, "path", (F.col("offset") / 1_000_000).cast("long")).sortWithinPartitions("path", "offset")
    return map_arrow(dealt, {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}, rows)

