"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. The captures' keys - the URL with its host reversed, then the page - are
sorted over the whole collection into parts; a part is a file of compressed blocks of lines and a sparse directory
with one entry per block. A lookup finds the part among the parts' first keys and the block in the directory, both by
binary search, then range-reads the block and, from the line found in it, the record.
"""

from __future__ import annotations

import base64
import bisect
import json
import sys
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.blobs import Ranges, open_store
from lucidgraph.llm.shared import by_value, shared_dir, table, written

#: Groups of equal payloads up to this number go to all executors (about 60 bytes each); beyond it they are joined.
MOST_BROADCAST = 200_000
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 1000
CAPTURES_PER_PART = 20_000


def reversed_host_key(url: str | None) -> str:
    """``http://a.b.org:80/x?y#z`` -> ``org,b,a)/x?y``; null and what has no host sort under ``)``."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        parts, host, port = None, "", None
    if not host:
        return ")" + "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    name = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return name + ")" + "".join(c if c > " " else f"%{ord(c):02X}" for c in rest)


def capture_key(url: str | None, page) -> str:
    return f"{reversed_host_key(url)} {'-' if page is None else page}"


def record_bytes(kind: str, page, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """An uncompressed WARC/1.1 record. A revisit has no payload, only its length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {''.join(c if c > ' ' else f'%{ord(c):02X}' for c in url)}"] if url else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page: {'-' if page is None else page}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (lower-case names) and the HTTP payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def sha1_base32(payload: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


CAPTURE = "key string, file string, offset long, length long"


def _writer(uri: str, date: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(uri)
        name, out, at = "", None, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    # an attempt that is run again writes another file; the index names those of the one that counts
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                payload = (r["html"] or "").encode()
                kind = "response" if r["first"] is None or r["first"] == r["page_id"] else "revisit"
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = pack.compress(record_bytes(kind, r["page_id"], r["url"], payload, digest, r["first"], date)) + pack.flush()
                out.write(data)
                rows.append((capture_key(r["url"], r["page_id"]), name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, uri: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the captures, one per record.

    Null html is an empty payload. Of rows with equal payloads those with the smallest page_id are responses (all of
    them, if it is repeated) and the others revisits; a null page_id is never the smallest, and where a group has no
    other all are responses. Other columns are ignored. An empty table writes nothing.
    """
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    groups = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = written(groups, "warc-equal")
    if groups.count() <= MOST_BROADCAST:
        groups = F.broadcast(groups)
    joined = rows.join(groups, "sha1", "left").select("page_id", "url", "html", "sha1", "first")
    return written(joined.mapInArrow(_writer(uri, date, level), CAPTURE), "warc-captures")


BLOCK = "part string, first_key string, n_lines long, n_blocks long"


def _indexer(uri: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(uri)
        part, out, at, lines, directory, total = uuid.uuid4().hex, None, 0, [], [], 0

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            directory.append((lines[0].partition("\t")[0], at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{folder}/{part}.blocks", compression=None)
                lines.append(f"{r['key']}\t{json.dumps([r['file'], r['offset'], r['length']])}")
                total += 1
                if len(lines) >= block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with store.open_output_stream(f"{folder}/{part}.directory") as f:
            f.write("\n".join(f"{k}\t{a}\t{n}" for k, a, n in directory).encode())
        yield pa.RecordBatch.from_pydict({"part": [part], "first_key": [directory[0][0]], "n_lines": [total], "n_blocks": [len(directory)]})

    return write


def write_index(captures: DataFrame, uri: str, block_lines: int = BLOCK_LINES, per_part: int = CAPTURES_PER_PART) -> DataFrame:
    """Sorts the captures by key and writes the parts; returns one row per part.

    Ranges are of keys, page included, so that one host's captures spread over many parts.
    """
    parts = max(1, -(-captures.count() // per_part))
    ranged = captures.repartitionByRange(parts, "key").sortWithinPartitions("key", "file", "offset")
    return written(ranged.mapInArrow(_indexer(uri, block_lines), BLOCK), "warc-parts")


class CaptureIndex:
    """Lookups in the parts of an index. ``parts``: (first key, part) in order, one entry per part."""

    def __init__(self, uri: str, parts: list[tuple[bytes, str]]):
        self.files, self.parts, self.firsts = Ranges(uri), parts, [k for k, _ in parts]
        self.directory: tuple[str, list[bytes], list[tuple[int, int]]] = ("", [], [])
        self.block: tuple[tuple[str, int], list[bytes], list[bytes]] = (("", -1), [], [])

    def _directory(self, part: str):
        if self.directory[0] != part:
            rows = [x.split(b"\t") for x in self.files.read_all(f"{part}.directory").split(b"\n")]
            self.directory = (part, [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows])
        return self.directory

    def _block(self, part: str, i: int):
        if self.block[0] != (part, i):
            lines = zlib.decompress(self.files.read(f"{part}.blocks", *self._directory(part)[2][i])).split(b"\n")
            self.block = ((part, i), [x.partition(b"\t")[0] for x in lines], lines)
        return self.block

    def lookup(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture of a key."""
        k, found = key.encode(), []
        # equal keys can cross a boundary: start where the last smaller first key is
        p = max(0, bisect.bisect_left(self.firsts, k) - 1)
        while p < len(self.parts) and self.firsts[p] <= k:
            part = self.parts[p][1]
            firsts = self._directory(part)[1]
            b = max(0, bisect.bisect_left(firsts, k) - 1)
            while b < len(firsts) and firsts[b] <= k:
                _, keys, lines = self._block(part, b)
                i = bisect.bisect_left(keys, k)
                while i < len(keys) and keys[i] == k:
                    found.append(tuple(json.loads(lines[i].partition(b"\t")[2])))
                    i += 1
                if i < len(keys):
                    return found
                b += 1
                firsts = self._directory(part)[1]
            p += 1
        return found

    def close(self) -> None:
        self.files.close()


FOUND = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_FOUND = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _reader(index_uri: str, archive_uri: str, parts: list[tuple[bytes, str]]):
    number = lambda x: None if x in (None, "-", "None") else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archives = CaptureIndex(index_uri, parts), Ranges(archive_uri)
        for batch in batches:
            places = [(file, at, n, key) for key in batch.column("key").to_pylist() for file, at, n in index.lookup(key)]
            rows = []
            for file, at, n, key in sorted(places):  # neighbours in an archive one after the other
                headers, payload = parse_record(zlib.decompress(archives.read(file, at, n), 31))
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response":
                    if sha1_base32(payload) != digest:
                        raise ValueError(f"{file} at {at}: the payload does not have the digest of its record")
                    size = len(payload)
                else:
                    size = int(headers["x-payload-length"])
                rows.append((key, number(headers["x-page"]), size, digest, headers["warc-type"], number(headers.get("x-refers-to-page")), headers.get("warc-target-uri")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)
        index.close()
        archives.close()

    return read


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"key": pa.array([capture_key(r["url"], r["page_id"]) for r in batch.to_pylist()], pa.string())})


def read_captures(wanted: DataFrame, parts: DataFrame, index_uri: str, archive_uri: str) -> DataFrame:
    """The records of the wanted (url, page_id) rows, each looked up in the index and read from its archive.

    Every capture of a wanted key is returned once; keys without a capture return nothing. The parts' first keys - one
    per ``CAPTURES_PER_PART`` captures - go to the tasks.
    """
    listed = sorted((r["first_key"].encode(), r["part"]) for r in parts.select("first_key", "part").collect())
    keys = wanted.select("url", "page_id").mapInArrow(_keys, "key string").distinct()
    n = max(1, len(listed))
    ranged = keys.repartitionByRange(n, "key").sortWithinPartitions("key")
    return ranged.mapInArrow(_reader(index_uri, archive_uri, listed), FOUND)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_dir(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives")
    parts = write_index(captures, f"{folder}/index")
    return read_captures(pages, parts, f"{folder}/index", f"{folder}/archives").drop("key", "url")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', strpos('0123456789abcdef', substr(hex, i, 1)) * 4 - 3, 4)), '') AS bits FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda k: CAST(substr(bits, i * 5 + k, 1) AS INTEGER) * (1 << (5 - k)))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""


by_value(sys.modules[__name__])
