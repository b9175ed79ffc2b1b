"""WARC archives with a two-level capture index.

Pages become gzip members of WARC files in the shared folder. Of equal payloads only one is stored; the others are revisit
records that name it. The capture index sorts all captures by their reversed-host URL key into gzip blocks of ``BLOCK_LINES`` lines; a
sparse directory has each block's first key and place, and a top level the first key of each index file. A look-up
binary-searches both and reads one block, or a few where a key fills more, then only the bytes of its records.

Tasks write files under names of their own; only names that a finished task returned are ever read, so lost
executors leave nothing but unread files.

Defined results: a null page text is an empty payload; a null URL is stored as ``urn:page:<id>``. Repeated rows are records of their own; of equal
payloads all rows with the largest id are responses, and a null id counts as smaller than any other. An empty table gives no files.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.llm.shared import new_path, written

ROLL_BYTES, BLOCK_LINES, TASK_BYTES = 64 << 20, 3000, 8 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id long, record_type string, digest string, file string, offset long, length long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, in lower case, without scheme, port 80 or 443 and user: ``com,example)/path?query``."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: a response with the payload, or a revisit of ``refers_to`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = url if url is not None else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    head += [] if refers_to is None else [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; ``payload`` is None in a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
        "refers_to": number("X-Refers-To-Page-ID"), "url": fields["WARC-Target-URI"], "payload": body if kind == "response" else None,
    }


def _writer(base: str, date: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        fs, top = _open(base)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                payload = (r["html"] or "").encode()
                member = gzip.compress(record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], date), 6, mtime=0)
                out.write(member)
                url = r["url"] if r["url"] is not None else f"urn:page:{r['page_id']}"
                rows.append((url_key(url), r["page_id"], "response" if r["refers_to"] is None else "revisit", r["digest"], f"{base}/{name}", at, len(member)))
                at += len(member)
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _names(_CAPTURE))
        if out is not None:
            out.close()

    return write


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def write_warc(pages: DataFrame, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each page and returns the captures. Of equal payloads of ``min_bytes`` or more, the largest id is stored."""
    spark = pages.sparkSession
    raw = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(raw).alias("digest"), F.length(raw).alias("bytes"), F.xxhash64(raw).alias("mark")
    )
    # ids, digests, lengths and a second hash find the groups; a group's size only enters as a count and a maximum
    same = ["digest", "bytes", "mark"]
    ids = written(own.filter(F.col("bytes") >= min_bytes).select("page_id", *same), "warc-digests")
    most = ids.groupBy(*same).agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1 and refers_to is not null").drop("n")
    again = ids.join(most, same).filter("page_id is null or page_id < refers_to").distinct().select(F.col("page_id").alias("again_id"), *[F.col(c).alias(f"again_{c}") for c in same], "refers_to")
    equal = own["page_id"].eqNullSafe(again["again_id"])
    for c in same:
        equal = equal & (own[c] == again[f"again_{c}"])
    both = own.join(again, equal, "left")
    base = new_path(spark, "warc")
    return written(both.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(base, date, roll_bytes), _CAPTURE), "warc-captures")


def _index_writer(base: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[dict] = []
        rows: list[tuple] = []
        out, at = None, 0
        name = f"{base}/{uuid.uuid4().hex}.cdx.gz"
        fs, top = _open(base)

        def flush():
            nonlocal out, at
            if out is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(_open(name)[1], compression=None)
            block = gzip.compress("".join(f"{x['key']} {json.dumps({k: v for k, v in x.items() if k != 'key'})}\n" for x in lines).encode(), 6, mtime=0)
            out.write(block)
            rows.append((lines[0]["key"], lines[-1]["key"], name, at, len(block), len(lines)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for x in batch.to_pylist():
                lines.append(x | {"key": x["key"].replace(" ", "%20").replace("\n", "%0A")})
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["first", "last", "file", "offset", "length", "n"])

    return write


@dataclass
class CaptureIndex:
    """``directory``: ``first, last, file, offset, length, n`` of every index block."""

    directory: DataFrame

    def captures(self) -> DataFrame:
        """All captures, read from the index blocks."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    rows = _block_lines(block)
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _CAPTURE.split(", "))]))

        n = -(-max(1, self.directory.count()) // 4)  # some blocks a task, however few bytes their rows have
        return self.directory.repartition(n, "file", "offset").mapInArrow(read, _CAPTURE)

    def lookup(self, url: str) -> list[dict]:
        """The captures of one URL: binary search over index files, then over that file's blocks, then one range read a block."""
        key = url_key(url).replace(" ", "%20").replace("\n", "%0A")
        tops = sorted(self.directory.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect(), key=lambda r: r["first"].encode())
        hi = bisect.bisect_right([r["first"].encode() for r in tops], key.encode())
        found: list[dict] = []
        for top in reversed(tops[:hi]):
            if top["last"].encode() < key.encode():
                break
            own = sorted(self.directory.filter(F.col("file") == top["file"]).collect(), key=lambda r: r["offset"])
            at = bisect.bisect_left([r["last"].encode() for r in own], key.encode())
            while at < len(own) and own[at]["first"].encode() <= key.encode():
                found += [x for x in _block_lines(own[at].asDict()) if x["key"] == key]
                at += 1
        return found


def _block_lines(block: dict) -> list[dict]:
    fs, path = _open(block["file"])
    with fs.open_input_file(path) as f:
        text = gzip.decompress(f.read_at(block["length"], block["offset"])).decode()
    return [{"key": k} | json.loads(v) for k, _, v in (x.partition(" ") for x in text.split("\n")[:-1])]


def write_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorts captures by key into index files in the shared folder. A key with very many captures spreads over files by page."""
    base = new_path(captures.sparkSession, "cdx")
    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return CaptureIndex(written(ordered.mapInArrow(_index_writer(base, block_lines), "first string, last string, file string, offset long, length long, n long"), "cdx-directory"))


def read_record(capture: dict) -> dict:
    """One record by a range read."""
    fs, path = _open(capture["file"])
    with fs.open_input_file(path) as f:
        return parse(gzip.decompress(f.read_at(capture["length"], capture["offset"])))


def read_warc(index: CaptureIndex) -> DataFrame:
    """Every record that the index knows, by range reads in the order of each archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _RECORD.split(", "))])
        for batch in batches:
            rows, held = [], 0
            for c in batch.to_pylist():
                if c["file"] != name:
                    name = c["file"]
                    fs, path = _open(name)
                    f = io.BufferedReader(fs.open_input_file(path), 1 << 20)
                f.seek(c["offset"])
                rows.append(parse(zlib.decompress(f.read(c["length"]), 31)))
                held += rows[-1]["payload_bytes"]
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    captures = index.captures().select("file", "offset", "length")
    total = captures.agg(F.sum("length")).first()[0] or 0
    return captures.repartitionByRange(max(1, -(-total // TASK_BYTES)), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, _RECORD)
