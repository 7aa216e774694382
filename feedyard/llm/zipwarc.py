"""WARC records in ZIP packages: writer, directory parser and range reader.

A package is a ZIP file whose members are stored, not compressed: `archive/data.warc.gz`
(one gzip member per record) and `indexes/index.cdxj.gz` (offset and length of each record).
The reader parses the end record, its ZIP64 form and the central directory, finds the stored
members, and reads byte ranges of them: no member is extracted.  A package without an index
is read front to back, record by record.

Writing: each task rolls packages of about `PACKAGE_BYTES` under names of its own in the
shared folder; the list of packages is a table, so files of a task that failed or ran twice
are never read.  Files are reached through pyarrow's file systems (file, hdfs, s3, gs, abfs),
by the scheme of the shared folder.

Defined results: a null html is an empty payload; a null url leaves out the target; a null
page_id is written as `null` and never chosen while another is there; rows that repeat the
largest page_id are all responses; extra columns are ignored; an empty table writes nothing.
"""
from __future__ import annotations

import base64
import gzip
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedyard.llm.common import prep, stage
from feedyard.session import scratch_root

#: Payloads from this size on are compared (fixed value of the contract).
REVISIT_BYTES = 1000
PACKAGE_BYTES = 64 << 20
#: Bytes of the archive that one task should read.
TASK_BYTES = 64 << 20
#: Bytes that one range read asks for.
RANGE_BYTES = 4 << 20
DATA_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj.gz"
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the ZIP format: signatures and the marks of a ZIP64 field.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- records

def record(kind: str, page: str, url: str | None, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """One WARC record; a revisit holds the HTTP head (with the payload's length) alone."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:x-page:{refers}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record (lower-case names), `http` (those of the HTTP head) and `payload`."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = raw[end + 4:end + 4 + int(out["content-length"])]
    if len(block) != int(out["content-length"]):
        raise ValueError("cut WARC record")
    head, _, out["payload"] = block.partition(b"\r\n\r\n")
    out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return out


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name not in ("", "null") else None


# ---------------------------------------------------------------- packages

class Package:
    """Writes one package to a stream, a record at a time."""

    def __init__(self, path: str):
        system, at = _open(path)
        self.path, self._file = path, system.open_output_stream(at)
        self._zip = zipfile.ZipFile(self._file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._data = self._zip.open(zipfile.ZipInfo(DATA_MEMBER), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, page: str, kind: str, raw: bytes) -> None:
        z = gzip.compress(raw, 1, mtime=0)
        self._data.write(z)
        self.index.append(json.dumps({"page": page, "type": kind, "offset": self.size, "length": len(z)}))
        self.size += len(z)

    def close(self) -> tuple[str, int]:
        self._data.close()
        with self._zip.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as f:
            f.write(gzip.compress("\n".join(self.index).encode(), 1, mtime=0))
        self._zip.close()
        self._file.close()
        return self.path, len(self.index)


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (local header offset, stored size, method) from the central directory."""
    tail = min(size, 65557)
    f.seek(size - tail)
    buf = f.read(tail)
    at = buf.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", buf, at + 10)
    if at >= 20 and buf[at - 20:at - 16] == LOCATOR64 and (count == MARK16 or length == MARK32 or start == MARK32):
        f.seek(struct.unpack_from("<Q", buf, at - 12)[0])
        end64 = f.read(56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    f.seek(start)
    cd, at, out = f.read(length), 0, {}
    for _ in range(count):
        if cd[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", cd, at + 8)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", cd, at + 20)
        offset, = struct.unpack_from("<I", cd, at + 42)
        name = cd[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = cd[at + 46 + n:at + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, ln = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # ZIP64: only the fields that are marked, in this order
                x = e + 4
                if plain == MARK32:
                    x += 8
                if packed == MARK32:
                    packed, = struct.unpack_from("<Q", extra, x)
                    x += 8
                if offset == MARK32:
                    offset, = struct.unpack_from("<Q", extra, x)
            e += 4 + ln
        out[name] = (offset, packed, method)
        at += 46 + n + m + k
    return out


def member_start(f, offset: int) -> int:
    """Position of a member's bytes, behind its local header."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError("broken local header")
    n, m = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n + m


def ranges(path: str) -> Iterator[tuple[str, int, int, list[int]]]:
    """(path, start, end, lengths of the records in it) of the ranges that hold a package's
    records; no lengths: records follow one another, to be found by reading."""
    system, at = _open(path)
    with system.open_input_file(at) as f:
        names = directory(f, f.size())
        data = [n for n in names if n.endswith((".warc.gz", ".warc"))]
        indexes = [n for n in names if n.startswith("indexes/")]
        for n in data + indexes:
            if names[n][2] != 0:
                raise ValueError(f"{n} is compressed; a range of it cannot be read")
        if len(data) != 1 or not indexes:
            for n in data:
                s = member_start(f, names[n][0])
                yield path, s, s + names[n][1], []
            return
        base = member_start(f, names[data[0]][0])
        rows = []
        for n in indexes:
            s = member_start(f, names[n][0])
            f.seek(s)
            raw = f.read(names[n][1])
            text = gzip.decompress(raw) if n.endswith(".gz") else raw
            rows += [json.loads(x[x.index("{"):]) for x in text.decode().split("\n") if "{" in x]
        rows.sort(key=lambda r: r["offset"])
        start, lengths, size = None, [], 0
        for r in rows:
            if lengths and (size + r["length"] > RANGE_BYTES or r["offset"] != start + size):
                yield path, base + start, base + start + size, lengths
                start, lengths, size = None, [], 0
            if start is None:
                start = r["offset"]
            lengths.append(r["length"])
            size += r["length"]
        if lengths:
            yield path, base + start, base + start + size, lengths


def records(path: str, start: int, end: int, lengths: list[int]) -> Iterator[dict]:
    system, at = _open(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        if lengths:
            buf, p = f.read(end - start), 0
            for n in lengths:
                yield parse(gzip.decompress(buf[p:p + n]))
                p += n
            return
        left, rest = end - start, b""
        first = f.read(min(2, left))
        left, rest = left - len(first), first
        if first == b"\x1f\x8b":
            d, raw = zlib.decompressobj(31), []
            while rest or left:
                if not rest:
                    rest = f.read(min(RANGE_BYTES, left))
                    left -= len(rest)
                raw.append(d.decompress(rest))
                rest = d.unused_data
                if d.eof:
                    yield parse(b"".join(raw))
                    d, raw = zlib.decompressobj(31), []
            return
        while rest or left:  # plain records
            while b"\r\n\r\n" not in rest and left:
                more = f.read(min(RANGE_BYTES, left))
                left, rest = left - len(more), rest + more
            head = rest.index(b"\r\n\r\n") + 4
            size = next(int(x.partition(b":")[2]) for x in rest[:head].split(b"\r\n") if x.lower().startswith(b"content-length:"))
            need = head + size + 4
            while len(rest) < need and left:
                more = f.read(min(max(RANGE_BYTES, need - len(rest)), left))
                left, rest = left - len(more), rest + more
            yield parse(rest[:need])
            rest = rest[need:]


# ---------------------------------------------------------------- the operators

def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per page row; returns the table of packages (path, records,
    bytes)."""
    spark = prep(pages.sparkSession)
    folder = (folder or f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"))
    src = src.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    keep = (src.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
            .where("n > 1").select("digest", "first"))
    src = src.join(keep, "digest", "left")
    src = src.withColumn("again", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    src = src.select("page_id", "url", F.when(~F.col("again"), F.col("html")).alias("html"), "digest", "size", "again", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(folder)
        pack, done = None, []
        for b in batches:
            for r in b.to_pylist():
                if pack is None:
                    system.create_dir(at, recursive=True)
                    pack = Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                page = "null" if r["page_id"] is None else str(r["page_id"])
                kind = "revisit" if r["again"] else "response"
                pack.add(page, kind, record(kind, page, r["url"], r["html"] or b"", r["digest"], r["size"], str(r["first"])))
                if pack.size >= PACKAGE_BYTES:
                    done.append((*pack.close(), pack.size))
                    pack = None
        if pack is not None:
            done.append((*pack.close(), pack.size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return stage(src.mapInArrow(run, "path string, records long, bytes long"), "packages")


def read(packages: DataFrame) -> DataFrame:
    """Every record of the packages (path, and bytes if known): page_id, url, payload (null for a revisit),
    payload_bytes, payload_digest, record_type, refers_to."""
    spark = prep(packages.sparkSession)
    # numbers of their own: AQE would merge the small rows of places into one task that reads it all
    held = packages.agg(F.count("*").alias("n"), (F.sum("bytes") if "bytes" in packages.columns else F.count("*") * PACKAGE_BYTES).alias("b")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(held["b"] or 0) // TASK_BYTES))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for p in b.column("path").to_pylist() for x in ranges(p)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                                              pa.array([g[3] for g in got], pa.list_(pa.int32()))], names=["path", "a", "z", "n"])

    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        for b in batches:
            for x in b.to_pylist():
                out, size = [], 0
                for r in records(x["path"], x["a"], x["z"], x["n"]):
                    digest = base64.b32decode(r["warc-payload-digest"].partition(":")[2]).hex()
                    own = r["warc-type"] == "response"
                    if own and hashlib.sha1(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"payload digest of {r['warc-record-id']} does not hold")
                    out.append({"page_id": _page(r["warc-record-id"]), "url": r.get("warc-target-uri"), "payload": r["payload"] if own else None,
                                "payload_bytes": len(r["payload"]) if own else int(r["http"]["content-length"]), "payload_digest": digest,
                                "record_type": r["warc-type"], "refers_to": _page(r.get("warc-refers-to"))})
                    size += len(r["payload"])
                    if size > RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)

    spots = packages.select("path").repartition(max(1, min(held["n"], tasks)), F.col("path")).mapInArrow(locate, "path string, a long, z long, n array<int>")
    spots = spots.repartition(tasks, F.xxhash64("path", "a"))
    return spots.mapInArrow(fetch, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
