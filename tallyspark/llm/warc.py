"""Operator 8, WARC: archives written and read as streams, with a chunked record table.

Writing: each task streams its rows into archives of its own in a shared folder (one gzip member per record), under a
name of its own; the table of finished archives says which count, so a task that is run again harms nothing.
Reading: each task streams an archive; payloads come out as rows of record id and chunk number, each with the digest
so far, so that no record is ever whole in memory.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder, shuffle_parts

CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    chunk_bytes: int = 1 << 20
    archive_bytes: int = 64 << 20  # a new archive begins beyond this many payload bytes
    min_revisit_bytes: int = 0
    level: int = 1


def _open(folder: str):
    """The file system of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _cut(data: memoryview, size: int):
    for i in range(0, len(data), size):
        yield data[i : i + size]


class ArchiveWriter:
    """Writes records to archives in folder; a payload is an iterable of bytes of known total length."""

    def __init__(self, folder: str, cfg: WarcConfig):
        self.fs, self.path = _open(folder)
        self.cfg, self.out, self.done = cfg, None, []

    def _begin(self):
        self.name, self.size, self.n = f"{self.path}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
        self.out = self.fs.open_output_stream(self.name, compression=None)

    def write(self, headers: list[tuple[str, str]], payload, length: int):
        if self.out is None:
            self._begin()
        gz = zlib.compressobj(self.cfg.level, wbits=31)
        head = CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % length]) + CRLF * 2
        self.out.write(gz.compress(head))
        for part in payload:
            self.out.write(gz.compress(part))
        self.out.write(gz.compress(CRLF * 2) + gz.flush())
        self.size, self.n = self.size + length, self.n + 1
        if self.size >= self.cfg.archive_bytes:
            self.close()

    def close(self):
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.n))
            self.out = None


class _Inflate(io.RawIOBase):
    """The bytes of a file of many gzip members, without holding more than a block."""

    def __init__(self, raw):
        self.raw, self.z, self.left, self.ready = raw, zlib.decompressobj(31), b"", b""

    def readable(self):
        return True

    def readinto(self, buf):
        while not self.ready:
            if self.z.eof:
                self.left, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.left or self.raw.read(1 << 16)
            self.left = b""
            if not data:
                return 0
            self.ready = self.z.decompress(data, 1 << 20)
            self.left = self.z.unconsumed_tail
        n = min(len(buf), len(self.ready))
        buf[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def read_records(raw, chunk_bytes: int):
    """(headers, payload chunks) of each record of an opened archive, in order; chunks must be used before the next."""
    s = io.BufferedReader(_Inflate(raw), 1 << 18)
    while True:
        line = s.readline()
        if not line:
            return
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := s.readline()) not in (CRLF, b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[k.lower()] = v
        left = [int(headers["content-length"])]

        def chunks(left=left):
            while left[0]:
                part = s.read(min(chunk_bytes, left[0]))
                if not part:
                    raise ValueError("the archive ends within a record")
                left[0] -= len(part)
                yield part

        yield headers, chunks()
        for _ in chunks():
            pass


def with_record_types(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, sha1, refers_to): of equal payloads of min_bytes bytes at least, the one with the largest id is
    what the others refer to. Only digests are shuffled to find it; the join splits hot digests."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    t = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    t = t.withColumn("sha1", F.sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    many = t.filter(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    t = t.join(many.drop("n"), ["sha1", "bytes"], "left")
    return t.select("id", "url", "payload", "sha1", F.when(F.col("top") > F.col("id"), F.col("top")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, cfg: WarcConfig) -> DataFrame:
    """(path, records) of the archives written for rows as with_record_types() gives them."""

    def run(batches):
        w = ArchiveWriter(folder, cfg)
        for b in batches:
            for r in b.to_pylist():
                data = r["payload"].encode("utf-8", "surrogatepass")
                digest = _base32(bytes.fromhex(r["sha1"]))
                kind = "response" if r["refers_to"] is None else "revisit"
                uri = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if r['id'] is None else r['id']}>"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(data)))]
                if kind == "revisit":
                    head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{r['refers_to']}>")]
                    w.write(head, (), 0)
                else:
                    w.write(head, _cut(memoryview(data), cfg.chunk_bytes), len(data))
        w.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in w.done], pa.string()), pa.array([n for _, n in w.done], pa.int64())], names=["path", "records"])

    return rows.mapInArrow(run, "path string, records long")


def read_chunks(archives: DataFrame, folder: str, cfg: WarcConfig = WarcConfig(), with_data: bool = True) -> DataFrame:
    """The chunked record table of archives (path): record_id, record_type, target_uri, refers_to, header_digest,
    header_bytes, chunk_no, bytes_so_far, sha1_so_far (base32), is_last, data. Empty payloads have one empty chunk."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("header_digest", pa.string()), ("header_bytes", pa.int64()), ("chunk_no", pa.int32()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("is_last", pa.bool_()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            fs, _ = _open(folder)
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as raw:
                    yield from _record_batches(read_records(raw, cfg.chunk_bytes), schema, with_data, cfg.chunk_bytes)

    ddl = "record_id string, record_type string, target_uri string, refers_to string, header_digest string, header_bytes long, chunk_no int, bytes_so_far long, sha1_so_far string, is_last boolean, data binary"
    paths = archives.select("path")
    return paths.repartition(shuffle_parts(archives.sparkSession), "path").mapInArrow(run, ddl)


def _record_batches(records, schema, with_data, limit):
    rows, held = [], 0
    for h, chunks in records:
        sha, size, no, total = hashlib.sha1(), 0, 0, int(h["content-length"])
        ident = lambda x: x[1:-1].removeprefix("urn:page:") if x else None
        for part in [b""] if not total else chunks:
            sha.update(part)
            size += len(part)
            rows.append((ident(h["warc-record-id"]), h["warc-type"], h.get("warc-target-uri"), ident(h.get("warc-refers-to")), h["warc-payload-digest"].removeprefix("sha1:"), int(h.get("x-payload-length", total)), no, size, _base32(sha.digest()), size == total, part if with_data else None))
            no, held = no + 1, held + len(part)
            if held >= 4 * limit or len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def archive_pages(pages: DataFrame, cfg: WarcConfig = WarcConfig(), id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Writes the archives in a new shared folder; the table of archives and the folder."""
    folder = new_folder(pages.sparkSession, "warc")
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    rows = with_record_types(pages, id_col, url_col, payload_col, cfg.min_revisit_bytes)
    return materialize(write_archives(rows, folder, cfg), "warc-archives"), folder


def round_trip(pages: DataFrame, cfg: WarcConfig = WarcConfig(), id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok: a row per page, from the archives.

    Null payloads are empty ones. Rows with equal ids and payloads that are the largest are responses, each of them; a
    null id is never referred to unless all are null, and then nothing refers. Headers drop nothing but line breaks in
    URLs. An empty table gives no archive and no row. Other columns are not read.
    digest_ok: the digest of the payload read is that of its header (revisits have no payload: true).
    """
    archives, folder = archive_pages(pages, cfg, id_col, url_col, payload_col)
    last = read_chunks(archives, folder, cfg, with_data=False).filter("is_last")
    return last.select(
        F.expr("try_cast(record_id as bigint)").alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("header_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("header_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
        ((F.col("record_type") == "revisit") | (F.col("header_digest") == F.col("sha1_so_far"))).alias("digest_ok"),
    )
