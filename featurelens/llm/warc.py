"""WARC archives: one gzip member per record, written and read in sequence.

``plan`` decides what each page's record is: of pages with equal payloads of at least ``least`` bytes
the one with the largest id is a ``response``, the others are ``revisit`` records that refer to it.
Payloads are compared by SHA-1, SHA-256 and length; only digests are shuffled for it.

``write`` turns each task's rows into archive files in a shared folder, a new file after ``ROLL`` bytes.
File names are new for each attempt of a task, and a manifest, committed by Spark's own writer, lists
the files of the attempts that counted; so a lost executor or a second attempt leaves only files that
nobody reads.  ``read`` opens the listed files on the executors and reads each from front to back:
bytes go through an incremental zlib decompressor, a record's end is its gzip member's end, the block is
framed by Content-Length, and block and payload digests are computed as the bytes pass.  A record that
is cut short, framed wrong or fails a digest raises ``WarcError``.  Memory: one decompression step and
one record's payload (only its digest, if ``keep_payload`` is off).

* Nulls: a null payload is empty; a null url gives the target URI ``about:blank``; a null id is
  written as ``null`` and read as null, and never is the one referred to.
* Ties: rows that share the largest id of a payload are all responses.  Repeated rows give repeated records.
* An empty table gives an empty archive and an empty result.  Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, or_empty

LEAST = 1000
ROLL = 64 << 20
STEP = 256 << 10
#: The revisit profile of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


class WarcError(ValueError):
    pass


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
         least: int = LEAST) -> DataFrame:
    """``__id``, ``__url``, ``__payload`` (binary) and ``__refers`` (null for a response)."""
    payload = or_empty(F.col(payload_col)).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), payload.alias("__payload"))
    same = [F.sha1("__payload").alias("__sha1"), F.sha2("__payload", 256).alias("__sha2"),
            F.octet_length("__payload").alias("__len")]
    keyed = rows.select("__id", *same).where(F.col("__len") >= least)
    groups = keyed.groupBy("__sha1", "__sha2", "__len").agg(F.max("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # Only payloads that occur twice matter; the rows of a hot one are split by adaptive execution.
    groups = groups.where("__n > 1").drop("__n")
    full = rows.select("*", *same).join(groups, ["__sha1", "__sha2", "__len"], "left")
    return full.select("__id", "__url", "__payload", F.when(
        ~F.col("__first").eqNullSafe(F.col("__id")), F.col("__first")).alias("__refers"))


def record_name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record; a revisit's block has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    payload_digest = base32(hashlib.sha1(payload).digest())
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~') if url else 'about:blank'}",
            f"WARC-Payload-Digest: {payload_digest}", f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", **how) -> DataFrame:
    """Writes the archives under ``folder``; returns their manifest (``path``, ``records``, ``bytes``)."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{root}/archives", recursive=True)
        out, path, files, n, size = None, "", [], 0, 0
        for b in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, n, size = f"{root}/archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = member(record(page_id, url, payload, refers, date))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL:
                    out.close()
                    out, files = None, [*files, (path, n, size)]
        if out is not None:
            out.close()
            files.append((path, n, size))
        for path, n, size in files:
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

    plan(pages, **how).mapInArrow(written, WRITTEN).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(WRITTEN).parquet(f"{folder}/manifest")


class Member:
    """One record's decompressed bytes, taken in steps from the file."""

    def __init__(self, source, left: bytes):
        self.source, self.z, self.raw, self.buffer = source, zlib.decompressobj(31), left, bytearray()

    def more(self) -> bool:
        """Decompresses up to ``STEP`` further bytes; False at the member's end."""
        while not self.z.eof:
            if not self.raw:
                self.raw = self.source.read(STEP)
                if not self.raw:
                    raise WarcError("the file ends within a record")
            got = self.z.decompress(self.raw, STEP)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                raise WarcError("a header without end")
        found = bytes(self.buffer[:at])
        del self.buffer[:at + len(mark)]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise WarcError("a block shorter than its Content-Length")
            part = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(part)
            yield part


def fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def page_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(null|-?\d+)>", name)
    if not found:
        raise WarcError(f"not a page's record: {name}")
    return None if found[1] == "null" else int(found[1])


def records(source, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an open archive, in order, verified."""
    left = source.read(STEP)
    while left:
        m = Member(source, left)
        head = fields(m.until(b"\r\n\r\n"))
        length, block, whole = int(head["content-length"]), hashlib.sha1(), hashlib.sha1()
        http, payload_bytes, payload, text = b"", 0, bytearray(), None
        for part in m.take(length):
            block.update(part)
            if text is None:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                text, part = fields(http[:at]), http[at + 4:]
            whole.update(part)
            payload_bytes += len(part)
            if keep_payload:
                payload += part
        while m.more():
            pass
        if bytes(m.buffer) != b"\r\n\r\n":
            raise WarcError("a record's end is not where its Content-Length says")
        if text is None or head["warc-block-digest"] != base32(block.digest()):
            raise WarcError(f"block digest of {head['warc-record-id']}")
        kind = head["warc-type"]
        if kind == "response" and (head["warc-payload-digest"] != base32(whole.digest())
                                   or int(text["content-length"]) != payload_bytes):
            raise WarcError(f"payload digest of {head['warc-record-id']}")
        yield {"page_id": page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": kind,
               "refers_to": page_of(head["warc-refers-to"]) if kind == "revisit" else None,
               "payload_bytes": int(text["content-length"]),
               "payload_digest": base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(),
               } | ({"payload": bytes(payload)} if keep_payload else {})
        left = m.raw or source.read(STEP)


def read(spark: SparkSession, manifest: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """A row per record of the manifest's archives; ``payload`` besides, if kept (a revisit's is empty)."""
    schema = RECORD + (", payload binary" if keep_payload else "")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as source:
                    for r in records(source, keep_payload):
                        rows.append(r)
                        if len(rows) >= (16 if keep_payload else 4096):
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
                 "payload_bytes": pa.int64(), "payload_digest": pa.string()}
        kinds |= {"payload": pa.binary()} if keep_payload else {}
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds.items()))

    files = manifest.select("path").repartition(spark.sparkContext.defaultParallelism * 4)
    return files.mapInArrow(opened, schema)


def archive(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    return read(spark, write(pages, folder, **how), folder)
