"""Dictionary-compressed WARC archives.

Pages with equal payloads are grouped by a content hash; the page with the largest id is
archived as a ``response`` record, the others as ``revisit`` records that refer to it.
Every task writes its own archives: it builds a Zstandard dictionary from the first records
it archives (a bounded sample), embeds it in a leading skippable frame, and compresses each
record as a frame of its own, so a reader needs nothing but the file.

Archives go to a folder of the shared store (through Arrow's file systems, never a local
temp folder), under a name that holds the task's partition and attempt.  The manifest, an
ordinary Parquet table that Spark commits, names the archives of the attempts that counted;
files left by a lost or repeated attempt are never read.

Defined results: a null html is an empty payload; a null url writes no target; a null page id
is written as ``null`` and read back as null; rows that repeat both the largest id and the
payload are all responses; an empty table writes no archive and reads back as no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.tables import sized, written
from riskframe.session import scratch_path

#: Fixed values of the format: skippable frame that holds the dictionary, and Zstandard's own magic.
DICT_FRAME = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DICT_BYTES = 64 << 10
#: Bound of the sample that a dictionary is built from.
SAMPLE_BYTES = 2 << 20
#: An archive is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record.  The block of a revisit is the HTTP header alone, with the payload's full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, payload, revisit)}",
            f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + target_uri(url))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to, payload, False)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def target_uri(url: str) -> str:
    """An address as a header may hold it: blanks, controls and percent signs that begin no escape are escaped; escapes stay."""
    return re.sub(r"[\x00-\x20\x7f]|%(?![0-9A-Fa-f]{2})", lambda m: f"%{ord(m[0]):02X}", url)


def _urn(page_id: int | None, payload: bytes, revisit: bool) -> str:
    """A record's name: page, kind and payload, so pages without an id or of the same id have records of their own
    (rows that repeat id and payload are the same record)."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{'revisit' if revisit else 'response'}:{payload_digest(payload)}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").split(":")[2]
    return None if name == "null" else int(name)


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained from the samples; where they are too few or too small to train, their own bytes serve as content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archives:
    """The archives of one task."""

    def __init__(self, base: str, name: str):
        self.store, self.base = pafs.FileSystem.from_uri(base)
        self.name, self.k, self.out, self.done = name, 0, None, []

    def start(self, samples: list[bytes]) -> None:
        self.dictionary = build_dictionary(samples)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=self.dictionary, write_content_size=True)

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.path = f"{self.base}/{self.name}-{self.k:04d}.warc.zst"
            self.store.create_dir(self.base, recursive=True)
            self.out = self.store.open_output_stream(self.path, compression=None)  # by name it would compress the file again
            data = self.dictionary.as_bytes()
            self.out.write(struct.pack("<II", DICT_FRAME, len(data)) + data)
            self.size, self.records = 8 + len(data), 0
        frame = self.packer.compress(record)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path.rpartition("/")[2], self.records, self.size))
            self.out, self.k = None, self.k + 1


def write_archives(pages: DataFrame, path: str, min_payload: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``path`` and return the manifest (archive, records, bytes)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("payload")).withColumn("_h", F.unhex(F.sha2("payload", 256)))
    same = sized(base.filter(F.octet_length("payload") >= min_payload).groupBy("_h")
                 .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("_h", "first"),
                 "warc-groups")
    rows = base.join(same, "_h", "left").select("page_id", "url", "payload", "first")
    folder = f"{path}/archives"

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        out = _Archives(folder, f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}")
        waiting, held = [], 0
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first"))):
                page_id, first = page_id.as_py(), first.as_py()
                record = record_bytes(page_id, url.as_py(), payload.as_py(), first, first is not None and page_id != first)
                if waiting is None:
                    out.add(record)
                    continue
                waiting.append(record)
                held += len(record)
                if held >= SAMPLE_BYTES:
                    out.start(waiting)
                    for r in waiting:
                        out.add(r)
                    waiting = None
        if waiting:
            out.start(waiting)
            for r in waiting:
                out.add(r)
        out.close()
        yield pa.record_batch([pa.array([x[0] for x in out.done], pa.string()), pa.array([x[1] for x in out.done], pa.int64()),
                               pa.array([x[2] for x in out.done], pa.int64())], names=["archive", "records", "bytes"])

    return written(rows.mapInArrow(archive, MANIFEST), "warc-manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, a record at a time."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    dictionary, rest = None, head
    if magic == DICT_FRAME:
        data, rest = stream.read(size), b""
        if data[:4] == struct.pack("<I", ZSTD_MAGIC):
            data = zstandard.ZstdDecompressor().decompress(data)
        dictionary = zstandard.ZstdCompressionDict(data)
    source = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(
        _Chained(rest, stream), read_across_frames=True), 1 << 20)
    while True:
        line = source.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := source.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            headers[k] = v
        block = source.read(int(headers["Content-Length"]))
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


class _Chained(io.RawIOBase):
    """First some bytes, then a stream."""

    def __init__(self, first: bytes, stream):
        self.first, self.stream = first, stream

    def read(self, n: int = -1) -> bytes:
        if self.first:
            out, self.first = self.first[:n] if n >= 0 else self.first, self.first[n:] if n >= 0 else b""
            return out
        return self.stream.read(n if n >= 0 else None)


def parse_record(headers: dict[str, str], block: bytes) -> tuple:
    """The RECORD columns; a response's payload must match its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    if not revisit and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    return (_page_of(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"],
            _page_of(headers["WARC-Refers-To"]) if revisit else None, headers.get("WARC-Target-URI"))


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """One row per record of the manifest's archives, parsed from their bytes."""
    folder = f"{path}/archives"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                got = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in records_of(stream):
                        got.append(parse_record(headers, block))
                        if len(got) == 2000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got), types)], names=names)
                            got = []
                if got:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got), types)], names=names)

    archives = max(1, manifest.count())
    return manifest.select("archive").repartition(min(archives, 10_000)).mapInArrow(rows, RECORD)


def archive_and_read(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives (below the shared scratch folder by default) and read them back."""
    path = path or scratch_path(spark, "warc")
    return read_archives(write_archives(pages, path), path)
