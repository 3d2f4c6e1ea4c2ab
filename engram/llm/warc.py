"""WARC archives compressed by Zstandard: one frame a record, the dictionary in a
skippable frame before them.

``write_archives`` has each task write its records to files of its own in the
shared folder; ``read_archives`` deals the files to tasks, which read them as
streams: the dictionary first, then frame by frame, each held against its
headers, lengths and digests.

Records with equal payloads of at least ``REVISIT_BYTES`` are stored once: the
one with the largest page_id is the response, the others revisit it and carry
its HTTP headers only.  Payloads are compared by SHA-256 and length.

Awkward rows: a null html is an empty payload; a null url leaves out the target
header, and its control characters are percent-encoded; a null page_id comes
before all others, and among null ids alone all are responses.  Rows that repeat
the largest page_id with an equal payload are all responses.  An empty table
gives no archive and no record.  Extra columns are not stored.

A damaged archive does not end the job: its reader gives a row with ``error``
and goes on with the next frame where there is one.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.llm._common import materialize, prepare, shared_folder

REVISIT_BYTES = 1000
#: An archive is closed after so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: An archive's dictionary is trained on its first records, as far as these go.
TRAIN_BYTES, TRAIN_RECORDS, DICTIONARY_BYTES = 1 << 20, 256, 16 << 10
READ_BYTES = 64 << 10
LEVEL = 3

#: Fixed values of the formats: skippable frames, Zstandard frames, WARC and its revisit profile.
DICTIONARY_MAGIC, SKIPPABLE_LOW, SKIPPABLE_HIGH, ZSTD_MAGIC = 0x184D2A5D, 0x184D2A50, 0x184D2A5F, 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
BREAK = b"\r\n"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, page_id long, url string, record_type string, record_id string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary, error string"
)


class DamagedArchive(ValueError):
    """A record that breaks the format, or does not hold what its headers say."""


def record_id(page_id: int | None, payload_sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{payload_sha1}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _lines(pairs: list[tuple[str, object]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None)


def build_record(page_id: int | None, url: str | None, sha1: str, length: int, payload: bytes | None, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or, where ``payload`` is None, a revisit."""
    block = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", length)]) + BREAK + (payload or b"")
    revisit = payload is None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, sha1)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), url)),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, sha1) if revisit else None),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ("WARC-Block-Digest", _digest(block)),
        ("Page-ID", page_id),
        ("Refers-To-Page-ID", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return VERSION + BREAK + _lines(head) + BREAK + block + BREAK + BREAK


def _headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in data.split(BREAK):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise DamagedArchive(f"no header line: {line[:60]!r}")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _number(headers: dict[str, str], name: str) -> int:
    if not re.fullmatch(r"[0-9]+", headers.get(name, "")):
        raise DamagedArchive(f"{name} is no length")
    return int(headers[name])


def parse_record(data: bytes) -> dict[str, object]:
    """The record of one frame as a row of ``RECORDS``; anything amiss raises.

    Checked are the version, the required headers, that the block has the length
    given and the record ends with it, the block's digest, the HTTP header's
    length, and the payload's digest.
    """
    top, gap, rest = data.partition(BREAK + BREAK)
    if not gap:
        raise DamagedArchive("headers do not end")
    version, _, lines = top.partition(BREAK)
    if version != VERSION:
        raise DamagedArchive(f"version is {version[:20]!r}")
    head = _headers(lines)
    for name in REQUIRED:
        if not head.get(name):
            raise DamagedArchive(f"{name} is missing")
    length = _number(head, "content-length")
    if len(rest) != length + 4 or rest[length:] != BREAK + BREAK:
        raise DamagedArchive(f"content-length is {length}, the frame holds {len(rest) - 4}")
    block, kind = rest[:length], head["warc-type"]
    if "warc-block-digest" in head and head["warc-block-digest"] != _digest(block):
        raise DamagedArchive("block digest differs")
    row: dict[str, object] = {"record_type": kind, "record_id": head["warc-record-id"], "url": head.get("warc-target-uri")}
    if kind not in ("response", "revisit"):
        return row
    http, gap, payload = block.partition(BREAK + BREAK)
    if not gap:
        raise DamagedArchive("HTTP headers do not end")
    claimed = _number(_headers(http.partition(BREAK)[2]), "content-length")
    digest = head.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise DamagedArchive("payload digest is missing")
    if kind == "response":
        if len(payload) != claimed:
            raise DamagedArchive(f"HTTP content-length is {claimed}, the payload has {len(payload)}")
        if digest != _digest(payload):
            raise DamagedArchive("payload digest differs")
    elif payload or "warc-refers-to" not in head:
        raise DamagedArchive("a revisit holds a payload or refers to nothing")
    try:
        page, other = (int(head[n]) if n in head else None for n in ("page-id", "refers-to-page-id"))
        bare = base64.b32decode(digest[5:]).hex()
    except ValueError as e:
        raise DamagedArchive(str(e)) from None
    return row | {"page_id": page, "payload_bytes": claimed, "payload_digest": bare, "refers_to": other, "payload": payload if kind == "response" else None}


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like these; empty where they are too few or too alike."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def archive(records: list[bytes], dictionary: bytes, more: Iterator[bytes] = iter(())) -> Iterator[bytes]:
    """The bytes of an archive: the dictionary's skippable frame, then a frame a record."""
    if dictionary:
        yield struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
    for record in records:
        yield packer.compress(record)
    for record in more:
        yield packer.compress(record)


class _Stream:
    """Bytes of a file, asked for by number."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.held += got
        return bool(got)

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        return self.held[:n]


def frames(file) -> Iterator[bytes | DamagedArchive]:
    """Each frame's content, with the dictionary of the leading skippable frame.

    A damaged frame gives an error; reading goes on at the next frame's magic.
    """
    stream, unpacker = _Stream(file), None
    first = True
    while len(magic := stream.peek(4)) == 4:
        (number,) = struct.unpack("<I", magic)
        if SKIPPABLE_LOW <= number <= SKIPPABLE_HIGH:
            size = struct.unpack("<I", stream.take(8)[4:].ljust(4, b"\0"))[0]
            content = stream.take(size)
            if len(content) < size:
                yield DamagedArchive("a skippable frame is cut short")
                return
            if first and number == DICTIONARY_MAGIC:
                if content[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary may itself be packed
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            first = False
            continue
        first = False
        unpacker = unpacker or zstandard.ZstdDecompressor()
        frame, parts = unpacker.decompressobj(), []
        if number != ZSTD_MAGIC:
            yield DamagedArchive(f"no frame begins with {magic!r}")
            if not _resume(stream, 1):
                return
            continue
        try:
            while not frame.eof and (stream.held or stream.more()):
                got, stream.held = stream.held, b""
                parts.append(frame.decompress(got))
            if not frame.eof:
                yield DamagedArchive("the last frame is cut short")
                return
            stream.held = frame.unused_data
            yield b"".join(parts)
        except zstandard.ZstdError as e:
            stream.held = got
            yield DamagedArchive(f"a frame cannot be decoded: {e}")
            if not _resume(stream, 4):
                return
    if stream.held:
        yield DamagedArchive(f"{len(stream.held)} bytes stand after the last frame")


def _resume(stream: _Stream, at: int) -> bool:
    """Move to the next frame's magic."""
    wanted = struct.pack("<I", ZSTD_MAGIC)
    while True:
        found = stream.held.find(wanted, at)
        if found >= 0:
            stream.held = stream.held[found:]
            return True
        stream.held, at = stream.held[-3:], 0
        if not stream.more():
            stream.held = b""
            return False


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, sha1, length, refers_to, payload): a record a page.

    ``refers_to`` is null for responses, ``payload`` null for revisits.  The
    payloads that occur more than once come from a count by hash with map-side
    combine; pages then meet them in one join, whose large side Spark can split.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("length", F.length("html").cast("long")).withColumn("sha256", F.sha2("html", 256))
    groups = rows.where(F.col("length") >= REVISIT_BYTES).groupBy(F.col("sha256").alias("same")).agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
    joined = rows.join(groups.where("n > 1 and leader is not null").drop("n"), F.col("sha256") == F.col("same"), "left")
    revisits = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    return joined.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.sha1("html").alias("sha1"), "length",
        F.when(revisits, F.col("leader")).cast("long").alias("refers_to"), F.when(~revisits, F.col("html")).alias("payload"),
    )


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def built() -> Iterator[bytes]:
            for batch in batches:
                for page, url, sha1, length, refers_to, payload in zip(*(batch.column(c) for c in ("page_id", "url", "sha1", "length", "refers_to", "payload"))):
                    yield build_record(page.as_py(), url.as_py(), sha1.as_py(), length.as_py(), payload.as_py(), refers_to.as_py(), date)

        records, done = built(), False
        while not done:
            sample, size = [], 0
            while size < TRAIN_BYTES and len(sample) < TRAIN_RECORDS:
                record = next(records, None)
                if record is None:
                    done = True
                    break
                sample.append(record)
                size += len(record)
            if not sample:
                break
            name, n, total = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
            about = b"software: engram\r\nformat: WARC File Format 1.1\r\n"
            info = VERSION + BREAK + _lines([
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", os.path.basename(name)),
                ("Content-Type", "application/warc-fields"), ("Content-Length", len(about)),
            ]) + BREAK + about + BREAK + BREAK

            def counted() -> Iterator[bytes]:
                nonlocal done, n
                while total < ARCHIVE_BYTES:
                    record = next(records, None)
                    if record is None:
                        done = True
                        return
                    n += 1
                    yield record

            # the name ends in .zst, but these bytes are packed already
            with store.open_output_stream(name, compression=None) as out:
                n = len(sample)
                for part in archive([info, *sample], train(sample), iter(()) if done else counted()):
                    out.write(part)
                    total += len(part)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [total]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; returns the manifest
    (path, records, bytes), a row a file.

    ``folder`` is a URI every executor can write to; the default lies in the
    shared folder.  The manifest is written before it is returned and names the
    files of successful tasks only: a task that is run again writes new files.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:"))
    return materialize(plan_records(pages).mapInArrow(_writer(folder, date), MANIFEST).withColumn("folder", F.lit(folder)), "manifest")


def _reader(payloads: bool):
    schema = pa.schema([
        ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
    ])

    def rows(path: str, folder: str) -> Iterator[dict]:
        store, _ = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(path, compression=None) as file:
            for content in frames(file):
                try:
                    if isinstance(content, DamagedArchive):
                        raise content
                    row = parse_record(content)
                except DamagedArchive as e:
                    row = {"error": str(e)}
                if not payloads:
                    row.pop("payload", None)
                if row.get("record_type") != "warcinfo":
                    yield row | {"path": path}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist()):
                held, size = [], 0
                for row in rows(path, folder):
                    held.append(row)
                    size += len(row.get("payload") or b"")
                    if len(held) >= 1024 or size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return read


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records (columns of ``RECORDS``) of the archives of a manifest, each file
    read as a stream by one task.  ``error`` says what is amiss with a record."""
    files = manifest.count()
    dealt = manifest.select("path", "folder").repartition(max(1, min(files, 4096)))
    return dealt.mapInArrow(_reader(payloads), RECORDS)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest (path, folder) of the ``.warc.zst`` files of a folder that has none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "").alias("path"), F.lit(folder if "://" in folder else f"file://{folder}").alias("folder"))


def with_payloads(records: DataFrame) -> DataFrame:
    """``records`` in which revisits carry the payload they refer to."""
    held = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("same")).agg(F.first("payload").alias("found"))
    met = records.join(held, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left")
    return met.withColumn("payload", F.coalesce("payload", "found")).drop("of", "same", "found")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error of
    every record, after the archives are written and read back."""
    read = read_archives(write_archives(pages), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
