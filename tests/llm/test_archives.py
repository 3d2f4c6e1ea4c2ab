"""Archives: round trips, the format itself, and damaged files."""

import hashlib
import io
import struct

import pytest
import zstandard

from engram.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(data) >= 1000 and equal and page != max(equal)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(equal) if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    long, edge = "é" * 500, "x" * 999
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: 1", long), (3, None, long), (4, "http://a/", edge), (5, "http://a/", edge), (6, "", None), (7, "u", "")]
    rows += [(None, "http://n/", long), (None, "http://n/", "y" * 2000), (None, "http://n/", "y" * 2000), (9, "r", "z" * 3000), (9, "r", "z" * 3000), (8, "r", "z" * 3000)]
    rows += [(10, "big", "<p>\r\n\r\nWARC/1.1" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = W.write_archives(df)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    records = W.read_archives(manifest)
    assert rows_of(records) == expected(rows) and records.where("error is not null").isEmpty()
    full = {(r.page_id, r.payload_digest): bytes(r.payload) for r in W.with_payloads(records).collect()}
    assert all(full[p, hashlib.sha1((h or "").encode()).hexdigest()] == (h or "").encode() for p, _, h in rows)
    urls = {r.page_id: r.url for r in records.collect()}
    assert urls[2] == "http://b/%0D%0AX: 1" and urls[3] is None
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = spark.createDataFrame([(1, "u", "h", 5, 6)], SCHEMA + ", path int, leader int")
    assert rows_of(W.round_trip(extra)) == expected([(1, "u", "h")])


def test_files_are_the_format(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}/p", f"<html><head><title>{i}</title></head><body>{'lorem ipsum ' * (i % 30)}</body></html>") for i in range(400)]
    W.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path))
    (file,) = tmp_path.glob("*.warc.zst")
    data = file.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    first = frame.decompress(data[8 + size :])
    assert frame.eof and first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and first.endswith(b"\r\n\r\n")
    again = W.read_archives(W.list_archives(spark, str(tmp_path)))
    assert rows_of(again) == expected(rows)


def test_archives_roll_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(W, "TRAIN_RECORDS", 8)
    rows = [(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 8) for i in range(60)]
    write = W._writer(f"file://{tmp_path}", "1970-01-01T00:00:00Z")
    batches = W.plan_records(spark.createDataFrame(rows, SCHEMA)).toArrow().to_batches()
    made = [b.to_pylist()[0] for b in write(iter(batches))]
    assert len(made) > 3 and sum(m["records"] for m in made) == 60
    assert sum(1 for m in made for c in W.frames(open(m["path"], "rb")) if b"response" in c[:40]) == 60


def pieces(dictionary=b""):
    page = [W.build_record(i, "http://a/", hashlib.sha1(p).hexdigest(), len(p), p, None, "1970-01-01T00:00:00Z") for i, p in enumerate((b"one", b"two", b"three"))]
    return [bytes(x) for x in W.archive(page, dictionary)], page


def test_damaged_archives():
    parts, page = pieces()
    read = lambda data: ["error" if isinstance(x, W.DamagedArchive) else x for x in W.frames(io.BytesIO(data))]
    assert read(b"".join(parts)) == page
    spoiled = bytearray(parts[1])
    spoiled[-1] ^= 1  # the frame's checksum
    assert read(parts[0] + bytes(spoiled) + parts[2]) == [page[0], "error", page[2]]
    assert read(parts[0] + b"junk" + parts[1]) == [page[0], "error", page[1]]
    assert read(parts[0] + parts[1][:-5]) == [page[0], "error"]
    assert read(parts[0] + b"ab") == [page[0], "error"]
    assert read(struct.pack("<II", W.DICTIONARY_MAGIC, 100) + b"short") == ["error"]
    assert read(b"") == []
    skipped = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert read(parts[0] + skipped + parts[1]) == page[:2]


def test_packed_dictionary():
    samples = [f"record {i} of a kind, status {i % 5}, path /a/{i}/index.html ".encode() * 3 for i in range(500)]
    raw = W.train(samples)
    assert raw
    parts, page = pieces(raw)
    packed = zstandard.ZstdCompressor().compress(raw)
    data = struct.pack("<II", W.DICTIONARY_MAGIC, len(packed)) + packed + b"".join(parts[1:])
    assert list(W.frames(io.BytesIO(data))) == page
    assert W.train([b"a"]) == b""


@pytest.mark.parametrize(
    "change",
    [
        (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type: response", b"WARC-Kind: response"), (b"WARC-Date: ", b"X-Date: "), (b"Page-ID: 0", b"Page-ID: q"),
        (b"one", b"eno"), (b"Content-Length: 3", b"Content-Length: 4"), (b"\r\n\r\n", b"\r\n"),
        (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: md5:"), (b"Content-Type: application", b"no header here"),
    ],
)
def test_false_headers(change):
    _, page = pieces()
    assert W.parse_record(page[0])["payload"] == b"one"
    assert change[0] in page[0]
    with pytest.raises(W.DamagedArchive):
        W.parse_record(page[0].replace(*change))


def test_revisits_hold_no_payload():
    good = W.build_record(1, None, "00" * 20, 5000, None, 7, "1970-01-01T00:00:00Z")
    row = W.parse_record(good)
    assert (row["payload_bytes"], row["refers_to"], row["payload"]) == (5000, 7, None)
    with pytest.raises(W.DamagedArchive):
        W.parse_record(good.replace(b"WARC-Refers-To: ", b"WARC-Other: "))
