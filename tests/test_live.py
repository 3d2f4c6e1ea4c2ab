"""The live source, as batch and stream, against servers of the test's own."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from engram.sources import live as V, log_files as L

LINES = b': hello\nevent: message\ndata: {"user": "a"}\n\ndata: {"user": "b"}\n\ndata: not json\n\n'


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(LINES)

    def log_message(self, *args):
        pass


class Numbered(BaseHTTPRequestHandler):
    """Events 1 .. ``made``, from the one after Last-Event-ID on, then silence."""

    made, asked = 0, []

    def do_GET(self):
        last = int(self.headers.get("Last-Event-ID") or 0)
        self.asked.append(last)
        self.send_response(200)
        self.end_headers()
        for i in range(last + 1, type(self).made + 1):
            self.wfile.write(f"id: {i}\ndata: {json.dumps({'user': f'u{i}', 'title': 't', 'id': str(i)})}\n\n".encode())
        self.wfile.flush()
        time.sleep(3)

    log_message = Handler.log_message


def serve(handler):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}/"


@pytest.fixture(scope="module")
def address():
    server, url = serve(Handler)
    yield url
    server.shutdown()


def test_payloads_and_limit(spark, address):
    assert [r.value for r in V.read_live(spark, address, seconds=5).collect()] == ['{"user": "a"}', '{"user": "b"}', "not json"]
    assert V.read_live(spark, address, limit=1, seconds=5).count() == 1


def test_a_stream_stops_when_idle_and_goes_on_from_its_checkpoint(spark, tmp_path):
    server, url = serve(Numbered)
    try:
        def run(**bounds):
            stream = L.map_events(L.open_source(spark, url, rows=10, seconds=0.5)).select("event_id", "actor")
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
            return V.run_bounded(query, **bounds)

        Numbered.made = 25
        assert run(idle_seconds=4) == 25
        ids = lambda: sorted(int(r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert ids() == list(range(1, 26))
        sizes = [json.loads(line.splitlines()[-1]) for line in [p.read_text() for p in sorted((tmp_path / "c" / "offsets").iterdir()) if p.name.isdigit()]]
        assert all(b["n"] - a["n"] <= 10 for a, b in zip([{"n": 0}, *sizes], sizes)) and sizes[-1]["id"] == "25"
        Numbered.made = 40
        assert 15 <= run(idle_seconds=30, max_events=15) and ids()[:40] == list(range(1, 41))
        assert 25 in Numbered.asked
    finally:
        server.shutdown()


def test_a_stream_takes_no_more_than_its_limit(spark, tmp_path):
    server, url = serve(Numbered)
    try:
        Numbered.made = 30
        query = V.follow_live(spark, url, rows=7, seconds=0.5, limit=12).writeStream.format("memory").queryName("limited").start()
        assert V.run_bounded(query, idle_seconds=3) == 12 and spark.table("limited").count() == 12
    finally:
        server.shutdown()


def test_events_are_read_by_the_protocol():
    class Answer:
        def __init__(self, body):
            self.lines = iter(body.splitlines(keepends=True))

        def readline(self):
            return next(self.lines, b"")

    events = V._Events.__new__(V._Events)
    events.answer, events.last_id = Answer(b"id: 1\ndata: a\ndata:b\n\n: note\n\nid: 2\n\ndata\n\nid: 3\ndata: last"), ""
    assert [events.next() for _ in range(4)] == [("1", "a\nb"), ("2", ""), ("3", "last"), None]


def test_events_again_between_offsets(monkeypatch):
    reader = V._StreamReader({"url": "u", "seconds": "1"})

    class Fake:
        def __init__(self, url, last_id, timeout):
            self.last_id, self.n = last_id, int(last_id or 0)

        def next(self):
            self.n += 1
            self.last_id = str(self.n)
            return (self.last_id, f"e{self.n}") if self.n <= 5 else None

        def close(self):
            pass

    monkeypatch.setattr(V, "_Events", Fake)
    assert list(reader.readBetweenOffsets({"id": "2", "n": 2}, {"id": "4", "n": 4})) == [("e3",), ("e4",)]
    with pytest.raises(RuntimeError):
        reader.readBetweenOffsets({"id": "3", "n": 3}, {"id": "9", "n": 9})


def test_sources_by_name(spark, tmp_path):
    assert L.resolve_source("live")[0] == "stream" and L.resolve_source("file:///a/b") == ("file", "/a/b") == L.resolve_source("/a/b")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.ndjson").write_text('{"user": "a", "title": "t", "id": "1"}\n\nnot json\n{"user": "", "title": "t"}\n')
    stream = L.map_events(L.open_source(spark, str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("named").trigger(availableNow=True).start().awaitTermination()
    assert [r.event_id for r in spark.table("named").collect()] == ["1"]
