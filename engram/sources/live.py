"""Live server-sent events as a Spark data source, for batch and streaming.

``read_live`` reads a bounded number of payloads at once.  ``follow_live`` is a
stream: its offset is the id of the last event taken, so a query that starts
again from its checkpoint asks the server to go on from there, as the protocol
of server-sent events provides.  A trigger takes ``rows`` events at most, and
waits ``seconds`` for them at most; nothing is read that is not asked for, so a
slow sink holds the source back.  ``run_bounded`` stops a query after it was idle
for a time or has taken enough.

A live stream is one connection, so one task reads it; feed the rows to
``log_files.RAW_EVENT`` parsing and ``streaming.log.append_to_log``.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class _Events:
    """One connection: (id, payload) of each event in turn."""

    def __init__(self, url: str, last_id: str, timeout: float):
        import urllib.request

        headers = {"Accept": "text/event-stream"} | ({"Last-Event-ID": last_id} if last_id else {})
        self.answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)
        self.last_id = last_id

    def next(self) -> tuple[str, str] | None:
        """The next event that has data; None where the server ends.  A server
        that is silent for the timeout raises TimeoutError."""
        data: list[str] = []
        while line := self.answer.readline():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if not text and data:
                return self.last_id, "\n".join(data)
            field, _, value = text.partition(":")
            value = value.removeprefix(" ")
            if field == "data":
                data.append(value)
            elif field == "id" and "\0" not in value:
                self.last_id = value
        return (self.last_id, "\n".join(data)) if data else None

    def close(self) -> None:
        self.answer.close()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.limit, self.seconds = options["url"], int(options.get("limit", 1000)), float(options.get("seconds", 30))

    def read(self, partition) -> Iterator[tuple[str]]:
        ends, got = time.monotonic() + self.seconds, 0
        try:
            events = _Events(self.url, "", self.seconds)
            while got < self.limit and time.monotonic() < ends and (event := events.next()) is not None:
                got += 1
                yield (event[1],)
        except TimeoutError:  # a silent server: what came so far counts
            return


class _StreamReader(SimpleDataSourceStreamReader):
    """Offsets are {id: the last event's id, n: events taken so far}."""

    def __init__(self, options: dict[str, str]):
        self.url, self.rows, self.seconds = options["url"], int(options.get("rows", 1000)), float(options.get("seconds", 5))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.events: _Events | None = None

    def initialOffset(self) -> dict:
        return {"id": "", "n": 0}

    def _take(self, start: dict, most: int, until: str | None = None) -> tuple[list[tuple[str]], dict]:
        if self.events is None or self.events.last_id != start["id"]:
            self._drop()
        out, last, ends = [], dict(start), time.monotonic() + self.seconds
        try:
            while len(out) < most and (until is not None or time.monotonic() < ends):
                if self.events is None:
                    self.events = _Events(self.url, last["id"], self.seconds)
                event = self.events.next()
                if event is None:  # the server ended; the next trigger asks again
                    self._drop()
                    break
                out.append((event[1],))
                last = {"id": event[0], "n": last["n"] + 1}
                if until is not None and last["id"] == until:
                    break
        except (TimeoutError, ConnectionError):
            self._drop()
        return out, last

    def _drop(self) -> None:
        if self.events is not None:
            self.events.close()
        self.events = None

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        left = self.rows if self.limit is None else min(self.rows, self.limit - start["n"])
        rows, end = self._take(start, left) if left > 0 else ([], start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        """The same events again, after a failure: the server is asked from ``start``."""
        rows, last = self._take(start, end["n"] - start["n"], end["id"])
        if last["n"] != end["n"]:
            raise RuntimeError(f"the server gave {last['n'] - start['n']} of {end['n'] - start['n']} events again")
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


class ServerSentEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)


def read_live(spark: SparkSession, url: str, limit: int = 1000, seconds: float = 30) -> DataFrame:
    """Payloads of a live stream, at most ``limit`` of them and for ``seconds`` at most."""
    spark.dataSource.register(ServerSentEvents)
    return spark.read.format("sse").option("url", url).option("limit", str(limit)).option("seconds", str(seconds)).load()


def follow_live(spark: SparkSession, url: str, rows: int = 1000, seconds: float = 5, limit: int | None = None) -> DataFrame:
    """A live stream's payloads as a streaming table; ``limit`` bounds all triggers together."""
    spark.dataSource.register(ServerSentEvents)
    stream = spark.readStream.format("sse").option("url", url).option("rows", str(rows)).option("seconds", str(seconds))
    return (stream if limit is None else stream.option("limit", str(limit))).load()


class _Watch(StreamingQueryListener):
    """Counts a query's rows and remembers when some last came."""

    def __init__(self, run_id: str):
        self.run_id, self.rows, self.last, self.changed = run_id, {}, None, threading.Event()

    def note(self, progress) -> None:
        if progress.numInputRows and progress.batchId not in self.rows:
            self.rows[progress.batchId] = progress.numInputRows
            self.last = time.monotonic()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.run_id:
            self.note(event.progress)
            self.changed.set()

    def onQueryIdle(self, event) -> None:
        self.changed.set()

    def onQueryTerminated(self, event) -> None:
        self.changed.set()


def run_bounded(query: StreamingQuery, idle_seconds: float, max_events: int | None = None) -> int:
    """Let a started query run until it was idle for so long, or has taken
    ``max_events`` (batches are never cut); stops it and returns how many events it
    took since.  A query that failed raises."""
    spark = SparkSession.getActiveSession()
    watch = _Watch(str(query.runId))
    spark.streams.addListener(watch)
    try:
        for progress in query.recentProgress:  # of before the listener was there
            watch.note(progress)
        while query.isActive:
            watch.changed.wait(0.1)
            watch.changed.clear()
            if watch.last is None and query.status["message"].startswith("Waiting"):  # it has asked its source once
                watch.last = time.monotonic()
            enough = max_events is not None and sum(watch.rows.values()) >= max_events
            if enough or watch.last is not None and time.monotonic() - watch.last >= idle_seconds:
                query.stop()
        if (error := query.exception()) is not None:
            raise error
        return sum(watch.rows.values())
    finally:
        spark.streams.removeListener(watch)
