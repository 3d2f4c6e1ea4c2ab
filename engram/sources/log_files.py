"""Tolerant readers: NDJSON files and pinned JSON datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from engram.functions.columns import date_iso, stable_id

RAW_EVENT = (
    "type string, user string, bot boolean, title string, wiki string, server_name string, title_url string, notify_url string, "
    "timestamp double, comment string, length struct<old:bigint,new:bigint>, meta struct<id:string,offset:bigint>, id string"
)


def read_ndjson(spark: SparkSession, path: str, limit: int | None = None, schema: str = RAW_EVENT) -> DataFrame:
    """Rows of a JSON-lines file; blank and unreadable lines are skipped, and
    ``limit`` counts the rows that could be read."""
    rows = parse_lines(spark.read.text(path), schema)
    return rows.limit(limit) if limit is not None else rows


def parse_lines(lines: DataFrame, schema: str = RAW_EVENT) -> DataFrame:
    """JSON objects out of (value) lines, of a batch or a stream; other lines are skipped."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), "value")
    return parsed.where(F.col("e").isNotNull() & F.get_json_object("value", "$").startswith("{")).select("e.*")


# Fixed value: the public stream that a live source means.
LIVE_URL = "https://stream.wikimedia.org/v2/stream/recentchange"


def resolve_source(source: str) -> tuple[str, str]:
    """(kind, address) of a source name: live stream, web address or file."""
    if source in ("sse", "live", "wikimedia"):
        return "stream", LIVE_URL
    if source.startswith(("http://", "https://")):
        return "stream", source
    return "file", source.removeprefix("file://")


def open_source(spark: SparkSession, source: str, rows: int = 1000, seconds: float = 5, limit: int | None = None, schema: str = RAW_EVENT) -> DataFrame:
    """The raw events that a source name stands for, as a stream: a live source,
    at most ``rows`` a trigger and ``limit`` in all, or the lines of a file or folder."""
    kind, address = resolve_source(source)
    if kind == "stream":
        from engram.sources.live import follow_live

        return parse_lines(follow_live(spark, address, rows, seconds, limit), schema)
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", 8).text(address), schema)


def read_pinned_json(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """A JSON list of records; with ``sha256`` the file must have that digest."""
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if found != sha256:
            raise ValueError(f"{path}: digest {found} is not the pinned one")
    return spark.read.json(path, multiLine=True)


def map_events(raw: DataFrame) -> DataFrame:
    """Raw change events to edits; rows without user or title go.

    An empty value falls through to the next like a missing one.  Without an id
    it is ``evt_`` and 16 hex digits of the hash of user, title and time, a time
    in whole seconds written without a point.
    """
    time = F.col("timestamp")
    as_text = F.coalesce(F.when(time == F.floor(time), F.floor(time).cast("string")).otherwise(time.cast("string")), F.lit(""))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    by = F.coalesce(some("meta.id"), some("id"), stable_id("evt", F.col("user"), F.col("title"), as_text))
    return raw.where("user is not null and user <> '' and title is not null and title <> ''").select(
        by.alias("event_id"), F.col("user").alias("actor"), F.coalesce("bot", F.lit(False)).alias("is_bot"), "title",
        F.coalesce(F.nullif("wiki", F.lit("")), F.nullif("server_name", F.lit("")), F.lit("unknown")).alias("wiki"),
        F.coalesce(some("title_url"), some("notify_url"), F.lit("")).alias("url"), F.coalesce("timestamp", F.lit(0.0)).alias("ts"),
        (F.coalesce("length.new", F.lit(0)) - F.coalesce("length.old", F.lit(0))).alias("bytes_delta"),
        F.coalesce("comment", F.lit("")).alias("summary"), F.coalesce(F.nullif("type", F.lit("")), F.lit("edit")).alias("kind"),
        F.coalesce("meta.offset", F.lit(-1)).alias("offset"),
    )


def questions_to_turns(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) of nested question records, sessions in order of date.

    A record whose dates, ids and sessions differ in number raises.
    """
    sizes = [F.size(c) for c in ("haystack_dates", "haystack_session_ids", "haystack_sessions")]
    checked = questions.withColumn("_same", F.assert_true((sizes[0] == sizes[1]) & (sizes[1] == sizes[2]), "dates, ids and sessions differ in number"))
    zipped = checked.where("_same is null").select(
        "question_id", F.explode(F.arrays_zip("haystack_dates", "haystack_session_ids", "haystack_sessions")).alias("z")
    )
    s = zipped.select("question_id", F.col("z.haystack_session_ids").alias("session_id"), date_iso(F.col("z.haystack_dates")).alias("date_iso"), F.col("z.haystack_sessions").alias("turns"))
    order = Window.partitionBy("question_id").orderBy(F.col("date_iso") == "", "date_iso", "session_id")
    sessions = s.withColumn("ordinal", F.row_number().over(order) - 1)
    turns = sessions.select("question_id", "session_id", "ordinal", F.posexplode("turns").alias("place", "t"))
    number = Window.partitionBy("question_id").orderBy("ordinal", "place")
    turns = turns.select("question_id", "session_id", (F.row_number().over(number) - 1).alias("turn"), "t.role", F.col("t.content").alias("text"))
    return sessions.drop("turns"), turns
