"""Domain views over the driver tables: edits, log records, claims, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.operators.steps import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, actor, page, ts_us, bytes, kind): one row an edit of a page."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("actor"), F.get_json_object("props", "$.k").alias("page"),
        micros(F.col("ts")).alias("ts_us"), F.col("value").alias("bytes"), F.col("event_type").alias("kind"),
    ).where("actor is not null and page is not null")


def event_log(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """Log records (part, off, ts_us, event_id, user_id, kind): event id modulo
    the number of partitions deals the records, in order of their ids.

    Offsets are counted in parallel, however few the partitions are."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.pmod("event_id", F.lit(partitions)).cast("int").alias("part"), "event_id", micros(F.col("ts")).alias("ts_us"), "user_id", F.col("event_type").alias("kind"))
    return numbered(rows, "part", ["event_id"], "off").select("part", "event_id", "ts_us", "user_id", "kind", F.col("off").cast("long").alias("off"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated claims (id, subject, predicate, valid_us, text) from the orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"),
        micros(F.col("o_orderdate")).alias("valid_us"), F.col("o_totalprice").alias("text"),
    )
