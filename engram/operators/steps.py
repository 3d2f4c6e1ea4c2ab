"""Written intermediate tables, numbering without a single task, and joins on hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can see, from ``spark.checkpoint.dir``; a
    temporary one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "engram-steps")
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **seen: Column) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: the lineage
    ends there, and later joins know its size.  The table goes with the application.

    ``seen``: aggregates of its rows, observed while they are written; they are
    the dict ``seen`` of the table returned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    noted = Observation() if seen else None
    (df.observe(noted, *(c.alias(n) for n, c in seen.items())) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if noted is not None:
        out.seen = noted.get
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return out


def spent(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan reads any more."""
    for df in tables:
        path = df._written_to
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 0 within ``group`` by ``order``.

    Rows are range-partitioned by group and order and counted in parallel; a
    task's first place in a group is the number of that group's rows in the
    tasks before it.  A hot group is spread over many tasks.
    """
    task, at, first, before = "_task", "_at", "_first", "_before"
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(sorted_rows.withColumns({task: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "numbered")
    counts = placed.groupBy(group, task).agg(F.count("*").alias("_n"), F.min(at).alias(first))
    earlier = Window.partitionBy(group).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(F.col(group).alias("_group"), F.col(task).alias("_in"), first, before)
    joined = placed.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col(task) == F.col("_in")))
    return joined.withColumn(name, F.col(at) - F.col(first) + F.col(before)).drop(task, at, first, before, "_group", "_in")


def join_split(left: DataFrame, right: DataFrame, key: list[str], most: int = 20_000) -> DataFrame:
    """Inner join on ``key`` in which a key of more than ``most`` right rows is
    dealt to several tasks: left rows go to one of its parts, right rows to all."""
    hot = right.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = hot.select(*key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    one = F.coalesce("_parts", F.lit(1))
    a = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*(c for c in left.columns if c not in key)), one).cast("int")).drop("_parts")
    b = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return a.join(b, [*key, "_part"]).drop("_part")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of ``keys``, from batches sorted by them."""
    held, now = [], None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i, value in enumerate(values):
            if value != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, now, start = [], value, i
        if values:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
