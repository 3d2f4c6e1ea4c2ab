"""The event log as files, the novelty gate over batches, and replay with parity digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.operators.memory import bucket_digests
from engram.operators.novelty import gate
from engram.operators.steps import numbered, spent, written

#: Offsets of a partition that share one row of state.
BLOCK = 1 << 16
LOG_SCHEMA = "key string, event_id bigint, ts_us bigint, value string, part int, off bigint"


def append_to_log(rows: DataFrame, path: str, partitions: int = 4, batch: str | None = None) -> None:
    """Append (key, event_id, ts_us, value) records; a key keeps its partition.

    Offsets go on from the largest of each partition.  A named ``batch`` that is
    written again replaces itself and gets the same offsets, so a retry is safe;
    one writer at a time is assumed.
    """
    spark = rows.sparkSession
    name = batch or uuid.uuid4().hex
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    known = spark.read.schema(LOG_SCHEMA + ", batch string").option("basePath", path)
    try:
        before = known.parquet(path).where(F.col("batch") != name)
        again = known.parquet(path).where(F.col("batch") == name).groupBy("part").agg(F.min("off").alias("own"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        before = again = None
    numbers = numbered(dealt, "part", ["ts_us", "event_id"], "_n")
    if before is None:
        offsets = numbers.withColumn("off", F.col("_n"))
    else:
        ends = before.groupBy("part").agg((F.max("off") + 1).alias("next"))
        starts = written(ends.join(again, "part", "full_outer").select("part", F.coalesce("own", "next").alias("start")), "starts")
        offsets = numbers.join(starts, "part", "left").withColumn("off", F.col("_n") + F.coalesce("start", F.lit(0)))
    offsets.select("key", "event_id", "ts_us", "value", "part", F.col("off").cast("long").alias("off")).write.mode("overwrite").parquet(f"{path}/batch={name}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records, from the first offset on."""
    return spark.read.schema(LOG_SCHEMA).parquet(path).drop("batch")


def follow_log(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """The log as a stream; ``files`` bounds what one trigger takes in."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files).parquet(path).drop("batch")


def once(stream: DataFrame) -> DataFrame:
    """The stream's records, each (part, off) once however often and in whatever
    batch it is delivered.

    State is a bit an offset, kept in blocks of BLOCK offsets of a partition;
    of a block that is full only that fact is kept.
    """
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else bytes(BLOCK // 8)
        if held == b"":  # full: all its offsets were there
            return
        seen = np.unpackbits(np.frombuffer(held, np.uint8))
        for frame in frames:
            at = (frame["off"] % BLOCK).to_numpy()
            new = ~frame["off"].duplicated().to_numpy() & (seen[at] == 0)
            seen[at] = 1
            if new.any():
                yield frame.loc[new, names]
        state.update((b"" if seen.all() else np.packbits(seen).tobytes(),))

    names = stream.columns
    blocked = stream.withColumn("_block", F.floor(F.col("off") / BLOCK))
    return blocked.groupBy("part", "_block").applyInPandasWithState(fold, stream.schema, "seen binary", "append", "NoTimeout")


def drain(stream: DataFrame, sink: str, checkpoint: str, admitted: Callable[[DataFrame], DataFrame] | None = None, topic: str | None = None) -> None:
    """Write what the stream holds now, each (part, off) once, and stop.

    A batch is written under its own number, so a batch that runs again after
    a failure replaces itself.  ``topic``: where the records that ``admitted``
    lets through are published as well, as JSON.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if topic is not None:
            wanted = admitted(batch) if admitted is not None else batch
            wanted.write.mode("overwrite").json(f"{topic}/batch={number}")
        batch.unpersist()

    once(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def same_records(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same records, by bucket digests."""
    columns = ["key", "event_id", "ts_us", "value", "part", "off"]
    x, y = bucket_digests(a, columns), bucket_digests(b, columns)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def _earlier(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame | None:
    """What batches before ``number`` wrote to ``path``; None if there is nothing."""
    try:
        return spark.read.schema(schema + ", batch long").parquet(path).where(F.col("batch") < number)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def gate_batch(batch: DataFrame, number: int, folder: str, threshold: float | None, group: str = "graph_key", order: str = "place", vector: str = "embedding") -> None:
    """Hold one batch against what earlier ones admitted; writes its verdicts and
    the vectors it admits under its own number, so that a batch that runs again
    replaces itself and is judged alike."""
    kinds = dict(batch.dtypes)
    known = _earlier(batch.sparkSession, f"{folder}/admitted", f"{group} {kinds[group]}, {vector} {kinds[vector]}", number)
    rows = written(batch.select(group, order, vector), "gate-batch")
    said = written(gate(rows, threshold, known, group, order, vector), "gate-said")
    said.write.mode("overwrite").parquet(f"{folder}/verdicts/batch={number}")
    taken = said.where("admitted").select(F.col(group).alias("_g"), F.col(order).alias("_o"))
    held = rows.join(taken, F.col(group).eqNullSafe(F.col("_g")) & (F.col(order) == F.col("_o"))).select(group, vector)
    held.write.mode("overwrite").parquet(f"{folder}/admitted/batch={number}")
    spent(rows, said)


def gate_stream(stream: DataFrame, threshold: float | None, folder: str, checkpoint: str, group: str = "graph_key", order: str = "place", vector: str = "embedding") -> DataFrame:
    """The novelty gate over what a stream holds now: verdicts (group, order,
    distance, admitted, batch) of all batches so far.

    Rows of a batch are taken in their order, after all earlier batches.  What
    was admitted lies in ``folder`` as rows, and meets a batch block by block;
    no task or state value holds a graph.
    """
    run = lambda batch, number: gate_batch(batch, number, folder, threshold, group, order, vector)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/verdicts")
