"""Helpers shared by the corpus operators: written intermediate tables, label
propagation for connected components, and pivot clusters for pair operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes of an Arrow batch handed to Python, whichever comes first.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Members of a cluster that one block holds; a task compares two blocks.
BLOCK_ROWS = 768
#: Parts that the members of large clusters are dealt to before they are copied.
SALTS = 64


def prepare(spark: SparkSession) -> None:
    """Session settings the Python stages rely on: Arrow batches bounded in rows
    and bytes.  They stay set, since plans are made when results are asked for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can see, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves if driver and executors are
    one process (master ``local``); on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "engram-tables")
    return folder.rstrip("/")


def apart(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` bears it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives later joins exact
    sizes.  An empty ``df`` reads back empty with the same schema.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame, shuffles: bool = True) -> None:
    """Delete a table of ``materialize`` that no plan reads any more.

    With ``shuffles`` the driver's JVM is asked to collect as well: Spark removes
    the shuffle files of finished steps once nothing there refers to them.
    """
    path = getattr(df, "_written_to", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        if shuffles:
            jvm.System.gc()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label = smallest node reachable.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so long chains shrink fast.  All rounds are joins
    with map-side minima; nothing is collected but one flag a round.
    """
    pairs = materialize(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "cc-edges"
    )
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
        .select("node", F.least("node", "label").alias("label"), F.lit(None).cast("long").alias("old")),
        "cc-labels",
    )
    while True:
        heard = both.join(labels.select(F.col("node").alias("a"), "label"), "a").select(
            F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("old")
        )
        merged = (
            labels.select("node", "label", F.col("label").alias("old")).union(heard)
            .groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        )
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = materialize(
            merged.join(up, "label", "left").select("node", F.least("label", "up").alias("label"), "old"),
            "cc-labels",
        )
        discard(labels, shuffles=False)
        labels = after
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")


def pivot_members(keys: DataFrame, key: list[str]) -> DataFrame:
    """Clusters that cover all pairs which share a key: (pivot, x), distinct.

    ``keys`` has the key columns and a long ``x``.  The smallest x of each key
    is its pivot; any two rows that share a key are then members of that
    pivot's cluster, and a pivot stands once in its own.  Rows grow with the
    number of keys, never with its square, and however many keys two rows
    share they meet in few clusters.

    The keys are shuffled once: the minima and the join that hands them back
    read the same exchange.  Both stream through a key's rows, holding one.
    """
    dealt = keys.repartition(*key)
    heads = (
        dealt.groupBy(*key).agg(F.min("x").alias("pivot"), F.max("x").alias("last"))
        .where("pivot < last").drop("last")
    )
    others = dealt.join(heads.hint("merge"), key).where("x <> pivot").select("pivot", "x").distinct()
    others = materialize(others, "clusters")
    return others.union(others.select("pivot", F.col("pivot").alias("x")).distinct())


def _blocks(weight: str | None, most: int) -> Column:
    heavy = F.sum(weight) / F.lit(most) if weight else F.lit(0.0)
    return F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)), F.ceil(heavy), F.lit(1)).cast("int")


def _spread(members: DataFrame, large: DataFrame) -> DataFrame:
    """``members`` with the columns of ``large`` (by pivot, null elsewhere); the
    members of a large cluster are spread over SALTS tasks before they are copied."""
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("x", F.lit(7)), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["pivot", "salt"], "left").drop("salt")


def block_pairs(members: DataFrame, weight: str | None = None, most: int = 2_000_000) -> DataFrame:
    """Deal each cluster into blocks and each pair of its blocks to one group.

    Adds block_a <= block_b (the group within ``pivot``) and ``own`` (the row's
    block).  A cluster of any size splits into groups of about two blocks; a
    row is copied once for each block of its cluster.  ``weight``: a column
    whose sum in a block stays about ``most``.
    """
    large = members.groupBy("pivot").agg(_blocks(weight, most).alias("blocks")).where("blocks > 1")
    dealt = _spread(members, large).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        "*", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b")
    ).drop("blocks", "other")


def own_blocks(members: DataFrame, weight: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows dealt, pivots of more than one block): each cluster in blocks, each
    block a group of its own with the cluster's ``head`` in it.  Rows are not
    copied, but for one head a block."""
    large = materialize(members.groupBy("pivot").agg(_blocks(weight, most).alias("blocks")).where("blocks > 1"), "large")
    dealt = _spread(members, large).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", F.explode(F.when(F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    return dealt.select("*", F.col("own").alias("block_a"), F.col("own").alias("block_b")).drop("blocks"), large.select("pivot")


def cross_blocks(members: DataFrame, weight: str, most: int) -> DataFrame:
    """Deal the pairs of a cluster that are not yet known to be in one class.

    ``members`` have a ``root``; those of a cluster's most frequent root meet
    only its others, which meet each other too.  Nothing is dealt of a cluster
    whose members all have one root, however many they are.
    """
    roots = members.groupBy("pivot", "root").agg(F.count("*").alias("n"))
    main = roots.groupBy("pivot").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    mixed = _spread(members, main.drop("roots")).where("main is not null").withColumn("minor", F.col("root") != F.col("main")).drop("main")
    mixed = materialize(mixed, "mixed")
    sizes = mixed.groupBy("pivot").pivot("minor", [True, False]).agg(_blocks(weight, most)).select("pivot", F.col("true").alias("few"), F.col("false").alias("many"))
    dealt = _spread(mixed, sizes)
    own = F.when(F.col("minor"), F.pmod(F.xxhash64("x"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("x"), F.col("many"))).cast("int")
    last = F.when(F.col("minor"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("*", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b")).drop("few", "many", "other", "minor")


def bundled(dealt: DataFrame, group: list[str], bundles: int) -> DataFrame:
    """``dealt`` with a ``bundle`` that takes in many whole groups, so that a
    call of a Python function serves more than one small group."""
    return dealt.withColumn("bundle", F.pmod(F.xxhash64(*group), F.lit(max(1, bundles))))


def groups_of(table: pa.Table, group: list[str]) -> Iterator[pa.Table]:
    """The groups of a bundle."""
    columns = [table.column(c).to_numpy() for c in group]
    order = np.lexsort(columns[::-1])
    edges = np.zeros(len(order), bool)
    edges[:1] = True
    for c in columns:
        edges[1:] |= c[order][1:] != c[order][:-1]
    starts = np.flatnonzero(edges)
    ordered = table.take(pa.array(order)).combine_chunks()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield ordered.slice(a, b - a)
