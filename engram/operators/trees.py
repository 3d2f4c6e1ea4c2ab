"""Trees of digests: whether two versions of a table agree, and where they do not.

A line belongs to the leaf that its key's hash begins with, so that equal keys of
two versions meet in one leaf whatever else changed.  A leaf's digest is that of
the sums of its lines' digests, an inner node's that of its children.  Two trees are held
against each other from the root down; only lines of leaves that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engram.operators.steps import written

#: Hex digits a level adds, and levels below the root: 16 ** 4 leaves.
DIGITS, LEVELS = 1, 4


def keyed_lines(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(leaf, key, line) of a table: ``key`` names its rows, ``columns`` are what a line says."""
    def joined(names: list[str]) -> Column:
        return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))

    named = rows.select(joined(key).alias("key"), joined(columns).alias("line"))
    return named.select(F.substring(F.sha2("key", 256), 1, DIGITS * LEVELS).alias("leaf"), "key", "line")


def write_tree(rows: DataFrame, key: list[str], columns: list[str], folder: str) -> None:
    """Write ``lines`` (leaf, key, line), in order of their leaves, and ``nodes``
    (path, digest, lines), the root being the empty path.

    A leaf's lines are summed where they lie, in four parts of 60 bits, so nothing
    is gathered and repeats count.
    """
    lines = keyed_lines(rows, key, columns).repartitionByRange("leaf").sortWithinPartitions("leaf", "key", "line")
    lines.write.mode("overwrite").parquet(f"{folder}/lines")
    stored = rows.sparkSession.read.parquet(f"{folder}/lines")
    parts = [F.conv(F.substring("hash", 15 * i + 1, 15), 16, 10).cast("long") for i in range(4)]
    # a part's upper and lower 30 bits are summed as long numbers, which stay exact for some 8 billion lines a leaf
    high, low = (lambda p: F.sum(F.shiftright(p, 30)).cast("decimal(20,0)")), (lambda p: F.sum(p.bitwiseAND(F.lit(2**30 - 1))))
    sums = F.concat_ws(",", *((high(p) * F.lit(2**30) + low(p)).cast("string") for p in parts), F.count("*").cast("string"))
    level = stored.withColumn("hash", F.sha2("line", 256)).groupBy(F.col("leaf").alias("path")).agg(F.sha2(sums, 256).alias("digest"), F.count("*").alias("lines"))
    level.write.mode("overwrite").parquet(f"{folder}/nodes/depth={LEVELS}")
    for depth in range(LEVELS - 1, -1, -1):
        below = rows.sparkSession.read.parquet(f"{folder}/nodes/depth={depth + 1}")
        up = F.substring("path", 1, DIGITS * depth)
        children = F.array_sort(F.collect_list(F.struct("path", "digest")))  # 16 at most
        level = below.groupBy(up.alias("path")).agg(F.sha2(F.array_join(F.transform(children, lambda c: F.concat(c["path"], F.lit(":"), c["digest"])), ","), 256).alias("digest"), F.sum("lines").alias("lines"))
        level.write.mode("overwrite").parquet(f"{folder}/nodes/depth={depth}")


def root(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, lines) of a whole table; no row for an empty one."""
    return spark.read.parquet(f"{folder}/nodes/depth=0").select("digest", "lines")


def changed_ranges(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(path, lines_a, lines_b): the leaves in which two trees differ, found from the
    root down: of a level only the children of nodes that differ are compared."""
    wanted = None
    for depth in range(LEVELS + 1):
        one, two = (spark.read.parquet(f"{f}/nodes/depth={depth}").select("path", F.col("digest").alias(f"digest_{s}"), F.col("lines").alias(f"lines_{s}")) for f, s in ((a, "a"), (b, "b")))
        if wanted is not None:
            above = F.substring("path", 1, DIGITS * (depth - 1))
            one, two = (t.join(wanted, above == wanted["above"], "left_semi") for t in (one, two))
        differ = one.join(two, "path", "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        wanted = differ.select(F.col("path").alias("above"))
    zero = F.lit(0).cast("long")
    return differ.select("path", F.coalesce("lines_a", zero).alias("lines_a"), F.coalesce("lines_b", zero).alias("lines_b"))


def changed_lines(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(key, change, line): lines that only one version has (``gone`` from a, ``new``
    in b), repeats counted.  Of both tables only leaves that differ are read: their
    lines lie in order, so other row groups are skipped where few leaves differ."""
    leaves = written(changed_ranges(spark, a, b).select(F.col("path").alias("leaf")), "leaves", low=F.min("leaf"), high=F.max("leaf"))
    inside = F.col("leaf").between(leaves.seen["low"], leaves.seen["high"])
    old, new = (spark.read.parquet(f"{f}/lines").where(inside).join(leaves, "leaf", "left_semi").select("key", "line", F.lit(n).alias("n")) for f, n in ((a, 1), (b, -1)))
    left = old.unionByName(new).groupBy("key", "line").agg(F.sum("n").alias("n")).where("n <> 0")
    change = F.when(F.col("n") > 0, "gone").otherwise("new")
    return left.select("key", change.alias("change"), "line", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))).alias("_")).drop("_")
