"""Exact top-k search by inner product with a vector-approximation file.

Every component is quantised to a cell, one byte a component, with cells as
wide as the vector's largest component needs; the approximations alone give
bounds on each score.  A first pass over them, block by block, keeps for each query
the vectors whose upper bound reaches the k-th best lower bound.  Exact
vectors are then read in the order of their bounds: a first batch of the best
bounds fixes a k-th score, and only vectors whose upper bound reaches it are
read after that, so the k-th result is certain.

Vectors that are null or hold null or non-finite components take no part; ids
that are null neither, nor do vectors whose components times ``scale`` have
squares that add up to 2 ** 62 or more: the product of any two others fits a
long, sums on the way too.  Of equal vectors only the k + 1 smallest ids can be
among the best, so no more are searched.  Ties go to the smaller id.  Rows
that repeat an id and its vector count once; an id that stands on several
vectors has the smallest of them, component by component.  Vectors are compared with those
of their own width.  Other columns are ignored, whatever their names.  An empty
table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from engram.llm._common import discard, materialize, prepare

#: Rows of a block of vectors and of a block of queries, and the bits of a cell's
#: number; the narrowest cell is of width 4.
VECTOR_BLOCK, QUERY_BLOCK, CELL_BITS, NARROWEST = 4096, 1024, 7, 2
FIRST_BATCH = 4


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64)


def _bounds(table: pa.Table, k: int) -> pa.Table:
    """Candidates of one block of queries in one block of vectors."""
    asks = table.column("asks")
    queries, stored = table.filter(asks), table.filter(pa.compute.invert(asks))
    q_ids, v_ids = queries.column("id").to_numpy(), stored.column("id").to_numpy()
    out_q, out_v, out_hi, out_lo = [], [], [], []
    if len(q_ids) and len(v_ids) and table.column("width")[0].as_py():
        asked, cells = _matrix(queries.column("v"), len(q_ids)), _matrix(stored.column("cells"), len(v_ids))
        wide = np.exp2(stored.column("shift").to_numpy())[:, None]
        low, high = cells * wide, cells * wide + (wide - 1)
        up, down = np.maximum(asked, 0), np.minimum(asked, 0)
        most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
        # past 2 ** 53 products are rounded: bounds are moved outwards by more than that can be
        furthest = np.maximum(np.abs(low), np.abs(high)).max()
        slack = np.abs(asked).sum(axis=1, keepdims=True) * furthest * (asked.shape[1] + 2) * 2.0**-52
        most, least = most + slack, least - slack
    else:
        most = least = np.zeros((len(q_ids), len(v_ids)))
    if most.size:
        same = q_ids[:, None] == v_ids[None, :]
        least[same] = -np.inf
        kth = np.partition(least, -k, axis=1)[:, -k] if least.shape[1] > k else np.full(len(q_ids), -np.inf)
        a, b = np.nonzero((most >= kth[:, None]) & ~same)
        out_q, out_v, out_hi, out_lo = q_ids[a], v_ids[b], most[a, b], least[a, b]
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "hi": pa.array(out_hi, pa.float64()), "lo": pa.array(out_lo, pa.float64())})


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``.

    Components are floor(scale * x); the score is their integer inner product.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale))
    fits = F.when(F.coalesce(sound, F.lit(False)), squares < F.lit(2.0**62)).otherwise(False)
    ints = vectors.where(F.col(id_col).isNotNull() & fits).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")
    )
    ints = materialize(ints.groupBy("id").agg(F.min("v").alias("v")), "int-vectors")
    # the k + 1 smallest ids of each vector; Spark limits each group before the shuffle
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    searched = ints.withColumn("nth", first).where(F.col("nth") <= k + 1).drop("nth")
    searched = materialize(searched, "searched")
    asked = ints.where(F.pmod("id", F.lit(every)) == 0)
    n_vectors, n_queries = searched.count(), asked.count()
    v_blocks, q_blocks = max(1, -(-n_vectors // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    # cells of a vector: as wide, a power of two, as its largest component needs
    largest = F.array_max(F.transform("v", lambda x: F.greatest(x, -x - 1)))
    shift = F.coalesce(F.greatest(F.length(F.bin(largest)) - CELL_BITS, F.lit(NARROWEST)), F.lit(NARROWEST)).alias("shift")
    cells = F.transform("v", lambda x: F.call_function("shiftright", x, F.col("shift")).cast("tinyint")).alias("cells")

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every_block(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    wide = F.size("v").alias("width")
    stored = searched.select("id", "v", shift).select("id", F.lit(None).cast("array<bigint>").alias("v"), cells, "shift", wide, F.lit(False).alias("asks"), block(v_blocks).alias("vb"), every_block(q_blocks).alias("qb"))
    sent = asked.select("id", "v", F.lit(None).cast("array<tinyint>").alias("cells"), F.lit(0).alias("shift"), wide, F.lit(True).alias("asks"), every_block(v_blocks).alias("vb"), block(q_blocks).alias("qb"))
    pairs = sent.unionByName(stored)
    bounded = pairs.groupBy("width", "qb", "vb").applyInArrow(lambda t: _bounds(t, k), "query_id long, vec_id long, hi double, lo double")
    bounded = materialize(bounded, "bounds")
    # the k-th best lower bound of a query over all blocks
    by_low = Window.partitionBy("query_id").orderBy(F.desc("lo"), "vec_id")
    floor = bounded.select("query_id", "lo", F.row_number().over(by_low).alias("nth")).where(F.col("nth") <= k)
    floor = floor.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lo")).otherwise(F.lit(float("-inf"))).alias("floor"))
    left = bounded.join(floor, "query_id").where("hi >= floor")
    left = materialize(left.select("query_id", "vec_id", "hi"), "candidates")
    discard(bounded)

    def exact(wanted: DataFrame) -> DataFrame:
        read = wanted.join(searched.select(F.col("id").alias("vec_id"), F.col("v").alias("v")), "vec_id")
        read = read.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        return read.where(F.size("q") == F.size("v")).select("query_id", "vec_id", product.alias("score"))

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # windows that keep a few rows a query; Spark cuts each task's rows before the shuffle
    by_high = Window.partitionBy("query_id").orderBy(F.desc("hi"), "vec_id")
    first = left.select("query_id", "vec_id", F.row_number().over(by_high).alias("turn")).where(F.col("turn") <= FIRST_BATCH * k)
    early = materialize(exact(first), "read-first")
    sure = early.select("query_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))).alias("nth")).where(F.col("nth") == k)
    sure = sure.select("query_id", F.col("score").alias("kth"))
    late = left.join(sure, "query_id", "left").where("kth is null or hi >= kth").join(early, ["query_id", "vec_id"], "left_anti")
    best = early.union(exact(late.select("query_id", "vec_id"))).withColumn("rank", F.row_number().over(ranked))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
