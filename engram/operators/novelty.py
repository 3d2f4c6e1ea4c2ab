"""The novelty gate: rows admitted in order, each only if far enough from all
rows admitted before it.

The rule is sequential, its work is not.  Rows are taken by prefixes that double
in length.  A prefix is first held against what is admitted already, block by
block; what is left of it is settled in rounds, in which each block decides all
rows that no undecided row of an earlier block is near to.  A round settles at
least the first block left of every group, and where rows near each other are
few, or in clusters, nearly all.  Nothing but blocks of vectors meets in a task,
and of two blocks that meet one row a vector goes on, however many pairs are near.

Distances are 1 - cosine, rounded to nine digits, so that they do not depend on
which products made them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.functions.columns import sound_vector
from engram.operators.retrieval import matrix, unit_rows
from engram.operators.steps import numbered, runs, spent, written

#: Vectors of a block; two blocks meet in a task, in tiles of TILE rows.
BLOCK, TILE = 4096, 512


def _meet(below: float | None):
    """Of two blocks: the least distance of each asking row to an earlier held one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key", "ask_block", "held_block"]):
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            if asks.all() or not asks.any():
                continue
            at = table.column("at").to_numpy()
            x, (ask_at, held_at) = unit_rows(matrix(table.column("v"))), (at[asks], at[~asks])
            ask, held = x[asks], x[~asks].T
            for s in range(0, len(ask), TILE):
                distance = np.round(1 - ask[s : s + TILE] @ held, 9)
                distance[held_at[None, :] >= ask_at[s : s + TILE, None]] = np.inf
                least = distance.min(axis=1)
                found = np.flatnonzero(least < (np.inf if below is None else below))
                if len(found):
                    key = pa.array([table.column("key")[0].as_py()] * len(found), pa.string())
                    yield pa.RecordBatch.from_arrays([key, pa.array(ask_at[s + found], pa.int64()), pa.array(least[found])], ["key", "at", "distance"])

    return run


def _nearest_before(asking: DataFrame, held: DataFrame, below: float | None = None, blocks: tuple[int | None, int | None] = (None, None), ask_below: int | None = None, apart: int = 0) -> DataFrame:
    """(key, at, distance): for each asking row the least distance to a held row
    of an earlier place; only those nearer than ``below``, where given.

    Asking rows (key, at, v, block, known) meet the held blocks from -known to
    their own, held rows (key, at, v, block, last) the asking blocks from their
    own to ``last``.  ``blocks``: bounds of the held blocks, where some are known
    to hold nothing; ``ask_below``: the same for asking blocks; ``apart`` 1
    leaves out a block's meeting with itself.
    """
    def each(first, last):
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    low, high = blocks
    first = -F.col("known") if low is None else F.lit(low)
    own = F.col("block") - apart
    a = asking.select("key", "at", "v", F.lit(True).alias("asks"), F.col("block").alias("ask_block"), each(first, own if high is None else F.least(own, F.lit(high - 1))).alias("held_block"))
    end = F.col("last") if ask_below is None else F.least("last", F.lit(ask_below - 1))
    b = held.select("key", "at", "v", F.lit(False).alias("asks"), each(F.greatest(F.col("block") + apart, F.lit(0)), end).alias("ask_block"), F.col("block").alias("held_block"))
    keys = ["key", "ask_block", "held_block"]
    dealt = a.union(b.select(*a.columns)).repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(_meet(below), "key string, at long, distance double")
    return found.groupBy("key", "at").agg(F.min("distance").alias("distance"))


def _decide(threshold: float):
    """A block's own fold in order.  ``waits`` marks rows that an undecided row of
    an earlier block is near to; those, and rows near them, stay undecided."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key", "block"]):
            x, waits = unit_rows(matrix(table.column("v"))), table.column("waits").to_numpy(zero_copy_only=False)
            taken, open_ = np.empty_like(x), np.empty_like(x)
            n = m = 0
            said = np.zeros(len(x), np.int8)  # 1 admitted, 0 refused, -1 undecided
            for i, v in enumerate(x):
                near = lambda held, v=v: len(held) and round(1 - float((held @ v).max()), 9) < threshold
                if near(taken[:n]):
                    continue
                if waits[i] or near(open_[:m]):
                    open_[m], m, said[i] = v, m + 1, -1
                else:
                    taken[n], n, said[i] = v, n + 1, 1
            left = np.flatnonzero(said != 0)
            if len(left):
                rows = table.take(pa.array(left)).select(["key", "at", "v", "block", "last", "known"])
                yield from rows.append_column("taken", pa.array(said[left] == 1)).combine_chunks().to_batches()

    return run


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("key", "at"), ["key", "at"], "left_anti")


def gate(rows: DataFrame, threshold: float | None, known: DataFrame | None = None, group: str = "graph_key", order: str = "place", vector: str = "embedding") -> DataFrame:
    """(group, order, distance, admitted) of ``rows`` (group, order, vector).

    In each group, by ``order``, a row is admitted if its distance to every row
    admitted before is at least ``threshold``, as the first always is; ``distance``
    is that to the nearest of them, null where there is none.  ``known`` (group,
    vector) holds what was admitted earlier.  With ``threshold`` None the gate is
    off: all are admitted, and distances are still told.

    Vectors without a direction (null, zero, or with a component that is null or
    not finite) are refused with a null distance and hold nothing back.  Vectors
    of different widths are not compared.  Places repeat in no group.
    """
    named = F.to_json(F.struct(F.col(group).alias("g"), F.size(vector).alias("width")))
    v = F.col(vector).cast("array<double>")
    sound = rows.where(sound_vector(F.col(vector))).select(named.alias("key"), F.col(order).alias("order"), v.alias("v"))
    placed = numbered(sound, "key", ["order"], "at")
    sizes = placed.groupBy("key").agg((F.floor((F.count("*") - 1) / BLOCK)).cast("int").alias("last"))
    if known is not None:
        old = known.where(sound_vector(F.col(vector))).select(named.alias("key"), v.alias("v"))
        counts = old.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("known"))
        sizes = sizes.join(counts, "key", "left").withColumn("known", F.coalesce("known", F.lit(0)))
        sizes = written(sizes, "gate-sizes")
        block = (-1 - F.pmod(F.xxhash64("v"), F.col("known"))).cast("int")
        held = written(old.join(sizes, "key").select("key", F.lit(-1).cast("long").alias("at"), "v", block.alias("block"), "last"), "gate-known")
    else:
        sizes, held = written(sizes.withColumn("known", F.lit(0)), "gate-sizes"), None
    base = written(placed.join(sizes, "key").select("key", "order", "at", "v", F.floor(F.col("at") / BLOCK).cast("int").alias("block"), "last", "known"), "gate-rows")
    if threshold is None:
        taken = base.select("key", "at", "v", "block", "last")
        held = taken if held is None else held.union(taken)
    else:
        blocks = (sizes.agg(F.max("last")).first()[0] or 0) + 1 if not base.isEmpty() else 0
        low, high = 0, 1
        while low < blocks:
            left, fresh, bounds = base.where((F.col("block") >= low) & (F.col("block") < high)).drop("order"), held, (None, low)
            while True:
                if fresh is not None:
                    left = _without(left, _nearest_before(left, fresh, threshold, bounds, high))
                left = written(left, "gate-left")
                waits = left.withColumn("waits", F.lit(False))
                if high - low > 1:
                    near = _nearest_before(left, left, threshold, (low, high), high, apart=1).select("key", "at", F.lit(True).alias("waits"))
                    waits = left.join(near, ["key", "at"], "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
                ordered = waits.repartition("key", "block").sortWithinPartitions("key", "block", "at")
                schema = "key string, at long, v array<double>, block int, last int, known int, taken boolean"
                out = written(ordered.select("key", "at", "v", "block", "last", "known", "waits").mapInArrow(_decide(threshold), schema), "gate-round")
                spent(left)
                fresh = out.where("taken").select("key", "at", "v", "block", "last")
                held = fresh if held is None else held.union(fresh)
                if out.where("not taken").isEmpty():
                    break
                left, bounds = out.where("not taken").drop("taken"), (low, high)
            low, high = high, 2 * high
        taken = held.where("at >= 0") if held is not None else base.limit(0)
    near = _nearest_before(base, held) if held is not None else base.select("key", "at", F.lit(None).cast("double").alias("distance")).limit(0)
    told = base.join(near, ["key", "at"], "left").join(taken.select("key", "at", F.lit(True).alias("admitted")), ["key", "at"], "left")
    every = rows.select(group, F.col(order).alias("_o"), named.alias("key"))
    told = told.select(F.col("key").alias("_k"), F.col("order").alias("_p"), "distance", "admitted")
    out = every.join(told, (F.col("key") == F.col("_k")) & (F.col("_o") == F.col("_p")), "left")
    return out.select(group, F.col("_o").alias(order), "distance", F.coalesce("admitted", F.lit(False)).alias("admitted"))

