"""Ranks over co-edit links by blocks of actors.

Actors are numbered in the order of their names and dealt to groups by ranges of
their numbers, so a link leads from its group to that or a later one.  The links of
two groups lie in one block, written once as a bucketed table of numbers; a step
sends the ranks of a group to its blocks and their sums back, and never a link.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.operators.blocks import by_blocks, coded, cuts, meetings, n_groups, sorted_groups
from engram.operators.labels import _coded, _meetings, _named
from engram.operators.steps import shared_folder, spent, written

#: Links of a block at most, links of a row, and tasks of a step at most.
BLOCK_LINKS, ROW_LINKS, BUCKETS = 8_000_000, 1_000_000, 64

LINKS = "block int, low int, high int, node binary, fan binary, near binary"
STATE = "grp int, given binary, kept binary, share binary, given_sum double, kept_sum double, n long"


def met_count(edits: DataFrame, rows: int, width: int) -> int:
    """Number of pairs of edits of one page within ``width``."""
    count = lambda line, first, n: iter([pa.table({"n": [int(n.sum())]})])
    return _meetings(edits, rows, width, count, "n long").agg(F.sum("n")).first()[0] or 0


def chained(edits: DataFrame, rows: int, width: int) -> DataFrame:
    """(a, b) of edits that follow each other on a page within ``width``: they hold
    the same actors together as all meetings do, and are no more than the edits."""
    def make(line, first: np.ndarray, n: np.ndarray) -> Iterator[pa.Table]:
        row = np.flatnonzero(n)
        one, two = line.more[0][row], line.more[0][first[row]]
        pairs = np.unique(np.minimum(one, two).astype(np.int64)[one != two] << 32 | np.maximum(one, two)[one != two])
        yield pa.table({"a": pa.array(pairs >> 32, pa.int32()), "b": pa.array(pairs & 0xFFFFFFFF, pa.int32())})

    return _meetings(edits, rows, width, make, "a int, b int")


def _block_links(edits: DataFrame, rows: int, width: int, n: int, size: int) -> DataFrame:
    """LINKS of edits (actor by number, page, ts_us): some actors of the low group, how
    many of the high one each met, and whom, by their places in their groups."""
    def make(table: pa.Table, alone: bool) -> Iterator[pa.Table]:
        actors = coded(table["actor"])[1].to_numpy()
        for l, r, *_ in meetings(table, alone, width):
            order, starts = sorted_groups(l, r)
            a, b = actors[l[order[starts]]], actors[r[order[starts]]]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            fan = np.diff(np.append(first, len(a)))
            low, high = int(a[0]) // size, int(b[0]) // size
            for some in cuts(fan, ROW_LINKS):
                own = slice(first[some.start], first[some.stop - 1] + fan[some.stop - 1])
                held = (a[first[some]] % size, fan[some], b[own] % size)
                yield pa.table({"block": pa.array([high * (high + 1) // 2 + low], pa.int32()), "low": pa.array([low], pa.int32()), "high": pa.array([high], pa.int32())}
                               | {k: pa.array([v.astype(np.int32 if k == "fan" else _kind(size)).tobytes()], pa.binary()) for k, v in zip(("node", "fan", "near"), held)})

    return by_blocks(edits, "actor", rows, make, LINKS, n, F.floor(F.col("actor") / size))


def _kind(size: int) -> type:
    return np.uint16 if size <= 2**16 else np.int32


def _state(grp: int, given: np.ndarray, kept: np.ndarray, share: np.ndarray) -> pa.Table:
    """A row of STATE."""
    numbers = {"given": given, "kept": kept, "share": share}
    row = {"grp": pa.array([grp], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in numbers.items()}
    return pa.table(row | {"given_sum": [float(given.sum())], "kept_sum": [float(kept.sum())], "n": [len(given)]})


def ranks(edits: DataFrame, rows: int, n_nodes: int, width: int, n_total: int, tolerance: float, most: int = 500, damping: float = 0.85) -> DataFrame:
    """(code, score) of edits (actor by number, page, ts_us): what ``pagerank`` gives over
    the links, a < b, of actors who edit one page within ``width``."""
    spark = edits.sparkSession
    n = max(n_groups(rows), math.ceil(math.sqrt(2 * met_count(edits, rows, width) / BLOCK_LINKS)))
    size = max(-(-n_nodes // n), 1)
    kind, each = _kind(size), 1.0 / max(n_total, 1)
    table = f"links_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{table}"
    _block_links(edits, rows, width, n, size).write.bucketBy(min(n * (n + 1) // 2, BUCKETS), "block").option("path", folder).saveAsTable(table)
    links = spark.table(table)

    def members(grp: int) -> int:
        return min(size, n_nodes - grp * size)

    def fans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                fan = np.zeros(members(b["low"][i].as_py()), np.float64)
                fan[np.frombuffer(b["node"][i].as_buffer(), kind)] = np.frombuffer(b["fan"][i].as_buffer(), np.int32)
                yield pa.record_batch({"grp": b["low"].slice(i, 1), "got": pa.array([fan.tobytes()], pa.binary())})

    def summed(got: pa.Table, n: int) -> np.ndarray:
        out = np.zeros(n, np.float64)
        for v in got["got"]:
            if v.is_valid:
                out += np.frombuffer(v.as_buffer(), np.float64)
        return out

    def start(got: pa.Table) -> pa.Table:
        grp = got["grp"][0].as_py()
        fan = summed(got, members(grp))
        share = np.divide(damping, fan, out=np.zeros(len(fan)), where=fan > 0)
        return _state(grp, np.full(len(fan), each), np.full(len(fan), each), share)

    def handed(links: pa.Table, told: pa.Table) -> pa.Table:
        if not len(links) or not len(told):
            return pa.table({"grp": pa.array([], pa.int32()), "got": pa.array([], pa.binary())})
        given = np.frombuffer(told["given"][0].as_buffer(), np.float64) * np.frombuffer(told["share"][0].as_buffer(), np.float64)
        high = links["high"][0].as_py()
        out = np.zeros(members(high), np.float64)
        for node, fan, near in zip(links["node"], links["fan"], links["near"]):
            node, fan, near = np.frombuffer(node.as_buffer(), kind), np.frombuffer(fan.as_buffer(), np.int32), np.frombuffer(near.as_buffer(), kind)
            out += np.bincount(near, np.repeat(given[node], fan), len(out))
        return pa.table({"grp": pa.array([high], pa.int32()), "got": pa.array([out.tobytes()], pa.binary())})

    def taken(state: pa.Table, got: pa.Table) -> pa.Table:
        kept, share = (np.frombuffer(state[c][0].as_buffer(), np.float64) for c in ("kept", "share"))
        given = summed(got, len(kept))
        return _state(state["grp"][0].as_py(), given, kept + given, share)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                kept = np.frombuffer(b["kept"][i].as_buffer(), np.float64)
                yield pa.record_batch({"code": pa.array(b["grp"][i].as_py() * size + np.arange(len(kept)), pa.int32()), "score": pa.array(kept / total)})

    groups = spark.range(-(-n_nodes // size)).select(F.col("id").cast("int").alias("grp"), F.lit(None).cast("binary").alias("got"))
    state = written(links.mapInArrow(fans, "grp int, got binary").union(groups).groupBy("grp").applyInArrow(start, STATE), "rank")
    at = F.explode(F.sequence("grp", F.lit(n - 1)))
    for _ in range(most):
        told = state.select("given", "share", F.col("grp").alias("low"), at.alias("high")).selectExpr("cast(high * (high + 1) / 2 + low as int) as block", "given", "share")
        got = links.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(handed, "grp int, got binary")
        seen = {k: F.sum(c) for k, c in (("given", "given_sum"), ("kept", "kept_sum"))}
        after = written(state.groupBy("grp").cogroup(got.groupBy("grp")).applyInArrow(taken, STATE), "rank", **seen)
        spent(state)
        state = after
        total = (state.seen["kept"] or 0.0) + (n_total - n_nodes) * each
        if (state.seen["given"] or 0.0) * damping / (1 - damping) <= tolerance * total:
            break
    else:
        raise RuntimeError(f"ranks still move by {state.seen['given']} after {most} steps")
    spark.sql(f"drop table {table}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return state.mapInArrow(scores, "code int, score double")


def numbered_edits(edits: DataFrame) -> tuple[DataFrame, int, DataFrame, int]:
    """Edits (actor by number, page, ts_us) and how many they are; (node, code) and how many."""
    e = edits.where("actor is not null and page is not null and ts_us is not null").select("actor", "page", F.col("ts_us").cast("long").alias("ts_us"))
    codes = _coded(edits.where("actor is not null").select(F.col("actor").alias("node")).distinct())
    by_code = e.join(codes.withColumnRenamed("node", "actor"), "actor").select(F.col("code").alias("actor"), "page", "ts_us")
    by_code = written(by_code, "edits", n=F.count(F.lit(1)))
    return by_code, by_code.seen["n"] or 0, codes, codes.count()


def of_meetings(edits: DataFrame, width: int, n_total: int, tolerance: float) -> DataFrame:
    """(node, score) of all actors, ranked over the links of those who edit one page within ``width``."""
    by_code, rows, codes, n_nodes = numbered_edits(edits)
    ranked = ranks(by_code, rows, n_nodes, width, n_total, tolerance)
    return codes.join(ranked, "code").select("node", "score")


def with_components(edits: DataFrame, width: int, n_total: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(node, score) as ``of_meetings``, and (node, component) of the actors who met any."""
    from engram.operators.graph import components

    by_code, rows, codes, n_nodes = numbered_edits(edits)
    ranked = codes.join(ranks(by_code, rows, n_nodes, width, n_total, tolerance), "code").select("node", "score")
    found = components(chained(by_code, rows, width)).select("node", F.col("component").alias("label"))
    return ranked, _named(found, codes).withColumnRenamed("label", "component")
