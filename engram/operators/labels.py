"""Label propagation by parts of a graph.

Nodes are numbered in the order of their values and dealt to parts by their number.
A part holds its nodes' neighbours as arrays of numbers and is written once, as a
bucketed table, so that it stays where it is; a step sends a node's label once to
each part in which it has neighbours, and never once a link.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.operators.blocks import CHUNK, Line, coded, cuts, sorted_groups, spread
from engram.operators.steps import numbered, shared_folder, spent, written

#: Links of a part, and parts at least; edits of a task that looks for meetings; widths in a cell of time.
PART_LINKS, LEAST_PARTS, TASK_EDITS, CELL = 8_000_000, 8, 200_000, 16

LINKS = "part int, node array<int>, near array<int>"
NEAR = "part int, node int, near array<int>, parts array<int>"
NOTE = "part int, own boolean, node array<int>, label array<int>, target array<int>, known array<int>, names array<string>, moving long"


# ------------------------------------------------------------------ links


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int32()))


def _dealt(a: np.ndarray, b: np.ndarray, n_parts: int) -> pa.Table:
    """Links in both directions, each once, an array a part."""
    low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
    keys = np.unique((low << 32 | high)[low != high])
    low, high = keys >> 32, keys & 0xFFFFFFFF
    node, near = np.concatenate([low, high]), np.concatenate([high, low])
    part = node % n_parts
    order = np.argsort(part, kind="stable")
    parts, n = np.unique(part, return_counts=True)
    ends = np.cumsum(n)
    return pa.table({"part": pa.array(parts, pa.int32()), "node": _lists(node[order], ends), "near": _lists(near[order], ends)})


def dealt_links(links: DataFrame, n_parts: int) -> DataFrame:
    """LINKS of (a, b) by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
            if sum(len(a) for a, _ in held) >= CHUNK:
                yield from _dealt(*(np.concatenate(x) for x in zip(*held)), n_parts).to_batches()
                held.clear()
        if held:
            yield from _dealt(*(np.concatenate(x) for x in zip(*held)), n_parts).to_batches()

    return links.mapInArrow(run, LINKS)


def _meetings(edits: DataFrame, rows: int, width: int, make: Callable, schema: str) -> DataFrame:
    """What ``make`` yields of the edits of some pages and stretches of time: it gets
    a ``Line`` with actors, each edit's first partner and their number.

    An edit is in its cell of time; the first ones stand in the cell before as well,
    for those that go before them."""
    cell = max(width, 1) * CELL
    own = F.floor(F.col("ts_us") / cell)
    at = F.explode(F.when(F.col("ts_us") - own * cell <= width, F.array(own, own - 1)).otherwise(F.array(own)))
    dealt = edits.withColumn("at", at).withColumn("late", F.col("at") < own).repartition(max(LEAST_PARTS, -(-rows // TASK_EDITS)), "page", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            held.clear()
            page, cells = coded(table["page"])[0], coded(table["at"])[0]
            line = Line(page * (int(cells.max()) + 1) + cells, table["ts_us"].to_numpy(), table["actor"].to_numpy(), table["late"].to_numpy())
            first = np.arange(len(line.ts)) + 1
            n = np.where(line.more[1], 0, line.place(line.group, line.ts + width, "right") - first)
            for found in make(line, first, n):
                yield from found.to_batches()

    return dealt.mapInArrow(run, schema)


def met_links(edits: DataFrame, rows: int, width: int) -> tuple[DataFrame, int]:
    """LINKS of edits (actor by number, page, ts_us) within ``width``, and the number of parts."""
    def count(line: Line, first: np.ndarray, n: np.ndarray) -> Iterator[pa.Table]:
        yield pa.table({"n": [int(n.sum())]})

    n_parts = parts_of(_meetings(edits, rows, width, count, "n long").agg(F.sum("n")).first()[0] or 0)

    def make(line: Line, first: np.ndarray, n: np.ndarray) -> Iterator[pa.Table]:
        for part in cuts(n, CHUNK):
            row, other = spread(first[part], n[part])
            yield _dealt(line.more[0][row + part.start], line.more[0][other], n_parts)

    return _meetings(edits, rows, width, make, LINKS), n_parts


def parts_of(links: int) -> int:
    return max(LEAST_PARTS, -(-2 * links // PART_LINKS))


def _neighbours(n_parts: int):
    """NEAR of a part's links: each node's neighbours in order, and the parts they are in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [b["node"].flatten().to_numpy().astype(np.int64) << 32 | b["near"].flatten().to_numpy() for b in batches]
        if not keys or not sum(map(len, keys)):
            return
        keys = np.unique(np.concatenate(keys))
        node, near = keys >> 32, keys & 0xFFFFFFFF
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        ends = np.append(starts[1:], len(node))
        for some in cuts(ends - starts, CHUNK):
            own = slice(starts[some.start], ends[some.stop - 1])
            row = np.repeat(np.arange(some.stop - some.start), (ends - starts)[some])
            to = np.unique(row * n_parts + near[own] % n_parts)
            sent = np.cumsum(np.bincount(to // n_parts, minlength=some.stop - some.start))
            nodes = node[starts[some]]
            yield from pa.table({
                "part": pa.array(nodes % n_parts, pa.int32()), "node": pa.array(nodes, pa.int32()),
                "near": _lists(near[own], ends[some] - own.start), "parts": _lists(to % n_parts, sent),
            }).to_batches()

    return run


# ------------------------------------------------------------------ steps


class Part:
    """A part's nodes with their neighbours, and what it has been told."""

    def __init__(self, near: pa.Table, notes: pa.Table):
        near = near.sort_by("node").combine_chunks()
        self.node = near["node"].to_numpy()
        lists = [near[c].combine_chunks() for c in ("near", "parts")]
        self.near, self.parts = (x.flatten().to_numpy() for x in lists)
        self.n, self.n_parts = (x.value_lengths().to_numpy().astype(np.int64) for x in lists)
        self.first, self.first_part = np.cumsum(self.n) - self.n, np.cumsum(self.n_parts) - self.n_parts
        own = notes["own"].to_numpy()
        self.own, self.told = notes.filter(pa.array(own)), notes.filter(pa.array(~own))

    def own_values(self, column: str) -> np.ndarray:
        node, values = _flat(self.own, "node"), _flat(self.own, column)
        return values[np.argsort(node)]

    def gathered(self, rows: np.ndarray, node: np.ndarray, value: np.ndarray, other: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, row, values): some rows at a time, with the value of each neighbour
        (``other`` where it has none); ``row`` counts from the first of them."""
        order = np.argsort(node, kind="stable")
        node, value = np.append(node[order], -1), np.append(value[order], other)
        for some in cuts(self.n[rows], CHUNK):
            held = rows[some]
            row, at = spread(self.first[held], self.n[held])
            near = self.near[at]
            place = np.searchsorted(node[:-1], near)
            yield held, row, np.where(node[place] == near, value[place], other)

    def notes(self, rows: np.ndarray, value: np.ndarray, said: Callable[[np.ndarray], pa.Array], own: dict) -> pa.Table:
        """The part's own note, and what ``rows`` have, to each part they have neighbours in."""
        row, at = spread(self.first_part[rows], self.n_parts[rows])
        part, node, value = self.parts[at], self.node[rows[row]], value[row]
        order, starts = sorted_groups(part)
        ends = np.append(starts[1:], len(order))
        made = [own]
        for s, e in zip(starts, ends):
            some = order[s:e]
            known = np.unique(value[some])
            made.append({"part": int(part[some[0]]), "own": False, "node": node[some], "label": value[some], "target": [], "known": known, "names": said(known), "moving": 0})
        kinds = {"part": pa.int32(), "own": pa.bool_(), "moving": pa.int64()}
        columns = {}
        for c in ("part", "own", "node", "label", "target", "known", "names", "moving"):
            if c in kinds:
                columns[c] = pa.array([m[c] for m in made], kinds[c])
            else:
                kind = pa.string() if c == "names" else pa.int32()
                offsets = np.concatenate(([0], np.cumsum([len(m[c]) for m in made])))
                values = pa.concat_arrays([m[c] if isinstance(m[c], pa.Array) else pa.array(m[c], kind) for m in made])
                columns[c] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        return pa.table(columns)


def _flat(notes: pa.Table, column: str) -> np.ndarray:
    return notes[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)


class Names:
    """What is known of labels, by number."""

    def __init__(self, notes: pa.Table):
        known, first = np.unique(_flat(notes, "known"), return_index=True)
        self.known, self.names = known, notes["names"].combine_chunks().flatten().take(pa.array(first))

    def __call__(self, labels: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(np.searchsorted(self.known, labels)))


def _empty() -> pa.Table:
    numbers = pa.list_(pa.int32())
    kinds = [("part", pa.int32()), ("own", pa.bool_()), ("node", numbers), ("label", numbers), ("target", numbers), ("known", numbers), ("names", pa.list_(pa.string())), ("moving", pa.int64())]
    return pa.schema(kinds).empty_table()


def _start(near: pa.Table, names: pa.Table) -> pa.Table:
    """Each node has its own label."""
    if not len(near):
        return _empty()
    own = pa.table({"own": pa.array([True] * len(names), pa.bool_()), "known": _lists(names["node"].to_numpy(), np.arange(len(names)) + 1), "names": pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1), pa.int32()), names["name"].combine_chunks().cast(pa.string()))})
    part, said = Part(near, own), Names(own)
    note = {"part": near["part"][0].as_py(), "own": True, "node": part.node, "label": part.node, "target": [], "known": part.node, "names": said(part.node), "moving": 0}
    return part.notes(np.arange(len(part.node)), part.node, said, note)


def _drawn(names: pa.Array, step: int) -> pa.Array:
    """The hashes that put a step's labels in order."""
    return pa.array([hashlib.md5(f"{n}:{step}".encode()).hexdigest() for n in names.to_pylist()], pa.string())


def _wishes(step: int):
    """Which label each node would move to, told to the parts of its neighbours."""
    def run(near: pa.Table, notes: pa.Table) -> pa.Table:
        part, said = Part(near, notes), Names(notes)
        label = part.own_values("label")
        target = np.full(len(label), -1, np.int32)
        for rows, row, heard in part.gathered(np.arange(len(label)), _flat(notes, "node"), _flat(notes, "label"), -1):
            keys = np.sort(row << 32 | heard)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n, keys = np.diff(np.append(starts, len(keys))), keys[starts]
            of, voted = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
            most = np.maximum.reduceat(n, np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))))
            held = np.zeros(len(rows), np.int64)
            same = voted == label[rows][of]
            held[of[same]] = n[same]
            best = np.flatnonzero(n == most[of])
            best = best[np.concatenate(([True], of[best][1:] != of[best][:-1]))]  # the smallest label
            target[rows] = np.where(most > held, voted[best], -1)
        rows = np.flatnonzero(target >= 0)
        known = np.unique(np.concatenate([label, target[rows]]))
        own = {"part": near["part"][0].as_py(), "own": True, "node": part.node, "label": label, "target": target, "known": known, "names": said(known), "moving": len(rows)}
        return part.notes(rows, target[rows], lambda some: _drawn(said(some), step), own)

    return run


def _moves(step: int):
    """Nodes move whose wish is first among those of their neighbours; all labels are told."""
    def run(near: pa.Table, notes: pa.Table) -> pa.Table:
        part = Part(near, notes)
        said = Names(part.own)
        label, target = part.own_values("label"), part.own_values("target")
        rows = np.flatnonzero(target >= 0)
        if len(rows):
            own = np.unique(target[rows])
            drawn = dict(zip(_flat(part.told, "known").tolist(), _flat(part.told, "names").tolist())) | dict(zip(own.tolist(), _drawn(said(own), step).to_pylist()))
            first = np.array(sorted(drawn, key=lambda t: (drawn[t], t)), np.int64)
            by_label = np.argsort(first)
            place = lambda labels: by_label[np.searchsorted(first[by_label], labels)]
            label = label.copy()
            for held, row, others in part.gathered(rows, _flat(part.told, "node"), place(_flat(part.told, "label")), len(first)):
                least = np.minimum.reduceat(others, np.cumsum(part.n[held]) - part.n[held])
                moving = held[place(target[held]) <= least]
                label[moving] = target[moving]
        known = np.unique(label)
        own = {"part": near["part"][0].as_py(), "own": True, "node": part.node, "label": label, "target": [], "known": known, "names": said(known), "moving": 0}
        return part.notes(np.arange(len(label)), label, said, own)

    return run


def settled(links: DataFrame, names: DataFrame, n_parts: int) -> DataFrame:
    """(node, label) by number of LINKS; ``names``: (code, name)."""
    spark = links.sparkSession
    near = links.repartitionById(n_parts, F.col("part")).mapInArrow(_neighbours(n_parts), NEAR)
    table = f"near_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{table}"
    near.write.bucketBy(n_parts, "part").option("path", folder).saveAsTable(table)
    held = spark.table(table).groupBy("part")

    def told(rows: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], **seen) -> DataFrame:
        return written(held.cogroup(rows.groupBy("part")).applyInArrow(make, NOTE), "notes", **seen)

    notes = told(names.select(F.pmod("code", F.lit(n_parts)).cast("int").alias("part"), F.col("code").cast("int").alias("node"), "name"), _start)
    step = 0
    while True:
        wishes = told(notes, _wishes(step), moving=F.sum("moving"))
        spent(notes)
        if not wishes.seen["moving"]:
            break
        notes, step = told(wishes, _moves(step)), step + 1
        spent(wishes)
    spark.sql(f"drop table {table}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    pairs = wishes.where("own").select(F.explode(F.arrays_zip("node", "label")).alias("x"))
    return pairs.select("x.node", "x.label")


def _coded(nodes: DataFrame) -> DataFrame:
    """(node, code): their places in order."""
    placed = numbered(nodes.select("node", F.lit(1).alias("all")), "all", ["node"], "code")
    return written(placed.select("node", F.col("code").cast("int").alias("code")), "codes")


def _named(found: DataFrame, codes: DataFrame) -> DataFrame:
    own = found.join(codes.select(F.col("code").alias("node"), F.col("node").alias("own")), "node")
    return own.join(codes.select(F.col("code").alias("label"), F.col("node").alias("name")), "label").select(F.col("own").alias("node"), F.col("name").alias("label"))


def of_links(edges: DataFrame) -> DataFrame:
    """(node, label) of links (a, b)."""
    edges = edges.select("a", "b").where("a <> b")
    codes = _coded(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    ends = [codes.select(F.col("node").alias(c), F.col("code").alias(f"_{c}")) for c in ("a", "b")]
    links = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    links = written(links, "links", n=F.count(F.lit(1)))
    n_parts = parts_of(links.seen["n"] or 0)
    return _named(settled(dealt_links(links, n_parts), codes.select("code", F.col("node").cast("string").alias("name")), n_parts), codes)


def of_meetings(edits: DataFrame, width: int) -> DataFrame:
    """(node, label) of the links of actors who edit one page within ``width``."""
    e = edits.where("actor is not null and page is not null and ts_us is not null").select("actor", "page", F.col("ts_us").cast("long").alias("ts_us"))
    e = written(e, "edits", n=F.count(F.lit(1)))
    codes = _coded(e.select(F.col("actor").alias("node")).distinct())
    by_code = e.join(codes.withColumnRenamed("node", "actor"), "actor").select(F.col("code").alias("actor"), "page", "ts_us")
    links, n_parts = met_links(by_code, e.seen["n"] or 0, width)
    return _named(settled(links, codes.select("code", F.col("node").cast("string").alias("name")), n_parts), codes)
