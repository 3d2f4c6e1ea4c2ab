"""N-gram Jaccard join by parity sketches.

Each text's set of word shingles is XOR-hashed into a bit sketch: every
shingle flips one bit, so two sketches differ in at most as many bits as the
sets differ in shingles.  Sets of similarity num/den and sizes up to ``hi``
differ in at most t = 2 * hi * (den - num) / (den + num) shingles, so of the
P parts a sketch is cut into, P - t at least are equal in every pair to be
found (pigeonhole).  It is then enough to join t + 1 parts of each sketch, if
all sketches choose them by one order of parts: two sets with P - t members in
common out of P meet in the first t + 1 of any order.  P is one number in a
band of sizes; t is each set's own, that of the largest partner it can have
there, since both sets of a pair take at least what the pair needs.  The order
is by the number of set bits, most first, so the parts joined say much and
empty parts are hardly ever among them.  Parts are joined by their hash within
a band of sizes.  Within each pivot's cluster the whole sketches are compared: rows that
have no partner within the bound leave.  What remains is verified on the
shingle sets, and components follow by label propagation.

A cluster of more than one block is first compared block by block, each with
the pivot, which gathers near copies however many they are.  What then remains
are its pairs of different components: members of the largest one meet only
the others.

Nulls and empty texts have no shingles and link with nothing.  Equal sets
(copies, repeated rows) are one node.  Rows with a null id take part; a
component's id is the smallest id that is not null.  A similarity of exactly
num/den links.  Texts of any length are read whole.  An empty table gives an
empty result; other columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from engram.llm._common import BATCH_ROWS, apart, bundled, connected_components, cross_blocks, discard, groups_of, materialize, own_blocks, pivot_members, prepare
from engram.llm._text import buffers, mix, shingles, word_hashes

#: Bits of one part of a sketch.
PART_BITS = 1024
#: Parts of a sketch for each part that its band's largest sets join.
PARTS = 1.5
#: Ratio between the bounds of neighbouring size bands: few sets stand in two.
BAND = 3
#: Rows, and shingles, that one call of a Python function takes in on average.
BUNDLE, BUNDLE_SHINGLES = 2000, 500_000
#: Bytes of sketches, and shingles, that a block holds besides BLOCK_ROWS.
SKETCH_BYTES, SHINGLES = 8 << 20, 2_000_000
#: What names a group of sketches to compare, and of sets to verify.
SKETCHED, VERIFIED = ["band", "pivot", "block_a", "block_b"], ["pivot", "block_a", "block_b"]


def band_bounds(num: int, den: int, most: int) -> list[int]:
    """Bounds s of the size bands; partners lie in the same or the next band."""
    bounds = [1]
    while bounds[-1] <= most:
        s = bounds[-1]
        bounds.append(max(s * BAND + 1, s * den // num + 1))
    return bounds


def part_keys(found: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray, bytes]]:
    """(band, hashes of the chosen sketch parts, compact sketch) of one set, for
    all bands it must stand in.  The compact sketch folds the same bits to
    about two a shingle; its distances are lower bounds too."""
    n, out = len(found), []
    bounds = band_bounds(num, den, n * den // num)
    for band in range(len(bounds) - 1):
        low, hi = bounds[band], bounds[band + 1] - 1
        if n > hi or n * den // num < low:
            continue
        most = 2 * hi * (den - num) // (den + num)
        if most < 1:
            continue  # only equal sets can reach the bound; those are one node
        parts = int(PARTS * (most + 1)) + 1
        own = (n + min(hi, n * den // num)) * (den - num) // (den + num)  # with its largest partner here
        bit = np.sort(found % np.uint64(parts * PART_BITS))
        _, first, count = np.unique(bit, return_index=True, return_counts=True)
        bit = bit[first[count % 2 == 1]]  # set bits: flipped an odd number of times
        part = (bit // np.uint64(PART_BITS)).astype(np.int64)
        salt = mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40))
        value = np.zeros(parts, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(value, part, mix(bit + np.uint64(0x5851F42D4C957F2D)))
            value = mix(value + salt)
        held = np.bincount(part, minlength=parts)
        width = 64 * max(8, -(-2 * hi // 64))
        folded = np.bincount((mix(found) % np.uint64(width)).astype(np.int64), minlength=width) % 2
        out.append((band, value[np.lexsort((value, -held))[: own + 1]], np.packbits(folded.astype(np.uint8)).tobytes()))
    return out


def _set_id(found: np.ndarray) -> int:
    """Identity of a set: a 64-bit hash of its sum and its parity."""
    with np.errstate(over="ignore"):
        both = np.array([np.sum(mix(found)) + np.uint64(len(found)) * mix(np.bitwise_xor.reduce(found, initial=np.uint64(0)))[()]])
    return int(mix(both).view(np.int64)[0])


def _node(set_id: int, band: int) -> int:
    """Name of a set in a band."""
    return int(mix(np.array([set_id], np.int64).view(np.uint64) ^ np.uint64(band + 1))[0].view(np.int64))


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row, never null: a 64-bit hash of id and text.  Only rows that
    repeat both share it."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _sets(batch: pa.RecordBatch, text: str, k: int) -> list[np.ndarray]:
    return shingles(*word_hashes(*buffers(batch.column(text))), k)


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, row_key, n_shingles, set_id, bands) per row; a set's bands stand in its first row of a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            found = _sets(batch, "text", k)
            ids = [_set_id(x) if len(x) else None for x in found]
            bands = []
            for i, x in zip(ids, found):
                if i is None or i in seen:
                    bands.append(None)
                else:
                    seen.add(i)
                    bands.append([{"band": b, "node": _node(i, b), "keys": keys.view(np.int64), "bits": bits} for b, keys, bits in part_keys(x, num, den)])
            if len(seen) > 200_000:
                seen.clear()
            kind = pa.list_(pa.struct([("band", pa.int32()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row_key"), pa.array([len(x) for x in found], pa.int64()), pa.array(ids, pa.int64()), pa.array(bands, kind)],
                ["id", "row_key", "n_shingles", "set_id", "bands"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, row_key long, n_shingles long, set_id long, bands array<struct<band:int,node:bigint,keys:array<long>,bits:binary>>")


def near_sketches(group: pa.Table, num: int, den: int) -> np.ndarray:
    """Places of the rows whose sketch is near enough another's of the group."""
    _, rows = np.unique(group.column("x").to_numpy(), return_index=True)
    n = group.column("n").to_numpy()[rows]
    held = group.column("bits")
    bits = np.stack([np.frombuffer(held[i].as_py(), np.uint64) for i in rows.tolist()])
    own = group.column("own").to_numpy()[rows]
    one_block = group.column("block_a")[0].as_py() == group.column("block_b")[0].as_py()
    near = np.zeros(len(rows), bool)
    for i in range(len(rows) - 1):
        apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int64)
        ok = apart * (den + num) <= (den - num) * (n[i + 1 :] + n[i])
        if not one_block:
            ok &= own[i + 1 :] != own[i]
        if ok.any():
            near[i] = True
            near[i + 1 :] |= ok
    return rows[near]


def verified_links(table: pa.Table, num: int, den: int) -> np.ndarray:
    """Edges (x, root) that connect what the verified pairs of a group connect.

    Counts common shingles of all pairs by one matrix product over the
    shingles that at least two rows hold.
    """
    x, rows = np.unique(table.column("x").to_numpy(), return_index=True)  # repeated rows: once
    own = table.column("own").to_numpy()[rows]
    sets = [np.frombuffer(table.column("shingles")[i].as_py(), np.uint64) for i in rows.tolist()]
    size = np.array([len(s) for s in sets], np.int64)
    one_block = table.column("block_a")[0].as_py() == table.column("block_b")[0].as_py()
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(x)), size)
    held = count[code] > 1
    owner, code = owner[held], code[held]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(x), len(x)), np.float32)
    wide = max(256, 4_000_000 // len(x))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, wide):
        a, b = np.searchsorted(code, [low, low + wide])
        cells = np.zeros((len(x), wide), np.float32)
        cells[owner[a:b], code[a:b] - low] = 1
        common += cells @ cells.T
    linked = den * common.astype(np.int64) >= num * (size[:, None] + size[None, :] - common.astype(np.int64))
    if not one_block:
        linked &= own[:, None] != own[None, :]
    np.fill_diagonal(linked, True)
    root = np.arange(len(x))
    while True:
        nearest = np.where(linked, root[None, :], len(x)).min(axis=1)
        if (nearest == root).all():
            break
        root = nearest
    return np.stack([x, x[root]], axis=1)[root != np.arange(len(x))]


def _near(table: pa.Table, num: int, den: int) -> pa.Table:
    """(pivot, x, head) of the sets of a bundle that are near another of their group."""
    parts = []
    for one in groups_of(table, SKETCHED):
        if len(one) > 1:
            rows = near_sketches(one, num, den)
            parts.append(one.take(pa.array(rows)).select(["pivot", "set_id", "head"]))
    empty = table.slice(0, 0).select(["pivot", "set_id", "head"])
    return pa.concat_tables([empty, *parts]).rename_columns(["pivot", "x", "head"])


def _read_sets(batches, k: int):
    """(text, places) rows to a row a place with the text's shingles."""
    kinds = {"x": pa.int64(), "pivot": pa.int64(), "block_a": pa.int32(), "block_b": pa.int32(), "own": pa.int32(), "shingles": pa.binary()}
    def rows_of(batch):
        for found, places in zip(_sets(batch, "text", k), batch.column("places").to_pylist()):
            if len(found):
                name, data = _set_id(found), found.tobytes()
                for place in places:
                    if place["x"] == name:
                        yield (*(place[c] for c in ("x", "pivot", "block_a", "block_b", "own")), data)

    for batch in batches:
        rows = rows_of(batch)
        while part := list(itertools.islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*part), kinds.values())], list(kinds))


def _verify(table: pa.Table, num: int, den: int) -> pa.Table:
    edges = np.concatenate([np.zeros((0, 2), np.int64), *(verified_links(one, num, den) for one in groups_of(table, VERIFIED) if len(one) > 1)])
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]})


def row_classes(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, row_key, n_shingles, root, component_id) for every row of ``docs``.

    ``root`` names the class, null for rows without shingles; component_id is
    the smallest id of the class, so an id that stands on texts of two classes
    can be that of both.
    """
    prepare(docs.sparkSession)
    sketched = materialize(sketch(docs, id_col, text_col, k, num, den), "sketches")
    # distinct sets with the key of one row to fetch a text by; copies are one node
    nodes = materialize(
        sketched.where("set_id is not null").groupBy("set_id")
        .agg(F.min("id").alias("least_id"), F.min("row_key").alias("fetch_key"), F.first("n_shingles").alias("n")),
        "sets",
    )
    banded = sketched.where("bands is not null").select("set_id", F.col("n_shingles").alias("n"), F.inline("bands"))
    # part hashes tell the bands apart, so a key and the set's name in its band are all that is shuffled
    keys = banded.select(F.col("node").alias("x"), F.explode("keys").alias("key"))
    sketches = banded.select(F.col("node").alias("x"), "set_id", "band", "n", "bits").dropDuplicates(["x"])
    sketches = materialize(sketches.withColumn("bytes", F.length("bits")), "set-sketches")
    rows = materialize(sketched.select("id", "row_key", "n_shingles", "set_id"), "rows")
    members = pivot_members(keys, ["key"])
    discard(sketched)
    sized = materialize(members.withColumn("head", F.col("x") == F.col("pivot")).join(sketches.select("x", "set_id", "bytes"), "x"), "members")
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))

    def near(dealt: DataFrame) -> DataFrame:
        """(pivot, x, head, n, fetch_key): sets whose sketch is near another's of its group."""
        compared = dealt.select("pivot", "x", "head", "own", "block_a", "block_b").join(sketches.drop("bytes"), "x")
        bundles = max(1, sized.count() // BUNDLE)
        found = bundled(compared, SKETCHED, bundles).groupBy("bundle").applyInArrow(lambda t: _near(t, num, den), "pivot long, x long, head boolean")
        return materialize(found.groupBy("pivot", "x").agg(F.max("head").alias("head")).join(nodes.withColumnRenamed("set_id", "x"), "x"), "near")

    def verified(dealt: DataFrame) -> DataFrame:
        """Edges of the pairs that are near enough, from the sets of the texts."""
        total = dealt.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
        # all places of a set, gathered by the row to fetch its text by: no key has those of two sets
        wanted = dealt.groupBy(F.col("fetch_key").alias("row_key")).agg(F.collect_list(F.struct("x", "pivot", "block_a", "block_b", "own")).alias("places"))
        wanted = materialize(wanted, "wanted")
        # rows that repeat id and text: one fetches, the others go before the shuffle, as do rows that nobody wants
        # where their keys are few enough for Spark to send them out
        asked = texts.join(wanted.select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"])
        fetched = asked.join(wanted.hint("merge"), "row_key").select("text", "places")
        sets = fetched.mapInArrow(lambda b: _read_sets(b, k), "x long, pivot long, block_a int, block_b int, own int, shingles binary")
        bundles = max(total["rows"] // BUNDLE, (total["n"] or 0) // BUNDLE_SHINGLES)
        edges = bundled(sets, VERIFIED, bundles).groupBy("bundle").applyInArrow(lambda t: _verify(t, num, den), "a long, b long")
        edges = materialize(edges, "edges")
        discard(wanted)
        return edges

    dealt, large = own_blocks(sized, "bytes", SKETCH_BYTES)
    found = near(dealt)
    dealt, larger = own_blocks(found, "n", SHINGLES)
    edges = verified(dealt)
    large = materialize(large.union(larger).distinct(), "large")
    if not large.isEmpty():
        classes = connected_components(edges)
        rooted = sized.join(large, "pivot", "left_semi").join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
        rooted = rooted.withColumn("root", F.coalesce("label", "set_id")).drop("label", "set_id")
        crossing = near(cross_blocks(rooted, "bytes", SKETCH_BYTES)).join(classes.withColumnRenamed("node", "x"), "x", "left")
        crossing = crossing.withColumn("root", F.coalesce("label", "x")).drop("label")
        edges = edges.union(verified(cross_blocks(crossing, "n", SHINGLES))).union(classes.select(F.col("node").alias("a"), F.col("label").alias("b")))
    labels = connected_components(edges)
    for table in (sketches, sized, found):
        discard(table)
    rooted = nodes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "least_id", F.coalesce("label", "set_id").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("set_id", "root", "component_id"), "classes")
    discard(nodes)
    return rows.join(classes, "set_id", "left").select("id", "row_key", "n_shingles", "root", "component_id")


def ngram_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``.

    Rows link when den * |A & B| >= num * |A | B| for their sets of k-word
    shingles; component_id is the smallest id reachable by links.
    """
    return row_classes(docs, id_col, text_col, k, num, den).select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with exactly one row of each class: one with the smallest id.

    A null id comes after all others.  Of texts of one class under one id the
    one with the smallest row key stays; of rows that repeat id and text, the
    first by the other columns.  Rows without shingles are in no class and stay.
    """
    rows = row_classes(docs, id_col, text_col, k, num, den).where("root is not null")
    rows = materialize(rows.groupBy("root", "component_id", "id", "row_key").agg(F.count("*").alias("n")), "class-rows")
    # classes of more than one row key, and the key that stays
    kept = (
        rows.groupBy("root").agg(
            F.min(F.when(F.col("id").eqNullSafe(F.col("component_id")), F.col("row_key"))).alias("kept"),
            F.min("row_key").alias("low"), F.max("row_key").alias("high"),
        ).where("low < high").select("root", "kept")
    )
    gone = materialize(rows.join(kept, "root").where("row_key <> kept").select("row_key"), "near-copies")
    repeated = materialize(rows.where("n > 1").select("row_key").join(gone, "row_key", "left_anti"), "repeated-rows")
    key, tie = apart(docs, "_row_key", "_tie")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    gone, repeated = (t.withColumnRenamed("row_key", key) for t in (gone, repeated))
    once = keyed.join(gone.union(repeated), key, "left_anti")
    other = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col) and isinstance(f.dataType, AtomicType)]
    first = Window.partitionBy(key).orderBy(*(other or [F.col(key)]))
    again = keyed.join(repeated, key, "left_semi").withColumn(tie, F.row_number().over(first)).where(F.col(tie) == 1)
    return once.select(*(F.col(f"`{c}`") for c in docs.columns)).union(again.select(*(F.col(f"`{c}`") for c in docs.columns)))
