"""Embedding near-duplicates by cross-polytope hashing.

Vectors of one label are hashed in several tables: a fast pseudo-random
rotation (sign flips and Hadamard transforms, three times) brings each vector
near one of the 2d signed unit vectors, several rotations make a bucket, and the
runner-up of each rotation is probed too.  The more vectors a label has, the
more rotations a bucket takes, so that chance meetings a vector stay few at
any size.  Pairs within the buckets are verified in double precision; nothing
below the threshold links.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do rows of a null label; each is its own component.  Equal
vectors of a label are hashed once and counted with their number.  Repeated
ids link like any other rows; a component's id is the smallest id.  Vectors of
different widths never link.  A cosine of exactly the threshold links.  Other
columns are ignored, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.llm._common import block_pairs, connected_components, discard, materialize, pivot_members, prepare
from engram.llm._text import mix

#: Hash tables, chance partners a vector may meet in one of them, most rotations
#: of a bucket (more lose links: at six and width 64 none of 4000 pairs was lost)
#: and the seed.
TABLES, CHANCE, MOST, SEED = 10, 0.5, 6, 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotations_for(vectors: int, width: int) -> int:
    """Rotations a bucket takes for a label of so many vectors: the fewest with
    which a vector meets at most CHANCE unrelated ones in a table."""
    spots, n = 2 << max(1, (width - 1).bit_length()), 1
    while n < MOST and vectors * (n + 1) ** 2 > CHANCE * spots**n:
        n += 1
    return n


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1.  A power of two is taken out of each first, which changes
    no digit, so that squares of very large or small components neither overflow
    nor vanish."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -exponent)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_codes(vectors: np.ndarray, rotations: int) -> np.ndarray:
    """[rows, tables * probes] bucket codes: the nearest signed unit vectors
    of ``rotations`` rotations, and each rotation's second choice in turn."""
    n, width = vectors.shape
    d = 1 << max(1, (width - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :width] = unit_rows(vectors)
    rng, codes = np.random.Generator(np.random.PCG64(SEED)), []
    for table in range(TABLES):
        best, second = [], []
        for _ in range(rotations):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            order = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            near = np.take_along_axis(y, order, axis=1)
            swap = np.abs(near[:, 0]) < np.abs(near[:, 1])
            order[swap], near[swap] = order[swap][:, ::-1], near[swap][:, ::-1]
            spots = (2 * order + (near > 0)).astype(np.uint64)
            best.append(spots[:, 0])
            second.append(spots[:, 1])
        for probe in range(rotations + 1):
            code = np.full(n, table + 1, np.uint64)
            for r in range(rotations):
                code = mix(code * np.uint64(4 * d + 1) + (second[r] if probe == r + 1 else best[r]))
            codes.append(code)
    return np.stack(codes, axis=1)


def _links(table: pa.Table, threshold: float) -> pa.Table:
    """Of a group of two blocks: x with its links counted here, and its root.

    A pair that meets in several clusters is counted in the one with the
    smallest pivot that both have.
    """
    x, own = table.column("x").to_numpy(), table.column("own").to_numpy()
    many = table.column("copies").to_numpy()
    unit = unit_rows(np.array(table.column("v").to_pylist(), np.float64))
    pivot = table.column("pivot")[0].as_py()
    linked = unit @ unit.T >= threshold
    if table.column("block_a")[0].as_py() != table.column("block_b")[0].as_py():
        linked &= own[:, None] != own[None, :]
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(linked)
    lists = table.column("pivots").to_pylist()
    held = np.zeros((len(x), max(map(len, lists))), np.int64)
    real = np.zeros(held.shape, bool)
    for i, p in enumerate(lists):
        held[i, : len(p)], real[i, : len(p)] = p, True
    counts = np.zeros(len(x), np.int64)
    for s in range(0, len(a), 20_000):
        left, right = held[a[s : s + 20_000]], held[b[s : s + 20_000]]
        # smallest common pivot: pivots below this one that both hold
        below = real[a[s : s + 20_000]] & (left < pivot)
        both = below[:, :, None] & real[b[s : s + 20_000]][:, None, :]
        lower = ((left[:, :, None] == right[:, None, :]) & both).any(axis=(1, 2))
        np.add.at(counts, a[s : s + 20_000][~lower], many[b[s : s + 20_000][~lower]])
    np.fill_diagonal(linked, True)
    root = np.arange(len(x))
    while True:
        nearest = np.where(linked, root[None, :], len(x)).min(axis=1)
        if (nearest == root).all():
            break
        root = nearest
    return pa.table({"x": x, "n": counts, "root": x[root]})


def embedding_classes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row."""
    prepare(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce(finite & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(sound, v).alias("v"))
    # equal vectors of a label are one node, named by a hash that keeps their order of ids out of it
    rows = materialize(rows.withColumn("x", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))), "vectors")
    nodes = materialize(
        rows.where("x is not null").groupBy("x", "label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least_id")), "nodes"
    )

    sizes = nodes.groupBy("label").agg(F.count("*").alias("held"))
    asked = nodes.select("x", "label", "v").join(sizes, "label")

    def hashed(batches):
        for batch in batches:
            groups: dict[tuple[int, int], list[int]] = {}
            lists = batch.column("v").to_pylist()
            for i, (one, held) in enumerate(zip(lists, batch.column("held").to_pylist())):
                groups.setdefault((len(one), rotations_for(held, len(one))), []).append(i)
            for (width, rotations), at in groups.items():
                codes = bucket_codes(np.array([lists[i] for i in at], np.float64), rotations).view(np.int64)
                take = pa.array(at)
                columns = [batch.column("x").take(take), batch.column("label").take(take), pa.array([width] * len(at), pa.int32()), pa.array(list(codes), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["x", "label", "width", "codes"])

    label_type = dict(nodes.dtypes)["label"]
    keys = asked.mapInArrow(hashed, f"x long, label {label_type}, width int, codes array<long>")
    keys = materialize(keys.select("x", "label", "width", F.explode("codes").alias("code")), "codes")
    members = materialize(pivot_members(keys, ["label", "width", "code"]), "members")
    discard(keys)
    pivots = members.groupBy("x").agg(F.collect_set("pivot").alias("pivots"))  # at most one for each code
    known = materialize(nodes.select("x", "copies", "v").join(pivots, "x"), "hashed")
    dealt = block_pairs(members).join(known, "x")
    found = dealt.groupBy("pivot", "block_a", "block_b").applyInArrow(lambda t: _links(t, threshold), "x long, n long, root long")
    found = materialize(found, "links")
    discard(known)
    discard(members)
    labels = connected_components(found.select(F.col("x").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("x").agg(F.sum("n").alias("others"))
    rooted = nodes.select("x", "copies", "least_id").join(labels.withColumnRenamed("node", "x"), "x", "left").join(counts, "x", "left")
    rooted = rooted.withColumn("root", F.coalesce("label", "x"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialize(
        rooted.join(least, "root").select("x", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "classes"
    )
    discard(found)
    discard(nodes)
    return rows.select("id", "x").join(classes, "x", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
