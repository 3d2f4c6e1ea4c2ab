"""Memory tables: upserts, handovers, snapshots, digests, the event log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from engram.functions.columns import NODE_LABELS, block_type, encode_map, flat_text, snippet, sound_vector, stable_id
from engram.functions.embed import embed
from engram.operators.novelty import gate
from engram.operators.steps import written

STATUS_OPEN, STATUS_SUPERSEDED = "open", "superseded"


def upsert_first_last(rows: DataFrame, key: str, order: list[str], first: list[str], last: list[str]) -> DataFrame:
    """One row a key: ``first`` columns from its first writer, ``last`` from its last."""
    place = F.struct(*order)
    return rows.groupBy(key).agg(*(F.min_by(c, place).alias(c) for c in first), *(F.max_by(c, place).alias(c) for c in last))


def merge_nodes(stored: DataFrame, rows: DataFrame, key: str, keep_first: list[str]) -> DataFrame:
    """Stored nodes overlaid by new ones: ``keep_first`` columns stay as first written."""
    other = [c for c in stored.columns if c != key]
    a, b = stored.alias("a"), rows.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = [F.coalesce(*(F.col(f"{s}.{c}") for s in ("ab" if c in keep_first else "ba"))).alias(c) for c in other]
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *pick)


def relate(edges: DataFrame, proposed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after, proposals with a missing end): ends are never invented, edges never doubled."""
    ids = nodes.where("id is not null").select("id").distinct()
    # merged: as a hash table in every task, the nodes would grow with their number
    known = lambda end: ids.select(F.col("id").alias(f"_{end}")).hint("merge")
    met = proposed.join(known("src"), F.col("src") == F.col("_src"), "left").join(known("dst"), F.col("dst") == F.col("_dst"), "left")
    both = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    ok, missing = met.where(both).select(*edges.columns), met.where(~both).select(*proposed.columns)
    return edges.unionByName(ok).dropDuplicates(["src", "relation", "dst"]), missing


def close_handovers(writes: DataFrame) -> DataFrame:
    """Each write closes its recipient's earlier open ones: status by successor."""
    after = F.lead("handover_id").over(Window.partitionBy("to_agent").orderBy("created_us", "handover_id"))
    closed = after.isNotNull() & (F.col("status") == STATUS_OPEN)
    return writes.withColumn("status", F.when(closed, STATUS_SUPERSEDED).otherwise(F.col("status")))


def latest_handover(handovers: DataFrame) -> DataFrame:
    """The latest write of each recipient, whatever its status."""
    newest = Window.partitionBy("to_agent").orderBy(F.desc("created_us"), F.desc("handover_id"))
    return handovers.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def read_handover(handovers: DataFrame) -> DataFrame:
    """By recipient: the latest write if it is open; a closed latest hides older ones."""
    return latest_handover(handovers).where(F.col("status") == STATUS_OPEN)


def open_handovers(handovers: DataFrame) -> DataFrame:
    """For all recipients: the latest of the open writes, older ones count."""
    return latest_handover(handovers.where(F.col("status") == STATUS_OPEN))


def snapshot_nodes(nodes: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most recent nodes, and whether there were more."""
    top = nodes.orderBy(F.desc("clock"), "id").limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc("clock"), "id"))
    whole = top.withColumn("_n", place).withColumn("capped", F.max("_n").over(Window.partitionBy()) > limit)
    return whole.where(F.col("_n") <= limit).drop("_n")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _packed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task, in order, as numbered compressed pieces, one a batch."""
    for n, batch in enumerate(b for b in batches if b.num_rows):
        text = "\n".join(batch.column("line").to_pylist()).encode()
        yield pa.RecordBatch.from_pydict({"part": batch.column("part")[:1], "n": pa.array([n], pa.int64()), "size": pa.array([len(text)], pa.int64()), "piece": [pa.compress(text, "zstd", asbytes=True)]})


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of all lines joined by line feeds; no row without a line."""
    found, some = hashlib.sha256(), False
    for batch in batches:
        for size, piece in zip(batch.column("size").to_pylist(), batch.column("piece")):
            if some:
                found.update(b"\n")
            found.update(pa.decompress(piece.as_buffer(), size, "zstd"))
            some = True
    if some:
        yield pa.RecordBatch.from_pydict({"digest": [found.hexdigest()]})


def digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SHA-256 of the sorted node lines, of the edge lines, and of both digests.

    Nodes are (label, key, author), edges (src, relation, relation_key, dst,
    author).  Lines are sorted by ranges in parallel.  The format asks for one hash
    over all lines of a kind, so one task a kind reads them; it gets them as
    compressed pieces, of which it sorts the numbers and holds one at a time open.
    ``bucket_digests`` runs in parallel.
    """
    def one(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        line = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
        lines = df.select(line.alias("line")).repartitionByRange("line").sortWithinPartitions("line")
        pieces = lines.select("line", F.spark_partition_id().alias("part")).mapInArrow(_packed_lines, "part int, n long, size long, piece binary")
        return pieces.repartition(1).sortWithinPartitions("part", "n").mapInArrow(_hash_pieces, "digest string").agg(F.max("digest").alias(name))

    both = one(nodes, ["label", "key", "author"], "nodes_digest").crossJoin(one(edges, ["src", "relation", "relation_key", "dst", "author"], "edges_digest"))
    return both.withColumn("graph_digest", F.sha2(F.concat("nodes_digest", "edges_digest"), 256))


def bucket_digests(rows: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """Order-free digests of equal parts of a table: (bucket, rows, total) with
    a sum of 64-bit hashes; two tables agree if all their buckets do."""
    h = F.xxhash64(*columns)
    return rows.select(F.pmod(h, F.lit(buckets)).alias("bucket"), h.cast("decimal(20,0)").alias("h")).groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("h").alias("total"))


def seek(log: DataFrame, limit: int, offset: int | None = None, since_us: int | None = None) -> DataFrame:
    """At most ``limit`` records of each partition from an offset or a time on,
    in order of time, partition and offset."""
    wanted = log
    if offset is not None:
        wanted = wanted.where(F.col("off") >= offset)
    if since_us is not None:
        wanted = wanted.where(F.col("ts_us") >= since_us)
    place = F.row_number().over(Window.partitionBy("part").orderBy("off"))
    return wanted.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n").orderBy("ts_us", "part", "off")


def tail(log: DataFrame, limit: int, since_offset: int | None = None) -> DataFrame:
    """The last ``limit`` records over all partitions, each first cut to its own last ones."""
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("off")))
    last = log.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
    if since_offset is not None:
        last = last.where(F.col("off") >= since_offset)
    return last.orderBy(F.desc("ts_us"), F.desc("part"), F.desc("off")).limit(limit)


def live_edges(log: DataFrame) -> DataFrame:
    """The largest offset of each partition."""
    return log.groupBy("part").agg(F.max("off").alias("live_edge"))


def key_counts(rows: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The k most frequent keys."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def producer_key(wiki: Column, server: Column) -> Column:
    """What an event is keyed by: its wiki, else its server, else ``unknown``."""
    return F.coalesce(F.nullif(wiki, F.lit("")), F.nullif(server, F.lit("")), F.lit("unknown"))


def receipt(rows: DataFrame, key: str, k: int = 8) -> DataFrame:
    """(records, keys, top): what was produced: how many records under how many
    keys, and the ``k`` most frequent of them as (key, n), ties by name."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("keys"))
    first = counts.orderBy(F.desc("n"), key).limit(k)  # k rows
    top = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), F.col(key).alias("key"), "n"))).alias("t"))
    return total.crossJoin(top).select("records", "keys", F.transform("t", lambda x: F.struct(x["key"], x["n"])).alias("top"))


def canonical(records: DataFrame) -> DataFrame:
    """Records in the log's own order: by their ``seq`` (part, off) where they have
    one, else by partition and offset, a missing one counting as 0."""
    zero = F.lit(0)
    part, off = F.coalesce("part", zero), F.coalesce("off", zero)
    if "seq" in records.columns:
        part, off = F.coalesce("seq.part", part), F.coalesce("seq.off", off)
    return records.orderBy(part, off)


def dedup_counts(log: DataFrame) -> DataFrame:
    """By partition: records fetched, offsets surfaced once each, and repeats."""
    surfaced = F.count_distinct("off")
    return log.groupBy("part").agg(F.count("*").alias("fetched"), surfaced.alias("surfaced"), (F.count("*") - surfaced).alias("duplicates"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(extra, missing): rows of ``a`` beyond ``b`` and of ``b`` beyond ``a``, repeats counted."""
    extra = a.exceptAll(b).agg(F.count("*").alias("extra"))
    return extra.crossJoin(b.exceptAll(a).agg(F.count("*").alias("missing")))


def mutation_counts(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(created, matched, kept): keys that an upsert adds, meets and leaves alone."""
    a, b = stored.select(key).distinct().withColumn("old", F.lit(1)), rows.select(key).distinct().withColumn("new", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("old").isNull()).alias("created"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("matched"),
        F.count_if(F.col("new").isNull()).alias("kept"),
    )


def upsert_counted(stored: DataFrame, rows: DataFrame, key: str, keep_first: list[str], path: str) -> dict[str, int]:
    """Write ``stored`` overlaid by ``rows`` to ``path``, as ``merge_nodes`` does, and
    count on the way: created, matched, kept, properties_set (values that the rows
    bring and that stand afterwards) and properties_changed.

    The counts are observed on the rows as they are written; nothing is read twice.
    """
    other = [c for c in stored.columns if c != key]
    a, b = stored.select(key, F.struct(*other).alias("a")), rows.select(key, F.struct(*(F.col(c) if c in rows.columns else F.lit(None).cast(dict(stored.dtypes)[c]).alias(c) for c in other)).alias("b"))
    met = a.join(b, key, "full_outer")

    def value(c: str):
        first, second = (F.col(f"{s}.{c}") for s in ("ab" if c in keep_first else "ba"))
        return F.coalesce(first, second)

    brought = [F.col(f"b.{c}").isNotNull() & (F.col(f"a.{c}").isNull() if c in keep_first else F.lit(True)) for c in other]
    changed = [taken & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c, taken in zip(other, brought)]
    total = lambda flags: F.coalesce(F.sum(sum((x.cast("long") for x in flags), F.lit(0))), F.lit(0))
    seen = Observation()
    counted = met.observe(
        seen, F.count_if(F.col("a").isNull()).alias("created"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"),
        F.count_if(F.col("b").isNull()).alias("kept"), total(brought).alias("properties_set"), total(changed).alias("properties_changed"),
    )
    counted.select(key, *(value(c).alias(c) for c in other)).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def upsert_event_graph(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all edits in log order: an Event, its Actor, Page and
    Case, and the edges actor EDITED event, event ON page, case IMPLICATES event.

    ``edits``: (event_id, actor, page, ts_us, case_id, author).  A node keeps
    the author of its first writer and the clock of its last.
    """
    at = F.struct("ts_us", "event_id")
    named = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    kinds = [("Event", "event_id"), ("Actor", "actor"), ("Page", "page"), ("Case", "case_id")]
    nodes = edits.select(F.explode(F.array(*(F.struct(named(k, c).alias("id"), F.lit(k).alias("label")) for k, c in kinds))).alias("n"), "author", "ts_us", at.alias("at"))
    nodes = nodes.where("n.id is not null").groupBy("n.id", "n.label").agg(F.min_by("author", "at").alias("author"), F.max("ts_us").alias("clock"))
    ends = [("Actor", "actor", "EDITED", "Event", "event_id"), ("Event", "event_id", "ON", "Page", "page"), ("Case", "case_id", "IMPLICATES", "Event", "event_id")]
    made = F.array(*(F.struct(named(k, a).alias("src"), F.lit(r).alias("relation"), named(m, b).alias("dst")) for k, a, r, m, b in ends))
    edges = edits.select(F.explode(made).alias("e")).select("e.*").where("src is not null and dst is not null").distinct()
    return nodes, edges


def remember(stored: DataFrame, rows: DataFrame, nearest: DataFrame | None = None, threshold: float = 0.15) -> DataFrame:
    """``stored`` after an upsert of typed nodes (label, block_type, text, tags,
    metadata, author, ts_us): an id is the hash of label, type and text, so
    what is remembered twice is one node; metadata becomes JSON.

    ``nearest``: (id, distance) of new nodes to the stored ones; those nearer
    than ``threshold`` are left out (the gate is opt-in).
    """
    new = rows.withColumn("id", stable_id("blk", F.col("label"), F.col("block_type"), F.col("text")))
    if nearest is not None:
        new = new.join(nearest.where(F.col("distance") < threshold).select("id"), "id", "left_anti")
    order = F.struct("ts_us", "author")
    new = new.withColumn("metadata_json", encode_map(F.col("metadata"))).groupBy("id").agg(
        F.first("label").alias("label"), F.first("block_type").alias("block_type"), F.first("text").alias("text"),
        *(F.max_by(c, order).alias(c) for c in ("tags", "metadata_json", "author")),
        F.min("ts_us").alias("created_us"), F.max("ts_us").alias("updated_us"),
    )
    return merge_nodes(stored, new.select(*stored.columns), "id", ["created_us"])


#: What ``remember_nodes`` writes of a node, beside its id and label.
REMEMBERED = {
    "text": "string", "summary": "string", "block_type": "string", "metadata_json": "string", "tags": "array<string>", "embedding": "array<float>",
    "ts": "double", "author": "string", "created_us": "bigint", "updated_us": "bigint",
}


def remember_nodes(stored: DataFrame, rows: DataFrame, author: str | None = None, threshold: float | None = None, now_us: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes after, receipt) of rows to remember.

    ``rows`` need ``content`` (of any type) or ``text``; they may have id, label,
    block_type, metadata (map of strings), tags, embedding, ts (seconds), case_id
    and why, each of which may be null.  Without an id a node's is the hash of its
    label, type and text.  Events carry their text as ``summary`` too.  Embedding
    and ``ts`` of a stored node stay unless new ones are given; the rest is
    replaced, but for ``created_us``.  ``author`` stands above the rows' own.  Of
    rows with one id the one with the latest ``ts`` counts, then the greatest text.
    Unknown labels and types raise when the tables are read.

    With ``threshold`` a row with a sound embedding is skipped if a node of its
    label, stored or admitted before it (by ts, then id), is nearer than that.

    Receipt: id, label, block_type, created, skipped, distance, case_id, why.
    Nodes after have all columns of ``stored`` and of ``REMEMBERED``; ``clock``,
    where stored, is a new node's time of creation.
    """
    have = dict(rows.dtypes)
    given = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    content = flat_text(F.col("content"), have["content"]) if "content" in have else F.coalesce(F.col("text"), F.lit(""))
    label = F.coalesce(given("label", "string"), F.lit("Claim"))
    checked = F.when(label.isin(NODE_LABELS), label).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("string"))
    kind, metadata = block_type(given("block_type", "string"), given("metadata", "map<string,string>"))
    now = F.unix_micros(F.current_timestamp()) if now_us is None else now_us
    new = rows.select(
        given("id", "string").alias("given_id"), checked.alias("label"), content.alias("text"), kind.alias("block_type"), encode_map(metadata).alias("metadata_json"),
        F.coalesce(given("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"), given("embedding", "array<float>").alias("embedding"), given("ts", "double").alias("ts"),
        F.coalesce(F.lit(author), given("author", "string")).alias("author"), now.alias("now"), given("case_id", "string").alias("case_id"), given("why", "string").alias("why"),
    )
    made = F.coalesce(F.nullif("given_id", F.lit("")), stable_id("blk", F.col("label"), F.col("block_type"), F.col("text")))
    last = [c for c in new.columns if c not in ("given_id", "label")]
    order = F.struct("ts", "text")
    new = new.withColumn("id", made).groupBy("id", "label").agg(*(F.max_by(c, order).alias(c) for c in last))
    new = written(new.withColumn("summary", F.when(F.col("label") == "Event", F.col("text"))), "remembered")
    said = new.select("id", "label", F.lit(None).cast("double").alias("distance"), F.lit(True).alias("admitted"))
    if threshold is not None:
        asked = new.where(sound_vector(F.col("embedding"))).select("label", "id", "embedding", F.concat(F.lpad(F.coalesce((F.col("ts") * 1e6).cast("decimal(20,0)"), F.lit(0)).cast("string"), 20, "0"), F.lit(":"), "id").alias("place"))
        held = stored.select("label", F.col("embedding").cast("array<float>").alias("embedding"))
        told = gate(asked.select("label", "place", "embedding"), threshold, held, group="label").join(asked.select("label", "place", "id"), ["label", "place"])
        told = told.select("id", "label", F.col("distance").alias("near"), F.col("admitted").alias("passed"))
        said = said.join(told, ["id", "label"], "left").select("id", "label", F.col("near").alias("distance"), F.coalesce("passed", F.lit(True)).alias("admitted"))
        said = written(said, "gated")
    known = stored.select("id", "label").distinct().withColumn("old", F.lit(True))
    receipt = new.join(said, ["id", "label"]).join(known, ["id", "label"], "left").select(
        "id", "label", "block_type", (F.col("admitted") & F.col("old").isNull()).alias("created"), (~F.col("admitted")).alias("skipped"), "distance", "case_id", "why",
    )
    kept = new.join(said.where("admitted").select("id", "label"), ["id", "label"], "left_semi")
    kept = kept.withColumns({"created_us": F.col("now"), "updated_us": F.col("now")})
    if "clock" in stored.columns:
        kept = kept.withColumn("clock", F.col("now").cast(dict(stored.dtypes)["clock"]))
    full = stored.select("*", *(F.lit(None).cast(t).alias(c) for c, t in REMEMBERED.items() if c not in stored.columns))
    types = dict(full.dtypes)
    fit = kept.select(*(F.col(c).cast(types[c]).alias(c) if c in kept.columns else F.lit(None).cast(types[c]).alias(c) for c in full.columns))
    return merge_nodes(full, fit, "id", ["created_us", "clock"]), receipt


def link_case(cases: DataFrame, edges: DataFrame, links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, edges) after linking (case_id, id, why, ts_us): a missing case is
    opened at its first link, nodes must exist, the last reason stands."""
    ok = links.join(nodes.select("id").distinct(), "id", "left_semi")
    opened = ok.groupBy(F.col("case_id").alias("id")).agg(F.lit("open").alias("status"), F.min("ts_us").alias("opened_us"))
    made = ok.groupBy(F.col("case_id").alias("src"), F.lit("IMPLICATES").alias("relation"), F.col("id").alias("dst")).agg(
        F.coalesce(F.max_by("why", "ts_us"), F.lit("remember")).alias("why")
    )
    kept = edges.join(made.select("src", "relation", "dst"), ["src", "relation", "dst"], "left_anti")
    return merge_nodes(cases, opened, "id", ["status", "opened_us"]), kept.unionByName(made)


def project_edges(edges: DataFrame) -> DataFrame:
    """(relation, type, src, dest): an edge's own relation, else its type, else RELATES."""
    relation = F.coalesce(F.nullif("relation", F.lit("")), F.nullif("type", F.lit("")), F.lit("RELATES"))
    return edges.select(relation.alias("relation"), F.coalesce(F.nullif("type", F.lit("")), relation).alias("type"), "src", F.col("dst").alias("dest"))


def project_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes without their embedding, with a ``snippet``: the first of ``keys``
    that is not blank, 180 characters of it, else the id."""
    return nodes.drop("embedding").withColumn("snippet", snippet(*keys, "id"))


def project_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(path_id, ids, labels) of (path_id, place, id) rows: a path's nodes in order.

    With ``edges`` (type, relation, src, dst) also ``relations``: from each node to
    the next ``relation>``, or ``<relation`` where the edge runs the other way; of
    several the least, null where there is none."""
    held = paths.join(nodes.select("id", "label"), "id")
    if edges is not None:
        after = paths.select("path_id", (F.col("place") - 1).alias("place"), F.col("id").alias("next"))
        ways = project_edges(edges).select("relation", "src", "dest")
        both = ways.select(F.col("src").alias("id"), F.col("dest").alias("next"), F.concat("relation", F.lit(">")).alias("way"))
        both = both.union(ways.select("dest", "src", F.concat(F.lit("<"), "relation"))).groupBy("id", "next").agg(F.min("way").alias("way"))
        held = held.join(after, ["path_id", "place"], "left").join(both, ["id", "next"], "left")
    columns = ["place", "id", "label"] + (["way", "next"] if edges is not None else [])
    rows = held.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("n"))
    out = [F.col("n.id").alias("ids"), F.col("n.label").alias("labels")]
    if edges is not None:
        out.append(F.transform(F.filter("n", lambda x: x["next"].isNotNull()), lambda x: x["way"]).alias("relations"))
    return rows.select("path_id", *out)


def write_artifacts(folder: str, **tables: DataFrame) -> None:
    """Each table as JSON lines in a folder of its name, replacing what is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def embedded(texts: DataFrame, cache: DataFrame, kind: str, dim: int = 256) -> tuple[DataFrame, DataFrame]:
    """(texts with ``embedding``, rows to add to the cache): a text is embedded
    once; ``cache`` is (cache_key, embedding), keyed by kind, width and text."""
    key = F.sha2(F.concat_ws("|", F.lit(kind), F.lit(str(dim)), F.coalesce("text", F.lit(""))), 256)
    keyed = texts.withColumn("cache_key", key)
    missing = keyed.select("cache_key", "text").dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    made = missing.select("cache_key", embed(F.col("text"), kind, dim).alias("embedding"))
    return keyed.join(cache.select("cache_key", "embedding").unionByName(made), "cache_key").drop("cache_key"), made
