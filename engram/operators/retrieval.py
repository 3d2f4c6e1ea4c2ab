"""Retrieval: exact nearest neighbours, lexical hits, fusion, expansion, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from engram.functions.columns import sound_vector
from engram.operators.steps import runs, written

#: Vectors and queries that meet in one task.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _closest(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the k nearest of each query, with those that tie with the k-th."""
    distance = np.round(1 - q @ v.T, 9)
    distance[q_ids[:, None] == v_ids[None, :]] = np.inf
    some = min(k, len(v_ids))
    kth = np.partition(distance, some - 1, axis=1)[:, some - 1]
    a, b = np.nonzero((distance <= kth[:, None]) & (distance < np.inf))
    return a, b, distance[a, b]


def _hits(q_ids: np.ndarray, v_ids: np.ndarray, found: tuple, kind: pa.DataType) -> pa.Table:
    a, b, distance = found
    return pa.table({"query_id": pa.array(q_ids[a].tolist(), kind), "vec_id": pa.array(v_ids[b].tolist(), kind), "distance": pa.array(distance, pa.float64())})


def _block_best(table: pa.Table, k: int) -> pa.Table:
    """The k nearest vectors of a block for each query of a block."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    ids, kind = np.array(table.column("id").to_pylist()), table.schema.field("id").type
    if asks.all() or not asks.any():
        return _hits(ids, ids, (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), kind)
    x = unit_rows(matrix(table.column("v")))
    return _hits(ids[asks], ids[~asks], _closest(ids[asks], x[asks], ids[~asks], x[~asks], k), kind)


def _scan_best(asked: pa.Table, k: int):
    """For a few queries: what is nearest to each in a partition, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, widths = np.array(asked.column("id").to_pylist()), np.array(asked.column("width").to_pylist())
        by_width = {w: (q_ids[widths == w], unit_rows(matrix(asked.filter(pa.array(widths == w)).column("v")))) for w in set(widths.tolist())}
        kind, held = asked.schema.field("id").type, []

        def cut() -> pa.Table:
            every = pa.concat_tables(held).sort_by([("query_id", "ascending"), ("distance", "ascending"), ("vec_id", "ascending")])
            ids = np.array(every.column("query_id").to_pylist())
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            return every.filter(pa.array(place < k))

        for batch in batches:
            width = batch.column("width").to_numpy(zero_copy_only=False)
            for w in set(width.tolist()) & set(by_width):
                some = batch.filter(pa.array(width == w))
                v_ids, v = np.array(some.column("id").to_pylist()), unit_rows(matrix(some.column("v")))
                own, q = by_width[w]
                held.append(_hits(own, v_ids, _closest(own, q, v_ids, v, k), kind))
            if sum(map(len, held)) > 4 * k * len(q_ids):
                held[:] = [cut()]
        if held and sum(map(len, held)):
            yield from cut().combine_chunks().to_batches()

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance, rank): exact cosine neighbours of a stated
    set of queries among all vectors of their width, a query's own id left out.

    Vectors without a direction (null, zero, or with a component that is null or
    not finite) neither ask nor are found.  Up to QUERY_BLOCK queries are handed
    to every task, which reads its vectors where they are and passes k rows a
    query on.  More queries meet the vectors block by block, one matrix product
    each; what a task holds is bounded either way.
    """
    def sound(df: DataFrame) -> DataFrame:
        return df.where(sound_vector(F.col("embedding"))).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("width"))

    asking, found = sound(queries), sound(vectors)
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"query_id {kind}, vec_id {kind}, distance double"
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    few = asking.limit(QUERY_BLOCK + 1).toArrow()
    if len(few) <= QUERY_BLOCK:
        best = found.mapInArrow(_scan_best(few, k), schema)
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    v_blocks, q_blocks = (max(1, -(-t.count() // n)) for t, n in ((found, VECTOR_BLOCK), (asking, QUERY_BLOCK)))

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        own, other = (q_blocks, v_blocks) if asks else (v_blocks, q_blocks)
        mine, theirs = F.pmod(F.xxhash64("id"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        rows = df.select("*", F.lit(asks).alias("asks"), mine.alias("mine"), theirs.alias("theirs"))
        qb, vb = ("mine", "theirs") if asks else ("theirs", "mine")
        return rows.select("id", "v", "width", "asks", F.col(qb).cast("int").alias("qb"), F.col(vb).cast("int").alias("vb"))

    best = dealt(asking, True).union(dealt(found, False)).groupBy("width", "qb", "vb").applyInArrow(lambda t: _block_best(t, k), schema)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _within(k: int):
    """Of each question's part: the k of its vectors most like the question's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["question_id", "part"]):
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            if asks.all() or not asks.any():
                continue
            x = unit_rows(matrix(table.column("v")))
            likeness = np.round(x[~asks] @ x[asks][0], 9)
            own = table.filter(pa.array(~asks)).select(["question_id", "chunk_id"]).append_column("similarity", pa.array(likeness))
            yield from own.sort_by([("similarity", "descending"), ("chunk_id", "ascending")]).slice(0, k).combine_chunks().to_batches()

    return run


def nearest_within(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, similarity, place): of each question's own chunks the
    ``k`` most like it by cosine, ties to the smaller chunk id.

    ``questions``: (question_id, embedding), one row each; ``chunks``:
    (question_id, chunk_id, embedding).  A question meets its chunks where they are
    dealt to; one of many chunks is dealt to several tasks by parts of VECTOR_BLOCK,
    each of which passes ``k`` rows on.  Vectors without a direction, or of another
    width than the question's, are left out.
    """
    def sound(df: DataFrame, *columns) -> DataFrame:
        return df.where(sound_vector(F.col("embedding"))).select(*columns, F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("width"))

    asked, held = sound(questions, "question_id"), sound(chunks, "question_id", "chunk_id")
    asked = written(asked.join(held.groupBy("question_id", "width").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("parts")), ["question_id", "width"]), "asked")
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
    own = held.join(asked.select("question_id", "width", "parts"), ["question_id", "width"]).select("question_id", part.alias("part"), F.lit(False).alias("asks"), "chunk_id", "v")
    each = asked.select("question_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), F.lit(None).cast(dict(chunks.dtypes)["chunk_id"]).alias("chunk_id"), "v")
    dealt = own.union(each).repartition("question_id", "part").sortWithinPartitions("question_id", "part")
    kinds = dict(own.dtypes)
    best = dealt.mapInArrow(_within(k), f"question_id {kinds['question_id']}, chunk_id {kinds['chunk_id']}, similarity double")
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "chunk_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def served_chunks(questions: DataFrame, chunks: DataFrame, k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(blocks, served) of the plain arm: each question's ``k`` chunks most like it.

    ``chunks``: (question_id, session_id, start, chunk, embedding).  Blocks are
    (question_id, place, session_id, start, similarity, session_rank), sessions
    ranked by their first block; served are (question_id, context, session_ids):
    the blocks as numbered texts, and the sessions in order of rank.
    """
    named = chunks.withColumn("chunk_id", F.struct("session_id", "start"))
    found = nearest_within(questions, named, k).select("question_id", "place", "chunk_id.session_id", "chunk_id.start", "similarity")
    first = found.withColumn("first", F.min("place").over(Window.partitionBy("question_id", "session_id")))
    blocks = written(first.withColumn("session_rank", F.dense_rank().over(Window.partitionBy("question_id").orderBy("first"))).drop("first"), "blocks")
    lines = F.array_join(F.transform(F.split("chunk", r"\r\n|[\n\r]"), lambda x: F.concat(F.lit("    "), x)), "\n")
    text = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] session "), F.col("session_id").cast("string"), F.lit("\n"), lines)
    told = blocks.join(chunks.select("question_id", "session_id", "start", "chunk"), ["question_id", "session_id", "start"])
    sessions = F.array_sort(F.collect_set(F.struct("session_rank", "session_id")))  # k at most
    served = told.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))).alias("b"), sessions.alias("s"))
    return blocks, served.select("question_id", F.array_join(F.col("b.text"), "\n").alias("context"), F.col("s.session_id").alias("session_ids"))


def term_hits(docs: DataFrame, terms: DataFrame, k: int | None) -> DataFrame:
    """(query_id, doc_id, hits, held, rank): documents by the number of a query's
    terms they hold; ``held`` is the number of distinct words of a document.

    Terms are written first, so that Spark knows their size: while they are few,
    words meet them where they are read."""
    terms = written(terms, "terms")
    every = F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")), " "))
    # explode_outer: before a plain explode Spark tests the array for rows, which works it out twice more
    words = docs.select("doc_id", every.alias("every")).select("doc_id", F.size("every").alias("held"), F.explode_outer("every").alias("term"))
    found = words.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.first("held").alias("held"))
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def fuse_ranks(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, id, rank from 1) lists."""
    union = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", "id", "rank"))
    scored = union.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def expand(seeds: DataFrame, mentions: DataFrame, fanout: int) -> DataFrame:
    """(seed neighbours) nodes that share entities with the seeds: (id, shared),
    counted over all seeds and entities, a seed's pairs with itself left out.

    Seeds are counted by entity before the join, so an entity of many nodes
    makes one row a mention, not one a pair.
    """
    own = mentions.join(seeds.select("id").distinct(), "id", "left_semi").groupBy("id", "entity").agg(F.count("*").alias("own"))
    per = own.groupBy("entity").agg(F.sum("own").alias("every"))
    pairs = mentions.join(per, "entity").join(own, ["id", "entity"], "left")
    shared = F.sum(F.col("every") - F.coalesce("own", F.lit(0)))
    return pairs.groupBy("id").agg(shared.alias("shared")).where("shared > 0").orderBy(F.desc("shared"), "id").limit(fanout)


def coverage(terms: DataFrame, held: DataFrame) -> DataFrame:
    """(item_id, asked, present, missing) of (item_id, term) against (term, held)."""
    found = terms.join(held, "term", "left")
    missing = F.array_join(F.sort_array(F.collect_list(F.when(F.col("held").isNull(), F.col("term")))), "|")
    return found.groupBy("item_id").agg(F.count("*").alias("asked"), F.count("held").alias("present"), missing.alias("missing"))


def turn_chunks(turns: DataFrame, window: int = 4, stride: int = 2) -> DataFrame:
    """Windows of ``window`` turns, each a line ``role: text``, every ``stride``;
    the last one reaches the end."""
    n = F.count("*").over(Window.partitionBy("conv_id"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    ahead = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, window - 1)
    whole = turns.withColumn("n", n).withColumn("start", place)
    whole = whole.withColumn("n_turns", F.count("*").over(ahead)).withColumn("chunk", F.array_join(F.collect_list(F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))).over(ahead), "\n"))
    first = (F.col("start") % stride == 0) & ((F.col("start") == 0) | (F.col("start") - stride + window < F.col("n")))
    return whole.where(first).select("conv_id", "start", "n_turns", "chunk")


def temporal_window(claims: DataFrame, low: int | None, high: int | None, k: int) -> DataFrame:
    """The earliest ``k`` claims within bounds; a missing bound is open."""
    wanted = claims.where("valid_us is not null")
    if low is not None:
        wanted = wanted.where(F.col("valid_us") >= low)
    if high is not None:
        wanted = wanted.where(F.col("valid_us") <= high)
    return wanted.orderBy("valid_us", "id").limit(k)


# Patterns of a question's features.
TEMPORAL = (
    r"\b(when|how long|how many (?:days|weeks|months|years|hours)|before|after|since|until|earlier|later|first|last|latest|most recent|recently|ago|during|between|"
    r"january|february|march|april|may|june|july|august|september|october|november|december|yesterday|today|tomorrow|week|month|year|date|time)\b"
)
EXPLICIT_DATE = r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\b\d{4}\b)"
PREFERENCE = (
    r"\b(prefer|preference|recommend|recommendation|suggest|should i|would i (?:like|enjoy|prefer)|favorite|favourite|like better|best (?:for|option|choice)|"
    r"pick|choose|advice|what would (?:i|you) (?:want|like|enjoy)|tailor|personali[sz]ed)\b"
)
SUPERLATIVE = r"\b(most|least|best|worst|biggest|smallest|highest|lowest|top)\b"
UPDATE = r"\b(now|currently|these days|still|any ?more|changed|switch(?:ed)?|new|latest|updated|no longer|instead)\b"
# Fields of the gold answer, which no feature may be named after.
GOLD_FIELDS = ["question_type", "answer", "answer_session_ids", "has_answer", "gold", "gold_session_ids", "is_abstention"]


def route(question: Column) -> dict[str, Column]:
    """Features of a question's text alone; a null text counts as empty."""
    text = F.coalesce(question, F.lit(""))
    found = {
        name: text.rlike(f"(?i){pattern}")
        for name, pattern in (("temporal", TEMPORAL), ("has_explicit_date", EXPLICIT_DATE), ("preference", PREFERENCE), ("superlative", SUPERLATIVE), ("update", UPDATE))
    }
    found["n_tokens"] = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    if leaked := [name for name in found if name in GOLD_FIELDS]:
        raise ValueError(f"a router may not read {leaked}")
    return found


def recall_of_first(rows: DataFrame, group: str, order: str, gold: str, k: int) -> DataFrame:
    """(group, recall_k): share of a group's gold rows whose ``order`` is among its first ``k`` rows.

    The first rows are cut before the shuffle and gold rows are only counted,
    so no group is held.  A value counts once among the hits however often it
    stands in the first rows; nulls rank last and are no gold.
    """
    is_gold = F.coalesce(F.col(gold), F.lit(False)) & F.col(order).isNotNull()
    total = rows.groupBy(group).agg(F.count_if(is_gold).alias("_gold"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).asc_nulls_last()))
    first = rows.where(F.col(order).isNotNull()).select(group, order).withColumn("_n", place).where(F.col("_n") <= k).select(group, order).distinct()
    golden = rows.where(is_gold).select(F.col(group).alias("_group"), F.col(order).alias("_order")).distinct()
    hits = first.join(golden, F.col(group).eqNullSafe(F.col("_group")) & (F.col(order) == F.col("_order"))).groupBy(F.col(group).alias("_hit_group")).agg(F.count("*").alias("_hits"))
    share = F.coalesce("_hits", F.lit(0)) / F.col("_gold")
    return total.join(hits, F.col(group).eqNullSafe(F.col("_hit_group")), "left").select(group, F.when(F.col("_gold") > 0, share).otherwise(0.0).alias(f"recall_{k}"))
