"""Line deduplication by a deletion-neighbourhood join.

A line occurrence is dropped when its text stood before, or when a line that
stands earlier lies within the edit bound of both: one edit (one character
inserted, deleted or changed) for lines of at least ``least`` characters, none
for shorter ones, in which one character says too much.  Earliest is the order of doc_id (nulls last), then of the text's hash, then of the line
number; the place of a line's text is its first occurrence.

Lines are compared after trimming and lower-casing A-Z; blank lines are kept.
Two lines one edit apart agree outside one of 2 (or 16) equal segments, so
only lines that share their first or last half with another line, and of
those the ones that share all but one sixteenth, go on (exact filters, which
keep every such pair).  Each of those emits its variants with one character deleted, as (hash, place) keys,
and its own hash as the key of a shorter partner.  Lines with an equal
variant at one place differ by one substitution; a line and its own variant
by one insertion.  Every member of a key is compared with the key's earliest
line only: all pairs are never made.  Candidates are verified by Levenshtein
distance on the texts.

A null text has no lines and stays null.  Rows that repeat doc_id and text
are one document.  Documents all of whose non-blank lines were dropped are
not kept; documents without a non-blank line are.  Texts of any length are
read whole, in time in proportion to it.  Other columns pass through, whatever
their names.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from engram.llm._common import discard, materialize, prepare
from engram.llm._text import LOWER, SLICE, buffers, mix

#: Characters of a line for one edit to be within its bound.
LEAST = 16
#: Segments of the finer filter.
FINE = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = _INVERSES = np.zeros(0, np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
#: Two independent values of a character: what is added before mixing, and a table for ASCII.
_CHARACTERS = [(np.uint64(salt), mix(np.arange(256, dtype=np.uint64) + np.uint64(salt))) for salt in (1 << 40, 3 << 41)]


def normal(line: Column) -> Column:
    """Trimmed of blanks and tabs and carriage returns, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(" \t\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def deletion_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a line with each of its characters deleted, and the places.

    A polynomial hash modulo 2^64: deleting a character divides what follows
    by the base, so all variants cost one pass.  The last key, with place -1,
    is the whole line's own hash; a shorter partner's variants meet it there.
    """
    c = mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    with np.errstate(over="ignore"):
        value = c * np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(len(c) - 1, 0), _BASE, np.uint64))])[: len(c)]
        upto = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        total = upto[-1]
        gone = upto[:-1] + (total - upto[1:]) * _INVERSE
        n = np.uint64(len(c))
        return mix(np.append(gone + (n - np.uint64(1)) * _BASE, total + n * _BASE)), np.append(np.arange(len(c)), -1)


def _growing(table: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    if len(table) >= n:
        return table
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, SLICE) + 1, base, np.uint64))])


def hashed_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """Lines of a byte buffer, trimmed, as prefix sums of two polynomial hashes.

    Yields (which, first byte, sums 1, sums 2, a, b) for runs of about half a MB of
    neighbouring lines: line ``which[j]`` is characters a[j] to b[j] of the
    run.  Blank lines are left out.  A line longer than a run is one by itself.
    """
    global _POWERS, _INVERSES
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = LOWER[data[lo:hi]]
        solid = np.flatnonzero(~_BLANK[part])
        first, last = np.searchsorted(solid, starts[i:j] - lo), np.searchsorted(solid, ends[i:j] - lo)
        which = np.flatnonzero(last > first)
        if len(which):
            a, b = solid[first[which]], solid[last[which] - 1] + 1
            if part.max() < 128:
                value, at_a, at_b = part, a, b
            else:  # a character is a lead byte with what continues it
                lead = (part & 0xC0) != 0x80
                lead[a] = True
                at = np.flatnonzero(lead)
                more = np.concatenate([part, np.zeros(3, np.uint8)]).astype(np.uint64)
                value, goes = more[at].copy(), np.ones(len(at), bool)
                for k in (1, 2, 3):
                    goes &= (more[at + k] & np.uint64(0xC0)) == 0x80
                    value |= np.where(goes, more[at + k] << np.uint64(8 * k), np.uint64(0))
                at_a, at_b = np.searchsorted(at, a), np.searchsorted(at, b)
            _POWERS, _INVERSES = _growing(_POWERS, _BASE, len(value)), _growing(_INVERSES, _INVERSE, len(value))
            sums = []
            for salt, ascii_values in _CHARACTERS:
                known = ascii_values[value] if value.dtype == np.uint8 else mix(value + salt)
                with np.errstate(over="ignore"):
                    sums.append(np.concatenate([[np.uint64(0)], np.cumsum(known * _POWERS[: len(known)], dtype=np.uint64)]))
            yield which + i, lo, *sums, at_a, at_b
        i = j


def _span(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (sums[b] - sums[a]) * _INVERSES[a]


def segment_keys(sums: np.ndarray, a: np.ndarray, b: np.ndarray, segments: int) -> np.ndarray:
    """[lines, 2 * segments] hashes of lines without one of their segments, for
    partners at least as long (m = n) and for those one shorter (m = n - 1):
    an edit within segment i of the shorter leaves what stands before and
    after that segment."""
    n, keys = b - a, []
    for m in (n, n - 1):
        for i in range(segments):
            low, rest = m * i // segments, m - m * (i + 1) // segments
            with np.errstate(over="ignore"):
                left = mix(_span(sums, a, a + low) + (low * segments + i).astype(np.uint64) * _BASE)
                keys.append(mix(left + _span(sums, b - rest, b) * _INVERSE + rest.astype(np.uint64)))
    return np.stack(keys, axis=1).view(np.int64)


def _line_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text, number) of all lines of the texts, blank ones too."""
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, at)
    count = np.diff(before) + 1
    text = np.repeat(np.arange(len(at) - 1), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    starts, ends = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    opens = number == 0
    starts[opens], starts[~opens] = at[:-1], breaks + 1
    closes = np.append(opens[1:], True)[: len(opens)]
    ends[closes], ends[~closes] = at[1:], breaks
    return starts, ends, text, number


def scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text_hash, text) rows to one row a line that is not blank."""
    for batch in batches:
        data, at = buffers(batch.column(2))
        starts, ends, text, number = _line_bounds(data, at)
        for which, _, one, two, a, b in hashed_slices(data, starts, ends):
            n = b - a
            with np.errstate(over="ignore"):
                h1, h2 = (mix(_span(s, a, b) + n.astype(np.uint64) * _BASE).view(np.int64) for s in (one, two))
            rows = pa.array(text[which])
            parts = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number[which].astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(n.astype(np.int32))]
            halves = segment_keys(one, a, b, 2)
            yield pa.RecordBatch.from_arrays([*parts, *(pa.array(halves[:, i]) for i in range(4))], ["id", "text_hash", "number", "h1", "h2", "n", "s0", "s1", "s2", "s3"])


def _fine_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, line) rows to (h1, h2, key) rows of the finer filter."""
    for batch in batches:
        data, at = buffers(batch.column(2))
        for which, _, one, _, a, b in hashed_slices(data, at[:-1], at[1:]):
            keys = segment_keys(one, a, b, FINE)
            rows = pa.array(np.repeat(which, keys.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keys.ravel())], ["h1", "h2", "key"])


def _count_lines(column: pa.Array) -> pa.Array:
    """Lines of each text that are not blank."""
    data, at = buffers(column)
    solid = np.flatnonzero(~_BLANK[data])
    line = np.searchsorted(np.flatnonzero(data == 10), solid)
    opens = np.ones(len(solid), bool)
    opens[1:] = line[1:] != line[:-1]
    begin = np.searchsorted(solid, at)
    opens[begin[begin < len(solid)]] = True  # a text's first line is its own
    upto = np.concatenate([[0], np.cumsum(opens)])
    return pa.array(np.diff(upto[begin]), pa.int64())


def _pick_lines(texts: pa.Array, numbers: pa.Array) -> pa.Array:
    """Normal forms of the lines of each text with the given numbers."""
    picked = []
    for text, wanted in zip(texts.to_pylist(), numbers.to_pylist()):
        lines = text.split("\n")
        picked.append([lines[n].strip(" \t\r").encode().lower().decode() for n in wanted])
    return pa.array(picked, pa.list_(pa.string()))


def _rebuild(texts: pa.Array, kept: pa.Array) -> pa.Array:
    """Each text with the kept lines and its blank ones."""
    built = []
    for text, numbers in zip(texts.to_pylist(), kept.to_pylist()):
        wanted = set(numbers or ())
        built.append("\n".join(x for n, x in enumerate(text.split("\n")) if n in wanted or not x.strip(" \t\r")))
    return pa.array(built, pa.string())


def sharing(keyed: DataFrame) -> DataFrame:
    """Of (h1, h2, key) rows the lines that share a key with another line."""
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("key")
    return keyed.join(shared, "key").select("h1", "h2").distinct()


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, line) rows to (rank, key, place) rows: a line's variants by the
    place of the missing character, and itself with place -1."""
    for batch in batches:
        for rank, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys, places = deletion_keys(line)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), rank)), pa.array(keys.view(np.int64)), pa.array(places.astype(np.int32))], ["rank", "key", "place"])


def near_lines(first: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2) of the lines with an earlier line one edit away.

    ``first``: (h1, h2, at, n, s0 to s3) per distinct line; ``texts``: a function
    of (h1, h2, at) rows that adds their ``line``.
    """
    halves = first.where(F.col("n") >= least).select("h1", "h2", F.explode(F.array_distinct(F.array("s0", "s1", "s2", "s3"))).alias("key"))
    suspects = sharing(halves).join(first.select("h1", "h2", "at"), ["h1", "h2"])
    wanted = materialize(suspects, "suspects")
    coarse = materialize(texts(wanted), "suspect-lines")
    discard(wanted)
    finer = coarse.select("h1", "h2", "line").mapInArrow(_fine_keys, "h1 long, h2 long, key long").distinct()
    ranked = coarse.join(sharing(finer), ["h1", "h2"]).orderBy("at").withColumn("rank", F.monotonically_increasing_id())
    lines = materialize(ranked.drop("at"), "ranked-lines")
    discard(coarse)

    made = materialize(lines.select("rank", "line").mapInArrow(_variants, "rank long, key long, place int"), "variants")
    # substitutions: variants equal in hash and place; all members are one edit apart
    changed = made.where("place >= 0")
    heads = changed.groupBy("key", "place").agg(F.min("rank").alias("early"), F.max("rank").alias("last")).where("early < last").drop("last")
    pairs = changed.join(heads, ["key", "place"]).where("rank > early").select(F.col("rank").alias("late"), "early")
    # insertions: a longer line's variant is a shorter line; that line is one text
    short = made.where("place = -1").select("key", F.col("rank").alias("short"))
    longer = changed.join(short, "key").select(F.greatest("rank", "short").alias("late"), F.least("rank", "short").alias("early"))
    pairs = materialize(pairs.union(longer).distinct(), "line-pairs")
    discard(made)
    one = lines.select("h1", "h2", F.col("rank").alias("late"), F.col("line").alias("one"))
    two = lines.select(F.col("rank").alias("early"), F.col("line").alias("two"))
    checked = pairs.join(one, "late").join(two, "early").where(F.levenshtein("one", "two", 1).between(0, 1))
    return checked.select("h1", "h2").distinct()


def kept_lines(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(id, text_hash, lines): the numbers of the lines each document keeps
    besides its blank ones; documents that keep none are missing."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    schema = "id long, text_hash long, number int, h1 long, h2 long, n int, s0 long, s1 long, s2 long, s3 long"
    lines = keyed.where("text <> ''").select("id", "text_hash", "text").mapInArrow(scan_lines, schema)
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "number").alias("at")
    hashed = lines.select("h1", "h2", at, "n", "s0", "s1", "s2", "s3")
    same = [F.first(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3")]
    first = materialize(hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), *same), "first-lines")

    def texts(suspects: DataFrame) -> DataFrame:
        wanted = suspects.select(
            F.col("at.id").alias("want_id"), F.col("at.text_hash").alias("want_hash"), F.struct("h1", "h2", "at").alias("w")
        ).groupBy("want_id", "want_hash").agg(F.collect_list("w").alias("ws"))  # at most one document's lines
        found = keyed.join(wanted, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("text_hash") == F.col("want_hash")))
        lines = arrow_udf(_pick_lines, "array<string>")("text", F.transform("ws", lambda w: w["at"]["number"]))
        found = found.select(F.explode(F.arrays_zip(F.col("ws"), lines.alias("line"))).alias("w"))
        return found.select("w.ws.h1", "w.ws.h2", "w.ws.at", "w.line").dropDuplicates(["h1", "h2"])

    near = near_lines(first, texts, least)
    kept = first.select("h1", "h2", "at").join(near, ["h1", "h2"], "left_anti")
    return kept.groupBy("at.id", "at.text_hash").agg(F.collect_list("at.number").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts.

    Documents left without a line go; columns and other values stay.
    """
    kept = materialize(kept_lines(docs, id_col, text_col, least), "kept-lines")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("row_id"), F.xxhash64(text).alias("row_hash"))
    joined = rows.join(kept, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    text = F.col(f"row.`{text_col}`").cast("string")
    blank = F.coalesce(~text.rlike(r"[^ \t\r\n]"), F.lit(True))
    rebuilt = joined.where(blank | F.col("lines").isNotNull()).withColumn(
        "left", arrow_udf(_rebuild, "string")(F.coalesce(text, F.lit("")), F.col("lines"))
    )
    left = F.when(blank, text).otherwise(F.col("left"))
    return rebuilt.select(*((left.alias(c) if c == text_col else F.col(f"row.`{c}`")) for c in docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col, n_lines, n_kept, kept): non-blank lines, those kept, and
    whether the document stays."""
    kept = kept_lines(docs, id_col, text_col, least).select(F.col("id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"), F.size("lines").alias("_n"))
    kept = materialize(kept, "kept-counts")
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"),
        arrow_udf(_count_lines, "long")(F.coalesce(text, F.lit(""))).alias("n_lines"),
    )
    joined = rows.join(kept, F.col("id").eqNullSafe(F.col("_kept_id")) & (F.col("hash") == F.col("_kept_hash")), "left")
    return joined.select(
        F.col("id").alias(id_col), "n_lines", F.coalesce("_n", F.lit(0)).cast("long").alias("n_kept"),
        ((F.col("n_lines") == 0) | F.col("_n").isNotNull()).alias("kept"),
    )
