"""How five document filters interact, in every order they can be applied in.

A document fails filter A below 50 words; B where 100 * distinct words < 65 *
words; C where 100 * capitals A-Z > 5 * code points; D with any of ``#$%&*|``;
E where a smaller doc_id of the whole table has the same text.  Words are
maximal ``[^\\x20\\x09-\\x0D]+``.

Documents come down to counts by (part, failure mask), 32 masks a part at most.
A part's counts become a decision diagram with one level a filter, whose leaves
and inner nodes carry counts; adjacent levels are swapped from one order to the
next, and the all-pass path of each order gives its five steps.

Awkward rows: a null text is empty; a null source is the part ``''``, like an
empty one; of a text under null and other ids the null ones fail E, under null
ids alone none does; rows that repeat id and text are each a document, none the
smaller one of the other.  Of several label rows of an id one with the value 1
is enough; labels of null ids count for nothing.  No documents give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.llm._common import materialize, prepare
from engram.llm._text import buffers

FILTERS = "ABCDE"
#: A long text's words are counted in pieces of about so many bytes.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_SIGN = bytes(b for b in range(256) if b not in b"#$%&*|")
_NOT_FIRST = bytes(range(0x80, 0xC0))

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words), holding one piece and the distinct words."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_mask(text: bytes) -> int:
    """Bit i: the text fails filter i of A to D."""
    words, distinct = word_counts(text)
    capitals, points = len(text.translate(None, _NOT_CAPITAL)), len(text.translate(None, _NOT_FIRST))
    fails = (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, bool(text.translate(None, _NOT_SIGN)))
    return sum(1 << i for i, f in enumerate(fails) if f)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch.column("text"))
        masks, digests = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            text = data[a:b].tobytes()
            masks.append(text_mask(text))
            digests.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            ["doc_id", "part", "mask", "digest"],
        )


def failure_masks(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every document, bit i for filter i of A to E.

    Texts stay where they are read; what moves is a digest a document.  The
    first of equal texts is found by a minimum with map-side combine, and met
    again by (digest, doc_id), so that a text of any number of copies makes no
    hot key.
    """
    prepare(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text"))
    kind = dict(rows.dtypes)["doc_id"]
    masked = materialize(rows.mapInArrow(_masked, f"doc_id {kind}, part string, mask int, digest binary"), "masks")
    first = masked.groupBy("digest").agg(F.min("doc_id").alias("first"))
    first = first.select(F.col("digest").alias("of"), "first", F.lit(True).alias("leads"))
    met = masked.join(first, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    return met.select("doc_id", "part", F.when(F.col("leads"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents, those of quality 1, those of toxic 1."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = masks.join(marks, "doc_id", "left")
    return known.groupBy("part", "mask").agg(
        F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


class Diagram:
    """A count-weighted decision diagram over failure masks.

    A node is a level's number, or a leaf; ``low`` is where its filter passes,
    ``high`` where it fails, and 0 stands for a branch without documents.  Equal
    nodes are one node.  ``order[level]`` is the filter tested there.
    """

    def __init__(self, counts: dict[int, tuple[int, int, int]], width: int):
        self.order = list(range(width))
        self.low, self.high, self.total = [0], [0], [(0, 0, 0)]
        self._known: dict[tuple, int] = {}
        self.root = self._build(counts, 0)

    def _node(self, level: int, low: int, high: int) -> int:
        if not (low or high):
            return 0
        key = (level, low, high)
        if key not in self._known:
            self._known[key] = self._add(low, high, tuple(x + y for x, y in zip(self.total[low], self.total[high])))
        return self._known[key]

    def _add(self, low: int, high: int, total: tuple[int, int, int]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.total.append(total)
        return len(self.total) - 1

    def _build(self, counts: dict[int, tuple[int, int, int]], level: int) -> int:
        if not counts:
            return 0
        if level == len(self.order):
            (total,) = counts.values()
            key = (level, *total, "leaf")
            if key not in self._known:
                self._known[key] = self._add(0, 0, total)
            return self._known[key]
        sides = [{m: c for m, c in counts.items() if m >> level & 1 == side} for side in (0, 1)]
        return self._node(level, self._build(sides[0], level + 1), self._build(sides[1], level + 1))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next: below each of the
        upper nodes the two middle grandchildren change places; all other
        nodes stay as they are."""
        made: dict[int, int] = {}

        def below(node: int) -> int:
            if node and node not in made:
                low, high = self.low[node], self.high[node]
                passed = self._node(level + 1, self.low[low], self.low[high])
                failed = self._node(level + 1, self.high[low], self.high[high])
                made[node] = self._node(level, passed, failed)
            return made.get(node, 0)

        def above(node: int, at: int) -> int:
            if not node or at == level:
                return below(node)
            return self._node(at, above(self.low[node], at + 1), above(self.high[node], at + 1))

        self.root = above(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> Iterator[tuple[int, tuple[int, int, int], tuple[int, int, int]]]:
        """(filter, counts kept, counts removed) down the path on which all pass."""
        node = self.root
        for f in self.order:
            yield f, self.total[self.low[node]], self.total[self.high[node]]
            node = self.low[node]


def plain_changes(width: int) -> Iterator[int]:
    """Levels to swap so that every order comes once: the largest movable
    element moves each time, and turns those larger round."""
    row, way = list(range(width)), [-1] * width
    while True:
        free = [x for x in range(width) if 0 <= (to := row.index(x) + way[x]) < width and row[to] < x]
        if not free:
            return
        x = max(free)
        at = row.index(x)
        to = at + way[x]
        row[at], row[to] = row[to], row[at]
        for y in range(x + 1, width):
            way[y] = -way[y]
        yield min(at, to)


def part_steps(counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of all orders, from one part's counts by mask."""
    width = len(FILTERS)
    diagram = Diagram(counts, width)
    paths = {tuple(diagram.order): list(diagram.all_pass())}
    for level in plain_changes(width):
        diagram.swap(level)
        paths[tuple(diagram.order)] = list(diagram.all_pass())
    fails, alone, share = [0] * width, [0] * width, [0] * width
    for path in paths.values():
        for step, (f, _, removed) in enumerate(path):
            share[f] += removed[0]
            if step == 0:
                fails[f] = removed[0]
            if step == width - 1:
                alone[f] = removed[0]
    return [
        ("".join(FILTERS[f] for f in order), step + 1, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], share[f])
        for order, path in paths.items()
        for step, (f, kept, removed) in enumerate(path)
    ]


def _part_rows(group: pd.DataFrame) -> pd.DataFrame:
    """One part: at most 32 rows in, 600 out."""
    counts = {int(m): (int(d), int(g), int(t)) for m, d, g, t in zip(group["mask"], group["docs"], group["good"], group["toxic"])}
    out = pd.DataFrame(part_steps(counts), columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    out.insert(0, "part", group["part"].iloc[0])
    return out


def filter_interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter order and step (columns of ``STEPS``)."""
    counts = mask_counts(failure_masks(documents), labels)
    return counts.groupBy("part").applyInPandas(_part_rows, STEPS)
