"""Packing of documents into fixed windows by order-preserving dynamic programming.

Documents keep their order: those of a partition make one stream of token ids
(each document's ids and an end id), and the stream is cut into windows of at
most ``window`` ids.  Candidates for a cut are the ends of documents (free),
ends of sentences (a small penalty) and, inside stretches without either, a
grid of places (a larger penalty for truncation).  The cheapest sequence of
cuts minimises padding plus penalties.  A window whose length is a power of two
is not padded, any other to the whole window.  For every place the best previous
cut within reach comes from a monotone queue, beside the few places that lie a
power of two before it, so a stream of n candidates costs n steps for each power
of two below the window.

A stream is worked off in blocks; the last windows of a block wait for the
next one, so only the last window of a partition is cut short.  A null or
empty text is its end id alone.  Repeated rows are packed each, equal costs go
to the earliest cut.  A null id stays null.  A text of any length is cut as
often as need be; the ids of one text at a time are held whole.  Other columns
are ignored, whatever their names.  An empty table gives none.  Sequence ids
combine the partition and a running number: unique, not gapless.
"""

from __future__ import annotations

import json
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from engram.llm._common import prepare

WINDOW, END_ID = 2048, 1
#: Ids of a block, and those at its end that wait for the next one.
BLOCK, WAIT = 1 << 18, 1 << 14
SENTENCE, TRUNCATED, GRID = 4, 48, 256

# How byte-level tokenizers of this family split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that the faster library is not asked to split.
LONG_SPACE = re.compile(r"\s{10000}")
_PROBE = "It's  a test:\n\t1234 Ünïcödé, don't…\r\n  <|endoftext|> 　x 'll"


def _byte_of_letter() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenIds:
    """Ids of texts as the ``tokenizers`` library gives them for a file.

    For byte-level files the same vocabulary and split are run by the faster
    ``tiktoken``; where a probe or a vocabulary does not agree, ``tokenizers``
    itself encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = _byte_of_letter(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = spec["model"]["vocab"]
        self.sentence_end = np.zeros(max([*vocabulary.values(), *special.values(), END_ID]) + 1, bool)
        if spec["model"].get("type") == "BPE" and all(c in letters for t in vocabulary if t not in special for c in t):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
            if fast.encode(_PROBE, allowed_special="all") == self.slow.encode(_PROBE, add_special_tokens=False).ids:
                self.fast = fast
            for t, i in ranks.items():
                self.sentence_end[i] = b"\n" in t or t.rstrip(b"\"')").endswith((b".", b"!", b"?"))
        else:
            for t, i in vocabulary.items():
                self.sentence_end[i] = t.endswith((".", "!", "?", "\n"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.slow.encode_batch(texts, add_special_tokens=False)]
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[int]:
        """The faster library's split backtracks over runs of white space, and
        gives up on long ones; texts that hold one go to ``tokenizers``."""
        if LONG_SPACE.search(text) is None:
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError:
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


_LOADED: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """The tokenizer of a file, loaded once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]


def exact_starts(at: np.ndarray, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(starts, upto): the indexes of places a power of two below ``window``
    before place j are ``starts[upto[j]:upto[j + 1]]``, ascending."""
    ends, starts = [], []
    for power in range((window - 1).bit_length() - 1, -1, -1):
        wanted = at - (1 << power)
        found = np.searchsorted(at, wanted)
        hit = np.flatnonzero(at[found] == wanted)
        ends.append(hit)
        starts.append(found[hit])
    order = np.argsort(np.concatenate(ends), kind="stable")
    upto = np.searchsorted(np.concatenate(ends)[order], np.arange(len(at) + 1))
    return np.concatenate(starts)[order].tolist(), upto.tolist()


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ends of the cheapest windows.  ``places`` ascend from after 0 to the end
    of the stream, with no gap above ``window``; a window from i to j costs its
    padding, window - (j - i) or, for a power of two, none, and the penalty of a
    cut at j.  Of equal costs the earliest i is taken."""
    at = [0, *places.tolist()]
    pen = [0, *penalty.tolist()]
    starts, upto = exact_starts(np.array(at, np.int64), window)
    n = len(at)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, index), values ascending
    for j in range(1, n):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        c = value + window - here
        for k in starts[upto[j] : upto[j + 1]]:
            if cost[k] < c or (cost[k] == c and k < i):
                c, i = cost[k], k
        cost[j] = c = c + pen[j]
        back[j] = i
        c += here
        while queue and queue[-1][0] > c:
            queue.pop()
        queue.append((c, j))
    ends, j = [], n - 1
    while j > 0:
        ends.append(at[j])
        j = back[j]
    return np.array(ends[::-1], np.int64)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut a stream at, and their penalties."""
    sentences = np.flatnonzero(sentence_end[ids]) + 1
    natural = np.union1d(sentences, doc_ends)
    gaps = np.diff(natural, prepend=0)
    extra = [np.arange(natural[g] - gaps[g] + GRID, natural[g], GRID) for g in np.flatnonzero(gaps > GRID)]
    places = np.union1d(natural, np.concatenate(extra)) if extra else natural
    penalty = np.full(len(places), TRUNCATED)
    penalty[np.isin(places, sentences, assume_unique=True)] = SENTENCE
    penalty[np.isin(places, doc_ends, assume_unique=True)] = 0
    return places, penalty


class Stream:
    """The stream of one partition: takes documents, gives pieces."""

    def __init__(self, tokens: TokenIds, first_sequence: int):
        self.tokens, self.sequence = tokens, first_sequence
        self.ids: list[np.ndarray] = []
        # of each document not yet done: id, its place in the stream, ids before it that are gone, all its ids
        self.docs: list[tuple[int | None, int, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: list[int]) -> None:
        whole = np.array([*ids, END_ID], np.uint32)
        self.ids.append(whole)
        self.docs.append((doc_id, 0, len(whole)))
        self.size += len(whole)

    def pieces(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of all windows that are sure; keeps the rest."""
        if not self.size:
            return None
        ids = np.concatenate(self.ids)
        left = np.array([total - gone for _, gone, total in self.docs], np.int64)
        doc_ends = np.cumsum(left)
        ends = best_cuts(*candidates(ids, doc_ends, self.tokens.sentence_end))
        if not last:
            ends = ends[ends <= len(ids) - WAIT]
        done = int(ends[-1]) if len(ends) else 0
        stops = np.union1d(ends, doc_ends[doc_ends <= done])
        starts = np.concatenate([[0], stops[:-1]])
        window = np.searchsorted(ends, starts, side="right")
        doc = np.searchsorted(doc_ends, starts, side="right")
        gone = np.array([d[1] for d in self.docs], np.int64)
        window_start = np.concatenate([[0], ends])[window] if len(ends) else starts
        offsets = np.concatenate([starts, stops[-1:]]).astype(np.int64) * 4
        batch = None
        if done:
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()),
                    pa.array(starts - (doc_ends - left)[doc] + gone[doc]), pa.array(stops - starts),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary()),
                    pa.array([self.docs[d][2] for d in doc.tolist()], pa.int64()),
                    pa.array(self.sequence + window), pa.array(starts - window_start),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            self.sequence += len(ends)
        first = int(np.searchsorted(doc_ends, done, side="right"))
        used = done - (int(doc_ends[first - 1]) if first else 0)
        self.docs = self.docs[first:]
        if self.docs:
            name, before, total = self.docs[0]
            self.docs[0] = (name, before + used, total)
        self.ids = [ids[done:].copy()]
        self.size = len(self.ids[0])
        return batch


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.
    Partitions are packed where they are read: no shuffle, and a lost task is
    run again alone.
    """
    prepare(docs.sparkSession)

    def run(batches):
        stream = Stream(token_ids(tokenizer), TaskContext.get().partitionId() << 40)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), stream.tokens.encode(texts)):
                stream.add(doc_id, ids)
            if stream.size >= BLOCK and (out := stream.pieces(False)) is not None:
                yield out
        if (out := stream.pieces(True)) is not None:
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packing_report(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` with a digest in place of the ids."""
    return pack(docs, tokenizer, id_col, text_col).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
