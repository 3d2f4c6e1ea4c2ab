"""Deterministic text embedders as Arrow functions."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: What separates words becomes a space.
SEPARATED = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))
#: Words and trigrams whose hashes a Python worker keeps, and the longest of them.
KEPT, LONGEST = 1 << 17, 64


@lru_cache(KEPT)
def _trigram_hash(run: str) -> bytes:
    return hashlib.blake2b(run.encode(), digest_size=8).digest()


def _word_hash(word: bytes) -> bytes:
    return hashlib.sha256(word).digest()


_kept_word_hash = lru_cache(KEPT)(_word_hash)


def trigram_vector(text: str | None, dim: int) -> np.ndarray:
    """Signed counts of hashed character trigrams, of unit length; empty: e0."""
    body = (text or "").strip().lower()
    if not body:
        out = np.zeros(dim)
        out[0] = 1.0
        return out
    padded = f"  {body}  "
    counts = Counter(map("".join, zip(padded, padded[1:], padded[2:])))
    h = np.frombuffer(b"".join(map(_trigram_hash, counts)), ">u8").astype(np.uint64)
    n = np.fromiter(counts.values(), float, len(counts))
    out = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63) == 1, -n, n), dim)
    length = np.linalg.norm(out)
    if length == 0:
        out[0] = length = 1.0
    return out / length


def word_vector(text: str | None, dim: int) -> np.ndarray:
    """Eight signed places of each word's SHA-256, of unit length."""
    counts = Counter((text or "").lower().encode("ascii", "replace").translate(SEPARATED).split() or [b"\0empty"])
    hashes = b"".join(map(_kept_word_hash if max(map(len, counts)) <= LONGEST else _word_hash, counts))
    h = np.frombuffer(hashes, ">u4").astype(np.uint32)
    n = np.repeat(np.fromiter(counts.values(), float, len(counts)), 8)
    out = np.bincount(h % np.uint32(dim), np.where(h & 1 << 24, -n, n), dim)
    length = np.linalg.norm(out)
    return out / length if length else out


EMBEDDERS = {"trigram": trigram_vector, "word": word_vector}


def embed(text: Column, kind: str, dim: int = 256) -> Column:
    """The embedding of a text column; the kind must be named, there is no fallback.

    Spark takes it for one that is not deterministic, which it is: else a filter on
    the embedding would work it out again below the projection that has it."""
    if kind not in EMBEDDERS:
        raise ValueError(f"unknown embedder {kind!r}; one of {sorted(EMBEDDERS)}")
    one = EMBEDDERS[kind]

    def run(column: pa.Array) -> pa.Array:
        return pa.array([one(t, dim).astype(np.float32) for t in column.to_pylist()], pa.list_(pa.float32()))

    return arrow_udf(run, "array<float>").asNondeterministic()(text)
