"""Whole-text helpers on numpy byte buffers, used inside Arrow stages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = np.asarray(h, np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1024), _BASE, np.uint64))])
    return _POWERS


_POWERS = np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all ``[^\\x20\\x09-\\x0D]+`` words, A-Z lower-cased, and
    each text's first word (n + 1 offsets).  Works through slices of about
    half a MB cut between words, so a very long text needs no more memory."""
    hashes, starts, ends_of_texts, s = [], [], at[1:-1], 0
    while s < len(data):
        e = min(s + SLICE, len(data))
        while e < len(data) and not SPACE[data[e]] and not np.any(ends_of_texts == e):
            step = np.flatnonzero(SPACE[data[e : e + 65536]])
            nearest = ends_of_texts[np.searchsorted(ends_of_texts, e) :][:1]
            e = min([e + (step[0] if len(step) else 65536), len(data), *nearest])
        part = LOWER[data[s:e]]
        inside = ~SPACE[part]
        edge = ends_of_texts[(ends_of_texts > s) & (ends_of_texts < e)] - s
        before = np.concatenate([[False], inside[:-1]])
        before[edge] = False
        after = np.concatenate([inside[1:], [False]])
        after[edge - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if len(first):
            long = last - first
            where = np.flatnonzero(inside)
            place = where - np.repeat(first, long)
            with np.errstate(over="ignore"):
                value = _TABLE[part[where]] * _powers(int(long.max()))[place]
                total = np.add.reduceat(value, np.concatenate([[0], np.cumsum(long)[:-1]]))
                hashes.append(mix(total + long.astype(np.uint64)))
            starts.append(first + s)
        s = e
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(where, at)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct k-word shingles of each text, sorted; fewer words than k count
    as one shingle, no words as none."""
    with np.errstate(over="ignore"):
        n = max(0, len(h) - k + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        rolled = mix(rolled)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = one * np.uint64(0xD6E8FEB86659FD93) + x
                out.append(mix(np.array([one])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
