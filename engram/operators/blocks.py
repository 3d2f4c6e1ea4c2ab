"""Pairs of actors and rings, made block by block where their edits lie.

Edits are dealt to groups by a hash of their actor or page, and every two groups
meet in one task.  All meetings of two actors, or all paths over two pages, are in
one block, so the task makes them chunk by chunk, sums them up, and returns
results only: what is shuffled are edits, once a group and packed (names by
number, times as steps), and never pairs or paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Groups at most while the edits are few; edits a group beyond that; edits that make a group worth its tasks.
GROUPS, GROUP_ROWS, LEAST_ROWS = 16, 1_000_000, 10_000
#: Pairs or paths held at once in a task, rows a batch returned, edits of a piece.
CHUNK, BATCH, PIECE = 1_000_000, 250_000, 200_000


def n_groups(rows: int) -> int:
    return max(min(GROUPS, -(-rows // LEAST_ROWS)), -(-rows // GROUP_ROWS), 1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a group's edits in order of page and time, compressed."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    held.clear()
    own = table["_own"].slice(0, 1).combine_chunks()
    table = table.drop_columns("_own")
    for c in ("actor", "page"):
        table = table.set_column(table.column_names.index(c), c, table[c].dictionary_encode()).unify_dictionaries()
    timed = "ts_us" in table.column_names
    order = [table["ts_us"].to_numpy()] if timed else [_numbers(table["actor"])]
    table = table.take(pa.array(np.lexsort((*order, _numbers(table["page"]))))).combine_chunks()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for at in range(0, len(table), PIECE):
        some = table.slice(at, PIECE)
        if timed:
            some = _with_ts(some, np.diff(some["ts_us"].to_numpy(), prepend=0))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, some.schema, options=options) as out:
            out.write_table(some)
        yield pa.record_batch({"_own": own, "piece": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _with_ts(table: pa.Table, ts: np.ndarray) -> pa.Table:
    return table.set_column(table.column_names.index("ts_us"), "ts_us", pa.array(ts))


def _unpacked(piece: pa.Buffer, side: int) -> pa.Table:
    table = pa.ipc.open_stream(piece).read_all()
    if "ts_us" in table.column_names:
        table = _with_ts(table, np.cumsum(table["ts_us"].to_numpy()))
    return table.append_column("side", pa.array(np.full(len(table), side, np.int8)))


def by_blocks(edits: DataFrame, key: str, rows: int, make: Callable[[pa.Table, bool], Iterator[pa.Table]], schema: str, n: int | None = None, own: Column | None = None) -> DataFrame:
    """What ``make`` yields of each block: the edits of two groups of ``key``, or of
    one (then its second argument is true).  ``side`` is 1 for rows of the second group.
    ``own``: the group from 0 to ``n`` of a row, in place of a hash of ``key``."""
    n = n or n_groups(rows)
    own = F.pmod(F.xxhash64(key), F.lit(n)) if own is None else own
    packed = edits.withColumn("_own", own.cast("int")).repartitionById(n, F.col("_own")).mapInArrow(_pack, "_own int, piece binary")
    dealt = packed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    dealt = dealt.select((high * (high + 1) / 2 + low).cast("int").alias("block"), (F.col("_own") > F.col("_other")).cast("byte").alias("side"), (F.col("_own") == F.col("_other")).alias("alone"), "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alone = [], False
        for b in batches:
            for i in range(b.num_rows):
                alone = b["alone"][i].as_py()
                held.append(_unpacked(b["piece"][i].as_buffer(), b["side"][i].as_py()))
        if held:
            table = pa.concat_tables(held)
            held.clear()
            for found in make(table, alone):
                yield from found.to_batches(max_chunksize=BATCH)

    return dealt.repartitionById(n * (n + 1) // 2, F.col("block")).mapInArrow(run, schema)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.indices.to_numpy() for c in column.chunks])


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the values, and the values."""
    coded_ = (column if pa.types.is_dictionary(column.type) else column.dictionary_encode()).unify_dictionaries()
    names = coded_.chunk(0).dictionary
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return place[_numbers(coded_)], names.take(pa.array(order))


class Line:
    """Rows in order of (group, ts), in which places are looked up."""

    def __init__(self, group: np.ndarray, ts: np.ndarray, *more: np.ndarray):
        order = np.lexsort((ts, group))
        self.group, self.ts, self.more = group[order], ts[order], [m[order] for m in more]
        self.key = None
        if len(ts):
            self.low, self.span = int(ts.min()), int(ts.max()) - int(ts.min()) + 3
            if (int(self.group[-1]) + 2) * self.span < 2**62:
                self.key = self.group * self.span + (self.ts - self.low + 1)

    def place(self, group: np.ndarray, ts: np.ndarray, side: str) -> np.ndarray:
        """Where (group, ts) would stand among the rows of its group."""
        if not len(self.ts):
            return np.zeros(len(group), np.int64)
        if self.key is not None:
            inside = np.clip(ts - self.low + 1, 0, self.span - 1)
            return np.searchsorted(self.key, np.minimum(group, self.group[-1] + 1) * self.span + inside, side)
        low, high = np.searchsorted(self.group, group, "left"), np.searchsorted(self.group, group, "right")
        while (wide := low < high).any():
            half = (low + high) // 2
            at = self.ts[np.minimum(half, len(self.ts) - 1)]
            before = wide & (at < ts if side == "left" else at <= ts)
            low, high = np.where(before, half + 1, low), np.where(wide & ~before, half, high)
        return low


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): each row with the ``n`` places from ``first`` on."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n - first, n)


def cuts(n: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of rows with at most ``most`` in all; a larger row stands alone."""
    ends, start = np.cumsum(n), 0
    while start < len(n):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(start, end)
        start = end


def sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in order of the keys, and where each new key starts."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = [int(k.max()) + 1 for k in keys]
    if sum(s.bit_length() for s in sizes) <= 62:
        packed = keys[0].astype(np.int64)
        for k, s in zip(keys[1:], sizes[1:]):
            packed = (packed << s.bit_length()) | k
        order = np.argsort(packed)
        packed = packed[order]
        new = packed[1:] != packed[:-1]
    else:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order) - 1, bool)
        for k in keys:
            new |= k[order[1:]] != k[order[:-1]]
    return order, np.concatenate(([0], np.flatnonzero(new) + 1))


# ------------------------------------------------------------------ pairs


def meetings(table: pa.Table, alone: bool, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(l, r, page, gap, fresh) of two actors and a page, by code: the smallest gap, and
    whether an edit marked ``fresh`` takes part.  All rows of an actor l come at once."""
    actor, _ = coded(table["actor"])
    page, _ = coded(table["page"])
    ts, side = table["ts_us"].to_numpy(), table["side"].to_numpy()
    fresh = table["fresh"].to_numpy() if "fresh" in table.column_names else np.zeros(len(ts), bool)
    one, two = (slice(None), slice(None)) if alone else (side == 0, side == 1)
    right = Line(page[two], ts[two], actor[two], fresh[two])
    order = np.lexsort((page[one], actor[one]))
    a, p, t, f = (x[one][order] for x in (actor, page, ts, fresh))
    first = right.place(p, t - width, "left")
    n = right.place(p, t + width, "right") - first
    carry = None
    for part in cuts(n, CHUNK):
        row, at = spread(first[part], n[part])
        row += part.start
        got = [a[row], right.more[0][at], p[row], np.abs(t[row] - right.ts[at]), f[row] | right.more[1][at]]
        if alone:
            kept = got[0] < got[1]
            got = [x[kept] for x in got]
        if carry is not None:
            got = [np.concatenate(x) for x in zip(carry, got)]
        order, starts = sorted_groups(*got[:3])
        if not len(starts):
            continue
        heads = order[starts]
        got = [*(x[heads] for x in got[:3]), np.minimum.reduceat(got[3][order], starts), np.logical_or.reduceat(got[4][order], starts)]
        # the last actor may go on in the next chunk
        done = int(np.searchsorted(got[0], a[part.stop - 1])) if part.stop < len(a) and a[part.stop] == a[part.stop - 1] else len(got[0])
        carry = [x[done:] for x in got]
        if done:
            yield tuple(x[:done] for x in got)
    if carry is not None and len(carry[0]):
        yield tuple(carry)


def windowed(edits: DataFrame, width: int, fresh: bool = False) -> DataFrame:
    """(a, b, shared, closest_us) of (actor, page, ts_us); with ``fresh`` only pairs
    whose meetings an edit marked so takes part in."""
    rows = edits.where("actor is not null and page is not null and ts_us is not null").select("actor", "page", F.col("ts_us").cast("long").alias("ts_us"), *(["fresh"] if fresh else []))
    kind = dict(rows.dtypes)["actor"]

    def make(table: pa.Table, alone: bool) -> Iterator[pa.Table]:
        names = coded(table["actor"])[1]
        for l, r, _, gap, new in meetings(table, alone, width):
            order, starts = sorted_groups(l, r)
            heads, shared, closest = order[starts], np.diff(np.append(starts, len(order))), np.minimum.reduceat(gap[order], starts)
            if fresh:
                kept = np.logical_or.reduceat(new[order], starts)
                heads, shared, closest = heads[kept], shared[kept], closest[kept]
            a, b = np.minimum(l[heads], r[heads]), np.maximum(l[heads], r[heads])
            yield pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "shared": shared, "closest_us": closest})

    return by_blocks(rows, "actor", rows.count(), make, f"a {kind}, b {kind}, shared long, closest_us long")


def links(edits: DataFrame, width: int) -> DataFrame:
    """(a, bs) of (actor, page, ts_us): actors b > a that a met within the width, each
    link once, in arrays so that links are written and read as few rows."""
    rows = edits.where("actor is not null and page is not null and ts_us is not null").select("actor", "page", F.col("ts_us").cast("long").alias("ts_us"))
    kind = dict(rows.dtypes)["actor"]

    def make(table: pa.Table, alone: bool) -> Iterator[pa.Table]:
        names = coded(table["actor"])[1]
        for l, r, *_ in meetings(table, alone, width):
            a, b = np.minimum(l, r), np.maximum(l, r)
            order, starts = sorted_groups(a, b)
            a, b = a[order[starts]], b[order[starts]]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            held = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), names.take(pa.array(b)))
            yield pa.table({"a": names.take(pa.array(a[first])), "bs": held})

    return by_blocks(rows, "actor", rows.count(), make, f"a {kind}, bs array<{kind}>")


#: A page on which less than this share of two groups' actor pairs meet is counted pair by pair, another as a column of a matrix.
DENSE = 1 / 600


def shared_pages(table: pa.Table, alone: bool, emit: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Array], pa.Table]) -> Iterator[pa.Table]:
    """What ``emit`` makes of (l, r, weight) of two actors, by code, some actors l at a time."""
    actor, names = coded(table["actor"])
    page, _ = coded(table["page"])
    side = table["side"].to_numpy()
    heads = (lambda k: k[0][k[1]])(sorted_groups(actor, page))
    actor, page, side = actor[heads], page[heads], side[heads]
    one, two = (slice(None), slice(None)) if alone else (side == 0, side == 1)
    a, p = actor[one], page[one]
    right = Line(page[two], actor[two], actor[two])
    everyone = np.unique(right.more[0])
    if not len(everyone) or not len(a):
        return
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    ends = np.append(starts[1:], len(a))
    most = max(1, CHUNK // len(everyone))
    for at in range(0, len(starts), most):
        rows = slice(starts[at], ends[min(at + most, len(starts)) - 1])
        left, l = np.unique(a[rows], return_inverse=True)
        q = p[rows]
        pages, n_left = np.unique(q, return_counts=True)
        first = np.searchsorted(right.group, pages, "left")
        n_right = np.searchsorted(right.group, pages, "right") - first
        table_ = np.zeros((len(left), len(everyone)), np.float32)
        thick = n_left * n_right > DENSE * table_.size
        for slab in np.array_split(pages[thick], -(-int(thick.sum()) // 256) or 1):
            if len(slab):
                x, y = np.zeros((len(left), len(slab)), np.float32), np.zeros((len(slab), len(everyone)), np.float32)
                for k, line, who, of in ((x, q, l, 0), (y, right.group, np.searchsorted(everyone, right.more[0]), 1)):
                    col = np.minimum(np.searchsorted(slab, line), len(slab) - 1)
                    held = slab[col] == line
                    k[(who[held], col[held]) if of == 0 else (col[held], who[held])] = 1
                table_ += x @ y
        thin = ~thick[np.searchsorted(pages, q)]
        which = np.searchsorted(pages, q[thin])
        for part in cuts(n_right[which], CHUNK):
            row, place = spread(first[which[part]], n_right[which[part]])
            flat = l[thin][part][row] * len(everyone) + np.searchsorted(everyone, right.more[0][place])
            np.add.at(table_.reshape(-1), flat, 1)
        i, j = np.nonzero(table_)
        weight = table_[i, j].astype(np.int64)
        i, j = left[i], everyone[j]
        if alone:
            kept = i < j
            i, j, weight = i[kept], j[kept], weight[kept]
        if len(i):
            yield emit(i, j, weight, names)


def weights(edits: DataFrame) -> DataFrame:
    """(a, b, weight): number of pages that two actors edited, a < b."""
    rows = edits.where("actor is not null and page is not null").select("actor", "page").distinct()
    kind = dict(rows.dtypes)["actor"]

    def emit(l: np.ndarray, r: np.ndarray, weight: np.ndarray, names: pa.Array) -> pa.Table:
        return pa.table({"a": names.take(pa.array(np.minimum(l, r))), "b": names.take(pa.array(np.maximum(l, r))), "weight": weight})

    def make(table: pa.Table, alone: bool) -> Iterator[pa.Table]:
        return shared_pages(table, alone, emit)

    return by_blocks(rows, "actor", edits.count(), make, f"a {kind}, b {kind}, weight long")


# ------------------------------------------------------------------ rings


class Paths:
    """Paths a - x - mid - y - c of one block of pages, by code."""

    def __init__(self, table: pa.Table, alone: bool, width: int, anchor: str | None):
        self.width = width
        self.actor, self.actors = coded(table["actor"])
        self.page, self.pages = coded(table["page"])
        ts, side = table["ts_us"].to_numpy(), table["side"].to_numpy()
        self.line = Line(self.page, ts, self.actor)
        self.anchor = None
        if anchor is not None:
            at = pc.index(self.actors, pa.scalar(anchor, self.actors.type)).as_py()
            self.anchor = at if at >= 0 else -1
            own = self.actor == self.anchor
            self.anchored = Line(self.page[own], ts[own], self.actor[own])
        self.own = self._own(ts, side, alone)

    def _own(self, ts: np.ndarray, side: np.ndarray, alone: bool) -> list[np.ndarray]:
        """(mid, x, y, tx, ty): two edits of one actor on different pages within the
        width, in order of the pages; x is the first group's, or the smaller."""
        by = Line(self.actor, ts, self.page, side)
        first = np.arange(len(ts)) + 1
        n = by.place(by.group, by.ts + self.width, "right") - first
        found = []
        for part in cuts(n, CHUNK):
            i, j = spread(first[part], n[part])
            i += part.start
            page, side_ = by.more
            kept = page[i] != page[j] if alone else side_[i] != side_[j]
            i, j = i[kept], j[kept]
            turned = page[i] > page[j] if alone else side_[i] > side_[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            found.append((by.group[i], page[i], page[j], by.ts[i], by.ts[j]))
        own = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        order = np.lexsort((own[2], own[1]))
        return [x[order] for x in own]

    def runs(self) -> Iterator[tuple[np.ndarray, Line, Line]]:
        """(rows of ``own``, ends on x, ends on y); with an anchor only what it is in."""
        every = np.arange(len(self.own[0]))
        if self.anchor is None:
            yield every, self.line, self.line
            return
        mid = self.own[0] == self.anchor
        yield every[mid], self.line, self.line
        yield every[~mid], self.anchored, self.line
        yield every[~mid], self.line, self.anchored

    def ends(self, line: Line, page: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = line.place(page, high - self.width, "left")
        return first, line.place(page, low + self.width, "right") - first

    def chunks(self) -> Iterator[list[np.ndarray]]:
        """(pair, s, m, l, span, start, tie) of all paths over some pairs of pages at
        once: the pair's first row in ``own``, its actors in order, and the order of
        equal spans and starts (by mid, then by the page a meets it on)."""
        if not len(self.own[0]):
            return
        mid, x, y, tx, ty = self.own
        low, high = np.minimum(tx, ty), np.maximum(tx, ty)
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        starts = np.flatnonzero(new)
        pair = starts[np.cumsum(new) - 1]
        runs = []
        bound = np.zeros(len(mid), np.int64)
        for rows, on_x, on_y in self.runs():
            first, n = self.ends(on_x, x[rows], low[rows], high[rows])
            m = n * self.ends(on_y, y[rows], low[rows], high[rows])[1]
            bound[rows] += m
            some = m > 0
            runs.append((rows[some], first[some], n[some], m[some], on_x, on_y))
        sizes = np.add.reduceat(bound, starts)
        ends = np.append(starts[1:], len(mid))
        for part in cuts(sizes, CHUNK):
            a, b = starts[part.start], ends[part.stop - 1]
            some = [[rows[i:j], first[i:j], n[i:j], m[i:j], on_x, on_y] for rows, first, n, m, on_x, on_y in runs for i, j in [np.searchsorted(rows, (a, b))]]
            if sizes[part].sum() <= 4 * CHUNK or self.anchor is not None:
                yield from self._rounds(some, low, high, pair)
            else:
                for by_least in self._by_least(slice(a, b), int(sizes[part].sum()), low, high):
                    yield from self._rounds(by_least, low, high, pair)

    def _by_least(self, rows: slice, size: int, low: np.ndarray, high: np.ndarray) -> Iterator[list]:
        """Runs of a pair of pages with many paths, by ranges of the path's first actor."""
        mid, x, y = (k[rows] for k in self.own[:3])
        every = np.arange(rows.start, rows.stop)
        on = [np.arange(*np.searchsorted(self.line.group, (p, p + 1))) for p in (x[0], y[0])]
        who = np.sort(np.concatenate([self.line.more[0][k] for k in on]))
        share = 1 - (1 - np.arange(1, (n := -(-size // CHUNK)) + 1) / n) ** (1 / 3)
        bounds = np.unique(np.append(who[np.minimum((share * len(who)).astype(np.int64), len(who) - 1)][:-1], who[-1] + 1))
        at = 0
        for end in bounds:
            def held(k: np.ndarray, least: int, most: int | None = None) -> Line:
                actor = self.line.more[0][k]
                k = k[(actor >= least) & (actor < (bounds[-1] if most is None else most))]
                return Line(self.line.group[k], self.line.ts[k], self.line.more[0][k])

            own, beyond = (mid >= at) & (mid < end), mid >= end
            rest = [held(k, at) for k in on]
            runs = []
            for of, on_x, on_y in ((own, *rest), (beyond, held(on[0], at, end), rest[1]), (beyond, held(on[0], end), held(on[1], at, end))):
                k = every[of]
                first, n_x = self.ends(on_x, self.own[1][k], low[k], high[k])
                m = n_x * self.ends(on_y, self.own[2][k], low[k], high[k])[1]
                some = m > 0
                runs.append((k[some], first[some], n_x[some], m[some], on_x, on_y))
            yield runs
            at = end

    def _rounds(self, runs: list, low: np.ndarray, high: np.ndarray, pair: np.ndarray) -> Iterator[list[np.ndarray]]:
        """The paths of some runs; where they are too many for one round, dealt by their actors."""
        rounds = max(1, -(-sum(int(m.sum()) for _, _, _, m, _, _ in runs) // (4 * CHUNK)))
        for turn in range(rounds):
            held = []
            for rows, first, n, m, on_x, on_y in runs:
                for s in cuts(m, CHUNK):
                    for found in self._made(rows[s], first[s], n[s], on_x, on_y, low, high, pair):
                        if rounds > 1:
                            kept = (found[1] * 31 + found[2] * 17 + found[3]) % rounds == turn
                            found = self.best([f[kept] for f in found])
                        held.append(found)
            if held:
                yield [np.concatenate(f) for f in zip(*held)]

    def _made(self, rows, first, n, on_x, on_y, low, high, pair) -> Iterator[list[np.ndarray]]:
        mid, x, y = self.own[:3]
        k, at = spread(first, n)
        row, a, ta = rows[k], on_x.more[0][at], on_x.ts[at]
        kept = a != mid[row]
        if self.anchor is not None and on_y is self.anchored:
            kept &= a != self.anchor
        row, a, ta = row[kept], a[kept], ta[kept]
        lo, hi = np.minimum(low[row], ta), np.maximum(high[row], ta)
        first, n = self.ends(on_y, y[row], lo, hi)
        m = mid[row]
        small, large = np.minimum(a, m), np.maximum(a, m)
        for part in cuts(n, CHUNK):
            k, at = spread(first[part], n[part])
            k += part.start
            c, tc, am, mm = on_y.more[0][at], on_y.ts[at], a[k], m[k]
            kept = (c != am) & (c != mm)
            k, c, tc, am, mm = k[kept], c[kept], tc[kept], am[kept], mm[kept]
            s, g = small[k], large[k]
            lowest, highest = np.minimum(s, c), np.maximum(g, c)
            start = np.minimum(lo[k], tc)
            # equal spans and starts: by a, mid and c, so the middle name first, then the largest as mid
            place = np.where(mm == highest, 1, np.where(mm == lowest, 2, 0)) * 2
            on_larger = np.where(am < c, x[row[k]] > y[row[k]], y[row[k]] > x[row[k]])
            yield [pair[row[k]], lowest, s + g + c - lowest - highest, highest, np.maximum(hi[k], tc) - start, start, place + on_larger]

    def best(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """Of each ring its first path by span, start and tie."""
        order, starts = sorted_groups(*found[:4])
        if len(starts) == len(order):
            return [f[order] for f in found]
        n = np.diff(np.append(starts, len(order)))
        heads = order[starts]
        many = np.repeat(n > 1, n)
        group, rows = np.repeat(np.arange(len(n)), n)[many], order[many]
        by = np.lexsort((found[6][rows], found[5][rows], found[4][rows], group))
        lead = np.concatenate(([True], group[by][1:] != group[by][:-1])) if len(by) else np.zeros(0, bool)
        heads[n > 1] = rows[by][lead]
        return [f[heads] for f in found]

    def names(self, found: list[np.ndarray]) -> dict[str, pa.Array]:
        pair, first, last = self._pairs(found)
        actors = [self.actors.take(pa.array(f)) for f in found[1:4]]
        return {"actors": pc.binary_join_element_wise(*actors, "|"), "pages": pc.binary_join_element_wise(first, last, "|").take(pa.array(pair))}

    def _pairs(self, found: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Each row's place among the pairs of pages, and their names in order; rows of a pair come together."""
        new = np.concatenate(([True], found[0][1:] != found[0][:-1]))
        x, y = (k[found[0][new]] for k in self.own[1:3])
        return np.cumsum(new) - 1, *(self.pages.take(pa.array(f)) for f in (np.minimum(x, y), np.maximum(x, y)))

    def told(self, found: list[np.ndarray]) -> pa.Table:
        """Each best path in full."""
        s, m, g, tie = *found[1:4], found[6]
        a = np.where(tie // 2 == 2, m, s)
        mid = np.choose(tie // 2, (m, g, s))
        c = np.where(tie // 2 == 1, m, g)
        pair, first, last = self._pairs(found)
        both, turned = pa.concat_arrays([first, last]), tie % 2
        named = {k: self.actors.take(pa.array(v)) for k, v in (("a", a), ("mid", mid), ("c", c))}
        named |= {k: both.take(pa.array(pair + len(first) * v)) for k, v in (("x", turned), ("y", 1 - turned))}
        return pa.table(self.names(found) | named | {"t_min": found[5], "t_max": found[5] + found[4], "span_us": found[4]})


RING = "actors string, pages string, span_us long"
PATH = "actors string, pages string, a string, mid string, c string, x string, y string, t_min long, t_max long, span_us long"
COUNT = "rings long, span_us long"


def ring_blocks(edits: DataFrame, rows: int, width: int, anchor: str | None, schema: str) -> DataFrame:
    """Rings of (actor, page, ts_us) as RING or PATH, each once; as COUNT their
    number and smallest span by block and chunk."""

    def make(table: pa.Table, alone: bool) -> Iterator[pa.Table]:
        paths = Paths(table, alone, width, anchor)
        for found in paths.chunks():
            if not len(found[0]):
                continue
            if schema == COUNT:
                starts = sorted_groups(*found[:4])[1]
                yield pa.table({"rings": [len(starts)], "span_us": [int(found[4].min())]})
                continue
            found = paths.best(found)
            yield paths.told(found) if schema == PATH else pa.table(paths.names(found) | {"span_us": found[4]})

    return by_blocks(edits.select("actor", "page", "ts_us"), "page", rows, make, schema)
