"""Rings and co-edits by blocks against brute force, with many groups and small chunks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from engram.operators import blocks as B, graph as G

SCHEMA = "event_id long, actor string, page string, ts_us long"


def edits(n=110, actors=8, pages=5, seed=3, bar=""):
    draw = random.Random(seed)
    return [(i, f"a{bar}{draw.randrange(actors)}", f"p{bar}{draw.randrange(pages)}", draw.randrange(900)) for i in range(n)]


def brute_rings(rows, width, anchor=None):
    best = {}
    for e1, e2 in itertools.permutations(rows, 2):
        if e1[1] != e2[1] or e1[2] == e2[2]:
            continue
        near = lambda e: [o for o in rows if o[2] == e[2] and o[1] != e[1] and abs(o[3] - e[3]) <= width]
        for a, c in itertools.product(near(e1), near(e2)):
            times = (e1[3], e2[3], a[3], c[3])
            if a[1] >= c[1] or max(times) - min(times) > width or (anchor and anchor not in (a[1], e1[1], c[1])):
                continue
            key = ("|".join(sorted((a[1], e1[1], c[1]))), "|".join(sorted((e1[2], e2[2]))))
            path = (max(times) - min(times), min(times), a[1], e1[1], c[1], e1[2], e2[2], max(times))
            best[key] = min(best.get(key, path), path)
    return best


@pytest.fixture(params=[(1, 4_000_000), (3, 4_000_000), (4, 7)])
def small(request, monkeypatch):
    """Numbers of groups, and chunks so small that pages and actors are cut."""
    monkeypatch.setattr(B, "n_groups", lambda rows: request.param[0])
    monkeypatch.setattr(B, "CHUNK", request.param[1])


@pytest.mark.parametrize("bar", ["", "|"])
def test_rings_are_brute_force(spark, small, bar):
    rows = edits(bar=bar)
    df = spark.createDataFrame(rows, SCHEMA)
    for anchor in (None, f"a{bar}3", "nobody"):
        want = brute_rings(rows, 60, anchor)
        got = {(r.actors, r.pages): (r.span_us, r.t_min, r.a, r.mid, r.c, r.x, r.y, r.t_max) for r in G.ring_paths(df, 60, anchor=anchor).collect()}
        assert got == want and bool(want) == (anchor != "nobody")
        found = G.rings(df, 60, anchor=anchor).collect()
        assert {(r.actors, r.pages): r.span_us for r in found} == {k: v[0] for k, v in want.items()} and len(found) == len(want)
    assert G.verdict_of(df, 60).first() == G.ring_verdict(G.rings(df, 60)).first()


def test_times_far_apart_keep_their_order():
    """Places are found where group and time do not fit one number."""
    import numpy as np

    draw = np.random.default_rng(1)
    group, ts = draw.integers(0, 9, 300), draw.integers(-(2**61), 2**61, 300)
    line = B.Line(group, ts)
    assert line.key is None
    for side in ("left", "right"):
        at = line.place(group, ts, side)
        rows = sorted(zip(group.tolist(), ts.tolist()))
        want = [sum(r < q if side == "left" else r <= q for r in rows) for q in zip(group.tolist(), ts.tolist())]
        assert at.tolist() == want


def test_rings_shuffle_edits_and_no_paths(spark):
    """A thousand edits at one time on each of two pages make far more paths than edits."""
    rows = [(i, f"a{i % 40}", f"p{i % 2 if i >= 40 else (i + 1) % 2}", i) for i in range(200)]
    plan = G.rings(spark.createDataFrame(rows, SCHEMA), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Window" not in plan and "Aggregate" not in plan


def brute_pairs(rows, width):
    met = {}
    for e, o in itertools.combinations(rows, 2):
        if e[1] != o[1] and e[2] == o[2] and (width is None or abs(e[3] - o[3]) <= width):
            met.setdefault((min(e[1], o[1]), max(e[1], o[1])), {}).setdefault(e[2], []).append(abs(e[3] - o[3]))
    return met


def test_coedits_are_brute_force(spark, small):
    rows = edits(200, 12, 6) + [(900, None, "p1", 5), (901, "a1", None, 5), (902, "a10", "p1", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    met = brute_pairs(rows[:200] + rows[202:], 40)
    got = G.coedited_windowed(df, 40).collect()
    assert {(r.a, r.b): (r.shared, r.closest_us) for r in got} == {k: (len(v), min(map(min, v.values()))) for k, v in met.items()} and len(got) == len(met)


@pytest.mark.parametrize("dense", [0.0, 1 / 600, 2.0])
def test_weights_are_brute_force(spark, small, monkeypatch, dense):
    """Pages as columns of a matrix, pair by pair, and both."""
    monkeypatch.setattr(B, "DENSE", dense)
    rows = edits(120, 12, 30)
    got = G.coedited_weight(spark.createDataFrame(rows + [(900, None, "p1", 5), (901, "a1", None, 5)], SCHEMA)).collect()
    want = {k: len(v) for k, v in brute_pairs(rows, None).items()}
    assert {(r.a, r.b): r.weight for r in got} == want and len(got) == len(want)


def test_pairs_are_not_shuffled(spark):
    """Fifty actors that meet on one page at one time make far more pairs than edits."""
    df = spark.createDataFrame([(i, f"a{i}", "p", 1) for i in range(50)], SCHEMA)
    for found in (G.coedited_windowed(df, 10), G.coedited_weight(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and found.count() == 50 * 49 // 2


def test_ranks_of_links_in_arrays(spark, small, monkeypatch):
    """Links come once each, and ranks are the same step by step as several steps a plan."""
    rows = edits(150, 12, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    links = G.coedit_links(df, 40)
    got = [(r.a, b) for r in links.collect() for b in r.bs]
    assert sorted(got) == sorted(brute_pairs(rows, 40))
    nodes = df.select(F.col("actor").alias("node")).distinct()
    several = {r.node: r.score for r in G.pagerank(spark.createDataFrame(got, "a string, b string"), nodes, 14).collect()}
    monkeypatch.setattr(G, "MANY_EDGES", 0)
    assert {r.node: r.score for r in G.pagerank(links, nodes, 14).collect()} == pytest.approx(several, abs=1e-7)


def test_neighbours_of_a_frequent_entity(spark):
    """The first rows of seeds and claims that all share one entity, with repeats."""
    from engram.operators.answering import entity_neighbours

    mentions = [(i, "e") for i in range(600)] + [(i, "f") for i in range(290, 310)] + [(700, "f"), (700, "f")]
    seeds = [(1, i) for i in range(0, 600, 2)] + [(2, 700), (2, 700)]
    m, s = spark.createDataFrame(mentions, "id long, entity string"), spark.createDataFrame(seeds, "query_id long, id long")
    want = {}
    for q, i in set(seeds):
        for e in {e for n, e in mentions if n == i}:
            want.setdefault(q, set()).update((n, e, i) for n, f in mentions if f == e and (q, n) not in set(seeds))
    expected = {(q, *r) for q, rows in want.items() for r in sorted(rows)[:12]}
    found = entity_neighbours(s, m, 3)
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)


def test_pieces_are_the_edits():
    """A group's pieces, packed and unpacked, hold its rows with names and times."""
    import pyarrow as pa

    rows = edits(500)
    table = pa.table({"actor": [r[1] for r in rows], "page": [r[2] for r in rows], "ts_us": pa.array([r[3] - 2**60 for r in rows]), "_own": pa.array([4] * 500, pa.int32())})
    pieces = list(B._pack(iter(table.to_batches(max_chunksize=90))))
    back = pa.concat_tables([B._unpacked(p["piece"][0].as_buffer(), 1) for p in pieces])
    assert [p["_own"][0].as_py() for p in pieces] == [4] and set(back["side"].to_pylist()) == {1}
    assert sorted(zip(*(back[c].to_pylist() for c in ("actor", "page", "ts_us")))) == sorted((a, p, t - 2**60) for _, a, p, t in rows)


def test_many_paths_come_in_small_rounds(monkeypatch):
    """Paths of one pair of pages are dealt by their first actor: few are made in more than one
    round, and a round holds few."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(B, "CHUNK", 25_000)
    draw = random.Random(5)
    rows = [(i, f"a{draw.randrange(200):03}", f"p{draw.randrange(2)}", draw.randrange(900)) for i in range(400)]
    table = pa.table({"actor": [r[1] for r in rows], "page": [r[2] for r in rows], "ts_us": pa.array([r[3] for r in rows]), "side": pa.array(np.zeros(400, np.int8))})
    made, calls = 0, B.Paths._made

    def counted(self, *args):
        nonlocal made
        for found in calls(self, *args):
            made += len(found[0])
            yield found

    monkeypatch.setattr(B.Paths, "_made", counted)
    paths = B.Paths(table, True, 300, None)
    sizes, rings = [], set()
    for found in paths.chunks():
        sizes.append(len(found[0]))
        best = paths.best(found)
        new = set(zip(*(f.tolist() for f in best[1:4])))
        assert len(new) == len(best[0]) and not new & rings
        rings |= new
    want = brute_rings(rows, 300)
    assert {"|".join(paths.actors[c].as_py() for c in r) for r in rings} == {k[0] for k in want}
    assert made < 1.5 * sum(sizes) and max(sizes) <= 100_000 and sum(sizes) > 40_000


def test_pairs_of_pages_are_named_once():
    """Many rings of a few pairs of pages: names are made a pair, and are those of the rows."""
    import numpy as np
    import pyarrow as pa

    rows = edits()
    table = pa.table({"actor": [r[1] for r in rows], "page": [r[2] for r in rows], "ts_us": pa.array([r[3] for r in rows]), "side": pa.array(np.zeros(len(rows), np.int8))})
    paths = B.Paths(table, True, 60, None)
    (found,) = (paths.best(f) for f in paths.chunks())
    pair, first, last = paths._pairs(found)
    assert len(first) == len(last) == len(set(found[0].tolist())) <= 10 < len(pair)
    want = brute_rings(rows, 60)
    told = paths.told(found).to_pylist()
    assert {(r["actors"], r["pages"]): (r["x"], r["y"]) for r in told} == {k: v[5:7] for k, v in want.items()}
