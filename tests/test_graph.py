"""Settled labels, leaders, ranks, lineage, digest trees and the plain arm on small graphs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import graph as G, retrieval as R, trees as T

S = 1_000_000


def settle(pairs):
    """The rule as it is stated, in plain Python."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label, step = {n: n for n in near}, 0
    while True:
        wish = {}
        for n, others in near.items():
            votes = Counter(label[o] for o in others)
            best = min(votes, key=lambda x: (-votes[x], x))
            if votes[best] > votes[label[n]]:
                wish[n] = (hashlib.md5(f"{best}:{step}".encode()).hexdigest(), best)
        if not wish:
            return label
        moves = {n: w[1] for n, w in wish.items() if all(wish[o] >= w for o in near[n] if o in wish)}
        label, step = label | moves, step + 1


GRAPHS = {
    "bipartite": [(a, b) for a in (1, 2, 3) for b in (10, 20, 30)],
    "hub": [(0, i) for i in range(1, 12)],
    "path": [(i, i + 1) for i in range(25)],
    "two cliques": [(a, b) for g in (range(5), range(10, 15)) for a in g for b in g if a < b] + [(4, 10)],
    "random": [(random.Random(7 + i).randrange(20), random.Random(70 + i).randrange(20)) for i in range(40)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_labels_settle(spark, name):
    pairs = GRAPHS[name]
    got = {r.node: r.label for r in G.label_propagation(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == settle(pairs)
    for n in got:
        votes = Counter(got[b if a == n else a] for a, b in {(min(p), max(p)) for p in pairs} if n in (a, b) and a != b)
        assert votes[got[n]] == max(votes.values())
    if name == "two cliques":
        assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1


def test_ranks_of_a_cycle_and_without_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    got = {r.node: r.score for r in G.pagerank(links, nodes, 7, 1e-7).collect()}
    rank = dict.fromkeys("abcdefg", 1 / 7)
    out = {"a": "bd", "b": "c", "c": "a"}
    for _ in range(400):
        lost = sum(r for n, r in rank.items() if n not in out)
        rank = {n: 0.15 / 7 + 0.85 * (lost / 7 + sum(rank[m] / len(o) for m, o in out.items() if n in o)) for n in rank}
    assert got == pytest.approx({n: rank[n] for n in "abcde"}, abs=1e-7)
    none = G.pagerank(links.limit(0), nodes, 7).collect()
    assert [r.score for r in none] == pytest.approx([1 / 7] * 5)


def test_leaders_and_their_cells(spark):
    links = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", "c"), ("x", "y")], "a string, b string")
    actors = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    found = G.ringleader(links, actors, 10, 2)
    first = found["influence"].orderBy("place").first()
    assert first.node == "c" and first.score_vs_baseline > 1.5
    assert [(r.node, r.size) for r in found["cell"].orderBy("place").collect()] == [(n, 4) for n in "abcd"]
    assert {(r.component, r.node) for r in found["communities"].collect()} == {("a", n) for n in "abcd"} | {("x", "x"), ("x", "y")}
    assert {r.node for r in found["label_propagation"].collect()} == set("abcdxy")


@pytest.mark.parametrize("most", [None, 0, 1, 6, 9, 40])
def test_lineage_of_a_long_chain(spark, most):
    heads = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 5)], "id long, via long")
    hits = spark.createDataFrame([(0,), (28,), (30,), (100,), (0,)], "id long")
    got = {}
    for r in G.lineage(hits, heads, most).collect():
        assert got.setdefault((r.id, r.step), r.node) == r.node
    paths = {0: list(range(31)), 28: [28, 29, 30], 30: [30], 100: [100, *range(5, 31)]}
    assert got == {(i, step): n for i, p in paths.items() for step, n in enumerate(p) if most is None or step <= most}


def test_trees_find_what_changed(spark, tmp_path):
    one = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("v"))
    two = one.where("id <> '5'").withColumn("v", F.when(F.col("id") == "9", "new").otherwise(F.col("v"))).union(spark.createDataFrame([("9", "new"), ("x", None)], "id string, v string"))
    for name, rows in (("a", one), ("b", two), ("c", one.repartition(5)), ("e", one.limit(0))):
        T.write_tree(rows, ["id"], ["id", "v"], str(tmp_path / name))
    a, b, c, e = (str(tmp_path / n) for n in "abce")
    leaf = lambda k: hashlib.sha256(k.encode()).hexdigest()[:4]
    changed = {r.path for r in T.changed_ranges(spark, a, b).collect()}
    assert changed == {leaf(k) for k in ("5", "9", "x")}
    lines = sorted((r.key, r.change, r.line) for r in T.changed_lines(spark, a, b).collect())
    assert lines == [("5", "gone", "5\x1f5"), ("9", "gone", "9\x1f2"), ("9", "new", "9\x1fnew"), ("9", "new", "9\x1fnew"), ("x", "new", "x\x1f")]
    assert T.changed_ranges(spark, a, c).count() == 0 and T.root(spark, a).collect() == T.root(spark, c).collect()
    assert T.changed_lines(spark, a, e).count() == 400 and T.root(spark, e).count() == 0 and T.changed_lines(spark, e, e).count() == 0


def test_chunks_within_questions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    questions = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(4)] + [(4, [0.0] * 4), (5, [1.0, 2.0])]
    chunks = [(int(rng.integers(6)), i, [float(x) for x in rng.normal(size=4)]) for i in range(80)] + [(0, 900, [0.0] * 4), (1, 901, None), (0, 902, [1.0])]
    got = R.nearest_within(spark.createDataFrame(questions, "question_id long, embedding array<double>"), spark.createDataFrame(chunks, "question_id long, chunk_id long, embedding array<double>"), 3)
    want = set()
    for q, v in questions[:4]:
        sims = sorted(((-round(float(np.dot(v, c) / np.linalg.norm(v) / np.linalg.norm(c)), 9), i) for g, i, c in chunks if g == q and c and len(c) == 4 and any(c)))
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(sims[:3])}
    assert {(r.question_id, r.chunk_id, r.place) for r in got.collect()} == want


def test_nearest_leaves_vectors_without_direction_out(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1e200, 1e200]), (9, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in R.nearest(v, v, 10).collect())
    assert {q for q, *_ in one} == {1, 2, 3, 8} and len(one) == 12
    assert next(d for q, i, d, _ in one if (q, i) == (3, 8)) == pytest.approx(1 - 2**-0.5, abs=1e-8)
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    assert sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in R.nearest(v, v, 10).collect()) == one


def test_chunks_served_with_their_sessions(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, embedding array<double>")
    c = spark.createDataFrame([(1, "s1", 0, "user: a\nassistant: b", [1.0, 0.1]), (1, "s2", 0, "user: c", [1.0, 0.0]), (1, "s1", 2, "user: d", [0.0, 1.0]), (2, "s3", 0, "user: e", [1.0, 0.0])], "question_id long, session_id string, start int, chunk string, embedding array<double>")
    blocks, served = R.served_chunks(q, c, 2)
    assert [(r.session_id, r.start, r.session_rank) for r in blocks.orderBy("place").collect()] == [("s2", 0, 1), ("s1", 0, 2)]
    r = served.first()
    assert (r.context, r.session_ids) == ("[1] session s2\n    user: c\n[2] session s1\n    user: a\n    assistant: b", ["s2", "s1"])


def test_labels_of_meetings_send_notes_and_no_links(spark, monkeypatch):
    from engram.operators import labels as L

    rng = random.Random(5)
    edits = [(f"n{rng.randrange(40)}", f"p{rng.randrange(3)}", rng.randrange(-3000, 9000)) for _ in range(400)] + [("n1", None, 5), (None, "p1", 5), ("alone", "p9", 5)]
    rows = [e for e in edits if None not in e]
    pairs = {(min(a, b), max(a, b)) for a, p, s in rows for b, q, t in rows if p == q and a != b and abs(s - t) <= 20}
    tables = []

    def kept(df, name, **seen):
        tables.append((name, written(df, name, **seen)))
        return tables[-1][1]

    written = L.written
    monkeypatch.setattr(L, "written", kept)
    monkeypatch.setattr(L, "spent", lambda *_: None)
    got = {r.node: r.label for r in G.coedit_labels(spark.createDataFrame(edits, "actor string, page string, ts_us long"), 20).collect()}
    assert got == settle(pairs) and len(got) > 30
    notes = [df.count() for name, df in tables if name == "notes"]
    assert len(notes) > 2 and max(notes) <= L.LEAST_PARTS * (L.LEAST_PARTS + 1) < len(pairs)
    assert G.coedit_labels(spark.createDataFrame([("a", "p", 1)], "actor string, page string, ts_us long"), 20).count() == 0


def test_changed_lines_meet_once(spark, tmp_path):
    one = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("v").alias("v"))
    two = one.where("id <> '7'").union(spark.createDataFrame([("8", "v"), ("8", "v")], "id string, v string"))
    for name, rows in (("a", one), ("b", two)):
        T.write_tree(rows, ["id"], ["v"], str(tmp_path / name))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    lines = T.changed_lines(spark, a, b)
    assert sorted((r.key, r.change) for r in lines.collect()) == [("7", "gone"), ("8", "new"), ("8", "new")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("LeftSemi") == 2
    for leaf in "89":  # digests are sums of four parts of 60 bits
        path = hashlib.sha256(leaf.encode()).hexdigest()[:4]
        held = [k for k in map(str, range(300)) if hashlib.sha256(k.encode()).hexdigest()[:4] == path]
        sums = [sum(int(hashlib.sha256(b"v").hexdigest()[15 * i : 15 * i + 15], 16) for _ in held) for i in range(4)]
        want = hashlib.sha256(",".join(map(str, [*sums, len(held)])).encode()).hexdigest()
        assert spark.read.parquet(f"{a}/nodes/depth=4").where(F.col("path") == path).first().digest == want


def test_a_page_is_its_first_events_author(spark, tmp_path):
    from engram.plans import registry

    rows = [(1, "2024-01-02", 7), (2, "2024-01-01", 8)]  # ids do not follow times
    events = spark.createDataFrame(rows, "event_id long, at string, user_id long")
    events.selectExpr("event_id", "cast(at as timestamp_ntz) as ts", "user_id", "'edit' as event_type", "1.0d as value", "'{\"k\": 3}' as props").write.parquet(str(tmp_path / "events.parquet"))
    assert [r.author for r in registry._nodes(spark, str(tmp_path)).where("label = 'Page'").collect()] == ["7"]
