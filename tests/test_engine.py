"""The verbs on hand-built tables, and extraction and reading by columns."""

import pytest
from pyspark.sql import functions as F

from engram.api import Engine
from engram.operators import extraction as E, retrieval as R

S = 1_000_000


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame(
        [("v1", "Claim", "drives a Civic", "ann", 1, [1.0, 0.0]), ("v2", "Claim", "drives a Tesla", "ann", 2, [1.0, 0.1]), ("x", "Page", "power grid", "bob", 3, None)],
        "id string, label string, text string, author string, clock long, embedding array<double>",
    )
    edges = spark.createDataFrame([("v2", "supersedes", "v1")], "src string, relation string, dst string")
    rows = [("N", "transit", 0), ("V", "transit", 120), ("V", "grid", 240), ("W", "grid", 360)]
    edits = spark.createDataFrame([(i, a, p, t * S) for i, (a, p, t) in enumerate(rows)], "event_id long, actor string, page string, ts_us long")
    return Engine(spark, nodes, edges, edits)


def test_writes(spark, engine):
    new = spark.createDataFrame([("v1", "Claim", "drives", "eve", 9, None), ("n", "Page", "t", "eve", 9, None)], engine.nodes.schema)
    after = {r.id: r for r in engine.remember(new)[0].collect()}
    # the acting agent signs every write; clock and embedding stay where nothing new is given
    assert (after["v1"].text, after["v1"].author, after["v1"].clock, after["v1"].embedding) == ("drives", "eve", 1, [1.0, 0.0])
    assert (after["n"].text, after["n"].author) == ("t", "eve") and len(after) == 4
    wanted = spark.createDataFrame([("v1", "supersedes", "v2"), ("v1", "about", "x"), ("v1", "about", "gone"), ("x", "supersedes", "x")], engine.edges.schema)
    made, lost = engine.relate(wanted)
    assert {tuple(r) for r in made.select("src", "relation", "dst").collect()} == {("v2", "supersedes", "v1"), ("v1", "about", "x")}
    assert {(r.src, r.dst) for r in lost.collect()} == {("v1", "v2"), ("v1", "gone"), ("x", "x")}


def test_recall(spark, engine):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r.id, r.head, r.depth) for r in engine.recall(q).orderBy("rank").collect()] == [("v1", "v2", 1), ("v2", "v2", 0)]
    q = spark.createDataFrame([("q", "which Civic?")], "query_id string, text string")
    assert [(r.id, r.head) for r in engine.recall(q, mode="lexical").collect()] == [("v1", "v2")]
    with pytest.raises(ValueError):
        engine.recall(q, mode="guess")


def test_analytic_verbs(engine):
    assert [(r.actors, r.span_us) for r in engine.ring().collect()] == [("N|V|W", 360 * S)]
    arms = {r.arm: (r.rings, r.should_open_case) for r in engine.ablation(engine.edits.where("event_id = 3")).collect()}
    assert arms == {"warm": (1, True), "cold": (0, False)}
    assert engine.ringleader(k=1).first().cell_size == 3
    nodes, edges = engine.graph(2)
    assert {r.id for r in nodes.collect()} == {"x", "v2"} and edges.count() == 0
    assert len(engine.digest().first().graph_digest) == 64


def test_handovers(spark, engine):
    schema = "to_agent string, handover_id long, created_us long, status string"
    old, new = spark.createDataFrame([("a", 1, 1, "open")], schema), spark.createDataFrame([("a", 2, 2, "open"), ("b", 3, 3, "open"), ("b", 4, 4, "done")], schema)
    after = engine.handover_write(old, new)
    assert {r.handover_id: r.status for r in after.collect()} == {1: "superseded", 2: "open", 3: "superseded", 4: "done"}
    assert [r.to_agent for r in engine.handover_read(after).collect()] == ["a"]


def test_claims(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "I really like Green Tea in the morning. Short one."), (1, 1, "user", "yes yes yes no no no to it is so it is"), (2, 0, "user", None), (2, 1, "user", "")],
        "conv_id long, turn long, role string, text string",
    )
    got = E.claims(turns).collect()
    assert [(r.text, r.predicate, r.kind, r.entities) for r in got] == [
        ("user: I really like Green Tea in the morning.", "green_like", "preference", ["green tea", "green", "morning"])
    ]
    assert E.claims(turns.limit(0)).count() == 0
    many = spark.createDataFrame([(1, i, "user", "The Amber River floods often enough.") for i in range(50)], turns.schema)
    assert E.claims(many).count() == 40


def test_verdicts(spark):
    cases = {'{"verdict": true}': True, 'so: {"verdict": "False"} end': False, "verdict = true": True, "{broken": None, "": None, "true": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", E.verdict(F.col("t")).alias("v")).collect()} == cases
    said = spark.createDataFrame([("",), (None,), ("There is NO information about it",), ("Blue",)], "t string")
    assert [r[0] for r in said.select(E.abstained(F.col("t"))).collect()] == [True, True, True, False]


def test_reader(spark):
    q = spark.createDataFrame([(1, "Which river floods often?"), (2, "Zebra?")], "k long, question string")
    c = spark.createDataFrame([(1, 0, "Nothing of note here. The river floods often."), (1, 1, "The river floods often."), (2, 0, "Plain words here today.")], "k long, turn long, text string")
    got = {r.k: (r.answer, r.overlap) for r in E.read_answers(q, c, "k", ["turn"]).collect()}
    assert got == {1: ("The river floods often.", 1.0), 2: (None, None)}


def test_nearest_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [1.0, i / 7]) for i in range(20)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, R.nearest(v, v, 3).collect()))
    monkeypatch.setattr(R, "VECTOR_BLOCK", 3)
    monkeypatch.setattr(R, "QUERY_BLOCK", 6)
    assert sorted(map(tuple, R.nearest(v, v, 3).collect())) == one and len(one) == 60
    assert R.nearest(v.limit(0), v, 3).count() == R.nearest(v, v.limit(0), 3).count() == 0


def test_expand_counts_pairs(spark):
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "b"), (1, "b"), (4, "c")], "id long, entity string")
    seeds = spark.createDataFrame([(1,), (2,)], "id long")
    assert [tuple(r) for r in R.expand(seeds, m, 10).collect()] == [(3, 3), (1, 1), (2, 1)]


def test_row_guards(spark):
    from engram.operators import metrics as X

    rows = spark.createDataFrame([(1, "r", "m"), (2, "old", "m"), (3, "r", None), (4, None, "x")], "question_id long, run_id string, served_model string")
    got = {tuple(r) for r in X.row_violations(rows, "r", "m").collect()}
    assert got == {("fresh_rows", 2, "old"), ("served_model", 3, None), ("fresh_rows", 4, None), ("served_model", 4, "x")}
    names = spark.createDataFrame([("qa.micro",), ("retrieval.r5",), ("accuracy",), (None,)], "name string")
    assert {r.name for r in X.stray_metrics(names).collect()} == {"accuracy", None}


def test_engine_neighbours_lineage_and_counts(spark):
    from engram.api import Engine

    nodes = spark.createDataFrame([("a", "Claim", "x", "me", 1, None), ("b", "Claim", "y", None, 2, None), ("c", "Claim", "z", "me", 3, None), ("t", "Entity", "tea", "", 1, None)], "id string, label string, text string, author string, clock long, embedding array<float>")
    edges = spark.createDataFrame([("b", "supersedes", "a"), ("c", "supersedes", "b"), ("a", "MENTIONS", "t"), ("c", "ABOUT", "t")], "src string, relation string, dst string")
    e = Engine(spark, nodes, edges, spark.createDataFrame([], "event_id long, actor string, page string, ts_us long"))
    hits = spark.createDataFrame([("q", "a")], "query_id string, id string")
    assert [tuple(r) for r in e.recall_neighbours(hits).collect()] == [("q", "c", "t", "a")]
    assert sorted((r.step, r.node) for r in e.recall_lineage(hits).collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert {tuple(r) for r in e.graph_counts().collect()} >= {("label", "Claim", 3), ("relation", "supersedes", 2), ("author", "unbound", 2), ("author", "me", 2)}
