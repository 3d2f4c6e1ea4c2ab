"""Remembering, counted upserts, and the text index."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from engram.api import Engine
from engram.operators import lexical as L, memory as M

NODES = "id string, label string, text string, author string, clock long, embedding array<double>"


def stable(*parts):
    return "blk_" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def test_remember(spark):
    stored = spark.createDataFrame([("e1", "Event", "old text", "ann", 5, [1.0, 0.0]), ("c1", "Claim", "near", "ann", 6, [0.0, 1.0])], NODES)
    rows = spark.createDataFrame(
        [
            (None, None, "fix", {"a": "1"}, ["t"], None, None, "plain", "k1", None),
            ("e1", "Event", None, None, None, None, 7.5, "new text", None, None),
            (None, "Claim", "learning", {"kind": "own"}, None, [0.0, 1.001], None, "too near", None, None),
            (None, "Claim", "note", None, None, [1.0, 1.0], 2.0, "apart", "k1", "because"),
            (None, "Claim", "note", None, None, [1.0, 1.01], 3.0, "near the one before", None, None),
            (None, "Claim", "note", None, None, [0.0, 0.0], 3.0, "no direction", None, None),
        ],
        "id string, label string, block_type string, metadata map<string,string>, tags array<string>, embedding array<float>, ts double, content string, case_id string, why string",
    )
    after, receipt = M.remember_nodes(stored, rows, author="me", threshold=0.15, now_us=F.lit(99).cast("long"))
    told = {r.id: r for r in receipt.collect()}
    plain = told[stable("Claim", "decision", "plain")]
    assert (plain.block_type, plain.created, plain.skipped, plain.distance, plain.case_id) == ("decision", True, False, None, "k1")
    assert told["e1"].created is False
    assert told[stable("Claim", "note", "too near")].skipped and told[stable("Claim", "note", "near the one before")].skipped
    assert not told[stable("Claim", "note", "apart")].skipped and not told[stable("Claim", "note", "no direction")].skipped
    nodes = {r.id: r for r in after.collect()}
    assert len(nodes) == 5
    assert json.loads(nodes[plain.id].metadata_json) == {"a": "1", "kind": "fix"} and nodes[plain.id].clock == 99
    event = nodes["e1"]
    assert (event.text, event.summary, event.author, event.clock, event.ts, event.embedding, event.updated_us) == ("new text", "new text", "me", 5, 7.5, [1.0, 0.0], 99)
    again = M.remember_nodes(after, rows.where("content = 'plain'"), now_us=F.lit(120).cast("long"))
    assert [(r.id, r.created) for r in again[1].collect()] == [(plain.id, False)]
    kept = {r.id: r for r in again[0].collect()}
    assert len(kept) == 5 and (kept[plain.id].created_us, kept[plain.id].updated_us) == (99, 120)

    engine = Engine(spark, stored, spark.createDataFrame([], "src string, relation string, dst string"), spark.createDataFrame([], "event_id long, actor string, page string, ts_us long"))
    cases, links = spark.createDataFrame([], "id string, status string, opened_us long"), spark.createDataFrame([], "src string, relation string, dst string, why string")
    cases, links = engine.link_case(cases, links, receipt)
    assert [(r.id, r.status) for r in cases.collect()] == [("k1", "open")]
    assert {(r.dst, r.why) for r in links.collect()} == {(plain.id, "remember"), (stable("Claim", "note", "apart"), "because")}


@pytest.mark.parametrize("column", ["label", "block_type"])
def test_unknown_words_raise(spark, column):
    stored = spark.createDataFrame([], NODES)
    rows = spark.createDataFrame([("x", "guess")], f"content string, {column} string")
    with pytest.raises(Exception, match="unknown"):
        M.remember_nodes(stored, rows)[0].collect()


def test_contents_of_all_kinds(spark):
    stored = spark.createDataFrame([], NODES)
    for content, text in ((7, "7"), (True, "True"), ([1, 2], "[1,2]"), (None, "")):
        kind = {int: "long", bool: "boolean", list: "array<int>"}.get(type(content), "string")
        after, _ = M.remember_nodes(stored, spark.createDataFrame([(content,)], f"content {kind}"))
        assert [(r.id, r.text) for r in after.collect()] == [(stable("Claim", "note", text), text)]


def test_counted_upsert(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", None)], "id long, first string, last string")
    rows = spark.createDataFrame([(2, "b", "y"), (3, "d", "z"), (4, "e", None)], "id long, first string, last string")
    got = M.upsert_counted(stored, rows, "id", ["first"], str(tmp_path / "t"))
    # set: 2.first, 2.last, 3.last, 4.first; 2.last stays what it was
    assert got == {"created": 1, "matched": 2, "kept": 1, "properties_set": 4, "properties_changed": 3}
    after = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, after.collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "e", None)]
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, M.merge_nodes(stored, rows, "id", ["first"]).collect()))
    plain = M.mutation_counts(stored, rows, "id").first().asDict()
    assert plain == {c: got[c] for c in plain}
    assert M.upsert_counted(stored.limit(0), rows.limit(0), "id", [], str(tmp_path / "e")) == dict.fromkeys(got, 0)


DOCS = [(1, "Claim", "The river floods often"), (2, "Claim", "A RIVER runs by"), (3, "Event", "riverside walk"), (4, "Event", None), (5, "Page", "the river page"), (6, "Claim", "x"), (7, "Claim", "naïve – ünï")]


@pytest.fixture(scope="module")
def index(spark):
    more = [(100 + i, "Claim", f"filler number {i} " + "padding " * (i % 5)) for i in range(150)]  # more than two blocks
    return L.build_index(spark.createDataFrame(DOCS + more, "id long, label string, text string"))


def found(index, spark, text, labels=("Claim", "Event"), k=5):
    hits = L.search(index, spark.createDataFrame([("q", text)], "query_id string, text string"), list(labels), k)
    return [(r.id, r.lane) for r in hits.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("iver", [(1, "contains"), (2, "contains"), (3, "contains")]), ("the RIVER", [(1, "words"), (2, "words")]), ("x", [(6, "contains")]), ("ÜN", [(7, "contains")]),
        ("r run", [(2, "contains")]), ("river floods rarely", [(1, "words"), (2, "words")]), ("not there at all%", []), ("", []), ("_i", []),
    ],
)
def test_words_then_substrings(spark, index, text, want):
    assert found(index, spark, text) == want


def test_labels_one_after_the_other(spark, index, tmp_path):
    assert [i for i, _ in found(index, spark, "iver", ["Event", "Claim"], 2)] == [3, 1]
    assert [i for i, _ in found(index, spark, "filler", ["Claim"], 3)] == [100, 101, 102]
    index.save(str(tmp_path))
    assert found(L.TextIndex.load(spark, str(tmp_path)), spark, "iver") == found(index, spark, "iver")


def test_substrings_equal_a_scan(spark, index):
    texts = ["mber 1", "padding p", "r 14", "ding", "99", "zz", "g number 149 "]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {(r.query_id, r.id) for r in L.substring_hits(index, q, ["Claim"], 1000).collect()}
    docs = index.docs.where("label = 'Claim'").collect()
    assert got == {(i, d.id) for i, t in enumerate(texts) for d in docs if t.lower() in d.text.lower()}


def test_recall_falls_back_to_substrings(spark):
    nodes = spark.createDataFrame([("a", "Claim", "by the river", "me", 1, [0.0, 0.0]), ("b", "Event", "far", "me", 2, [1.0, 0.0]), ("c", "Page", "river page", "me", 3, [1.0, 0.1])], NODES)
    none = spark.createDataFrame([], "src string, relation string, dst string")
    engine = Engine(spark, nodes, none, spark.createDataFrame([], "event_id long, actor string, page string, ts_us long"))
    q = spark.createDataFrame([("q", "iver", [1.0, 0.0])], "query_id string, text string, embedding array<double>")
    assert [(r.id, r.lane) for r in engine.recall(q, mode="lexical").collect()] == [("a", "contains")]
    assert [(r.id, r.lane) for r in engine.recall(q).collect()] == [("b", "vector")]
    assert [r.id for r in engine.recall(q, labels=("Event", "Page")).orderBy("rank").collect()] == ["b", "c"]
