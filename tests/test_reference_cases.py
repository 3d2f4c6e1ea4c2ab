"""Golden and discriminating cases on small hand-built tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import columns as C
from engram.functions.embed import embed, trigram_vector, word_vector
from engram.operators import graph as G, memory as M, metrics as X, retrieval as R
from engram.sources import log_files as L
from engram.operators.novelty import gate
from engram.streaming import log as SL

S = 1_000_000
EDIT = "event_id long, actor string, page string, ts_us long"


def edits(spark, spread, base=1_700_000_000):
    rows = [("N", "transit", 0), ("V", "transit", 1), ("V", "grid", 2), ("W", "grid", 3), ("N", "water", 0), ("W", "civic", 3)]
    return spark.createDataFrame([(i, a, p, (base + spread * k) * S) for i, (a, p, k) in enumerate(rows)], EDIT)


def test_ring_fires_and_does_not(spark):
    found = G.rings(edits(spark, 120), 720 * S).collect()
    assert [(r.actors, r.pages, r.span_us, r.closeness) for r in found] == [("N|V|W", "grid|transit", 360 * S, 0.5)]
    assert G.rings(edits(spark, 86_400), 720 * S).count() == 0
    assert G.rings(edits(spark, 120), 720 * S, anchor="N").count() == 1 and G.rings(edits(spark, 120), 720 * S, anchor="Z").count() == 0
    assert G.rings(edits(spark, 120), 720 * S, since=(1_700_000_000 + 130) * S).count() == 0
    verdict = G.ring_verdict(G.rings(edits(spark, 120), 720 * S)).first()
    assert (verdict.rings, verdict.ring_score, verdict.should_open_case) == (1, 0.5, True)
    assert not G.ring_verdict(G.rings(edits(spark, 120).limit(0), 720 * S)).first().should_open_case


def test_coedit(spark):
    df = spark.createDataFrame([(1, "Alice", "p", 1000 * S), (2, "Bob", "p", 1100 * S), (3, "Cy", "p", 9000 * S)], EDIT)
    assert [tuple(r) for r in G.coedited_windowed(df, 720 * S).collect()] == [("Alice", "Bob", 1, 100 * S)]
    assert G.coedited_weight(df).count() == 3


def test_pagerank_golden_values(spark):
    links = spark.createDataFrame([("N", "V"), ("W", "V")], "a string, b string")
    nodes = spark.createDataFrame([("N",), ("V",), ("W",)], "node string")
    got = {r.node: r.score for r in G.pagerank(links, nodes, 12).collect()}
    assert all(abs(got[n] - x) < 2e-6 for n, x in {"V": 0.197079, "N": 0.072993, "W": 0.072993}.items())
    assert [tuple(r) for r in G.cells(G.components(links)).collect()] == [("N", 3)]


def test_lineage(spark):
    def pairs(rows):
        df = spark.createDataFrame(rows, "id string, subject string, predicate string, valid_us long, text string")
        return {tuple(r) for r in G.supersede_pairs(df).collect()}

    cars = [("c1", "u", "drives", 1, "Civic"), ("c2", "u", "drives", 2, "Tesla"), ("c3", "u", "drives", 3, "Rivian")]
    assert pairs(cars) == {("c2", "c1", "supersedes"), ("c3", "c2", "supersedes")}
    assert pairs([("c1", "u", "p", 1, "a"), ("c2", "u", "p", 1, "b")]) == {("c2", "c1", "contradicts")}
    assert pairs([("c1", "u", "p", 1, "a"), ("c2", "u", "p", 2, "a"), ("c3", "u", "q", 3, "b")]) == set()
    chain = spark.createDataFrame([(f"v{i + 1:02}", f"v{i:02}", "supersedes") for i in range(1, 9)], "newer string, older string, relation string")
    clocks = spark.createDataFrame([], "id string, clock long")
    heads = G.supersede_heads(chain, clocks)
    got = {r.id: (r.head, r.depth) for r in heads.collect()}
    assert got["v01"] == ("v09", 8) and got["v08"] == ("v09", 1) and len(got) == 8
    hits = spark.createDataFrame([("v06",), ("v09",)], "id string")
    assert sorted((r.id, r.step, r.node) for r in G.lineage(hits, heads).collect()) == [("v06", 0, "v06"), ("v06", 1, "v07"), ("v06", 2, "v08"), ("v06", 3, "v09"), ("v09", 0, "v09")]
    assert G.lineage(hits, heads, 1).count() == 3
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    new = spark.createDataFrame([("a", "c"), ("a", "a"), ("d", "a")], "src string, dst string")
    assert {tuple(r) for r in G.reaches(edges, new).collect()} == {("a", "c"), ("a", "a")}


def test_forked_lineage(spark):
    """The longest chain wins, then the newest head, then the smaller id; cycles end the walk."""
    def heads(pairs, clocks=()):
        df = spark.createDataFrame(pairs, "newer string, older string")
        return {r.id: (r.head, r.depth) for r in G.supersede_heads(df, spark.createDataFrame(list(clocks), "id string, clock long")).collect()}

    assert heads([("b", "old"), ("c", "b"), ("z", "old")]) == {"old": ("c", 2), "b": ("c", 1)}
    assert heads([("new_a", "old"), ("new_b", "old")], [("new_a", 5), ("new_b", 7)]) == {"old": ("new_b", 1)}
    assert heads([("new_b", "old"), ("new_a", "old")]) == {"old": ("new_a", 1)}
    ladder = [(f"n{i + 1:02}", f"n{i:02}") for i in range(20)] + [("n12", "n03"), ("y", "n10"), ("x2", "x1"), ("x1", "n05")]
    assert heads(ladder)["n00"] == ("n20", 20) and heads(ladder)["n18"] == ("n20", 2)
    assert heads([("b", "a"), ("c", "b"), ("a", "c"), ("b", "s"), ("h", "t"), ("a", "t")]) == {"t": ("h", 1)}


def test_handovers(spark):
    rows = [("r", 1, 10, "open"), ("r", 2, 20, "open"), ("s", 3, 10, "open"), ("s", 4, 20, "done")]
    df = spark.createDataFrame(rows, "to_agent string, handover_id long, created_us long, status string")
    assert {(r.handover_id, r.status) for r in M.close_handovers(df).collect()} == {(1, "superseded"), (2, "open"), (3, "superseded"), (4, "done")}
    assert {r.handover_id for r in M.read_handover(df).collect()} == {2}
    assert {r.handover_id for r in M.open_handovers(df).collect()} == {2, 3}


def test_upserts_and_relations(spark):
    stored = spark.createDataFrame([("x", "first", 1)], "id string, author string, n int")
    new = spark.createDataFrame([("x", "second", 2), ("y", "third", 3)], "id string, author string, n int")
    once = M.merge_nodes(stored, new, "id", ["author"])
    assert {tuple(r) for r in once.collect()} == {("x", "first", 2), ("y", "third", 3)}
    assert {tuple(r) for r in M.merge_nodes(once, new, "id", ["author"]).collect()} == {tuple(r) for r in once.collect()}
    edges = spark.createDataFrame([("x", "references", "y")], "src string, relation string, dst string")
    asked = spark.createDataFrame([("x", "references", "y"), ("y", "references", "x"), ("x", "references", "ghost")], edges.schema)
    after, missing = M.relate(edges, asked, once)
    assert after.count() == 2 and [r.dst for r in missing.collect()] == ["ghost"]


def test_relate_tells_each_proposal_once(spark):
    nodes = spark.createDataFrame([("x",), ("y",), (None,)], "id string")
    edges = spark.createDataFrame([], "src string, relation string, dst string")
    asked = spark.createDataFrame([("x", None, "y"), ("x", "r", None), (None, "r", "y"), ("x", "r", "z")], edges.schema)
    after, missing = M.relate(edges, asked, nodes)
    assert [tuple(r) for r in after.collect()] == [("x", None, "y")]
    assert {tuple(r) for r in missing.collect()} == {("x", "r", None), (None, "r", "y"), ("x", "r", "z")}


def test_digest_depends_on_content_only(spark):
    nodes = spark.createDataFrame([("Actor", "a", "x"), ("Page", "p", None)], "label string, key string, author string")
    edges = spark.createDataFrame([("a", "EDITED", "", "p", "")], "src string, relation string, relation_key string, dst string, author string")
    one = M.digest(nodes, edges).first()
    assert one == M.digest(nodes.orderBy(F.desc("key")).repartition(3), edges).first()
    lines = "\n".join(sorted(["Actor\x1fa\x1fx", "Page\x1fp\x1f"]))
    assert one.nodes_digest == hashlib.sha256(lines.encode()).hexdigest()
    changed = nodes.withColumn("author", F.lit("other"))
    assert M.digest(changed, edges).first().graph_digest != one.graph_digest


def test_digest_gathers_no_lines_in_one_value(spark, capsys):
    nodes = spark.range(20_000).select(F.lit("L").alias("label"), F.col("id").cast("string").alias("key"), F.lit("a").alias("author"))
    edges = spark.createDataFrame([], "src string, relation string, relation_key string, dst string, author string")
    out = M.digest(nodes, edges)
    out.explain()
    assert "listagg" not in capsys.readouterr().out.lower()
    lines = "\n".join(sorted(f"L\x1f{i}\x1fa" for i in range(20_000)))
    assert out.first() == (hashlib.sha256(lines.encode()).hexdigest(), None, None)


def test_digest_sorts_lines_in_parallel(spark, capsys):
    lines = [("L", str(i % 5_000), "é" * (i % 3)) for i in range(30_000)]
    nodes = spark.createDataFrame(lines, "label string, key string, author string").repartition(7)
    edges = spark.createDataFrame([], "src string, relation string, relation_key string, dst string, author string")
    out = M.digest(nodes, edges)
    assert out.first().nodes_digest == hashlib.sha256("\n".join(sorted("\x1f".join(x) for x in lines)).encode()).hexdigest()
    out.explain()
    assert capsys.readouterr().out.count("rangepartitioning(line") == 2


def test_columns(spark):
    rows = [("2023/04/10 (Mon) 17:50", " New--York  City! ", "Works At"), ("garbage", "", ""), ("", None, "--")]
    df = spark.createDataFrame(rows, "d string, e string, p string")
    got = df.select(C.date_iso(F.col("d")), C.normalize_entity(F.col("e")), C.normalize_predicate(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("2023-04-10T17:50", "new york city", "works_at"), ("", "", "unspecified"), ("", None, "unspecified")]
    ranks = spark.createDataFrame([(["x", "a", "y", "b"], ["a", "b"])], "r array<string>, g array<string>")
    assert tuple(ranks.select(*(C.recall_at(F.col("r"), F.col("g"), k) for k in (1, 2, 4))).first()) == (0.0, 0.5, 1.0)


def test_retrieval(spark):
    lists = [spark.createDataFrame([("q", i, r) for r, i in enumerate(ids, 1)], "query_id string, id string, rank int") for ids in (["a", "b", "c"], ["b", "d"])]
    assert [r.id for r in R.fuse_ranks(lists, 4).orderBy("place").collect()] == ["b", "a", "d", "c"]
    turns = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(7)] + [(2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    chunks = {(r.conv_id, r.start, r.n_turns): r.chunk for r in R.turn_chunks(turns).collect()}
    assert set(chunks) == {(1, 0, 4), (1, 2, 4), (1, 4, 3), (2, 0, 1)}
    assert chunks[1, 4, 3] == "user: t4\nuser: t5\nuser: t6" and chunks[2, 0, 1] == "assistant: "
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.05]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.distance == 0) for r in R.nearest(v.where("vec_id = 0"), v, 2).orderBy("rank").collect()] == [(1, True), (2, False)]


def test_votes_and_guards(spark):
    def panel(**families):
        return [(f, {"t": True, "f": False, "-": None}[v]) for f, votes in families.items() for v in votes]

    panels = {
        1: (panel(a="tt", b="t"), (True, True, True)), 2: (panel(a="t", b="f"), (None, False, False)),
        # half of a family's votes unread leave it a label, two thirds do not
        3: (panel(a="tt--"), (True, True, True)), 4: (panel(a="t--", b="f"), (False, False, False)), 5: (panel(a="t-", b="f"), (None, False, False)),
        6: (panel(a="f", b="ff"), (False, False, True)), 7: (panel(a="-", b="--"), (None, False, False)), 8: (panel(a="t", b="-"), (True, False, False)), 9: (panel(a="tf", b="t"), (True, False, False)),
    }
    votes = spark.createDataFrame([(i, *v) for i, (rows, _) in panels.items() for v in rows], "id int, family string, vote boolean")
    assert {r.id: (r.verdict, r.floor, r.unanimous) for r in X.majority(votes).collect()} == {i: want for i, (_, want) in panels.items()}
    assert {r.family: (r.n, r.accuracy) for r in X.family_accuracy(votes).collect()} == {"a": (9, 5 / 9), "b": (8, 2 / 8)}
    rows = spark.createDataFrame([("q1", "t", "s", True, 3, 0), ("q1", "t", "s2", None, 30, 0)], "question_id string, question_type string, split string, label boolean, returned int, flag int")
    bad = {r.check_name: r.n for r in X.violations(rows, 3, 12).collect()}
    assert bad == {"complete": 1, "no_duplicates": 1, "one_split": 1, "within_budget": 1, "judged": 1, "too_good": 1}


def test_ndjson_and_mapping(spark, tmp_path):
    path = tmp_path / "events.ndjson"
    good = '{"type":"edit","user":"U","title":"T","wiki":"w","timestamp":1785757268,"length":{"old":43087,"new":43205},"meta":{"id":"m1","offset":7}}'
    path.write_text(f'{good}\n\nnot json\n{{"title":"no user"}}\n{good.replace("m1", "m2")}\n')
    raw = L.read_ndjson(spark, str(path))
    assert raw.count() == 3 and L.read_ndjson(spark, str(path), limit=1).count() == 1
    mapped = L.map_events(raw).orderBy("event_id").collect()
    assert [(r.event_id, r.bytes_delta, r.offset, r.ts) for r in mapped] == [("m1", 118, 7, 1785757268.0), ("m2", 118, 7, 1785757268.0)]
    assert L.resolve_source("sse")[0] == "stream" and L.resolve_source("file:///a") == ("file", "/a")


def test_question_unnest(spark):
    turn = "struct<role:string,content:string,has_answer:boolean>"
    schema = f"question_id string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<{turn}>>"
    two = [("user", "a", False), ("assistant", "b", True)]
    df = spark.createDataFrame([("q", ["2023/06/01", "2023/01/01"], ["s2", "s1"], [two, two])], schema)
    sessions, turns = L.questions_to_turns(df)
    assert [(r.session_id, r.ordinal) for r in sessions.orderBy("ordinal").collect()] == [("s1", 0), ("s2", 1)] and turns.count() == 4
    bad = spark.createDataFrame([("q", ["2023/06/01"], ["s2", "s1"], [two, two])], schema)
    with pytest.raises(Exception, match="differ in number"):
        L.questions_to_turns(bad)[0].collect()


def test_log_replay_parity(spark, tmp_path):
    rows = spark.createDataFrame([(f"w{i % 3}", i, 1000 * i, f"v{i}") for i in range(50)], "key string, event_id long, ts_us long, value string")
    log = str(tmp_path / "log")
    SL.append_to_log(rows.where("event_id < 30"), log)
    SL.append_to_log(rows.where("event_id >= 30"), log)
    whole = SL.read_log(spark, log)
    assert whole.select("part", "off").distinct().count() == 50
    ends = {r.part: (r.n, r.m) for r in whole.groupBy("part").agg(F.count("*").alias("n"), F.max("off").alias("m")).collect()}
    assert all(n == m + 1 for n, m in ends.values())
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    SL.drain(SL.follow_log(spark, log), sink, check)
    SL.drain(SL.follow_log(spark, log), sink, check)  # nothing new: nothing doubled
    warm = spark.read.parquet(sink).drop("batch")
    assert SL.same_records(warm, whole) and not SL.same_records(warm.limit(49), whole)


def test_redelivered_records_surface_once(spark, tmp_path):
    log, sink, check, topic = (str(tmp_path / n) for n in ("log", "sink", "check", "topic"))
    rows = spark.range(40).select(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("key"), F.col("id").alias("event_id"), F.col("id").alias("ts_us"), F.lit("v").alias("value"), (F.col("id") % 2).cast("int").alias("part"), F.floor(F.col("id") / 2).alias("off"))
    rows.where("event_id < 30").write.parquet(f"{log}/batch=a")
    SL.drain(SL.follow_log(spark, log), sink, check, lambda d: d.where("event_id % 10 = 0"), topic)
    # a later file brings old records again, in another order, some of them twice, and new ones below them
    again = rows.where("event_id >= 12").union(rows.where("event_id > 33")).orderBy(F.desc("event_id")).coalesce(1)
    again.write.parquet(f"{log}/batch=b")
    SL.drain(SL.follow_log(spark, log), sink, check, lambda d: d.where("event_id % 10 = 0"), topic)
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == list(range(40))
    assert sorted(r.event_id for r in spark.read.json(topic).collect()) == [0, 10, 20, 30]


def test_a_batch_appended_again_replaces_itself(spark, tmp_path):
    log = str(tmp_path / "log")
    for name, low in (("one", 0), ("two", 10), ("one", 0), ("two", 10)):
        rows = spark.range(low, low + 10).select(F.lit("k").alias("key"), F.col("id").alias("event_id"), F.col("id").alias("ts_us"), F.lit("v").alias("value"))
        SL.append_to_log(rows, log, 2, name)
    assert [(r.event_id, r.off) for r in SL.read_log(spark, log).orderBy("event_id").collect()] == [(i, i) for i in range(20)]


def test_gate_stream_keeps_what_it_admitted(spark, tmp_path):
    path = str(tmp_path / "rows")
    rng = np.random.default_rng(2)
    rows = [("g", i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(40)]
    schema = "graph_key string, place long, embedding array<float>"
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        out = SL.gate_stream(spark.readStream.schema(schema).parquet(path), 0.15, str(tmp_path / "gate"), str(tmp_path / "c"))
    got = {r.place: r.admitted for r in out.collect()}
    want = {r.place: r.admitted for r in gate(spark.createDataFrame(rows, schema), 0.15).collect()}
    assert got == want and 0 < sum(got.values()) < 40


def test_numbers_and_joins_of_a_hot_key(spark):
    from engram.operators.steps import join_split, numbered

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise("hot").alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    got = numbered(rows, "g", ["v"], "n").collect()
    for g in ("hot", None):
        own = sorted((r.v, r.n) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(len(own)))
    a, b = rows.where("g = 'hot'").limit(50).select("g", F.col("v").alias("x")), rows.where("g = 'hot'").select("g", F.col("v").alias("y"))
    assert join_split(a, b, ["g"], 100).distinct().count() == 50 * 2000


def test_rounding_is_of_the_exact_number(spark):
    values = [2.675, 0.125, 0.375, 1.005, 66.65, -2.675, 1e300, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (1, 2):
        assert [r[0] for r in df.select(C.round_half_even(F.col("v"), places)).collect()] == [round(v, places) for v in values]


def test_route_patterns(spark):
    asked = ["How many weeks since March?", "Which is best for me, should I switch now?", "On 2023/04/10", "top of 1999", "Tell me more", None]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in R.route(F.col("q")).items())).collect()]
    assert got == [
        (True, False, False, False, False, 5), (False, False, True, True, True, 9), (False, True, False, False, False, 2),
        (False, True, False, True, False, 3), (False, False, False, False, False, 3), (False, False, False, False, False, 0),
    ]


def test_guards_and_combination(spark):
    panel = spark.createDataFrame([(1, "claude-3", ["gpt-4o", "gemini", "llama"]), (2, "gpt-4o", ["GPT-4", "gemini", "llama"]), (3, "x", ["gpt-4", "gpt-3.5", "llama"])], "panel_id int, reader string, judges array<string>")
    assert {tuple(r) for r in X.family_clashes(panel).collect()} == {(2, "same family"), (3, "unknown family"), (3, "too few families")}
    one = spark.createDataFrame([("qa.micro", 0.5), ("qa.macro", 0.4)], "name string, value double")
    other = spark.createDataFrame([("qa.micro", 0.6)], one.schema)
    assert X.combine_metrics(one, one).count() == 2
    for bad in ((one, other), (other,)):
        with pytest.raises(Exception, match="differing values|micro and macro"):
            X.combine_metrics(*bad).collect()


def test_embedding_cache_and_remember(spark):
    cache = spark.createDataFrame([], "cache_key string, embedding array<float>")
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string")
    out, made = M.embedded(texts, cache, "word", 16)
    made = spark.createDataFrame(made.collect(), made.schema)
    assert out.count() == 3 and made.count() == 2
    assert M.embedded(texts, made, "word", 16)[1].count() == 0
    rows = spark.createDataFrame([("Claim", "note", "x", ["t"], {"b": "1", "a": "2"}, "me", 5), ("Claim", "note", "x", ["u"], None, "you", 9)], "label string, block_type string, text string, tags array<string>, metadata map<string,string>, author string, ts_us long")
    none = spark.createDataFrame([], "id string, label string, block_type string, text string, tags array<string>, metadata_json string, author string, created_us long, updated_us long")
    after = M.remember(none, rows)
    r = after.first()
    assert after.count() == 1 and (r.tags, r.metadata_json, r.author, r.created_us, r.updated_us) == (["u"], "{}", "you", 5, 9)
    near = after.select("id", F.lit(0.1).alias("distance"))
    assert M.remember(none, rows, near).count() == 0


def test_gate_equals_a_plain_fold(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 2}", i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "graph_key string, place long, embedding array<float>").repartition(5)
    got = {r.place: r.admitted for r in gate(df, 0.15).collect()}
    for g in ("g0", "g1"):
        held = []
        for _, place, v in (r for r in rows if r[0] == g):
            x = np.float64(np.float32(v)) / np.linalg.norm(np.float32(v))
            ok = not held or 1 - max(float(h @ x) for h in held) >= 0.15
            assert got[place] == ok
            if ok:
                held.append(x)


def test_embedders(spark):
    df = spark.createDataFrame([("a cat sat",), ("",), (None,), ("a cat sat",)], "t string")
    for kind, one in (("trigram", trigram_vector), ("word", word_vector)):
        got = [np.array(r[0]) for r in df.select(embed(F.col("t"), kind)).collect()]
        assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in got) and (got[0] == got[3]).all()
        assert np.allclose(got[0], one("a cat sat", 256), atol=1e-6)
    with pytest.raises(ValueError):
        embed(F.col("t"), "other")


def test_every_sql_has_a_query():
    from engram.plans import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 45


def test_recall_of_first_holds_no_group(spark, capsys):
    from engram.operators import retrieval as R

    rows = [("a", i, i % 3 == 0) for i in range(30)] + [("b", i, False) for i in range(5)] + [(None, 7, True), (None, 8, None), ("c", 1, True), ("c", 1, True)]
    got = R.recall_of_first(spark.createDataFrame(rows, "source string, doc_id long, gold boolean").repartition(3), "source", "doc_id", "gold", 10)
    got.explain()
    shown = capsys.readouterr().out
    assert "collect_list" not in shown and "WindowGroupLimit" in shown
    assert {tuple(r) for r in got.collect()} == {("a", 0.4), ("b", 0.0), (None, 1.0), ("c", 0.5)}


def test_recall_query_equals_brute_force(spark, sf_dir):
    from engram.plans import registry

    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    groups = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        if r.doc_id in docs:
            groups.setdefault(docs[r.doc_id], []).append((r.doc_id, r.quality == 1))
    want = {}
    for source, rows in groups.items():
        gold = {i for i, good in rows if good}
        want[source] = len({i for i, _ in sorted(rows)[:10]} & gold) / len(gold) if gold else 0.0
    assert {r.source: r.recall_10 for r in registry.recall_at_k(spark, sf_dir).collect()} == pytest.approx(want)
