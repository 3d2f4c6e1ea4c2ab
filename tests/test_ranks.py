"""Ranks and components by blocks of actors against those over links as rows."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import blocks as B, graph as G, ranks as R

SCHEMA = "actor string, page string, ts_us long"


def edits(n=130, actors=23, pages=5):
    draw = random.Random(8)
    rows = [(f"a{draw.randrange(actors)}", f"p{draw.randrange(pages)}", draw.randrange(20_000)) for _ in range(n)]
    return rows + [("alone", "p1", 90_000), ("timeless", "p1", None), ("pageless", None, 5), ("b1", "p9", 1), ("b2", "p9", 41), ("b3", "p9", 81)]


@pytest.mark.parametrize("n, chunk", [(1, 1_000_000), (4, 7)])
def test_leaders_are_those_over_links(spark, monkeypatch, n, chunk):
    """One group and several, rows of few links; actors that met nobody keep their rank."""
    monkeypatch.setattr(R, "n_groups", lambda rows: n)
    monkeypatch.setattr(B, "CHUNK", chunk)
    monkeypatch.setattr(R, "ROW_LINKS", chunk)
    df = spark.createDataFrame(edits(), SCHEMA)
    actors = df.select(F.col("actor").alias("node")).distinct()
    links = G.coedited_windowed(df, 40).select("a", "b")
    want, got = G.ringleader(links, actors, 40, settled=False), G.coedit_leaders(df, 40, 40)
    for part in ("communities", "cell"):
        assert sorted(map(tuple, got[part].collect())) == sorted(map(tuple, want[part].collect()))
    assert want["communities"].count() > 6
    exact = {r.node: r.score for r in G.pagerank(links, actors, 40, 1e-12).collect()}
    assert {r.node: r.score for r in G.coedit_ranks(df, 40, 40, 1e-12).collect()} == pytest.approx(exact, abs=1e-11) and len(exact) > 25
    assert [r.node for r in got["influence"].orderBy("place").collect()] == [r.node for r in want["influence"].orderBy("place").collect()]


def test_components_need_no_more_links_than_edits(spark):
    """A hundred edits at one time make 4,950 links, of which 99 hold all together."""
    df = spark.createDataFrame([(f"a{i:02}", "p", 5) for i in range(100)], SCHEMA)
    by_code, rows, _, n_nodes = R.numbered_edits(df)
    assert (rows, n_nodes, R.met_count(by_code, rows, 10)) == (100, 100, 4950)
    assert R.chained(by_code, rows, 10).count() == 99
    assert G.coedit_leaders(df, 10, 101)["communities"].select("size").distinct().collect()[0][0] == 100


def test_no_edits_have_no_leader(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not G.coedit_ranks(empty, 10, 0, 1e-9).collect()
    assert not G.coedit_leaders(empty, 10, 0)["influence"].collect()
