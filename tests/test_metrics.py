"""Recall tables, suspect scores, budgets and floors."""

import pytest
from pyspark.sql import functions as F

from engram.functions import columns as C
from engram.operators import memory as M, metrics as X


def test_recall_by_k_and_type(spark):
    rows = spark.createDataFrame(
        [("q1", "a", ["x", "y"], ["y", "z", "x"]), ("q2", "a", [], ["y"]), ("q3", "b", ["x", "x", "w"], ["x"]), ("q4", None, ["x"], None)],
        "question_id string, question_type string, gold array<string>, ranked array<string>",
    )
    got = {(r.question_type, r.k): (r.n, round(r.recall, 6)) for r in X.recall_table(rows.where("question_id <> 'q4'"), [1, 3]).collect()}
    assert got == {("a", 1): (2, 0.25), ("a", 3): (2, 0.5), ("b", 1): (1, 0.666667), ("b", 3): (1, 0.666667), (None, 1): (3, 0.388889), (None, 3): (3, 0.555556)}
    assert X.recall_table(rows, [1]).where("question_type is null").first().n == 4
    assert X.recall_table(rows.limit(0), [1]).count() == 0


def test_suspects_and_budgets(spark):
    judged = spark.createDataFrame([("one", "t", True)] * 9 + [("one", "u", False), ("two", "t", True)], "arm string, question_type string, label boolean")
    sure = spark.createDataFrame([("qa.two",)], "metric string")
    assert {r.metric for r in X.suspect_scores(X.arm_scores(judged), sure).collect()} == {"qa.one", "qa.one.t", "qa.two.t"}
    arms = spark.createDataFrame([("a", 10), ("b", 10), ("c", 12)], "arm string, budget int")
    assert X.budget_clashes(arms).count() == 3 and X.budget_clashes(arms.where("arm <> 'c'")).count() == 0


def test_floors(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("d", 2)], "stratum string, n long")
    take = lambda *args: {r.stratum: r["take"] for r in X.floored_allocation(counts, *args).collect()}
    assert take(2) == dict.fromkeys("abcd", 2) and take(2, 10) == {"a": 2, "b": 3, "c": 3, "d": 2}
    for wrong in ((3,), (2, 7), (2, 13), (2, 12)):
        with pytest.raises(ValueError):
            take(*wrong)


def test_headers_and_projections(spark):
    h = spark.createDataFrame([({"author_agent": "ann"},), ({"author_agent": ""},), ({"x": "y"},), (None,)], "h map<string,string>")
    assert [r[0] for r in h.select(C.log_author(F.col("h"), "bridge")).collect()] == ["ann", "bridge", "bridge", "bridge"]
    nodes = spark.createDataFrame([("n1", "Claim", " ", "x" * 200, [1.0]), ("n2", "Claim", None, None, None)], "id string, label string, title string, text string, embedding array<double>")
    got = {r.id: r.snippet for r in M.project_nodes(nodes, ["title", "text"]).collect()}
    assert got == {"n1": "x" * 180, "n2": "n2"} and "embedding" not in M.project_nodes(nodes, ["text"]).columns
    for value, kind, text in ((None, "string", ""), (True, "boolean", "True"), ([1], "array<int>", "[1]"), (2, "int", "2")):
        assert spark.createDataFrame([(value,)], f"v {kind}").select(C.flat_text(F.col("v"), kind)).first()[0] == text


def test_artifacts(spark, tmp_path):
    M.write_artifacts(str(tmp_path), rows=spark.range(3), aggregate=spark.createDataFrame([(1.5,)], "mean double"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 3 and spark.read.json(str(tmp_path / "aggregate")).first().mean == 1.5


def test_bucket_digests_see_any_change(spark):
    one = spark.range(500).select("id", (F.col("id") % 3).alias("v"))
    digest = lambda df: {tuple(r) for r in M.bucket_digests(df, ["id", "v"], 16).collect()}
    assert digest(one) == digest(one.orderBy(F.desc("id")).repartition(7))
    changed = digest(one) ^ digest(one.withColumn("v", F.when(F.col("id") == 77, 9).otherwise(F.col("v"))))
    assert 0 < len(changed) <= 4 and digest(one) != digest(one.union(one.limit(1)))
