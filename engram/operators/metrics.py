"""Aggregates over judged answers, lanes and votes, and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from engram.functions.columns import model_family, round_half_even


def micro_macro(judged: DataFrame) -> DataFrame:
    """(n, micro, macro): mean of the labels, and mean of the types' means."""
    per = judged.groupBy("question_type").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("acc"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("micro"), F.avg("acc").alias("macro"))


def per_type(judged: DataFrame) -> DataFrame:
    return judged.groupBy("question_type").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("accuracy"))


def abstention(judged: DataFrame) -> DataFrame:
    """Accuracy where one should abstain, and false abstentions where not."""
    should = F.col("is_abstention")
    return judged.agg(
        F.avg(F.when(should, F.col("label").cast("double"))).alias("abstention_accuracy"),
        F.avg(F.when(~should, F.col("predicted_abstain").cast("double"))).alias("false_abstention_rate"),
    )


def lane_band(a: DataFrame, b: DataFrame, most: float = 0.02) -> DataFrame:
    """Two lanes' means, agreement by row, and whether they confirm each other."""
    joined = a.select("id", F.col("label").alias("la")).join(b.select("id", F.col("label").alias("lb")), "id")
    means = joined.agg(F.avg(F.col("la").cast("double")).alias("lane_a"), F.avg(F.col("lb").cast("double")).alias("lane_b"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("agreement"))
    return means.withColumn("confirmed", F.abs(F.col("lane_a") - F.col("lane_b")) <= most)


def _more(yes: Column, no: Column) -> Column:
    return F.when(yes > no, True).when(yes < no, False)


def family_labels(votes: DataFrame) -> DataFrame:
    """(id, family, label) of (id, family, vote): the majority of the votes that
    could be read; null on a tie, and where at least twice as many could not be
    read as could."""
    per = votes.groupBy("id", "family").agg(
        F.count_if(F.col("vote") == F.lit(True)).alias("yes"), F.count_if(F.col("vote") == F.lit(False)).alias("no"), F.count("*").alias("all")
    )
    cast = F.col("yes") + F.col("no")
    return per.select("id", "family", F.when(cast * 2 > F.col("all") - cast, _more(F.col("yes"), F.col("no"))).alias("label"))


def majority(votes: DataFrame) -> DataFrame:
    """(id, verdict, floor, unanimous): the majority of the families' labels, ties
    undecided; whether every family says true; whether all have one and the same
    label, none of them null."""
    total = family_labels(votes).groupBy("id").agg(F.count_if("label").alias("y"), F.count_if(~F.col("label")).alias("n"), F.count("*").alias("all"))
    all_true, all_false = F.col("y") == F.col("all"), F.col("n") == F.col("all")
    return total.select("id", _more(F.col("y"), F.col("n")).alias("verdict"), all_true.alias("floor"), (all_true | all_false).alias("unanimous"))


def violations(rows: DataFrame, expected: int, budget: int) -> DataFrame:
    """Integrity checks as (check_name, n) rows; n > 0 is a violation.

    ``rows``: (question_id, question_type, split, label, returned, flag).
    """
    n = rows.agg(
        F.abs(F.count("*") - expected).alias("complete"), (F.count("*") - F.countDistinct("question_id")).alias("no_duplicates"),
        F.greatest(F.countDistinct("split") - 1, F.lit(0)).alias("one_split"), F.count_if(F.col("returned") > budget).alias("within_budget"),
        F.count_if(F.col("label").isNull()).alias("judged"), F.when(F.avg(F.col("label").cast("double")) >= 0.9, 1).otherwise(0).cast("long").alias("too_good"),
    )
    names = ["complete", "no_duplicates", "one_split", "within_budget", "judged", "too_good"]
    return n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check_name"), F.col(c).cast("long").alias("n")) for c in names))).alias("c")).select("c.*")


def stratified_allocation(counts: DataFrame, total: int) -> DataFrame:
    """(stratum, take): proportional shares by largest remainder."""
    everything = Window.partitionBy()
    share = F.col("n") * total / F.sum("n").over(everything)
    floored = counts.withColumn("base", F.floor(share)).withColumn("part", F.round(share - F.floor(share), 9))
    place = F.row_number().over(Window.orderBy(F.desc("part"), "stratum"))
    rest = F.lit(total) - F.sum("base").over(everything)
    return floored.withColumn("take", F.col("base") + (place <= rest).cast("long")).select("stratum", "n", "take")


def writer_stats(rows: DataFrame, key: str, places: int | None = 1) -> DataFrame:
    """(key, seen, admitted, rejected_pct) of rows with an ``admitted`` flag; the
    percentage with ``places`` digits after the point, or all."""
    share = F.lit(100.0) * F.count_if(~F.col("admitted")) / F.count("*")
    out = rows.groupBy(key).agg(F.count("*").alias("seen"), F.count_if("admitted").alias("admitted"), share.alias("rejected_pct"))
    return out if places is None else out.withColumn("rejected_pct", round_half_even(F.col("rejected_pct"), places))


def accuracy_table(judged: DataFrame) -> DataFrame:
    """Accuracy overall, by type, and by type and abstention, in one pass."""
    types = [F.col("question_type"), F.col("is_abstention")]
    grouped = judged.groupingSets([[], types[:1], types], *types)
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 9).alias("accuracy"))


def row_violations(rows: DataFrame, run_id: str, pinned: str) -> DataFrame:
    """(guard, question_id, found) of rows of another run (``fresh_rows``) or
    answered by another model than the pinned one (``served_model``); a missing
    value is a violation."""
    wanted = {"fresh_rows": ("run_id", run_id), "served_model": ("served_model", pinned)}
    checks = F.array(*(
        F.when(~F.col(c).eqNullSafe(F.lit(x)), F.struct(F.lit(guard).alias("guard"), F.col(c).cast("string").alias("found"))) for guard, (c, x) in wanted.items()
    ))
    return rows.select("question_id", F.explode(F.array_compact(checks)).alias("c")).select("c.guard", "question_id", "c.found")


def stray_metrics(metrics: DataFrame, spaces: tuple[str, ...] = ("qa.", "retrieval.")) -> DataFrame:
    """Metric names outside the named spaces; a null name is one of them."""
    inside = F.lit(False)
    for s in spaces:
        inside = inside | F.startswith(F.col("name"), F.lit(s))
    return metrics.where(~F.coalesce(inside, F.lit(False)))


def by_bucket(judged: DataFrame, types: list[str]) -> DataFrame:
    """(table, place, bucket, n, accuracy): the official types in their declared
    order, and a clean table in which abstentions are a bucket of their own."""
    order = F.array_position(F.array(*map(F.lit, types)), F.col("bucket"))
    own = judged.select(F.lit("official").alias("table"), F.col("question_type").alias("bucket"), "label")
    clean = judged.select(F.lit("clean"), F.when(F.col("is_abstention"), "abstention").otherwise(F.col("question_type")), "label")
    found = own.union(clean).groupBy("table", "bucket").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("accuracy"))
    by_name = F.row_number().over(Window.partitionBy("table").orderBy("bucket"))
    return found.where((F.col("table") == "clean") | (order > 0)).withColumn("place", F.when(F.col("table") == "official", order).otherwise(by_name)).select("table", "place", "bucket", "n", "accuracy")


def family_accuracy(votes: DataFrame) -> DataFrame:
    """(family, n, accuracy) of (id, family, vote): a family's majority an id,
    undecided ones counted as false; no rows for an empty panel."""
    right = F.coalesce("label", F.lit(False)).cast("double")
    return family_labels(votes).groupBy("family").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def stratified_sample(rows: DataFrame, allocation: DataFrame, id_col: str, stratum: str, seed: int) -> DataFrame:
    """(id, stratum): of each stratum the ``take`` rows with the smallest hash of
    seed and id, so the sample depends on neither order nor partitions."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    order = Window.partitionBy(stratum).orderBy("_draw", id_col)
    placed = rows.select(id_col, stratum, drawn.alias("_draw")).withColumn("_n", F.row_number().over(order))
    most = allocation.agg(F.max("take")).first()[0] or 0  # a bound for all strata lets Spark cut rows before the shuffle
    wanted = allocation.select(F.col("stratum").alias(stratum), "take")
    return placed.where(F.col("_n") <= most).join(wanted, stratum).where(F.col("_n") <= F.col("take")).select(id_col, stratum)


def family_clashes(panels: DataFrame, least: int = 3) -> DataFrame:
    """(panel_id, found) of (panel_id, reader, judges): a judge of the reader's
    family, a model of no known family, or a panel of fewer than ``least`` families."""
    families = F.transform("judges", model_family)
    reader = model_family(F.col("reader"))
    unknown = F.exists(families, lambda f: f.startswith("unknown:")) | reader.startswith("unknown:")
    found = F.array_compact(F.array(
        F.when(F.array_contains(families, reader), "same family"), F.when(unknown, "unknown family"), F.when(F.size(F.array_distinct(families)) < least, "too few families")
    ))
    return panels.select("panel_id", F.explode(found).alias("found"))


def unhashed(configs: DataFrame, required: list[str]) -> DataFrame:
    """(config_id, missing): required inputs that a configuration's hash leaves out."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("hashed"))
    return configs.select("config_id", F.explode(missing).alias("missing"))


# Fixed value: the accuracy from which labels' own noise explains a number.
NOISE_FLOOR = 0.96


def noise_notes(metrics: DataFrame) -> DataFrame:
    """(name, value): accuracies at or past the noise floor of the labels."""
    return metrics.where(F.col("value") >= NOISE_FLOOR)


def summed_deltas(deltas: DataFrame, composed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(arm, summed, composed): arms whose levers' deltas do not add up to the
    delta measured for all of them, so that only the latter may be quoted."""
    summed = deltas.groupBy("arm").agg(F.sum("delta").alias("summed"))
    return composed.join(summed, "arm").where(F.abs(F.col("summed") - F.col("composed")) > tolerance).select("arm", "summed", "composed")


def gold_reads(features: DataFrame, gold: list[str]) -> DataFrame:
    """(router, field): gold fields among the features that a router reads."""
    return features.where(F.col("field").isin(gold)).select("router", "field").distinct()


def gate_failures(gates: DataFrame) -> DataFrame:
    """(gate): gates that let a sabotaged arm pass, or that were never shown one."""
    shown = gates.groupBy("gate").agg(F.count_if("sabotaged").alias("n"), F.count_if(F.col("sabotaged") & F.col("passed")).alias("let"))
    return shown.where("n = 0 or let > 0").select("gate")


def combine_metrics(*tables: DataFrame) -> DataFrame:
    """(name, value) rows of all tables, each name once; a name with two values
    raises when the rows are read, as does accuracy without micro and macro."""
    both = tables[0].select("name", "value")
    for t in tables[1:]:
        both = both.unionByName(t.select("name", "value"))
    one = both.groupBy("name").agg(F.min("value").alias("value"), F.max("value").alias("_high"))
    same = F.assert_true(F.col("value").eqNullSafe(F.col("_high")), F.concat(F.lit("differing values of "), "name"))
    halves = one.agg(F.max(F.contains("name", F.lit(".micro"))).alias("_mi"), F.max(F.contains("name", F.lit(".macro"))).alias("_ma"))
    whole = F.assert_true(~F.col("name").startswith("qa.") | (F.col("_mi") & F.col("_ma")), F.lit("micro and macro must both be there"))
    checked = one.crossJoin(F.broadcast(halves))  # one row
    return checked.where(same.isNull() & whole.isNull()).select("name", "value")


def recall_table(rows: DataFrame, ks: list[int]) -> DataFrame:
    """(question_type, k, n, recall) of (question_id, question_type, gold, ranked):
    the mean share of gold ids among the first ``k`` ranked, over all rows (type
    null) and by type, in one pass.  A gold id counts as often as it is listed; a
    row without gold counts 0; no rows give none."""
    top = lambda k: F.size(F.filter("gold", lambda g: F.array_contains(F.slice("ranked", 1, k), g))) / F.size("gold")
    at = [F.struct(F.lit(k).alias("k"), F.when(F.size("gold") > 0, top(k)).otherwise(0.0).alias("r")) for k in dict.fromkeys(ks)]
    each = rows.select("question_type", F.explode(F.array(*at)).alias("c")).select(F.col("question_type").alias("t"), "c.k", "c.r")
    grouped = each.groupingSets([[F.col("k")], [F.col("t"), F.col("k")]], F.col("t"), F.col("k"))
    out = grouped.agg(F.grouping("t").alias("all"), F.count("*").alias("n"), F.avg("r").alias("recall"))
    return out.where("all = 1 or t is not null").select(F.when(F.col("all") == 0, F.col("t")).alias("question_type"), "k", "n", "recall")


# Fixed value: the accuracy from which a number is suspect until it is confirmed.
SUSPECT = 0.90


def arm_scores(judged: DataFrame) -> DataFrame:
    """(metric, value) of (arm, question_type, label): accuracies of each arm, as
    ``qa.arm``, and of each of its categories, as ``qa.arm.category``."""
    grouped = judged.groupingSets([[F.col("arm")], [F.col("arm"), F.col("question_type")]], F.col("arm"), F.col("question_type"))
    found = grouped.agg(F.grouping("question_type").alias("all"), F.avg(F.col("label").cast("double")).alias("value"))
    return found.select(F.concat_ws(".", F.lit("qa"), "arm", F.when(F.col("all") == 0, F.col("question_type"))).alias("metric"), "value")


def suspect_scores(scores: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """(metric, value): scores at or past SUSPECT that are not among ``confirmed``
    (metric), and so may not be quoted."""
    high = scores.where(F.col("value") >= SUSPECT).select("metric", "value")
    return high if confirmed is None else high.join(confirmed.select("metric").distinct(), "metric", "left_anti")


def budget_clashes(arms: DataFrame) -> DataFrame:
    """(arm, budget) of all arms if they do not declare one and the same budget, else nothing."""
    differ = arms.agg((F.count_distinct("budget") > 1).alias("_differ"))
    return arms.select("arm", "budget").distinct().crossJoin(F.broadcast(differ)).where("_differ").drop("_differ")  # one row


def floored_allocation(counts: DataFrame, per_type: int, top_up_to: int | None = None) -> DataFrame:
    """(stratum, n, take) of (stratum, n): ``per_type`` of each stratum, and of the
    largest ones (ties by name) one more each until ``top_up_to`` in all.

    Too few rows in a stratum, or a total that is not reached with one more each,
    raises."""
    strata, short = counts.agg(F.count("*"), F.min("n")).first()
    extra = 0 if top_up_to is None else top_up_to - per_type * strata
    if not 0 <= extra <= strata:
        raise ValueError(f"{top_up_to} is not between {per_type * strata} and {(per_type + 1) * strata}")
    place = F.row_number().over(Window.orderBy(F.desc("n"), "stratum"))  # one row a stratum
    out = counts.select("stratum", "n", (F.lit(per_type) + (place <= extra).cast("int")).cast("long").alias("take"))
    if strata and (short < per_type or not out.where("take > n").isEmpty()):
        raise ValueError("a stratum has fewer rows than are to be taken")
    return out
