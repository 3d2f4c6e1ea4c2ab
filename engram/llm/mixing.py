"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``share`` of all words; no target passes ``most`` times its source's words,
and what is cut off is shared by weight among the others until none is above.
The rate target / words of a source is the expected number of copies of each
of its documents: the whole part is certain, the rest is an inclusion
probability p.  For the rest documents are ranked by

    u / (1 - u)  /  (p / (1 - p))

with u drawn from a hash of id and text, and the smallest are taken one copy
more, as long as the words taken come nearest the source's target: a sample of
fixed size (in words) with the given inclusion odds.  Rows of a source thus
differ by one cut in their order, which is all that is computed from them:
the documents are never shuffled.

A null text has size 0.  Rows that repeat id and text share their draw and are
all taken or all left; ties of draws go by id and size.  A null id is drawn as
-1.  Texts of any length count whole.  Other columns are ignored or passed
through, whatever their names.  An empty table gives an empty result.  Only the
distinct rows of one rank cell of a source meet in a window, never a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from engram.llm._common import discard, materialize

# Weights of the sources, repeating.
WEIGHTS = [5, 2, 1]
SHARE, MOST = 1.5, 2.0
#: Cells a rank range is cut into, and how often.
CELLS, LEVELS = 1024, 2
_UNIT = float(2**48)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(id_col: Column, text: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the md5 of the seed, the id and the text's md5."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("-1")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(_UNIT)


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, target) by capped sharing; the table has a row a source."""
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    weights = F.array(*map(F.lit, WEIGHTS))
    named = per.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))).cast("double"))
    # in order of cap / weight, those capped are a prefix: the k-th is capped
    # if the level that the rest would get passes its cap / weight; after the
    # first that is not, levels only fall
    named = named.withColumn("cap", F.lit(MOST) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col(source).isNull(), source)
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(SHARE) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = named.withColumn("level", level)
    final = levelled.withColumn("lambda", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return final.select(source, "source_size", F.least("cap", F.col("weight") * F.coalesce("lambda", F.lit(float("inf")))).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    text, name = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    return docs.select(*more, name.alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), draw(name, text, seed).alias("u"))


def _ranked(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """``sized`` with its source's rates and the Pareto variable mapped to
    (0, 1), which keeps its order."""
    odds = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))
    return sized.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))


def source_cuts(sized: DataFrame) -> DataFrame:
    """(of, source_size, target, whole, p, low, cut): of a source's rows in order
    of (rank, id, size) those below rank ``low``, and those up to ``cut``, are
    taken once more than ``whole`` times."""
    targets = source_targets(sized)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = targets.withColumn("whole", F.floor(rate + 1e-12).cast("long")).withColumn("p", F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0)))
    rated = materialize(rated.select(F.col("source").alias("of"), "source_size", "target", "whole", "p", (F.col("target") - F.col("whole") * F.col("source_size")).alias("want")), "rates")
    rows = _ranked(sized, rated)

    # narrow the place where the target is reached, cell by cell: all rows of
    # lower cells are taken, all of higher ones are not
    spots = rated.where("p > 0").select(F.col("of").alias("at"), F.lit(0.0).alias("low"), F.lit(1.0).alias("step"), F.col("want").alias("rest"))
    for level in range(LEVELS):
        spots = materialize(spots, "spots")
        within = rows.where("rank is not null").join(spots, F.col("source").eqNullSafe(F.col("at")))
        within = within.where("rank >= low and rank < low + step")
        cell = F.least(F.floor((F.col("rank") - F.col("low")) / (F.col("step") / CELLS)), F.lit(CELLS - 1)).cast("int")
        sums = within.groupBy("at", "low", "step", "rest", cell.alias("cell")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("at").orderBy("cell"))
        reached = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        nearest = reached.groupBy("at").agg(F.min_by(F.struct("cell", "low", "step", "rest", "upto", "words"), "cell").alias("c"))
        found = nearest.select(F.col("at").alias("found"), (F.col("c.low") + F.col("c.cell") * (F.col("c.step") / CELLS)).alias("low2"), (F.col("c.step") / CELLS).alias("step2"), (F.col("c.rest") - F.col("c.upto") + F.col("c.words")).alias("rest2"))
        # a source whose rows do not reach the target takes all of them
        spots = spots.join(found, F.col("at").eqNullSafe(F.col("found")), "left").select(
            "at", F.coalesce("low2", F.lit(1.0)).alias("low"), F.coalesce("step2", F.lit(0.0)).alias("step"), F.coalesce("rest2", F.lit(0.0)).alias("rest")
        )
    spots = materialize(spots, "spots")
    # rows of one narrow cell only, equal ones as one: a row more is taken if that comes nearer the target
    edge = rows.join(spots, F.col("source").eqNullSafe(F.col("at"))).where("rank >= low and rank < low + step")
    edge = edge.groupBy("at", "rest", "rank", "id", "size").agg((F.col("size") * F.count("*")).alias("words"))
    before = F.sum("words").over(Window.partitionBy("at").orderBy("rank", "id", "size")) - F.col("size")
    taken = edge.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (2 * (F.col("rest") - F.col("before")) >= F.col("size")))
    cuts = taken.groupBy(F.col("at").alias("cut_of")).agg(F.max(F.struct("rank", "id", "size")).alias("cut"))
    placed = spots.select("at", "low").join(cuts, F.col("at").eqNullSafe(F.col("cut_of")), "left")
    return materialize(
        rated.join(placed, F.col("of").eqNullSafe(F.col("at")), "left").select("of", "source_size", "target", "whole", "p", "low", "cut"), "cuts"
    )


def _copies(ranked: DataFrame) -> Column:
    up_to_cut = F.struct("rank", "id", "size") <= F.col("cut")
    extra = (F.col("rank") < F.col("low")) | up_to_cut
    return F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(id, source, size, source_size, target, copies) per row."""
    sized = materialize(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    ranked = _ranked(sized, source_cuts(sized))
    return ranked.select("id", "source", "size", "source_size", "target", _copies(ranked).alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns stay."""
    sized = materialize(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    cuts = source_cuts(sized)
    discard(sized)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    ranked = _ranked(_sized(docs, id_col, text_col, source_col, seed, row), cuts)
    taken = ranked.select("row", _copies(ranked).alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(f"row.`{c}`") for c in docs.columns))
