"""A text index for questions by words and by substrings.

Words: postings (term, id), scored by how rare a question's words are.
Substrings: runs of one to three characters, posted for blocks of 64 documents
as one bit a document, so that the documents that hold all trigrams of a question
come from an AND over few rows; only those are read for the substring itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from engram.functions.columns import contains_text, search_terms
from engram.operators.steps import numbered, written

#: Documents of a posting's block: the bits of a long.
BLOCK = 64


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "))


def _runs(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _asked_runs(text: Column) -> Column:
    """What a question's substring must hold: its trigrams, or all of it if it is shorter."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, _runs(text, 3)).otherwise(F.filter(F.array(low), lambda t: t != ""))


@dataclass
class TextIndex:
    """``docs`` (id, label, text, block, bit); ``terms`` (term, id, label);
    ``sizes`` (label, docs); ``grams`` (gram, block, bits); ``spread`` (gram, blocks)."""

    docs: DataFrame
    terms: DataFrame
    sizes: DataFrame
    grams: DataFrame
    spread: DataFrame

    def save(self, folder: str) -> None:
        """The index as tables in a folder; postings are clustered by term and gram."""
        for name, key in (("docs", "block"), ("terms", "term"), ("sizes", "label"), ("grams", "gram"), ("spread", "gram")):
            getattr(self, name).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TextIndex:
        return TextIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("docs", "terms", "sizes", "grams", "spread")))


def build_index(docs: DataFrame) -> TextIndex:
    """Index (id, label, text); a null text holds no word and no substring."""
    rows = docs.select("id", "label", F.coalesce("text", F.lit("")).alias("text")).withColumn("all", F.lit(1))
    placed = numbered(rows, "all", ["id"], "at")
    held = written(placed.select("id", "label", "text", F.floor(F.col("at") / BLOCK).alias("block"), (F.col("at") % BLOCK).cast("int").alias("bit")), "index-docs")
    terms = held.select(F.explode_outer(_words(F.col("text"))).alias("term"), "id", "label").where("term <> ''")
    sizes = held.groupBy("label").agg(F.count("*").alias("docs"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    grams = held.select("block", bit.alias("one"), F.explode_outer(F.concat(*(_runs(F.col("text"), n) for n in (1, 2, 3)))).alias("gram")).where("gram is not null").groupBy("gram", "block").agg(F.bit_or("one").alias("bits"))
    grams = written(grams, "index-grams")
    return TextIndex(held, terms, sizes, grams, grams.groupBy("gram").agg(F.count("*").alias("blocks")))


def _first(found: DataFrame, labels: list[str], k: int, order: list[Column]) -> DataFrame:
    """Of each question and label the first ``k`` by ``order``, then label after
    label, cut to ``k`` in all."""
    of_label = Window.partitionBy("query_id", "label").orderBy(*order)
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    some = found.withColumn("_n", F.row_number().over(of_label)).where(F.col("_n") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "_n")))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def word_hits(index: TextIndex, queries: DataFrame, labels: list[str], k: int) -> DataFrame:
    """(query_id, id, rank, score) of (query_id, text): documents by the sum, over
    a question's words that they hold, of ln(1 + documents / documents with the
    word), both counted within the label."""
    asked = queries.select("query_id", F.explode(search_terms(F.col("text"))).alias("term"))
    wanted = written(asked, "asked-terms")
    held = index.terms.where(F.col("label").isin(labels)).join(written(wanted.select("term").distinct(), "asked-words"), "term", "left_semi")
    rare = held.groupBy("term", "label").agg(F.count("*").alias("n")).join(index.sizes, "label")
    weights = rare.select("term", "label", F.log(1 + F.col("docs") / F.col("n")).alias("weight"))
    found = held.join(weights, ["term", "label"]).join(wanted, "term").groupBy("query_id", "id", "label").agg(F.round(F.sum("weight"), 9).alias("score"))
    return _first(found, labels, k, [F.desc("score"), F.col("id")])


def substring_candidates(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, block, bits): the documents that hold every trigram of a question.

    A question first meets the postings of its rarest trigram; its other trigrams
    only the blocks found there."""
    asked = queries.select("query_id", F.explode(_asked_runs(F.col("text"))).alias("gram"))
    met = written(asked.join(index.spread, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0))), "asked-grams")
    rarest = met.groupBy("query_id").agg(F.min_by("gram", F.struct("blocks", "gram")).alias("gram"), F.count("*").alias("n"))
    start = index.grams.join(rarest, "gram").select("query_id", "block", "n")
    every = start.join(met.select("query_id", "gram"), "query_id").join(index.grams, ["gram", "block"])
    shared = every.groupBy("query_id", "block").agg(F.count("*").alias("found"), F.first("n").alias("n"), F.bit_and("bits").alias("bits"))
    return shared.where("found = n and bits <> 0").select("query_id", "block", "bits")


def substring_hits(index: TextIndex, queries: DataFrame, labels: list[str], k: int) -> DataFrame:
    """(query_id, id, rank, score): documents whose text holds the question's, case
    aside, in order of their ids.  An empty question asks for nothing."""
    text = F.lower(F.coalesce("text", F.lit("")))
    q = written(queries.select("query_id", text.alias("text")), "asked-texts")
    docs = index.docs.where(F.col("label").isin(labels)).withColumnRenamed("text", "held")
    near = substring_candidates(index, q).join(docs, "block")
    near = near.where(F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1).cast("long")) != 0).select("query_id", "id", "label", "held")
    found = near.join(q, "query_id").where(contains_text(F.col("held"), F.col("text")))
    return _first(found.select("query_id", "id", "label", F.lit(0.0).alias("score")), labels, k, [F.col("id")])


def search(index: TextIndex, queries: DataFrame, labels: list[str], k: int) -> DataFrame:
    """(query_id, id, rank, score, lane) of (query_id, text): hits by words, and for
    questions that have none in any label, by substring; ``lane`` tells which."""
    q = written(queries.select("query_id", "text"), "asked")
    words = written(word_hits(index, q, labels, k), "word-hits").withColumn("lane", F.lit("words"))
    rest = q.join(words.select("query_id").distinct(), "query_id", "left_anti")
    return words.unionByName(substring_hits(index, rest, labels, k).withColumn("lane", F.lit("contains")))
