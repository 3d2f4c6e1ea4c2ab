"""The corpus pipeline: five stages, each written as Parquet and read again.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, all but the last with the columns of ``docs``.

All stages take an empty table (and give one), extra columns of any name (which
pass through unchanged up to the last stage), texts of any length, and rows
whose id, text, source or language is null or that repeat others.  What each
does with such rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm import language_id, line_dedup, mixing, ngram_join, packing
from engram.llm._common import discard, materialize
from engram.llm.queries import tokenizer_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rest goes.

    Texts that are null or hold no letter go; repeated rows are judged alike; a
    null source has the prior of all documents.
    """
    return language_id.identified_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stood before, here or in another document.

    Documents left without a line go, those that had none stay.  The smallest id
    keeps a line, a null id comes last; rows that repeat id and text are one
    document, of which all stay.
    """
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 0.8).

    The smallest id stays, a null id comes last; of repeated rows one stays.
    Texts without a word are in no group and stay.
    """
    return ngram_join.drop_near_copies(docs, k=5, num=8, den=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is one of the sources, the last; texts without a word have
    size 0; rows that repeat id and text are all taken or all left.
    """
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids, with the ids.

    A null or empty text is its end id alone; repeated rows are packed each; a
    null id stays null.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Classes of near copies and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
