"""Claims out of turns, verdicts out of replies, and the overlap reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from engram.functions.columns import normalize_entity, normalize_predicate, sentences

# Words that are no entities, words that are no search terms,
# phrases of an abstaining answer.
ENTITY_STOP = """the a an and or but if of to in on at for with about from by as is are was were be i
my me you your it its that this these those there their they them he she his her had has
have will would could should can may might not no yes do does did what when where who how
why very really just so too also then than""".split()
READER_STOP = """a an the and or but if of to in on at for with about from by as is are was were be been
being do does did what when where who whom which how why my i me you your it its that this
these those there their they them he she his her had has have will would could should can
may might not no yes s t""".split()
ABSTAINS = [
    "i don't have enough information", "i do not have enough information", "not enough information", "cannot be determined from",
    "isn't mentioned in", "is not mentioned in", "no information about",
]
# What ends a line, and lines of a context that are no evidence.
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
HEADINGS = ["SESSION DATE INDEX", "CONVERSATION HISTORY", "QUESTION:"]
# Patterns of names, long words, slot verbs and kinds.
NAMES = r"\b[A-Z][a-zA-Z0-9]{2,}(?:\s+[A-Z][a-zA-Z0-9]{2,})*"
LONG_WORDS = r"[A-Za-z][A-Za-z0-9']{4,}"
VERBS = r"\b(is|was|have|has|got|bought|use|prefer|like|work|live|study)\b"
PREFERENCE = r"\b(prefer|like|love|hate|favorite|favourite|rather|enjoy|dislike|want)\b"
EVENT = r"\b(yesterday|today|last week|ago|on \w+day|went|visited|happened|attended)\b"


def entities(sentence: Column) -> Column:
    """Normalised names, then long words, each once and in order."""
    words = F.filter(F.regexp_extract_all(sentence, F.lit(LONG_WORDS), F.lit(0)), lambda w: ~F.lower(w).isin(ENTITY_STOP))
    named = F.concat(F.regexp_extract_all(sentence, F.lit(NAMES), F.lit(0)), words)
    return F.filter(F.array_distinct(F.transform(named, normalize_entity)), lambda e: e != "")


def claims(turns: DataFrame, most: int = 40) -> DataFrame:
    """(conv_id, turn, place, text, predicate, kind, entities) of (conv_id, turn,
    role, text): one claim a sentence of 25 characters or more that names
    something; the first ``most`` of a session, six entities each."""
    # names are found where sentences are made: as a column with a condition on it they would be worked out once for each
    each = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), entities(s).alias("found")))
    s = turns.where(F.length("text") >= 25).select("conv_id", "turn", "role", F.posexplode_outer(each).alias("place", "s"))
    s = s.where(F.size("s.found") > 0).select("conv_id", "turn", "role", "place", "s.sentence", "s.found")
    low = F.lower("sentence")
    head = F.split_part(F.element_at("found", 1), F.lit(" "), F.lit(1))
    verb = F.coalesce(F.nullif(F.regexp_extract(low, VERBS, 1), F.lit("")), F.lit("attr"))
    kind = F.when(low.rlike(PREFERENCE), "preference").when(low.rlike(EVENT), "event").otherwise("fact")
    order = Window.partitionBy("conv_id").orderBy("turn", "place")
    first = s.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return first.select(
        "conv_id", "turn", "place", F.concat("role", F.lit(": "), "sentence").alias("text"), normalize_predicate(F.concat(head, F.lit("_"), verb)).alias("predicate"),
        kind.alias("kind"), F.slice("found", 1, 6).alias("entities"),
    )


def extraction_quality(found: DataFrame, turns: DataFrame) -> DataFrame:
    """(claims, no_predicate, no_entity, no_provenance) of a set of claims."""
    lost = found.join(turns.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").agg(F.count("*").alias("no_provenance"))
    n = found.agg(
        F.count("*").alias("claims"), F.count_if(F.col("predicate").isin("", "unspecified")).alias("no_predicate"), F.count_if(F.size("entities") == 0).alias("no_entity")
    )
    return n.crossJoin(lost)


def verdict(reply: Column) -> Column:
    """True or false as a reply's JSON object or text says; else null."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    said = F.lower(F.trim(F.get_json_object(body, "$.verdict")))
    low = F.lower(F.trim(reply))
    return (
        F.when(said == "true", True).when(said == "false", False)
        .when(low.rlike(r'"?verdict"?\s*[:=]\s*true'), True).when(low.rlike(r'"?verdict"?\s*[:=]\s*false'), False)
    )


def official_label(reply: Column) -> Column:
    """Whether the reply says yes anywhere; null counts as no."""
    return F.contains(F.lower(F.coalesce(reply, F.lit(""))), F.lit("yes"))


def abstained(answer: Column) -> Column:
    """Whether the answer is empty or declines."""
    t = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    out = t == ""
    for phrase in ABSTAINS:
        out = out | F.contains(t, F.lit(phrase))
    return out


def terms(text: Column) -> Column:
    """Distinct lower-case words of more than two characters, stop words left out."""
    words = F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(READER_STOP)))


def read_answers(questions: DataFrame, context: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, answer, overlap): the context sentence that shares most words with
    its question, the earliest on ties; null where none shares any.  A sentence
    ends with its line at the latest, and headings are not read.

    ``questions``: (key, question); ``context``: (key, *order, text).
    """
    lines = context.select(key, *order, F.posexplode(F.split("text", LINES)).alias("_line", "text")).withColumn("text", F.trim("text"))
    lines = lines.where(~F.col("text").rlike("^(" + "|".join(HEADINGS) + ")"))
    order = [*order, "_line"]
    s = lines.select(key, *order, F.posexplode_outer(sentences(F.col("text"), 13)).alias("_place", "answer")).where("answer is not null")
    both = s.join(questions.select(key, terms(F.col("question")).alias("_q")), key).withColumn("_t", terms(F.col("answer")))
    shared = F.size(F.array_intersect("_q", "_t"))
    scored = both.where(shared > 0).withColumn("overlap", F.round(shared / (F.sqrt(F.size("_q")) * F.sqrt(F.size("_t"))), 9))
    best = scored.groupBy(key).agg(F.min_by(F.struct("answer", "overlap"), F.struct(-F.col("overlap"), *order, "_place")).alias("b"))
    return questions.select(key).join(best, key, "left").select(key, F.substring("b.answer", 1, 800).alias("answer"), "b.overlap")


def panel_summary(verdicts: DataFrame) -> DataFrame:
    """(n, maj3, floor, undecided, unanimous_rate) of (id, verdict, floor, unanimous);
    an undecided row counts as false."""
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 9)
    return verdicts.agg(
        F.count("*").alias("n"), share(F.col("verdict")).alias("maj3"), share(F.col("floor")).alias("floor"),
        F.count_if(F.col("verdict").isNull()).alias("undecided"), share(F.col("unanimous")).alias("unanimous_rate"),
    )


def render_session(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, context): all turns of a session as numbered lines."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    line = F.concat(F.lit("["), place.cast("string"), F.lit("] "), "role", F.lit(": "), F.coalesce("text", F.lit("")))
    lines = turns.select("conv_id", place.alias("n"), line.alias("line")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    return lines.select("conv_id", F.size("l").cast("long").alias("n_turns"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))
