"""Column expressions shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F


def sound_vector(v: Column) -> Column:
    """Whether a numeric array has a direction: not null, all components finite
    and one of them not zero."""
    wide = lambda x: x.cast("double")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(wide(x)) & (F.abs(wide(x)) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: wide(x) != 0), F.lit(False))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 16 hex digits of the parts' SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def normalize_entity(x: Column) -> Column:
    """Lower case, other than a-z and 0-9 to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9 ]+", " "), r"\s+", " "))


def normalize_predicate(x: Column) -> Column:
    """Lower case, other than a-z and 0-9 to ``_``; empty: ``unspecified``."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unspecified"))


def date_iso(x: Column) -> Column:
    """"2023/04/10 (Mon) 17:50" to "2023-04-10T17:50"; unreadable: empty."""
    pattern = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?:\D+(\d{1,2}):(\d{2}))?"
    part = [F.regexp_extract(x, pattern, i) for i in range(1, 6)]
    day = F.concat(part[0], F.lit("-"), F.lpad(part[1], 2, "0"), F.lit("-"), F.lpad(part[2], 2, "0"))
    time = F.concat(F.lit("T"), F.lpad(part[3], 2, "0"), F.lit(":"), part[4])
    return F.coalesce(F.when(part[0] == "", "").when(part[3] == "", day).otherwise(F.concat(day, time)), F.lit(""))


def clamp_int(x: Column, default: int, low: int, high: int) -> Column:
    """An integer within bounds; what cannot be read becomes ``default``."""
    return F.least(F.greatest(F.coalesce(x.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def snippet(*columns: str) -> Column:
    """First column that is not blank, 180 characters of it."""
    return F.substring(F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns)), 1, 180)


def contains_text(haystack: Column, needle: Column) -> Column:
    """Case-insensitive substring test; null counts as empty."""
    return F.contains(F.lower(F.coalesce(haystack, F.lit(""))), F.lower(needle))


def search_terms(question: Column, most: int | None = 24) -> Column:
    """The first ``most`` lower-case words of more than two characters, each once."""
    words = F.split(F.lower(F.regexp_replace(question, "[^A-Za-z0-9]+", " ")), " ")
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_distinct(long if most is None else F.slice(long, 1, most))


def sentences(text: Column, least: int = 25) -> Column:
    """Sentences (after ``. ! ?`` and white space) of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s) >= least)


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    """Share of the gold ids among the first k ranked; 0 without gold."""
    hit = F.size(F.array_intersect(F.slice(ranked, 1, k), gold))
    return F.when(F.size(gold) > 0, hit / F.size(gold)).otherwise(0.0)


def round_half_even(x: Column, places: int) -> Column:
    """Rounded by the exact value of the binary number, halves to even.

    Neither ``round`` nor ``bround`` does so: both start from the shortest
    decimal, which may be a half where the number is not.  Meant for the few
    rows of a finished report."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else round(v, places) for v in column.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(x.cast("double"))


def flat_text(x: Column, kind: str) -> Column:
    """Any content as one string: text as it is, numbers written out, lists and
    maps as JSON; null is empty.  ``kind`` is the column's type name."""
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(x), F.lit(""))
    return F.coalesce(F.initcap(x.cast("string")) if kind == "boolean" else x.cast("string"), F.lit(""))


def encode_map(x: Column) -> Column:
    """A map of strings as JSON with its keys in order; null is ``{}``."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(x)))
    return F.coalesce(F.to_json(entries), F.lit("{}"))


def graph_key(split: Column, question_id: Column) -> Column:
    """Key of a question's own graph: other than letters, digits and ``_`` become ``_``."""
    return F.concat(F.lit("lme_"), F.regexp_replace(F.concat(split, F.lit("_"), question_id), "[^A-Za-z0-9_]+", "_"))


# What counts as true and as false in a query string.
TRUE_WORDS, FALSE_WORDS = ["1", "true", "yes", "on"], ["0", "false", "no", "off", "null", "none", ""]


def coerce(x: Column, kind: str) -> Column:
    """A query-string value as the JSON type its schema declares, itself JSON:
    what cannot be read stays a string, and so does a value of another kind."""
    as_text = F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    low = F.lower(F.trim(x))
    if kind == "integer":
        return F.coalesce(F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("decimal(38,0)").cast("string")), as_text)
    if kind == "number":
        return F.coalesce(F.trim(x).try_cast("double").cast("string"), as_text)
    if kind == "boolean":
        return F.when(low.isin(TRUE_WORDS), "true").when(low.isin(FALSE_WORDS), "false").otherwise("true")
    if kind in ("array", "object"):
        body = F.trim(x)
        read = F.when(body.startswith("[") | body.startswith("{"), F.coalesce(F.try_parse_json(body).cast("string"), as_text))
        parts = F.to_json(F.filter(F.split(x, ","), lambda p: p != "")) if kind == "array" else F.lit("{}")
        return F.coalesce(read, parts)
    return as_text


# Labels of nodes, types of blocks, and words that stand for a type and a kind.
NODE_LABELS = ["Actor", "Page", "Wiki", "Event", "Entity", "Claim", "Case", "Agent", "Assertion", "Action"]
BLOCK_TYPES = ["note", "snippet", "doc", "code", "trace", "decision", "anti-pattern", "dataset", "exploit", "kg", "conversation", "utterance", "other"]
NOT_BLOCK_TYPES = {"fix": ("decision", "fix"), "learning": ("note", "learning")}


def block_type(given: Column, metadata: Column) -> tuple[Column, Column]:
    """(type, metadata) of a block: none is a note, ``fix`` and ``learning`` are a
    type and a ``kind`` in the metadata (one that is there stays); other words
    raise when the rows are read."""
    held = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    kind, out = held, F.when(given.isNull() | (given == ""), "note")
    for word, (real, name) in NOT_BLOCK_TYPES.items():
        out = out.when(given == word, real)
        kind = F.when((given == word) & ~F.map_contains_key(held, "kind"), F.map_concat(held, F.create_map(F.lit("kind"), F.lit(name)))).otherwise(kind)
    unknown = F.raise_error(F.concat(F.lit("unknown block type "), given)).cast("string")
    return out.when(given.isin(BLOCK_TYPES), given).otherwise(unknown), kind


# Names of model families, and what a model's name holds.
MODEL_FAMILIES = {
    "anthropic": ["claude", "anthropic", "sonnet", "opus", "haiku", "fable"],
    "openai": ["gpt-", "gpt4", "gpt3", "o1-", "o3-", "o4-", "openai", "davinci", "chatgpt"],
    "google": ["gemini", "palm", "bison", "gemma"], "meta": ["llama"], "mistral": ["mistral", "mixtral", "magistral"],
    "nvidia": ["nemotron"], "qwen": ["qwen"], "deepseek": ["deepseek"], "cohere": ["command-r", "cohere"],
}


def model_family(model: Column) -> Column:
    """The first family a model's name points to, else ``unknown:`` and the name."""
    name = F.lower(F.coalesce(model, F.lit("")))
    held = [(family, [F.contains(name, F.lit(n)) for n in needles]) for family, needles in MODEL_FAMILIES.items()]
    out = F.concat(F.lit("unknown:"), name)
    for family, found in reversed(held):
        out = F.when(F.array_contains(F.array(*found), True), family).otherwise(out)
    return out


def fill_template(template: Column, values: list[tuple[str, Column]]) -> Column:
    """``{name}`` of each value replaced by it, one after the other, in a text
    that may hold other braces."""
    out = template
    for name, value in values:
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def log_author(headers: Column, default: str) -> Column:
    """Who a log record is by: its header ``author_agent``, else the default."""
    return F.coalesce(F.nullif(F.element_at(headers, "author_agent"), F.lit("")), F.lit(default))


def lag_us(arrived_us: Column, origin_us: Column) -> Column:
    """Microseconds between a record's origin and its place in the log."""
    return arrived_us - origin_us
