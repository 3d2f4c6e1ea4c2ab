"""Retrieval for questions over a claim graph, in one set-oriented plan, and the
graph itself.

Tables: questions (query_id, question, embedding); claims (id, text, predicate,
kind, entities, subject, valid_us, session_id, turn, embedding); turns
(session_id, turn, role, text); sessions (session_id, date_iso).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from engram.functions.columns import normalize_entity, normalize_predicate, search_terms
from engram.operators import graph as G, retrieval as R
from engram.operators.extraction import NAMES
from engram.operators.steps import numbered, written

# Budgets of the stages.
LANE, FINAL, FANOUT, WINDOW, PACK, PROMOTED, CHAIN = 24, 12, 12, 40, 6, 36, 6
KINDS = ["fact", "preference", "event"]


# Fixed value: what Python's str.strip takes off.
BLANKS = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANKS}+|{BLANKS}+\\z", "")


def _member(object_: Column, name: str) -> Column:
    """A member as VARIANT; SQL null where it is missing, a VARIANT null where it is null."""
    return F.try_variant_get(object_, f"$.{name}", "variant")


def _written_out(v: Column) -> Column:
    """A member as text: strings as they are, ``True``, ``False`` and ``None`` as
    Python writes them, numbers with their digits, the rest as JSON."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).when(kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double").cast("string")).otherwise(text)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def parsed_claims(replies: DataFrame) -> DataFrame:
    """(session_id, place, raw) of (session_id, reply): the claims of replies that
    are a JSON object with ``claims``, fenced or amid prose, each as VARIANT.

    A reply that is JSON of another kind, such as a list, gives none; neither does
    one without JSON.  Members of the list that are no objects are left out, and
    keep their place.
    """
    body = _stripped(F.col("reply"))
    body = F.when(F.startswith(body, F.lit("```")), F.regexp_replace(F.regexp_replace(body, "^```[a-zA-Z]*\\s*", ""), "\\s*```\\z", "")).otherwise(body)
    whole = F.try_parse_json(body)
    within = F.try_parse_json(F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit("")))
    read = replies.select("session_id", F.coalesce(whole, within).alias("reply"))
    found = F.when(_is_object(F.col("reply")), F.try_variant_get("reply", "$.claims", "array<variant>"))
    return read.select("session_id", F.posexplode(found).alias("place", "raw")).where(_is_object(F.col("raw")))


def normal_claims(parsed: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, place, id, text, kind, predicate, entities, subject,
    from_turn, valid_from) of ``parsed_claims``: blank texts go, unknown kinds
    are facts, turns are cut to whole numbers and clamped to the session's, the
    subject is the first entity, an empty date gives way to the session's.

    ``sessions``: (session_id, n_turns, date_iso).  Entities that are no list
    count as none.
    """
    raw = F.col("raw")
    said = lambda name: _written_out(_member(raw, name))
    text = _stripped(F.coalesce(said("text"), F.lit("")))
    listed = F.coalesce(F.try_variant_get(raw, "$.entities", "array<variant>"), F.array().cast("array<variant>"))
    named = F.filter(F.transform(listed, _written_out), lambda e: _stripped(e) != "")
    norm = F.filter(F.transform(named, normalize_entity), lambda e: e != "")
    turn, turn_kind = _member(raw, "from_turn"), F.schema_of_variant(_member(raw, "from_turn"))
    whole = F.when(turn_kind == "STRING", F.when(_stripped(said("from_turn")).rlike(r"^[+-]?[0-9]+\z"), _stripped(said("from_turn")).try_cast("decimal(38,0)")))
    whole = whole.when(turn_kind == "BOOLEAN", F.try_variant_get(turn, "$", "boolean").cast("int").cast("decimal(38,0)"))
    number = F.try_variant_get(turn, "$", "double")
    whole = F.coalesce(whole.otherwise(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("decimal(38,0)")), F.lit(0))
    turn = F.greatest(F.lit(0), F.least(whole, F.col("n_turns") - 1)).cast("int")
    date, date_kind = said("valid_from"), F.schema_of_variant(_member(raw, "valid_from"))
    empty = (date == "") | (date_kind == "VOID") | date.isin("False", "[]", "{}") | F.coalesce(F.try_variant_get(_member(raw, "valid_from"), "$", "double") == 0, F.lit(False)) & (date_kind != "STRING")
    kind = F.lower(F.coalesce(said("kind"), F.lit("fact")))
    return parsed.where(text != "").join(sessions, "session_id").select(
        "session_id", "place", F.concat(F.col("session_id").cast("string"), F.lit("::c"), F.col("place").cast("string")).alias("id"), text.alias("text"),
        F.when(kind.isin(KINDS), kind).otherwise("fact").alias("kind"),
        normalize_predicate(F.coalesce(said("predicate"), F.lit(""))).alias("predicate"), norm.alias("entities"),
        F.when(F.size(named) > 0, normalize_entity(F.get(named, F.lit(0)))).otherwise("").alias("subject"),
        turn.alias("from_turn"), F.when(empty, None).otherwise(date).alias("valid_from"), F.substring("date_iso", 1, 10).alias("_day"),
    ).withColumn("valid_from", F.coalesce("valid_from", "_day")).drop("_day")


def claim_graph(sessions: DataFrame, turns: DataFrame, claims: DataFrame, dated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all sessions at once: sessions and their NEXT spine,
    turns IN_SESSION, claims FROM_TURN, entities that claims MENTION, and what
    claims supersede or contradict.  ``dated`` False leaves dates and spine out.
    """
    session, turn = F.concat(F.lit("s:"), F.col("session_id").cast("string")), F.concat(F.lit("t:"), F.col("session_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    claim, named = F.concat(F.lit("c:"), F.col("id").cast("string")), F.col("entity")
    mentions = claims.select(claim.alias("src"), F.explode(F.array_distinct("entities")).alias("entity"))
    nodes = sessions.select(session.alias("id"), F.lit("Session").alias("label"))
    nodes = nodes.union(turns.select(turn, F.lit("Turn"))).union(claims.select(claim, F.lit("Claim")))
    nodes = nodes.union(mentions.select(F.concat(F.lit("e:"), named), F.lit("Entity")).distinct())
    edges = turns.select(turn.alias("src"), F.lit("IN_SESSION").alias("relation"), session.alias("dst"))
    edges = edges.union(claims.select(claim, F.lit("FROM_TURN"), turn)).union(mentions.select("src", F.lit("MENTIONS"), F.concat(F.lit("e:"), named)))
    if dated:
        spine = numbered(sessions.where("date_iso <> ''").withColumn("all", F.lit(1)), "all", ["date_iso", "session_id"], "at")
        after = spine.select((F.col("at") - 1).alias("at"), session.alias("next"))
        edges = edges.union(spine.join(after, "at").select(session, F.lit("NEXT"), "next"))
    pairs = G.supersede_pairs(claims.where("subject <> ''"))
    newer, older = (F.concat(F.lit("c:"), F.col(c).cast("string")) for c in ("newer", "older"))
    return nodes, edges.union(pairs.select(newer, "relation", older))


def expand_each(seeds: DataFrame, mentions: DataFrame, fanout: int) -> DataFrame:
    """(query_id, id, rank): of each query the claims that share most entities with
    its seeds; pairs of a claim with itself are left out.

    Seeds are counted by entity first, so an entity of many claims makes one row
    a claim."""
    own = seeds.select("query_id", "id").join(mentions, "id")
    per = own.groupBy("query_id", "entity").agg(F.count("*").alias("every"))
    pairs = mentions.join(per, "entity").join(own.withColumn("mine", F.lit(1)), ["query_id", "id", "entity"], "left")
    shared = pairs.groupBy("query_id", "id").agg(F.sum(F.col("every") - F.coalesce("mine", F.lit(0))).alias("shared")).where("shared > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "id")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fanout)


def question_entities(question: Column) -> Column:
    """Distinct normalised names in a question."""
    names = F.transform(F.regexp_extract_all(question, F.lit(NAMES), F.lit(0)), normalize_entity)
    return F.array_distinct(F.filter(names, lambda e: F.length(e) > 2))


def preference_pack(questions: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, id, place): the stated preferences about a question's entities,
    or the latest ones where there are none."""
    stated = claims.where("kind = 'preference'").select("id", "valid_us")
    asked = questions.select("query_id", F.explode(question_entities(F.col("question"))).alias("entity"))
    about = asked.join(mentions.join(stated.select("id"), "id", "left_semi"), "entity").select("query_id", "id").distinct()
    by_id = Window.partitionBy("query_id").orderBy("id")
    about = written(about.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= PACK), "pack")
    latest = stated.orderBy(F.desc("valid_us"), "id").limit(PACK)
    latest = latest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("valid_us"), "id"))).select("id", "place")
    rest = questions.select("query_id").join(about.select("query_id"), "query_id", "left_anti").crossJoin(F.broadcast(latest))  # PACK rows
    return about.unionByName(rest.select("query_id", "id", "place"))


STAGES = ["s1a", "s1b", "s1_fused", "s2", "s4", "s3_promoted", "s5", "preference_pack", "missing_entities"]


def retrieve(questions: DataFrame, claims: DataFrame, turns: DataFrame, sessions: DataFrame, expansion: bool = True, supersede: bool = True, temporal: bool = True, sufficiency: bool = True) -> DataFrame:
    """What ``retrieve_counted`` serves."""
    return retrieve_counted(questions, claims, turns, sessions, expansion, supersede, temporal, sufficiency)[0]


def retrieve_counted(questions: DataFrame, claims: DataFrame, turns: DataFrame, sessions: DataFrame, expansion: bool = True, supersede: bool = True, temporal: bool = True, sufficiency: bool = True) -> tuple[DataFrame, DataFrame]:
    """(served, counts) for all questions at once.

    Served are rows (query_id, part, place, claim_id, promoted, session_id,
    date_iso, role, turn_text, missing, claim_text, predicate, kind, lineage,
    session_rank): the items for each question, their source turns verbatim, the
    names in the question that no claim mentions, what an item has superseded
    (from the head down to the claim that was hit, each with its text and date),
    and the place of its session among the question's, by first item.

    Nearest claims and claims of turns that hold its words are fused by rank,
    then fused with claims that share entities with the first six, and for
    questions about time with the earliest dated ones; each of the first 36 gives
    way to the head of its chain, if that is at most six steps away; twelve
    remain.  Questions about preferences get the stated ones as well, as part
    ``preference``.  The flags leave a stage out.

    Counts are rows (query_id, and one column a stage of STAGES): how many claims
    each stage found, how many gave way to a head, what was served and missed.
    """
    features = R.route(F.col("question"))
    asked = written(questions.select("query_id", "question", "embedding", features["temporal"].alias("temporal"), features["preference"].alias("preference")), "asked")
    mentions = claims.select("id", F.explode(F.array_distinct("entities")).alias("entity"))
    stages = []

    def counted(stage: str, rows: DataFrame) -> DataFrame:
        stages.append(rows.select("query_id", F.lit(stage).alias("stage")))
        return rows

    vectors = claims.where("embedding is not null").select(F.col("id").alias("vec_id"), "embedding")
    near = R.nearest(asked.select(F.col("query_id").alias("vec_id"), "embedding"), vectors, LANE).select("query_id", F.col("vec_id").alias("id"), "rank", F.lit("s1a").alias("lane"))
    terms = asked.select("query_id", F.explode(search_terms(F.col("question"))).alias("term"))
    hits = R.term_hits(turns.select(F.struct("session_id", "turn").alias("doc_id"), "text"), terms, LANE).select("query_id", "doc_id.session_id", "doc_id.turn", F.col("rank").alias("turn_rank"))
    order = Window.partitionBy("query_id").orderBy("turn_rank", "id")
    words = hits.join(claims.select("id", "session_id", "turn"), ["session_id", "turn"]).withColumn("rank", F.row_number().over(order)).select("query_id", "id", "rank", F.lit("s1b").alias("lane"))
    lanes = written(near.unionByName(words), "lanes")
    lists = [counted(lane, lanes.where(F.col("lane") == lane)) for lane in ("s1a", "s1b")]
    everything = 10**9
    fused = counted("s1_fused", written(R.fuse_ranks(lists, everything).select("query_id", "id", F.col("place").alias("rank")), "fused"))
    found = fused
    if expansion:
        shared = counted("s2", written(expand_each(fused.where(F.col("rank") <= max(4, FINAL // 2)), mentions, FANOUT), "expanded"))
        found = R.fuse_ranks([found, shared], everything).select("query_id", "id", F.col("place").alias("rank"))
    if temporal:
        dated = claims.join(sessions.where("date_iso <> ''"), "session_id").orderBy("date_iso", "id").limit(WINDOW)
        dated = dated.withColumn("rank", F.row_number().over(Window.orderBy("date_iso", "id"))).select("id", "rank")
        window = counted("s4", asked.where("temporal").select("query_id").crossJoin(F.broadcast(dated)))  # WINDOW rows
        found = R.fuse_ranks([found, window], everything).select("query_id", "id", F.col("place").alias("rank"))
    found = found.select("query_id", "id", "rank", F.lit(False).alias("promoted"), F.lit(None).cast(dict(claims.dtypes)["id"]).alias("origin"))
    heads = None
    if supersede:
        pairs = G.supersede_pairs(claims.where("subject <> ''")).where("relation = 'supersedes'").select("newer", "older")
        heads = written(G.supersede_heads(pairs, claims.select("id", F.col("valid_us").alias("clock"))), "heads")
        led = found.drop("promoted", "origin").join(heads.where(F.col("depth") <= CHAIN).select("id", "head"), "id", "left").withColumn("head", F.when(F.col("rank") <= PROMOTED, F.col("head")))
        led = written(led.select("query_id", F.coalesce("head", "id").alias("id"), "rank", F.col("head").isNotNull().alias("promoted"), F.when(F.col("head").isNotNull(), F.col("id")).alias("origin")), "led")
        counted("s3_promoted", led.where("promoted"))
        found = led.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.max("promoted").alias("promoted"), F.min_by("origin", F.when(F.col("promoted"), F.col("rank"))).alias("origin"))
    final = Window.partitionBy("query_id").orderBy("rank")
    items = counted("s5", written(found.withColumn("place", F.row_number().over(final)).where(F.col("place") <= FINAL).select("query_id", F.lit("item").alias("part"), "place", "id", "promoted", "origin"), "items"))
    pack = preference_pack(asked.where("preference"), claims, mentions).join(items.select("query_id", "id"), ["query_id", "id"], "left_anti")
    counted("preference_pack", pack)
    served = written(items.unionByName(pack.select("query_id", F.lit("preference").alias("part"), "place", "id", F.lit(False).alias("promoted"), F.lit(None).cast(dict(items.dtypes)["origin"]).alias("origin"))), "served")

    named = asked.select("query_id", F.explode(question_entities(F.col("question"))).alias("entity"))
    unknown = named.join(mentions.select("entity").distinct(), "entity", "left_anti")
    if sufficiency:
        counted("missing_entities", unknown)
    absent = unknown.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("entity")), "|").alias("missing"))
    day = F.coalesce(F.date_format(F.timestamp_micros("valid_us"), "yyyy-MM-dd"), F.lit(""))
    said = claims.select("id", "session_id", "turn", F.col("text").alias("claim_text"), "predicate", "kind", day.alias("valid_from"))
    # served claims are cut out before they meet their turns and sessions: written, they are few and known to be
    told = written(said.join(served.select("id"), "id", "left_semi"), "told")
    spoken = turns.join(told.select("session_id", "turn"), ["session_id", "turn"], "left_semi").withColumnRenamed("text", "turn_text")
    held = sessions.join(told.select("session_id"), "session_id", "left_semi")
    source = told.join(spoken, ["session_id", "turn"], "left").join(held, "session_id", "left")
    out = served.join(source, "id", "left").join(absent, "query_id", "left")
    if heads is not None:
        line = written(G.lineage(served.where("origin is not null").select(F.col("origin").alias("id")), heads, CHAIN), "lines").join(said.select(F.col("id").alias("node"), F.col("claim_text").alias("text"), F.col("valid_from").alias("from")), "node")
        line = line.groupBy(F.col("id").alias("origin")).agg(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("back"), "text", "from"))).alias("line"))  # CHAIN + 1 at most
        out = out.join(line, "origin", "left").withColumn("lineage", F.transform("line", lambda x: F.struct(x["text"], x["from"])))
    else:
        out = out.withColumn("lineage", F.lit(None).cast("array<struct<text:string,from:string>>"))
    at = F.when(F.col("part") == "item", F.col("place")).otherwise(FINAL + F.col("place"))
    first = F.min(at).over(Window.partitionBy("query_id", "session_id"))
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("first"))
    missing = F.coalesce("missing", F.lit("")) if sufficiency else F.lit("")
    out = out.withColumn("first", first).withColumn("session_rank", rank).select(
        "query_id", "part", "place", F.col("id").alias("claim_id"), "promoted", "session_id", "date_iso", "role", "turn_text", missing.alias("missing"),
        "claim_text", "predicate", "kind", "lineage", "session_rank",
    )
    every = stages[0]
    for s in stages[1:]:
        every = every.unionByName(s)
    sums = every.groupBy("query_id").pivot("stage", STAGES).count()
    counts = asked.select("query_id").join(sums, "query_id", "left").select("query_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in STAGES))
    return out, counts


def render_context(served: DataFrame, dates: DataFrame) -> DataFrame:
    """(query_id, context, date_index) of what ``retrieve`` serves.

    An item is its date and session, its source turn, its claim, and what that has
    superseded; stated preferences and names without memory follow.  ``dates``:
    (query_id, date_iso) of a question's sessions, for the index of dates.
    """
    # The forms of the lines.
    changed = "   \u26a0 SUPERSEDES an earlier statement (lineage shown)"
    preferences = "\nUSER'S STATED PREFERENCES (always included, not ranked):"
    coverage = "\nCOVERAGE NOTE: no memory at all about: "
    day = F.coalesce(F.nullif(F.substring("date_iso", 1, 10), F.lit("")), F.lit("undated"))
    older = F.coalesce(F.transform(F.slice("lineage", 2, CHAIN), lambda x: F.format_string("      \u21b3 superseded value (as of %s): %s", F.coalesce(x["from"], F.lit("?")), x["text"])), F.array().cast("array<string>"))
    head = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), day, F.lit(" \u2014 session "), F.col("session_id").cast("string"), F.when(F.size("lineage") > 1, changed).otherwise(""))
    turn = F.when(F.coalesce("turn_text", F.lit("")) != "", F.concat(F.lit("    "), "role", F.lit(': "'), "turn_text", F.lit('"')))
    slot = F.when(F.coalesce("predicate", F.lit("")) != "", F.concat(F.lit("      (attribute: "), "predicate", F.lit(", kind: "), "kind", F.lit(")")))
    item = F.array_join(F.concat(F.array(head, turn, F.concat(F.lit("    \u2192 claim: "), "claim_text"), slot), older), "\n")
    preference = F.concat(F.lit("    \u2022 ["), day, F.lit("] "), "claim_text")
    line = F.when(F.col("part") == "item", item).otherwise(preference)
    of = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("place", line.alias("line"))))), lambda x: x["line"]), "\n")
    held = served.groupBy("query_id").agg(of("item").alias("items"), of("preference").alias("liked"), F.max("missing").alias("missing"))
    gaps = F.array_join(F.slice(F.split("missing", r"\|"), 1, 5), ", ")
    context = F.array_join(F.array(
        F.col("items"), F.when(F.col("liked") != "", F.concat(F.lit(preferences + "\n"), "liked")), F.when(F.col("missing") != "", F.concat(F.lit(coverage), gaps)),
    ), "\n")
    days = dates.where("date_iso <> ''").groupBy("query_id").agg(F.array_sort(F.collect_set("date_iso")).alias("d"))
    short = F.transform("d", lambda x: F.substring(x, 1, 10))
    listed = F.format_string("SESSION DATE INDEX: %s (%d sessions, %s \u2192 %s)", F.array_join(short, ", "), F.size("d"), F.element_at(short, 1), F.element_at(short, -1))
    return held.join(days, "query_id", "left").select("query_id", context.alias("context"), F.coalesce(listed, F.lit("")).alias("date_index"))


def entity_neighbours(seeds: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """(query_id, id, entity, via): claims that share an entity with a query's
    seeds and are none of them, each once a seed and entity; 4 * k a query, in
    order of id, entity and seed."""
    own = seeds.select("query_id", F.col("id").alias("via")).distinct().join(mentions.distinct().withColumnRenamed("id", "via"), "via")
    # every claim served has a row at least, so 4 * k claims and 4 * k seeds an entity are enough
    by_query = Window.partitionBy("query_id").orderBy("id")
    found = own.select("query_id", "entity").distinct().join(mentions, "entity").select("query_id", "id").distinct()
    found = found.join(seeds.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    found = found.withColumn("_n", F.row_number().over(by_query)).where(F.col("_n") <= 4 * k).drop("_n")
    first = Window.partitionBy("query_id", "entity").orderBy("via")
    via = own.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 4 * k).drop("_n")
    pairs = found.join(mentions.distinct(), "id").join(via, ["query_id", "entity"])
    order = Window.partitionBy("query_id").orderBy("id", "entity", "via")
    return pairs.select("query_id", "id", "entity", "via").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 4 * k).drop("_n")
