"""Queries of guards, projections, parsing, writes and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import columns as C
from engram.operators import answering as A, graph as G, memory as M, metrics as X, retrieval as R
from engram.plans.registry import EDITS, JUDGED, VOTES, _judged, _votes, query
from engram.sources import tables as S
from engram.streaming.derived import rebuild

FAMILIES = " ".join(f"when {' or '.join(f"contains(m, '{n}')" for n in needles)} then '{family}'" for family, needles in C.MODEL_FAMILIES.items())
MODELS = ["Claude-3", "gpt-4o", "gemini-pro", "LLaMA-2", "mixtral-8x7b", "nemotron", "Qwen2", "deepseek-v3", "command-r", "mystery"]
PANELS = f"""named as (select event_id as panel_id, list_value({', '.join(f"'{m}'" for m in MODELS)}) as m from events),
panels as (select panel_id, m[panel_id // 50 % 10 + 1] as reader, [m[panel_id // 150 % 10 + 1], m[panel_id // 350 % 10 + 1], m[panel_id // 550 % 10 + 1]] as judges from named)"""


@query(f"""with {PANELS}, fam as (select panel_id, (select case {FAMILIES} else 'unknown:' || m end from (select lower(reader) as m)) as r,
  list_transform(judges, lambda j: case {FAMILIES.replace("(m,", "(lower(j),")} else 'unknown:' || lower(j) end) as f from panels)
select panel_id, 'same family' as found from fam where list_contains(f, r)
union all select panel_id, 'unknown family' from fam where starts_with(r, 'unknown:') or len(list_filter(f, lambda x: starts_with(x, 'unknown:'))) > 0
union all select panel_id, 'too few families' from fam where len(list_distinct(f)) < 3""")
def guard_families(spark, sf):
    """Reader and judges that share a family, or of no known one."""
    n = F.col("event_id")
    pick = lambda k: F.get(F.array(*map(F.lit, MODELS)), (F.floor(n / k) % len(MODELS)).cast("int"))
    panels = S.table(spark, sf, "events").select(n.alias("panel_id"), pick(50).alias("reader"), F.array(pick(150), pick(350), pick(550)).alias("judges"))
    return X.family_clashes(panels)


@query("""select doc_id as config_id, m as missing from (select doc_id, unnest(['prompt', 'reader', 'budget']) as m, case when lang = 'en' then ['prompt', 'reader'] else ['budget', 'other'] end as hashed from documents)
where not list_contains(hashed, m)""")
def guard_config_hash(spark, sf):
    hashed = F.when(F.col("lang") == "en", F.array(F.lit("prompt"), F.lit("reader"))).otherwise(F.array(F.lit("budget"), F.lit("other")))
    return X.unhashed(S.table(spark, sf, "documents").select(F.col("doc_id").alias("config_id"), hashed.alias("hashed")), ["prompt", "reader", "budget"])


@query("select 'c' || c_custkey as name, (c_custkey % 101) / 100.0::double as value from customer where (c_custkey % 101) / 100.0::double >= 0.96")
def guard_noise(spark, sf):
    c = S.table(spark, sf, "customer")
    return X.noise_notes(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), ((F.col("c_custkey") % 101) / 100.0).alias("value")))


@query("""with s as (select l_orderkey as arm, sum(l_linenumber)::double as summed, max(l_linenumber)::double as composed from lineitem group by 1)
select arm, summed, composed from s where abs(summed - composed) > 1e-9""")
def guard_summed_deltas(spark, sf):
    """Orders as arms, their lines as levers: only those of one line add up."""
    l = S.table(spark, sf, "lineitem")
    composed = l.groupBy(F.col("l_orderkey").alias("arm")).agg(F.max("l_linenumber").cast("double").alias("composed"))
    return X.summed_deltas(l.select(F.col("l_orderkey").alias("arm"), F.col("l_linenumber").cast("double").alias("delta")), composed)


@query("""select distinct event_type as router, case event_id % 4 when 0 then 'temporal' when 1 then 'answer' when 2 then 'n_tokens' else 'gold' end as field
from events where event_id % 4 in (1, 3)""")
def guard_gold_reads(spark, sf):
    n = F.col("event_id") % 4
    field = F.when(n == 0, "temporal").when(n == 1, "answer").when(n == 2, "n_tokens").otherwise("gold")
    e = S.table(spark, sf, "events")
    return X.gold_reads(e.select(F.col("event_type").alias("router"), field.alias("field")), R.GOLD_FIELDS)


@query("""select o_custkey as gate from orders group by 1 having count(*) filter (where o_orderpriority = '1-URGENT') = 0
or count(*) filter (where o_orderpriority = '1-URGENT' and o_orderstatus = 'F') > 0""")
def guard_gates(spark, sf):
    """Gates never shown a sabotaged arm, or that let one pass."""
    o = S.table(spark, sf, "orders")
    return X.gate_failures(o.select(F.col("o_custkey").alias("gate"), (F.col("o_orderpriority") == "1-URGENT").alias("sabotaged"), (F.col("o_orderstatus") == "F").alias("passed")))


@query("""select 'qa.micro' as name, avg(n_chars)::double as value from documents union all select 'qa.macro', avg(m) from (select avg(n_chars)::double as m from documents group by source)
union all select 'retrieval.' || lang, count(*)::double from documents where lang is not null group by lang""")
def metrics_combined(spark, sf):
    d = S.table(spark, sf, "documents")
    micro = d.agg(F.avg("n_chars").alias("value")).select(F.lit("qa.micro").alias("name"), "value")
    macro = d.groupBy("source").agg(F.avg("n_chars").alias("m")).agg(F.avg("m").alias("value")).select(F.lit("qa.macro").alias("name"), "value")
    r = d.where("lang is not null").groupBy(F.concat(F.lit("retrieval."), "lang").alias("name")).agg(F.count("*").cast("double").alias("value"))
    return X.combine_metrics(micro.union(macro), r, micro)


@query(f"""with {JUDGED}, b as (select 'official' as "table", question_type as bucket, label from judged union all select 'clean', case when is_abstention then 'abstention' else question_type end, label from judged),
g as (select "table", bucket, count(*) as n, avg(label::int) as accuracy from b group by 1, 2)
select "table", cast(case when "table" = 'official' then list_position(['src2', 'src0', 'src1'], bucket) else row_number() over (partition by "table" order by bucket) end as int) as place, bucket, n, accuracy
from g where "table" = 'clean' or bucket in ('src2', 'src0', 'src1')""")
def qa_buckets(spark, sf):
    """Accuracy by type in a declared order, and with abstentions apart."""
    return X.by_bucket(_judged(spark, sf), ["src2", "src0", "src1"]).withColumn("place", F.col("place").cast("int"))


@query(f"with {VOTES} select family, count(*) as n, avg(case when label then 1.0 else 0.0 end) as accuracy from labels_of group by 1")
def panel_families(spark, sf):
    return X.family_accuracy(_votes(spark, sf))


@query("""with c as (select source as stratum, count(*) as n from documents group by 1), s as (select *, floor(n * 100 / sum(n) over ()) as base,
  round(n * 100 / sum(n) over () - floor(n * 100 / sum(n) over ()), 9) as part from c),
a as (select stratum, base + case when row_number() over (order by part desc, stratum) <= 100 - sum(base) over () then 1 else 0 end as take from s)
select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5('20260803:' || doc_id), doc_id) as n from documents) d join a on a.stratum = d.source where n <= take""")
def stratified_sample(spark, sf):
    """A hundred documents by source, drawn by a hash of seed and id."""
    d = S.table(spark, sf, "documents")
    share = X.stratified_allocation(d.groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("n")), 100)
    return X.stratified_sample(d, share, "doc_id", "source", 20260803)


@query(f"""with recursive {EDITS}, e as (select distinct a.actor as a, b.actor as b from edits a join edits b on a.page = b.page and a.actor <> b.actor and abs(a.ts_us - b.ts_us) <= 60000000),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on r.seen = e.a), l as (select node, min(seen) as component from r group by 1)
select component, count(*) over (partition by component) as size, row_number() over (partition by component order by node) - 1 as place, node from l""")
def cell_members(spark, sf):
    pairs = G.coedit_pairs(S.edits(spark, sf), 60_000_000)
    return G.cell_members(G.components(pairs.select("a", "b")))


@query("""select coalesce(nullif(case when event_id % 3 = 0 then '' else event_type end, ''), nullif(case when event_id % 2 = 0 then 'TYPE' else '' end, ''), 'RELATES') as relation,
case when event_id % 2 = 0 then 'TYPE' else coalesce(nullif(case when event_id % 3 = 0 then '' else event_type end, ''), 'RELATES') end as type, cast(user_id as varchar) as src, cast(event_id as varchar) as dest from events""")
def edge_projection(spark, sf):
    e, n = S.table(spark, sf, "events"), F.col("event_id")
    return M.project_edges(e.select(
        F.when(n % 3 == 0, "").otherwise(F.col("event_type")).alias("relation"), F.when(n % 2 == 0, "TYPE").otherwise("").alias("type"),
        F.col("user_id").cast("string").alias("src"), n.cast("string").alias("dst"),
    ))


@query("""select conv_id as path_id, array_to_string(list(conv_id || '.' || turn order by turn), '>') as ids, array_to_string(list(role order by turn), '>') as labels from conversations group by 1""")
def path_projection(spark, sf):
    t = S.table(spark, sf, "conversations")
    name = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    nodes = t.select(name.alias("id"), F.col("role").alias("label"))
    paths = M.project_paths(t.select(F.col("conv_id").alias("path_id"), F.col("turn").alias("place"), name.alias("id")), nodes)
    return paths.select("path_id", F.array_join("ids", ">").alias("ids"), F.array_join("labels", ">").alias("labels"))


@query("""select event_id, '{"kind":"' || event_type || '","z":"' || user_id || '"}' as encoded, 'lme_' || regexp_replace(event_type || '@v1.2_' || event_id, '[^A-Za-z0-9_]+', '_', 'g') as graph_key,
'Q: {who} ' || event_type || ' / ' || event_id as prompt, epoch_us(ts) - epoch_us(date_trunc('hour', ts)) as lag_us from events where user_id is not null""")
def scalar_forms(spark, sf):
    """A map as JSON, a graph key, a filled template and a lag for each event."""
    e = S.table(spark, sf, "events").where("user_id is not null")
    held = F.create_map(F.lit("z"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    prompt = C.fill_template(F.lit("Q: {who} {kind} / {id}"), [("kind", F.col("event_type")), ("id", F.col("event_id").cast("string"))])
    return e.select(
        "event_id", C.encode_map(held).alias("encoded"), C.graph_key(F.concat("event_type", F.lit("@v1.2")), F.col("event_id").cast("string")).alias("graph_key"),
        prompt.alias("prompt"), C.lag_us(S.micros(F.col("ts")), S.micros(F.date_trunc("hour", "ts"))).alias("lag_us"),
    )


@query("""select doc_id, case when doc_id % 5 in (0, 3, 4) then 'true' else 'false' end as as_bool,
case when doc_id % 5 = 0 then '' || doc_id when doc_id % 5 = 1 then '-7' when doc_id % 5 = 2 then '"1.5"' when doc_id % 5 = 3 then '"x ' || doc_id || '"' else '""' end as as_int,
case when doc_id % 5 = 2 then '["a","b"]' when doc_id % 5 = 3 then '["x ' || doc_id || '"]' when doc_id % 5 = 4 then '[]' when doc_id % 5 = 0 then '["' || doc_id || '"]' else '[" -7 "]' end as as_list from documents""")
def coerced(spark, sf):
    n = F.col("doc_id") % 5
    v = F.when(n == 0, "Yes").when(n == 1, " off ").when(n == 2, "").otherwise("maybe")
    text = F.col("doc_id").cast("string")
    i = F.when(n == 0, text).when(n == 1, " -7 ").when(n == 2, "1.5").when(n == 3, F.concat(F.lit("x "), text)).otherwise("")
    listed = F.when(n == 2, "a,,b").otherwise(i)
    return S.table(spark, sf, "documents").select("doc_id", C.coerce(v, "boolean").alias("as_bool"), C.coerce(i, "integer").alias("as_int"), C.coerce(listed, "array").alias("as_list"))


#: Replies as extraction gives them, by session modulo their number: (text, claims found as
#: (place, text, kind, predicate, entities, subject, from_turn, valid_from)); %d is the session.
REPLIES = [
    ('```json\n{"claims": [{"text": " seen %d ", "kind": "Preference", "predicate": "Likes Tea!", "entities": ["Green--Tea", " ", "Session"], "from_turn": "1"}, {"text": " "}]}\n```',
     [(0, "seen %d", "preference", "likes_tea", "green tea|session", "green tea", 1, "2023-04-10")]),
    ('Here: {"claims": [{"text": "\\n c \\n", "kind": "guess", "from_turn": 2.7, "valid_from": ""}]} Done.', [(0, "c", "fact", "unspecified", "", "", 2, "2023-04-10")]),
    ('[{"claims": [{"text": "in a list"}]}]', []),
    ("no claims { here", []),
    ('{"claims": [5, {"text": 7, "kind": null, "entities": "tea", "from_turn": true, "valid_from": "2020-01-02"}, {"text": true, "from_turn": -3, "entities": [12, null]}]}',
     [(1, "7", "fact", "unspecified", "", "", 1, "2020-01-02"), (2, "True", "fact", "unspecified", "12|none", "12", 0, "2023-04-10")]),
    ('{"claims": [{"text": null, "from_turn": "2.7", "predicate": null, "valid_from": 0}, {"kind": "event"}, {"text": "late", "from_turn": 99}]}',
     [(0, "None", "fact", "none", "", "", 0, "2023-04-10"), (2, "late", "fact", "unspecified", "", "", 99, "2023-04-10")]),
    ('{"answer": []}', []), ('{"claims": {"text": "no list"}}', []), ("", []),
]


def _replies_sql() -> str:
    rows = [f"({i}, {', '.join(repr(x) if isinstance(x, str) else str(x) for x in c)})" for i, (_, found) in enumerate(REPLIES) for c in found]
    return f"""with s as (select conv_id as session_id, cast(count(*) as int) as n_turns from conversations group by 1),
    found(reply, place, text, kind, predicate, entities, subject, from_turn, valid_from) as (values {", ".join(rows)})
    select session_id, cast(place as int) as place, session_id || '::c' || place as id, replace(text, '%d', cast(session_id as varchar)) as text, kind, predicate, entities, subject,
      cast(least(from_turn, n_turns - 1) as int) as from_turn, valid_from from s join found on session_id % {len(REPLIES)} = reply"""


@query(_replies_sql())
def claims_parsed(spark, sf):
    """Replies as extraction gives them: fenced, amid prose, bare, without JSON,
    JSON of other kinds, and members of other types than asked for."""
    s = S.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").cast("int").alias("n_turns")).withColumn("date_iso", F.lit("2023-04-10T17:50"))
    text = F.get(F.array(*(F.lit(t) for t, _ in REPLIES)), F.pmod("session_id", F.lit(len(REPLIES))).cast("int"))
    reply = F.replace(text, F.lit("%d"), F.col("session_id").cast("string"))
    found = A.normal_claims(A.parsed_claims(s.select("session_id", reply.alias("reply"))), s)
    return found.withColumn("entities", F.array_join("entities", "|"))


@query(f"""with {EDITS}, l as (select *, 'k' || event_id % 7 as case_id from edits),
n as (select 'Event:' || event_id as id, 'Event' as label, actor, ts_us, event_id from l union all select 'Actor:' || actor, 'Actor', actor, ts_us, event_id from l
  union all select 'Page:' || page, 'Page', actor, ts_us, event_id from l union all select 'Case:' || case_id, 'Case', actor, ts_us, event_id from l)
select id, label, arg_min(actor, (ts_us, event_id)) as author, max(ts_us) as clock from n group by 1, 2""")
def upsert_events(spark, sf):
    e = S.edits(spark, sf)
    return M.upsert_event_graph(e.withColumns({"case_id": F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")), "author": F.col("actor")}))[0].select("id", "label", "author", "clock")


@query("""with c as (select 'k' || event_id % 7 as src, 'IMPLICATES' as relation, 'c' || user_id as dst, arg_max(event_type, (epoch_us(ts), event_id)) as why from events where user_id in (select c_custkey from customer) group by 1, 3)
select * from c""")
def case_links(spark, sf):
    """Links of cases to customers that exist."""
    e = S.table(spark, sf, "events").where("user_id is not null")
    links = e.select(F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("case_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("why"), F.struct(S.micros(F.col("ts")).alias("t"), "event_id").alias("ts_us"))
    nodes = S.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    cases = spark.createDataFrame([], "id string, status string, opened_us struct<t:bigint,event_id:bigint>")
    edges = spark.createDataFrame([], "src string, relation string, dst string, why string")
    return M.link_case(cases, edges, links, nodes)[1]


RANKED = """rows_of as (select event_type as question_type, list_transform(range(10), lambda i: (event_id * 7 + i * 3) % 20) as ranked,
  case when event_id % 5 = 0 then cast([] as bigint[]) else [event_id % 20, event_id * 3 % 20, 5] end as gold from events),
each as (select question_type, k, case when len(gold) = 0 then 0.0 else len(list_filter(gold, lambda g: list_contains(ranked[1:k], g))) / len(gold) end as r from rows_of, (select unnest([1, 5, 10]) as k))"""


@query(f"""with {RANKED} select cast(null as varchar) as question_type, k, count(*) as n, round(avg(r), 9) as recall from each group by k
union all select question_type, k, count(*), round(avg(r), 9) from each where question_type is not null group by question_type, k""")
def recall_by_type(spark, sf):
    """Recall at 1, 5 and 10 over rank lists made from the events, in all and by type."""
    n = F.col("event_id")
    ranked = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (n * 7 + i * 3) % 20)
    gold = F.when(n % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n % 20, n * 3 % 20, F.lit(5).cast("bigint")))
    rows = S.table(spark, sf, "events").select(n.alias("question_id"), F.col("event_type").alias("question_type"), gold.alias("gold"), ranked.alias("ranked"))
    return X.recall_table(rows, [1, 5, 10, 5]).withColumn("recall", F.round("recall", 9))


@query(f"""with {JUDGED}, s as (select 'qa.' || split as metric, avg(label::int) as value from judged group by split
union all select 'qa.' || split || '.' || question_type, avg(label::int) from judged group by split, question_type)
select metric, round(value, 9) as value from s where value >= 0.9 and metric not in (select 'qa.' || min(split) || '.' || min(question_type) from judged)""")
def guard_suspects(spark, sf):
    """Accuracies of 0.9 and more of languages as arms and sources as categories, one cell confirmed."""
    j = _judged(spark, sf)
    sure = j.agg(F.concat(F.lit("qa."), F.min("split"), F.lit("."), F.min("question_type")).alias("metric"))
    return X.suspect_scores(X.arm_scores(j.withColumnRenamed("split", "arm")), sure).withColumn("value", F.round("value", 9))


@query("select distinct c_mktsegment as arm, 10 + c_custkey % 2 as budget from customer")
def guard_budgets(spark, sf):
    """Arms that declare two budgets."""
    c = S.table(spark, sf, "customer")
    return X.budget_clashes(c.select(F.col("c_mktsegment").alias("arm"), (10 + F.col("c_custkey") % 2).alias("budget")))


@query("""with c as (select source as stratum, count(*) as n from documents group by 1),
a as (select stratum, 2 + case when row_number() over (order by n desc, stratum) <= 7 then 1 else 0 end as take from c)
select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5('20260803:' || doc_id), doc_id) as n from documents) d join a on a.stratum = d.source where n <= take""")
def stratified_floor(spark, sf):
    """Two documents of each source, and one more of the seven largest."""
    d = S.table(spark, sf, "documents")
    counts = d.groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("n"))
    return X.stratified_sample(d, X.floored_allocation(counts, 2, 2 * counts.count() + 7), "doc_id", "source", 20260803)


@query("""with e as (select conv_id || '.' || turn as id, lead(conv_id || '.' || turn) over (partition by conv_id order by turn) as next, turn, conv_id, role,
  case when turn % 3 = 0 then 'NEXT>' when turn % 3 = 1 then '<replies' end as way from conversations)
select conv_id as path_id, array_to_string(list(id order by turn), '>') as ids, array_to_string(list(coalesce(way, '-') order by turn) filter (where next is not null), ' ') as relations from e group by 1""")
def path_relations(spark, sf):
    """Conversations as paths: an edge onwards, one that runs back, and none in turn."""
    t = S.table(spark, sf, "conversations")
    name = lambda turn: F.concat_ws(".", F.col("conv_id").cast("string"), turn.cast("string"))
    here, onwards, there = name(F.col("turn")), F.col("turn") % 3 == 0, name(F.col("turn") + 1)
    edges = t.where("turn % 3 < 2").select(F.lit("NEXT").alias("type"), F.when(onwards, "").otherwise("replies").alias("relation"), F.when(onwards, here).otherwise(there).alias("src"), F.when(onwards, there).otherwise(here).alias("dst"))
    paths = M.project_paths(t.select(F.col("conv_id").alias("path_id"), F.col("turn").alias("place"), here.alias("id")), t.select(here.alias("id"), F.col("role").alias("label")), edges)
    return paths.select("path_id", F.array_join("ids", ">").alias("ids"), F.array_join("relations", " ", "-").alias("relations"))


@query(f"""with {EDITS}, n as (select distinct 'Event' || chr(31) || 'Event:' || event_id || chr(31) || 'bridge' as line from edits
  union all select distinct 'Actor' || chr(31) || 'Actor:' || actor || chr(31) || 'bridge' from edits union all select distinct 'Page' || chr(31) || 'Page:' || page || chr(31) || 'bridge' from edits),
e as (select 'Actor:' || actor || chr(31) || 'EDITED' || chr(31) || '' || chr(31) || 'Event:' || event_id || chr(31) || '' as line from edits union all select 'Event:' || event_id || chr(31) || 'ON' || chr(31) || '' || chr(31) || 'Page:' || page || chr(31) || '' from edits),
d as (select (select sha256(string_agg(line, chr(10) order by line)) from n) as nodes_digest, (select sha256(string_agg(line, chr(10) order by line)) from e) as edges_digest)
select nodes_digest, edges_digest, sha256(nodes_digest || edges_digest) as graph_digest from d""")
def rebuild_digest(spark, sf):
    """The graph of the event log, each view delivered twice and in another order, as its digest."""
    e = S.edits(spark, sf).select("event_id", "actor", "page", "ts_us", "kind", F.lit("bridge").alias("author"), (F.col("event_id") % 4).alias("part"), F.col("event_id").alias("off"))
    return rebuild(e.unionByName(e.where("kind = 'view'")).orderBy(F.desc("off")), 3_600_000_000)["digest"]
