"""Queries of extraction, judging, log parity and writes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engram.functions import columns as C
from engram.operators import extraction as E, graph as G, memory as M, metrics as X, retrieval as R
from engram.operators.steps import shared_folder
from engram.plans.registry import EDITS, HOUR, JUDGED, LOG, VOTES, _judged, _votes, query, ring_sql
from engram.sources import tables as S

SPLIT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
NORM = r"trim(regexp_replace(regexp_replace(lower(trim(e)), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in E.ENTITY_STOP)
FOUND = f"""cut as (select conv_id, turn, role, unnest({SPLIT}) as sentence, unnest(range(len({SPLIT}))) as p from conversations where length(text) >= 25),
long as (select conv_id, turn, role, trim(sentence) as sentence, row_number() over (partition by conv_id, turn order by p) - 1 as place from cut where length(trim(sentence)) >= 25),
named as (select *, list_filter(list_transform(list_concat(regexp_extract_all(sentence, '{E.NAMES}'),
  list_filter(regexp_extract_all(sentence, '{E.LONG_WORDS.replace("'", "''")}'), lambda w: lower(w) not in ({_STOP}))), lambda e: {NORM}), lambda e: e <> '') as every from long),
firsts as (select *, list_filter(every, lambda e, i: list_position(every, e) = i) as found from named),
claims as (select conv_id, turn, place, role || ': ' || sentence as text, kind, found[1:6] as entities, trim(regexp_replace(
  string_split(found[1], ' ')[1] || '_' || coalesce(nullif(regexp_extract(lower(sentence), '{E.VERBS}', 1), ''), 'attr'), '[^a-z0-9]+', '_', 'g'), '_') as predicate
  from (select *, case when regexp_matches(lower(sentence), '{E.PREFERENCE}') then 'preference' when regexp_matches(lower(sentence), '{E.EVENT}') then 'event' else 'fact' end as kind,
    row_number() over (partition by conv_id order by turn, place) as n from firsts where len(found) > 0) where n <= 40)"""


@query(f"with {FOUND} select conv_id, turn, cast(place as int) as place, text, predicate, kind, array_to_string(entities, '|') as entities from claims")
def claims_extract(spark, sf):
    return E.claims(S.table(spark, sf, "conversations")).withColumn("entities", F.array_join("entities", "|"))


@query(f"""with {FOUND} select count(*) as claims, count(*) filter (where predicate in ('', 'unspecified')) as no_predicate,
count(*) filter (where len(entities) = 0) as no_entity, count(*) filter (where not exists (select 1 from conversations c where c.conv_id = claims.conv_id and c.turn = claims.turn)) as no_provenance from claims""")
def extraction_quality(spark, sf):
    t = S.table(spark, sf, "conversations")
    return E.extraction_quality(E.claims(t), t)


@query("""select l_orderkey as claim_id, l_linenumber as line, o_orderdate as turn_time, c_name as session_name
from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey""")
def provenance_chain(spark, sf):
    l, o, c = (S.table(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line"), F.col("o_orderdate").alias("turn_time"), F.col("c_name").alias("session_name"))


@query("select doc_id, 'contains' as mode from documents where contains(lower(coalesce(text, '')), 'license')")
def contains_search(spark, sf):
    d = S.table(spark, sf, "documents").where(C.contains_text(F.col("text"), F.lit("LICENSE")))
    return d.select("doc_id", F.lit("contains").alias("mode"))


@query("""with t as (select distinct item_id, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) as term from benchmark),
w as (select distinct unnest(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) as term from documents)
select item_id, count(*) as asked, count(w.term) as present, coalesce(string_agg(t.term, '|' order by t.term) filter (where w.term is null), '') as missing
from t left join w using (term) where length(t.term) > 2 group by 1""")
def entity_coverage(spark, sf):
    """Terms of each question that no document holds."""
    t = S.table(spark, sf, "benchmark").select("item_id", F.explode(C.search_terms(F.col("text"), None)).alias("term"))
    w = S.table(spark, sf, "documents").select(F.explode_outer(C.search_terms(F.col("text"), None)).alias("term")).where("term is not null").distinct().withColumn("held", F.lit(True))
    return R.coverage(t, w)


@query("""select user_id as actor, count(*) as seen, count(*) filter (where event_type <> 'view') as admitted,
100.0::double * count(*) filter (where event_type = 'view') / count(*) as rejected_pct from events group by 1""")
def writer_stats(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("actor"), (F.col("event_type") != "view").alias("admitted"))
    return X.writer_stats(e, "actor", places=None)


@query(f"""with {JUDGED} select question_type, is_abstention, count(*) as n, round(avg(label::int), 9) as accuracy
from judged group by grouping sets ((), (question_type), (question_type, is_abstention))""")
def qa_grouping(spark, sf):
    return X.accuracy_table(_judged(spark, sf))


@query(f"with {JUDGED} select question_type, round(avg(returned), 6) as mean, min(returned) as least, max(returned) as most from judged group by 1")
def set_sizes(spark, sf):
    return _judged(spark, sf).groupBy("question_type").agg(F.round(F.avg("returned"), 6).alias("mean"), F.min("returned").alias("least"), F.max("returned").alias("most"))


@query(f"""with {VOTES} select count(*) as n, round(avg(coalesce(verdict, false)::int), 9) as maj3, round(avg(floor::int), 9) as floor,
count(*) filter (where verdict is null) as undecided, round(avg(unanimous::int), 9) as unanimous_rate from verdicts""")
def panel_summary(spark, sf):
    return E.panel_summary(X.majority(_votes(spark, sf)))


@query("""with r as (select l.doc_id, case when toxic = 1 then 'I cannot say; no information about it' when quality = 1 then 'Sure: {"verdict": true} yes' when d.n_chars % 2 = 0 then 'verdict = False' else '' end as reply
from labels l join documents d using (doc_id))
select doc_id, case when reply like 'Sure%' then true when reply like 'verdict%' then false end as verdict, contains(lower(reply), 'yes') as official,
reply = '' or contains(lower(reply), 'no information about') as abstained from r""")
def reply_verdicts(spark, sf):
    d = S.table(spark, sf, "labels").join(S.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    reply = F.when(F.col("toxic") == 1, "I cannot say; no information about it").when(F.col("quality") == 1, 'Sure: {"verdict": true} yes').when(F.col("n_chars") % 2 == 0, "verdict = False").otherwise("")
    r = d.select("doc_id", reply.alias("reply"))
    return r.select("doc_id", E.verdict(F.col("reply")).alias("verdict"), E.official_label(F.col("reply")).alias("official"), E.abstained(F.col("reply")).alias("abstained"))


@query("""select conv_id, count(*) as n_turns, string_agg('[' || n || '] ' || role || ': ' || coalesce(text, ''), chr(10) order by n) as context
from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) group by 1""")
def full_context(spark, sf):
    return E.render_session(S.table(spark, sf, "conversations"))


@query()
def extractive_reader(spark, sf):
    """Each conversation's first turn as the question, its later turns as the context."""
    t = S.table(spark, sf, "conversations")
    q = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.min("turn").alias("first"))
    later = t.join(q.select("conv_id", "first"), "conv_id").where("turn > first").select("conv_id", "turn", "text")
    return E.read_answers(q.select("conv_id", F.coalesce("question", F.lit("")).alias("question")), later, "conv_id", ["turn"])


@query(f"with {LOG}, r as (select part, off from elog union all select part, off from elog where kind = 'view') select part, count(*) as fetched, count(distinct off) as surfaced, count(*) - count(distinct off) as duplicates from r group by 1")
def log_dedup(spark, sf):
    """Views delivered twice: what is fetched, what surfaces, what repeats."""
    log = S.event_log(spark, sf)
    return M.dedup_counts(log.unionByName(log.where("kind = 'view'")))


@query(f"""with {LOG}, replay as (select event_id from elog where kind <> 'purchase' union all select event_id from elog where kind = 'view')
select (select count(*) from (select event_id from replay except all select event_id from events)) as extra,
(select count(*) from (select event_id from events except all select event_id from replay)) as missing""")
def event_parity(spark, sf):
    """A replay that lost the purchases and took the views twice, against the events."""
    log = S.event_log(spark, sf)
    replay = log.where("kind <> 'purchase'").select("event_id").union(log.where("kind = 'view'").select("event_id"))
    return M.multiset_difference(replay, S.table(spark, sf, "events").select("event_id"))


@query(f"""with w as (select count(*) as rings, coalesce(max(closeness), 0.0) as ring_score from ({ring_sql(HOUR)})),
c as (select count(*) as rings, coalesce(max(closeness), 0.0) as ring_score from ({ring_sql(HOUR, only="(ts_us, event_id) = (select max((ts_us, event_id)) from edits)")}))
select 'warm' as arm, rings, ring_score, rings > 0 and ring_score >= 0.5 as should_open_case from w
union all select 'cold', rings, ring_score, rings > 0 and ring_score >= 0.5 from c""")
def ablation(spark, sf):
    """The rings that history and the latest edit make, and the edit alone."""
    e = S.edits(spark, sf)
    return G.ablation(e, e.orderBy(F.desc("ts_us"), F.desc("event_id")).limit(1), HOUR)


@query("""select (select count(*) from customer where c_custkey not in (select o_custkey from orders)) as created, (select count(*) from customer where c_custkey in (select o_custkey from orders)) as matched,
(select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)) as kept""")
def upsert_counts(spark, sf):
    stored = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return M.mutation_counts(stored, S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("""with a as (select c_custkey as id, 'ann' as author, case when c_custkey % 3 = 0 then null else c_name end as name from customer where c_custkey % 4 <> 0),
b as (select c_custkey as id, 'bob' as author, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then 'new ' || c_name else c_name end as name from customer where c_custkey % 2 = 0),
m as (select a.id as old, b.id as new, a.name as old_name, b.name as new_name from a full join b using (id))
select count(*) filter (where old is null) as created, count(*) filter (where old is not null and new is not null) as matched, count(*) filter (where new is null) as kept,
count(new_name) + count(*) filter (where old is null) as properties_set, count(*) filter (where new_name is not null and new_name is distinct from old_name) + count(*) filter (where old is null) as properties_changed from m""")
def upsert_counted(spark, sf):
    """An upsert that keeps first authors, with the counts observed while it is written."""
    c = S.table(spark, sf, "customer")
    n, name = F.col("c_custkey"), F.col("c_name")
    stored = c.where(n % 4 != 0).select(n.alias("id"), F.lit("ann").alias("author"), F.when(n % 3 != 0, name).alias("name"))
    rows = c.where(n % 2 == 0).select(n.alias("id"), F.lit("bob").alias("author"), F.when(n % 5 == 0, None).when(n % 7 == 0, F.concat(F.lit("new "), name)).otherwise(name).alias("name"))
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/upserted-{uuid.uuid4().hex}"
    counts = M.upsert_counted(stored, rows, "id", ["author"], folder)
    return spark.createDataFrame([counts], "created long, matched long, kept long, properties_set long, properties_changed long")


@query("""with n as (select 'c' || c_custkey as id from customer union select 'p' || p_partkey from part),
p as (select distinct 'c' || user_id as src, 'VIEWED' as relation, 'p' || event_id as dst from events where user_id is not null)
select *, src in (select id from n) and dst in (select id from n) as related from p""")
def relate_edges(spark, sf):
    """Proposed edges, and whether both ends exist so that they are written."""
    c, p, e = (S.table(spark, sf, n) for n in ("customer", "part", "events"))
    name = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    nodes = c.select(name("c", "c_custkey").alias("id")).union(p.select(name("p", "p_partkey").alias("id")))
    wanted = e.where("user_id is not null").select(name("c", "user_id").alias("src"), F.lit("VIEWED").alias("relation"), name("p", "event_id").alias("dst")).distinct()
    made, lost = M.relate(wanted.limit(0), wanted, nodes)
    return made.withColumn("related", F.lit(True)).unionByName(lost.withColumn("related", F.lit(False)))


@query("select conv_id, turn, cast(conv_id as varchar) || '::t' || (row_number() over (partition by conv_id order by turn) - 1) as turn_id from conversations")
def turn_ordinals(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return S.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("::t"), n.cast("string")).alias("turn_id"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M') as date_iso from events")
def date_forms(spark, sf):
    e = S.table(spark, sf, "events")
    return e.select("event_id", C.date_iso(F.date_format("ts", "yyyy/MM/dd (E) HH:mm")).alias("date_iso"))


@query("""select event_id, event_id % 4 as part, coalesce(json_extract_string(props, '$.author_agent'), 'bridge') as author, try_cast(json_extract_string(props, '$.k') as int) as k,
least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') as int), 50), 1), 80) as clamped from events""")
def record_decode(spark, sf):
    """Log records read out of their JSON; what cannot be read is null."""
    e = S.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    author = F.coalesce(F.get_json_object("props", "$.author_agent"), F.lit("bridge"))
    return e.select("event_id", (F.col("event_id") % 4).alias("part"), author.alias("author"), k.try_cast("int").alias("k"), C.clamp_int(k, 50, 1, 80).alias("clamped"))


@query("select doc_id, substr(coalesce(nullif(trim(text), ''), nullif(trim(source), ''), cast(doc_id as varchar)), 1, 180) as snippet from documents")
def node_snippets(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", C.snippet("text", "source", "doc_id").alias("snippet"))


@query("""with r as (select event_id as question_id, event_type as run_id, nullif(json_extract_string(props, '$.k'), '7') as served_model from events)
select 'fresh_rows' as guard, question_id, run_id as found from r where run_id is distinct from 'view'
union all select 'served_model', question_id, served_model from r where served_model is distinct from '8'""")
def guard_rows(spark, sf):
    """Events as answer rows: those of another run or another model than stated."""
    k = F.nullif(F.get_json_object("props", "$.k"), F.lit("7"))
    r = S.table(spark, sf, "events").select(F.col("event_id").alias("question_id"), F.col("event_type").alias("run_id"), k.alias("served_model"))
    return X.row_violations(r, "view", "8")


@query("""select distinct source || '.' || lang as name from documents where not starts_with(source || '.' || lang, 'qa.') and not starts_with(source || '.' || lang, 'retrieval.')""")
def guard_namespaces(spark, sf):
    d = S.table(spark, sf, "documents")
    return X.stray_metrics(d.select(F.concat("source", F.lit("."), "lang").alias("name")).where("name is not null").distinct())


GRAPH = rf"""{FOUND}, vecs as (select vec_id, embedding, count(*) over () as n_vecs from embeddings),
graph as (select conv_id || '.' || turn || '.' || place as id, text, predicate, kind, entities, entities[1] as subject, conv_id as session_id, turn,
  1672531200000000 + (conv_id % 365) * 86400000000 as valid_us, conv_id * 31 + turn * 7 + place as seed from claims),
mentions as (select distinct id, unnest(entities) as entity from graph),
sessions as (select distinct conv_id as session_id, strftime(make_timestamp(1672531200000000 + (conv_id % 365) * 86400000000), '%Y-%m-%d') as date_iso from conversations)"""


def _claim_graph(spark, sf):
    """Claims of the conversations, dated by conversation, with vectors of the embeddings table."""
    from engram.operators.steps import written

    turns = S.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    found = E.claims(S.table(spark, sf, "conversations"))
    day = F.lit(1672531200000000) + (F.col("conv_id") % 365) * 86400000000
    name = F.concat_ws(".", *(F.col(c).cast("string") for c in ("conv_id", "turn", "place")))
    n = S.table(spark, sf, "embeddings").count()
    c = found.select(
        name.alias("id"), "text", "predicate", "kind", "entities", F.get("entities", F.lit(0)).alias("subject"), F.col("conv_id").alias("session_id"), "turn",
        day.alias("valid_us"), ((F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("place")) % n).alias("vec_id"),
    )
    c = written(c.join(S.table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id"), "claims")
    sessions = turns.select("session_id").distinct().withColumn("date_iso", F.date_format(F.timestamp_micros(F.lit(1672531200000000) + (F.col("session_id") % 365) * 86400000000), "yyyy-MM-dd"))
    return c, turns, sessions


def _questions(spark, sf):
    from engram.plans.registry import _asked

    n = S.table(spark, sf, "embeddings").count()
    q = _asked(spark, sf).where("item_id % 5 = 0").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "question", (F.col("item_id") % n).alias("vec_id"))
    return q.join(S.table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


@query(f"""with {GRAPH}, every as (
  select 's:' || session_id as id, 'Session' as label from sessions union all select 't:' || conv_id || ':' || turn, 'Turn' from conversations
  union all select 'c:' || id, 'Claim' from graph union all select distinct 'e:' || entity, 'Entity' from mentions)
select label, count(*) as n, min(id) as first, max(id) as last from every group by 1""")
def claim_graph_nodes(spark, sf):
    from engram.operators.answering import claim_graph

    c, turns, sessions = _claim_graph(spark, sf)
    nodes, _ = claim_graph(sessions, turns, c)
    return nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"""with {GRAPH}, spine as (select session_id, lead(session_id) over (order by date_iso, session_id) as next from sessions),
sp as (select id as newer, lag(id) over w as older, text, lag(text) over w as old_text, valid_us, lag(valid_us) over w as old_valid from graph window w as (partition by subject, predicate order by valid_us, session_id, id))
select 't:' || conv_id || ':' || turn as src, 'IN_SESSION' as relation, 's:' || conv_id as dst from conversations
union all select 'c:' || id, 'FROM_TURN', 't:' || session_id || ':' || turn from graph union all select 'c:' || id, 'MENTIONS', 'e:' || entity from mentions
union all select 's:' || session_id, 'NEXT', 's:' || next from spine where next is not null
union all select 'c:' || newer, case when valid_us = old_valid then 'contradicts' else 'supersedes' end, 'c:' || older from sp where older is not null and text <> old_text""")
def claim_graph_edges(spark, sf):
    from engram.operators.answering import claim_graph

    c, turns, sessions = _claim_graph(spark, sf)
    return claim_graph(sessions, turns, c)[1]


def _retrieve_sql(final: str = "select * from ranked") -> str:
    from engram.operators import retrieval as R
    from engram.plans.registry import ASKED

    def fuse(name: str, *lists: str) -> str:
        union = " union all ".join(f"select query_id, id, rank from {x}" for x in lists)
        return f"""{name} as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from (
          select query_id, id, round(sum(1.0::double / (60 + rank)), 12) as score from ({union}) group by 1, 2))"""

    norm = NORM.replace("(e)", "(e)")
    return f"""with recursive {GRAPH}, {ASKED},
    asked as materialized (select 'q' || item_id as query_id, question, embedding, regexp_matches(question, '(?i){R.TEMPORAL}') as temporal, regexp_matches(question, '(?i){R.PREFERENCE}') as preference
      from q left join vecs on vec_id = item_id % (select count(*) from embeddings) where item_id % 5 = 0),
    held as materialized (select graph.*, embedding from graph left join vecs on vec_id = seed % (select count(*) from embeddings)),
    dist as (select a.query_id, h.id, round(1 - list_sum(list_transform(list_zip(a.embedding, h.embedding), lambda p: p[1]::double * p[2]::double)) /
      (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(h.embedding, lambda x: x::double * x::double)))), 9) as d from asked a cross join held h),
    near as (select * from (select query_id, id, row_number() over (partition by query_id order by d, id) as rank from dist) where rank <= 24),
    terms as (select distinct query_id, unnest(list_filter(string_split(lower(regexp_replace(question, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2)[1:24]) as term from asked),
    words as (select distinct conv_id, turn, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) as term from conversations),
    turn_hits as (select *, row_number() over (partition by query_id order by hits desc, conv_id, turn) as turn_rank from (select query_id, conv_id, turn, count(*) as hits from words join terms using (term) group by 1, 2, 3)),
    lexical as (select query_id, id, row_number() over (partition by query_id order by turn_rank, id) as rank from turn_hits t join graph g on g.session_id = t.conv_id and g.turn = t.turn where turn_rank <= 24),
    {fuse("fused", "near", "lexical")},
    expanded as (select * from (select query_id, id, row_number() over (partition by query_id order by shared desc, id) as rank from (
      select f.query_id, n.id, count(*) as shared from fused f join mentions m on m.id = f.id join mentions n on n.entity = m.entity and n.id <> f.id where f.rank <= 6 group by 1, 2)) where rank <= 12),
    {fuse("wider", "fused", "expanded")},
    dated as (select query_id, id, rank from asked, (select id, row_number() over (order by date_iso, id) as rank from graph join sessions using (session_id)) where temporal and rank <= 40),
    {fuse("timed", "wider", "dated")},
    sp as (select newer, older from (select id as newer, lag(id) over w as older, text, lag(text) over w as old_text, valid_us, lag(valid_us) over w as old_valid
      from graph window w as (partition by subject, predicate order by valid_us, session_id, id)) where older is not null and text <> old_text and valid_us <> old_valid),
    walk as (select older as id, newer as head, 1 as depth, [older, newer] as path from sp union all select w.id, p.newer, w.depth + 1, list_append(w.path, p.newer) from walk w join sp p on p.older = w.head where w.depth < 6),
    heads as (select id, head, path from walk where head not in (select older from sp)),
    moved as (select query_id, coalesce(h.head, t.id) as id, rank, h.path from timed t left join heads h on h.id = t.id and t.rank <= 36),
    led as (select query_id, id, min(rank) as rank, bool_or(path is not null) as promoted, arg_min(path, rank) filter (where path is not null) as path from moved group by 1, 2),
    items as materialized (select * from (select *, row_number() over (partition by query_id order by rank) as place from led) where place <= 12),
    names as (select distinct query_id, e as entity from (select query_id, unnest(list_transform(regexp_extract_all(question, '{E.NAMES}'), lambda e: {norm})) as e from asked) where length(e) > 2),
    about as (select query_id, id, row_number() over (partition by query_id order by id) as place from (select distinct n.query_id, m.id from names n join mentions m using (entity) join graph g on g.id = m.id
      where g.kind = 'preference' and n.query_id in (select query_id from asked where preference))),
    latest as (select id, row_number() over (order by valid_us desc, id) as place from graph where kind = 'preference'),
    pack as (select * from about where place <= 6 union all select query_id, id, place from asked, latest where place <= 6 and preference and query_id not in (select query_id from about)),
    served as (select query_id, 'item' as part, place, id, promoted, path from items union all select query_id, 'preference', place, id, false, null from pack p where not exists (select 1 from items i where i.query_id = p.query_id and i.id = p.id)),
    absent as (select query_id, string_agg(entity, '|' order by entity) as missing from names where entity not in (select entity from mentions) group by 1),
    lines as (select query_id, id, n, path[n] as node from (select query_id, id, path, unnest(range(1, len(path) + 1)) as n from served where path is not null)),
    line as (select l.query_id, l.id, string_agg(strftime(make_timestamp(g.valid_us), '%Y-%m-%d') || '=' || g.text, chr(10) order by n desc) as lineage from lines l join graph g on g.id = l.node group by 1, 2),
    whole as (select s.query_id, part, cast(place as int) as place, s.id as claim_id, promoted, g.session_id, date_iso, c.role, c.text as turn_text, coalesce(missing, '') as missing,
      g.text as claim_text, g.predicate, g.kind, coalesce(lineage, '') as lineage, min(case when part = 'item' then place else 12 + place end) over (partition by s.query_id, g.session_id) as first
      from served s join graph g on g.id = s.id left join conversations c on c.conv_id = g.session_id and c.turn = g.turn left join sessions using (session_id) left join absent a on a.query_id = s.query_id
      left join line l on l.query_id = s.query_id and l.id = s.id and part = 'item'),
    ranked as (select * exclude (first), cast(dense_rank() over (partition by query_id order by first) as int) as session_rank from whole)
    {final}"""


STAGE_SQL = """, n as (select query_id, 's1a' as stage from near union all select query_id, 's1b' from lexical union all select query_id, 's1_fused' from fused union all select query_id, 's2' from expanded
      union all select query_id, 's4' from dated union all select query_id, 's3_promoted' from moved where path is not null union all select query_id, 's5' from items
      union all select query_id, 'preference_pack' from served where part = 'preference' union all select query_id, 'missing_entities' from names where entity not in (select entity from mentions))
    select a.query_id, """ + ", ".join(f"count(*) filter (where stage = '{s}') as {s}" for s in ("s1a", "s1b", "s1_fused", "s2", "s4", "s3_promoted", "s5", "preference_pack", "missing_entities")) + """
    from asked a left join n on n.query_id = a.query_id group by 1"""
RENDER_SQL = """, it as (select *, string_split(lineage, chr(10)) as older from ranked),
    told as (select query_id, string_agg('[' || place || '] ' || date_iso || ' \u2014 session ' || session_id || case when len(older) > 1 then '   \u26a0 SUPERSEDES an earlier statement (lineage shown)' else '' end || chr(10)
        || case when turn_text <> '' then '    ' || role || ': "' || turn_text || '"' || chr(10) else '' end || '    \u2192 claim: ' || claim_text || chr(10) || '      (attribute: ' || predicate || ', kind: ' || kind || ')'
        || coalesce((select string_agg(chr(10) || '      \u21b3 superseded value (as of ' || substr(x, 1, 10) || '): ' || substr(x, 12), '' order by i) from (select unnest(older[2:]) as x, unnest(range(2, len(older) + 1)) as i)), ''),
        chr(10) order by place) filter (where part = 'item') as items,
      string_agg('    \u2022 [' || date_iso || '] ' || claim_text, chr(10) order by place) filter (where part = 'preference') as liked, max(missing) as missing,
      list_sort(list(distinct date_iso)) as d from it group by 1)
    select query_id, items || case when liked is not null then chr(10) || chr(10) || 'USER''S STATED PREFERENCES (always included, not ranked):' || chr(10) || liked else '' end
      || case when missing <> '' then chr(10) || chr(10) || 'COVERAGE NOTE: no memory at all about: ' || array_to_string(string_split(missing, '|')[1:5], ', ') else '' end as context,
      'SESSION DATE INDEX: ' || array_to_string(d, ', ') || ' (' || len(d) || ' sessions, ' || d[1] || ' \u2192 ' || d[-1] || ')' as date_index from told"""


ARM = """t as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) - 1 as start, count(*) over (partition by conv_id) as n from conversations),
vecs as (select vec_id, embedding, count(*) over () as n_vecs from embeddings),
chunks as (select a.conv_id % 12 as question_id, a.conv_id as session_id, a.start, string_agg(b.role || ': ' || b.text, chr(10) order by b.start) as chunk
  from t a join t b on a.conv_id = b.conv_id and b.start between a.start and a.start + 3 where a.start % 2 = 0 and (a.start = 0 or a.start - 2 + 4 < a.n) group by a.conv_id, a.start),
scored as (select c.*, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) *
  sqrt(list_sum(list_transform(v.embedding, lambda x: x::double * x::double)))), 9) as similarity from chunks c join vecs q on q.vec_id = c.question_id join vecs v on v.vec_id = (c.session_id * 31 + c.start * 7) % v.n_vecs),
placed as (select *, row_number() over (partition by question_id order by similarity desc, session_id, start) as place from scored),
kept as (select *, min(place) over (partition by question_id, session_id) as first from placed where place <= 12)"""


def _arm(spark, sf):
    """Every twelfth session belongs to one question; vectors are those of the embeddings table."""
    v = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = v.count()
    q = v.where("vec_id between 0 and 11").select(F.col("vec_id").alias("question_id"), "embedding")
    c = R.turn_chunks(S.table(spark, sf, "conversations")).select((F.col("conv_id") % 12).alias("question_id"), F.col("conv_id").alias("session_id"), "start", "chunk")
    c = c.withColumn("vec_id", (F.col("session_id") * 31 + F.col("start") * 7) % n).join(v, "vec_id").drop("vec_id")
    return R.served_chunks(q, c)


@query(f"with {ARM} select question_id, cast(place as int) as place, session_id, start, similarity, cast(dense_rank() over (partition by question_id order by first) as int) as session_rank from kept")
def plain_arm(spark, sf):
    """From turns to chunks to the chunks most like each question, and their sessions by rank."""
    return _arm(spark, sf)[0]


@query(f"""with {ARM} select question_id, string_agg('[' || place || '] session ' || session_id || chr(10) || '    ' || replace(chunk, chr(10), chr(10) || '    '), chr(10) order by place) as context,
(select string_agg(session_id, ',' order by first) from (select distinct session_id, first from kept k where k.question_id = kept.question_id)) as sessions from kept group by 1""")
def plain_arm_context(spark, sf):
    return _arm(spark, sf)[1].select("question_id", "context", F.array_join(F.transform("session_ids", lambda x: x.cast("string")), ",").alias("sessions"))


@query(_retrieve_sql())
def retrieve(spark, sf):
    """The composed retrieval for every fifth benchmark passage, asked as a question."""
    from engram.operators.answering import retrieve as run

    lines = F.transform("lineage", lambda x: F.concat(x["from"], F.lit("="), x["text"]))
    return run(_questions(spark, sf), *_claim_graph(spark, sf)).withColumn("lineage", F.coalesce(F.array_join(lines, "\n"), F.lit("")))


@query(_retrieve_sql(STAGE_SQL))
def retrieve_counts(spark, sf):
    """How many claims each stage found for each of these questions."""
    from engram.operators.answering import retrieve_counted

    return retrieve_counted(_questions(spark, sf), *_claim_graph(spark, sf))[1]


@query(_retrieve_sql(RENDER_SQL))
def rendered_context(spark, sf):
    """What is served to these questions as a reader's context, with the dates of the served sessions."""
    from engram.operators.answering import render_context, retrieve as run
    from engram.operators.steps import written

    served = written(run(_questions(spark, sf), *_claim_graph(spark, sf)), "served")
    return render_context(served, served.select("query_id", "date_iso"))


@query(f"""with {GRAPH}, s as (select conv_id % 3 as query_id, conv_id || '.' || turn || '.' || place as id from claims where conv_id % 10 = 0),
p as (select distinct s.query_id, n.id, n.entity, s.id as via from s join mentions m on m.id = s.id join mentions n on n.entity = m.entity where not exists (select 1 from s t where t.query_id = s.query_id and t.id = n.id))
select query_id, id, entity, via from (select *, row_number() over (partition by query_id order by id, entity, via) as n from p) where n <= 40""")
def entity_neighbours(spark, sf):
    """Claims one entity away from three sets of seeds."""
    from engram.operators.answering import entity_neighbours as run

    c, _, _ = _claim_graph(spark, sf)
    return run(c.where("session_id % 10 = 0").select((F.col("session_id") % 3).alias("query_id"), "id"), c.select("id", F.explode(F.array_distinct("entities")).alias("entity")), 10)
