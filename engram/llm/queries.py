"""The thirteen numbered queries over the corpus tables, and SQL for those SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.llm import conversation_repair, embedding_dedup, filter_audit, language_id, license_scan, line_dedup, mixing, ngram_join, packing, quality, topk_search, url_filter, warc


def tokenizer_path() -> str:
    """The tokenizer file: ENGRAM_TOKENIZER, or the public byte-level one."""
    if "ENGRAM_TOKENIZER" in os.environ:
        return os.environ["ENGRAM_TOKENIZER"]
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, language, probability, keep of every document."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.document_languages(docs, columns=["doc_id"]).select(
        "doc_id", F.col("id_language").alias("language"), F.col("id_probability").alias("probability"), F.col("id_keep").alias("keep")
    )


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages, with declared language, address and host evidence."""
    pages, docs = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents")
    return language_id.page_languages(pages, docs, columns=["page_id"]).select(
        "page_id", F.col("id_language").alias("language"), F.col("id_probability").alias("probability"), F.col("id_keep").alias("keep")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_classes(_table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("matches")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(_table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_url_filter, op3_embedding_dedup, op4_license_scan, op5_line_dedup, op6_topk_search,
        op7_quality, op8_ngram_join, op9_packing, op10_mixing, op11_conversation_repair, op12_warc, op13_filter_audit,
        language_id_pages,
    )
}

ORACLE_SQL = {
    # every vector that is sound, as integers; all pairs of a stated query and a vector
    "op6_topk_search": """
        with v as (
          select vec_id, min(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))) as v
          from embeddings
          where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            and coalesce(list_sum(list_transform(embedding, lambda x: pow(256 * cast(x as double), 2))), 0) < pow(2.0, 62)
          group by vec_id
        ), s as (
          select q.vec_id as query_id, c.vec_id,
                 cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
          from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
        ), r as (
          select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
        )
        select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
    """,
    "op10_mixing": """
        with sized as (
          select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
                 (cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '-1') || ':' || md5(coalesce(text, ''))), 1, 12) as bigint) + 0.5) / 281474976710656.0 as u
          from documents
        ), per as (
          select source, cast(sum(size) as bigint) as source_size,
                 [5.0, 2.0, 1.0][cast((row_number() over (order by source nulls last) - 1) % 3 as int) + 1]::double as weight
          from sized group by source
        ), capped as (
          select *, 2.0::double * source_size as cap, (2.0::double * source_size) / weight as ratio from per
        ), levels as (
          select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over w, 0)) /
                    (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
          from capped window w as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)
        ), targets as (
          select source, source_size, least(cap, weight * coalesce(max(case when level <= ratio then level end) over (), 'infinity'::double)) as target
          from levels
        ), rated as (
          select *, case when source_size > 0 then target / source_size else 0 end as rate from targets
        ), parts as (
          select *, floor(rate + 1e-12) as whole, greatest(rate - floor(rate + 1e-12), 0) as p from rated
        ), ranked as (
          select s.doc_id, s.source, s.size, s.u, r.source_size, r.target, r.whole, r.p,
                 r.target - r.whole * r.source_size as want,
                 (s.u / (1 - s.u) / (r.p / (1 - r.p))) as odds
          from sized s join parts r on s.source is not distinct from r.source
        ), summed as (
          select *, sum(size) over (partition by source order by odds / (1 + odds), doc_id, size) as upto from ranked
        )
        select doc_id, cast(size as bigint) as size, source_size, target,
               cast(size * (whole + case when p > 0 and upto - size <= want and 2 * (want - (upto - size)) >= size then 1 else 0 end) as bigint) as taken
        from summed
    """,
    "op12_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        g as (select *, max(page_id) over (partition by html) as leader from p),
        r as (select *, strlen(html) >= 1000 and leader is not null and page_id is distinct from leader as again from g)
        select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest,
               case when again then 'revisit' else 'response' end as record_type, case when again then leader end as refers_to,
               cast(null as varchar) as error
        from r
    """,
    # masks of each document, counts by part and mask, and each of the 120 orders over the masks
    "op13_filter_audit": """
        with d as (
          select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
        ), w as (
          select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from d
        ), m as (
          select doc_id, part,
                 [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
                  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
                  regexp_matches(text, '[#$%&*|]'), doc_id is distinct from first_id] as fails
          from w
        ), l as (
          select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
          from labels where doc_id is not null group by doc_id
        ), c as (
          select part, fails, count(*) as docs, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
          from m left join l on m.doc_id = l.doc_id group by part, fails
        ), f as (select unnest(range(1, 6)) as f),
        o as (
          select [a.f, b.f, c.f, d.f, e.f] as ord from f a, f b, f c, f d, f e
          where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), s as (select ord, unnest(range(1, 6)) as step from o),
        t as (
          select c.*, s.ord, s.step, s.ord[s.step] as f,
                 len(list_filter(s.ord[1 : s.step - 1], lambda x: c.fails[x])) as before, c.fails[s.ord[s.step]] as here
          from c, s
        ), a as (
          select part, ord, step, f,
                 coalesce(sum(docs) filter (before = 0 and not here), 0) as kept,
                 coalesce(sum(docs) filter (before = 0 and here), 0) as removed,
                 coalesce(sum(docs) filter (before > 0 and here), 0) as redundant,
                 coalesce(sum(docs) filter (here and len(list_filter(fails, lambda x: x)) = 1), 0) as unique_fails,
                 coalesce(sum(good) filter (before = 0 and here), 0) as good_lost,
                 coalesce(sum(toxic) filter (before = 0 and here), 0) as toxic_lost
          from t group by part, ord, step, f
        )
        select part, list_aggregate(list_transform(ord, lambda x: substr('ABCDE', x::int, 1)), 'string_agg', '') as filter_order, cast(step as int) as step,
               cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
               cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
               cast(sum(removed) over (partition by part, f) as bigint) as shapley
        from a
    """,
}
