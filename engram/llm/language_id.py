"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the languages of the model:
byte-trigram likelihoods of the whole text, the language the markup declares,
the language the address suggests (path segment or country suffix), and a
prior of the host.  Host priors are smoothed hierarchically, host towards
domain towards the whole corpus, from grouped sums of the texts' own
posteriors; a row's own share is taken out of its host's before it is used.
How far declarations and suffixes can be trusted is measured on the corpus,
as their agreement with the texts.

Rows without a letter (null, empty, digits only) are rejected with language
``und``, and so are rows in none of the languages: those whose mean
log-likelihood a trigram, over the whole text, lies in each language further
below that of its fitted rows than their spread and the text's length explain.
Others are kept when the best posterior reaches ``least``.  Missing
evidence counts for nothing.  A null host has the corpus prior.  Repeated rows
are judged alike; of equal posteriors the first language in order of name is
taken.  Texts of any length are read whole, in slices.  Columns of the input
pass through unchanged: where one has the name of a result, the result's name
is lengthened by ``_``.  An empty table gives an empty result, and a corpus
without a labelled row gives ``und`` throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from engram.llm._common import apart, materialize, prepare
from engram.llm._text import LOWER, SLICE, buffers

#: Hashed trigrams; labelled rows (expected) that the text model is fitted on.
BUCKETS, SAMPLE = 1 << 14, 4000
#: Trigrams are not independent: how much each counts.
TEMPER = 0.25
#: Strength of the coarser prior, in rows; posterior that keeps a row.
ALPHA, LEAST = 20.0, 0.5
#: Open-set test: deviations below the fitted rows' median that a text may lie;
#: least deviation between rows; how much neighbouring trigrams, which overlap,
#: raise the variance of a text's mean.
OUTSIDE, ROW_SPREAD, OVERLAP = 5.0, 0.5, 3.0
#: Counts a bucket that smoothing adds, to all languages in the same proportion.
SMOOTH = 0.05

# Languages of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en"}


def _codes(data: np.ndarray) -> np.ndarray:
    x = LOWER[data].astype(np.uint32)
    return (((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)) >> np.uint32(18)


def _letters(data: np.ndarray) -> np.ndarray:
    return (data >= 128) | ((LOWER[data] >= 97) & (LOWER[data] <= 122))


def _counts(data: np.ndarray) -> np.ndarray:
    """Trigrams of a text by bucket, counted in slices."""
    out = np.zeros(BUCKETS, np.int64)
    for s in range(0, len(data) - 2, SLICE):
        out += np.bincount(_codes(data[s : s + SLICE + 2]), minlength=BUCKETS)
    return out


def text_scores(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """[texts, 2 * languages + 2]: tempered log-likelihoods, the posteriors of
    the texts alone, and the numbers of letters and trigrams."""
    n = len(at) - 1
    sums, grams, letters = np.zeros((n, table.shape[1])), np.zeros(n), np.zeros(n)
    for i in range(n):
        s, end = at[i], at[i + 1]
        while s < end:
            e = min(end, s + SLICE)
            letters[i] += np.count_nonzero(_letters(data[s:e]))
            part = data[s : min(end, e + 2)]
            if len(part) > 2:
                sums[i] += table[_codes(part)].sum(axis=0, dtype=np.float64)
                grams[i] += len(part) - 2
            s = e
    sums *= TEMPER
    own = np.exp(sums - sums.max(axis=1, keepdims=True, initial=-np.inf))
    return np.concatenate([sums, own / own.sum(axis=1, keepdims=True), letters[:, None], grams[:, None]], axis=1)


def like_fitted(sums: np.ndarray, grams: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """1 where a text is like the fitted rows of some language.  The fewer
    trigrams, the wider the limits; a text without one is like any."""
    many = np.maximum(grams, 1)[:, None]
    means = sums / (TEMPER * many)
    limits = fits[:, 0] - OUTSIDE * np.sqrt(fits[:, 1] ** 2 + OVERLAP * fits[:, 2] / many)
    return (means >= limits).any(axis=1).astype(np.float64)


def fit_text_model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log p(trigram | language), fits) from about ``sample`` labelled rows.

    Each language gives the same number of rows, or all it has.  Rows are
    drawn by a hash of id and the text's length, so reruns agree.  Counts are summed in
    Spark; what comes back is BUCKETS numbers a language and one a drawn row.
    A trigram unseen everywhere has the same probability in each language.

    ``fits`` holds for each language the median of its rows' mean
    log-likelihood a trigram, each row scored by the counts without its own,
    their deviation (of the lower tail, by its 5 % quantile), and the variance
    of one trigram.
    """
    labelled = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, F.length(text_col)).alias("draw")
    ).where("lang is not null and text is not null")
    held = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    shares = held.withColumn("share", F.lit(sample) / F.count("*").over(Window.partitionBy()) / F.col("rows")).select("lang", "share")
    drawn = labelled.join(F.broadcast(shares), "lang").where(F.col("draw") / 2.0**64 + 0.5 <= F.col("share")).select("lang", "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            data, at = buffers(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                part = data[at[i] : at[i + 1]]
                if len(part) > 2:
                    totals[lang] = totals.get(lang, 0) + _counts(part)
        for lang, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": t[at]})

    sums = drawn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique().tolist())
    counts = np.zeros((BUCKETS, max(1, len(languages))))
    for i, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        counts[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    total = np.maximum(counts.sum(axis=0), 1)
    smooth = SMOOTH * BUCKETS / (SMOOTH * BUCKETS + total.mean())
    table = (1 - smooth) * counts / total + smooth / BUCKETS
    place = {lang: i for i, lang in enumerate(languages)}

    def held_out(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            langs, means = [], []
            for i, lang in enumerate(batch.column(0).to_pylist()):
                part = data[at[i] : at[i + 1]]
                if len(part) > 2:
                    n = _counts(part)
                    code = np.flatnonzero(n)
                    n = n[code]
                    rest = (counts[code, place[lang]] - n) / max(total[place[lang]] - n.sum(), 1)
                    langs.append(lang)
                    means.append(float(n @ np.log((1 - smooth) * rest + smooth / BUCKETS) / n.sum()))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "mean": pa.array(means, pa.float64())})

    means = drawn.mapInArrow(held_out, "lang string, mean double").toPandas() if languages else None
    fits = np.zeros((max(1, len(languages)), 3))
    for i, lang in enumerate(languages):
        own = means["mean"][means["lang"] == lang].to_numpy()
        middle = np.median(own)
        p, logs = counts[:, i] / total[i], np.log(table[:, i])
        fits[i] = middle, max(ROW_SPREAD, (middle - np.quantile(own, 0.05)) / 1.645), p @ logs**2 - (p @ logs) ** 2
    return languages, np.log(table).astype(np.float32), fits


def markup_language(html: Column) -> Column:
    """Two-letter language an ``<html lang=...>`` declares, or null."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2})(?![a-z])", 1)
    return F.nullif(F.lower(found), F.lit(""))


def address_language(url: Column, languages: list[str]) -> Column:
    """Language of the first path segment or of the host's country suffix, or null."""
    segment = F.lower(F.regexp_extract(url, r"(?i)://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1))
    suffix = F.lower(F.regexp_extract(url, r"(?i)://[^/?#:]*\.([a-z]{2})(?:[:/?#]|$)", 1))
    named = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return F.when(segment.isin(languages), segment).otherwise(named[suffix])


def visible_text(html: Column) -> Column:
    """Markup with scripts, styles, comments and tags taken out, white space as one blank."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"[ \t\r\n]+", " ")


def identify_languages(
    rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: Column, host: Column, domain: Column | None = None,
    declared: Column | None = None, suffix: Column | None = None, least: float = LEAST, columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` of ``rows`` (all by default) with ``id_language``,
    ``id_probability`` and ``id_keep``.

    With ``columns`` the scores are written beside them, so that texts are read
    once; all columns would be a copy of the table, so there texts are scored
    again when the result is read.

    ``host`` may hold any share of the rows: priors are sums over groups with
    map-side partial sums, and joined back as a small table where it is one
    (Spark checks its size) or as a join that splits skewed keys.
    """
    prepare(rows.sparkSession)
    languages, table, fits = model
    none = F.lit(None).cast("string")
    whole = columns is None
    columns = rows.columns if whole else columns
    results = apart(rows.select(*(F.col(f"`{c}`") for c in columns)), "id_language", "id_probability", "id_keep")
    passed = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    if not languages:
        und = [v.alias(c) for v, c in zip((F.lit("und"), F.lit(0.0), F.lit(False)), results)]
        return rows.select(*(F.col(f"`{c}`") for c in columns), *und)
    width = len(languages)

    def scores(column: pa.Array) -> pa.Array:
        found = text_scores(*buffers(column), table)
        found = np.concatenate([found[:, :-1], like_fitted(found[:, :width], found[:, -1], fits)[:, None]], axis=1)
        return pa.array(list(found), pa.list_(pa.float64()))

    scored = rows.select(
        passed, arrow_udf(scores, "array<double>")(F.coalesce(text.cast("string"), F.lit(""))).alias("_ev_text"),
        host.cast("string").alias("_ev_host"), (domain if domain is not None else none).cast("string").alias("_ev_domain"),
        (declared if declared is not None else none).alias("_ev_declared"), (suffix if suffix is not None else none).alias("_ev_suffix"),
    )
    if not whole:
        scored = materialize(scored, "language-scores")
    own = [F.col("_ev_text")[width + i] for i in range(width)]
    # a letter, and like the fitted rows of some language
    evident = (F.col("_ev_text")[2 * width] > 0) & (F.col("_ev_text")[2 * width + 1] > 0)
    names = F.array(*map(F.lit, languages))

    def best_of(scores: Column) -> Column:
        return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))

    argmax = best_of(F.slice("_ev_text", 1, width))

    # one row a host: rows, posterior sums, and how often declarations agree
    per_host = scored.where(evident).select(
        "_ev_host", "_ev_domain", *(p.alias(f"p{i}") for i, p in enumerate(own)),
        F.col("_ev_declared").isin(languages).cast("long").alias("d_all"), (F.col("_ev_declared") == argmax).cast("long").alias("d_same"),
        F.col("_ev_suffix").isin(languages).cast("long").alias("s_all"), (F.col("_ev_suffix") == argmax).cast("long").alias("s_same"),
    )
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(width)]
    other = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("d_all", "d_same", "s_all", "s_same")]
    hosts = materialize(per_host.groupBy("_ev_host", "_ev_domain").agg(F.count("*").alias("n"), *sums, *other), "host-languages")
    total = hosts.agg(F.sum("n").alias("n"), *sums, *(F.sum(c).alias(c) for c in ("d_all", "d_same", "s_all", "s_same"))).first()
    everyone = [((total[f"p{i}"] or 0.0) + 1.0) / ((total["n"] or 0) + width) for i in range(width)]
    sure = {c: ((total[f"{c}_same"] or 0) + 4.0) / ((total[f"{c}_all"] or 0) + 5.0) for c in "ds"}
    domains = hosts.where("_ev_domain is not null").groupBy("_ev_domain").agg(F.sum("n").alias("dn"), *(F.sum(f"p{i}").alias(f"d{i}") for i in range(width)))
    smooth = hosts.join(domains, "_ev_domain", "left").select(
        F.col("_ev_host").alias("_key_host"), F.col("_ev_domain").alias("_key_domain"), F.col("n").alias("_host_n"),
        F.array(*(F.col(f"p{i}") for i in range(width))).alias("_host_p"),
        F.array(*((F.coalesce(f"d{i}", F.lit(0.0)) + ALPHA * everyone[i]) / (F.coalesce("dn", F.lit(0)) + ALPHA) for i in range(width))).alias("_coarse"),
    )
    smooth = materialize(smooth, "host-priors").where("_key_host is not null")

    joined = scored.join(smooth, (F.col("_ev_host") == F.col("_key_host")) & F.col("_ev_domain").eqNullSafe(F.col("_key_domain")), "left")
    logs = []
    for i, lang in enumerate(languages):
        # the host's other rows: its sums without this row's own share
        rest = F.greatest(F.col("_host_p")[i] - F.when(evident, own[i]).otherwise(0.0), F.lit(0.0))
        prior = (rest + ALPHA * F.col("_coarse")[i]) / (F.col("_host_n") - F.when(evident, 1).otherwise(0) + ALPHA)
        said = F.lit(0.0)
        for column, r in (("_ev_declared", sure["d"]), ("_ev_suffix", sure["s"])):
            r = min(max(r, 1e-3), 1 - 1e-3)
            miss = np.log((1 - r) / max(1, width - 1))
            said = said + F.when(F.col(column) == lang, float(np.log(r))).when(F.col(column).isin(languages), float(miss)).otherwise(0.0)
        logs.append(F.col("_ev_text")[i] + F.log(F.coalesce(prior, F.lit(everyone[i])) + 1e-9) + said)
    joined = joined.withColumn("_logs", F.array(*logs))
    shares = F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs")))
    joined = joined.withColumn("_best", 1 / F.aggregate(shares, F.lit(0.0), lambda t, x: t + x))
    verdicts = (
        F.when(evident, best_of(F.col("_logs"))).otherwise("und"), F.when(evident, F.col("_best")).otherwise(0.0), evident & (F.col("_best") >= least)
    )
    return joined.select(*(F.col(f"row.`{c}`") for c in columns), *(v.alias(c) for v, c in zip(verdicts, results)))


def document_languages(docs: DataFrame, least: float = LEAST, columns: list[str] | None = None) -> DataFrame:
    """Languages of a documents table: text, markup in the text, source as host."""
    model = fit_text_model(docs, "doc_id", "text", "lang")
    text = F.col("text").cast("string")
    return identify_languages(docs, model, text, F.col("source"), declared=markup_language(text), least=least, columns=columns)


def identified_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return document_languages(docs, least).where(F.col(apart(docs, "id_keep")[0])).select(*(F.col(f"`{c}`") for c in docs.columns))


def page_languages(pages: DataFrame, docs: DataFrame, least: float = LEAST, columns: list[str] | None = None) -> DataFrame:
    """Languages of a pages table: visible text, declared language, address, host and domain."""
    from engram.llm.url_filter import host_of

    model = fit_text_model(docs, "doc_id", "text", "lang")
    host = host_of(F.col("url"))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return identify_languages(
        pages, model, visible_text(F.col("html")), host, domain, markup_language(F.col("html")), address_language(F.col("url"), model[0]), least, columns
    )
