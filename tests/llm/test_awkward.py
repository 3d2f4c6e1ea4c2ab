"""Every operator and stage on the same awkward rows: nulls, empty and very long
texts, ties, repeated rows, empty tables and columns named like internal ones."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("engram.llm")
import engram.llm  # noqa: E402
from engram.llm import embedding_dedup, language_id, license_scan, line_dedup, mixing, ngram_join, packing, quality, queries, topk_search, url_filter  # noqa: E402

DOCUMENTS = {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html", "vec_id", "embedding", "label", "quality"}


def internal_names():
    """Column names that the modules' own code uses."""
    found = set()
    for path in Path(engram.llm.__file__).parent.glob("*.py"):
        found |= set(re.findall(r"alias\(\"(\w+)\"\)|withColumn\(\"(\w+)\"|\"(_\w+)\"", path.read_text()) and [n for t in re.findall(r"alias\(\"(\w+)\"\)|withColumn\(\"(\w+)\"|\"(_\w+)\"", path.read_text()) for n in t if n])
    lower = {n.lower(): n for n in sorted(found)}
    return sorted(n for low, n in lower.items() if low not in DOCUMENTS)


def clashing(df):
    return df.withColumns({n: F.lit(f"own {n}") for n in internal_names() if n not in df.columns})


WORDS = "the river and the town were quiet in the early morning while people walked to work over the old bridge"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, WORDS, "en", "a", 1), (1, WORDS, "en", "a", 1), (2, WORDS, "en", "a", 1), (None, WORDS, "en", None, None), (None, WORDS + " today", None, None, 0),
        (1, "another text stands on the same id\nand it has two lines of its own here", "en", "b", 2), (3, None, None, "b", None), (4, "", "de", "", 0), (None, None, None, None, None),
        (5, " \n\t\n ", "de", "a", 3), (6, long, "en", "b", 9), (7, "x" * 200_000, None, "b", 9), (8, "\n" * 50_000, "en", "a", 5), (9, WORDS.upper() + "\n" + WORDS, "en", "A", 1),
        (10, "под мостом течёт река", "ru", "é", 1), (11, "tie", "en", "a", 1), (12, "tie", "en", "a", 1),
    ]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)).persist()


STAGES = {
    "language_id": language_id.identified_documents, "line_dedup": line_dedup.dedup_lines, "ngram_join": ngram_join.drop_near_copies, "mixing": mixing.mixed_documents,
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_whole_rows(docs, name):
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    got = out.select("doc_id", "text", "source", "n_chars").collect()
    known = {(r.doc_id, r.source, r.n_chars) for r in docs.select("doc_id", "source", "n_chars").collect()}
    assert got and all((r.doc_id, r.source, r.n_chars) in known for r in got)
    internal = [n for n in internal_names() if n in docs.columns]
    assert out.where(" or ".join(f"`{n}` <> 'own {n}'" for n in internal)).count() == 0
    assert STAGES[name](docs.limit(0)).count() == 0


def test_stage_results_on_awkward_rows(docs):
    lines = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).select("doc_id", "text").collect()}
    assert (1, WORDS) in lines and (2, WORDS) not in {(i, t) for i, t in lines} and (3, None) in lines and (4, "") in lines and (8, "\n" * 50_000) in lines
    assert not any(t and WORDS.upper() in t for _, t in lines)
    kept = [(r.doc_id, r.text) for r in ngram_join.drop_near_copies(docs).select("doc_id", "text").collect()]
    assert kept.count((1, WORDS)) == 1 and (2, WORDS) not in kept and kept.count((11, "tie")) == 1 and (12, "tie") not in kept and kept.count((None, None)) == 1
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == docs.count() and all(0 <= r.copies <= 2 for r in mixed)
    assert sum(r.copies for r in mixed) == mixing.mixed_documents(docs).count()


OPERATORS = {
    "language": lambda d: language_id.document_languages(d, columns=["doc_id"]), "licenses": license_scan.scan_licenses, "lines": line_dedup.line_report,
    "ngrams": ngram_join.ngram_classes, "mix": mixing.mix,
    "quality": lambda d: quality.score_quality(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("y"), F.lit("x").alias("draw"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_give_a_row_for_each_row(docs, name):
    out = OPERATORS[name](docs)
    assert out.count() == docs.count() and OPERATORS[name](docs.limit(0)).count() == 0
    key = "doc_id" if "doc_id" in out.columns else "id"
    assert sorted(str(r[0]) for r in out.select(key).collect()) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    again = OPERATORS[name](docs.repartition(5))
    # sums of floats depend on their order in the last digits
    plain = [sorted(str([round(x, 4) if isinstance(x, float) else x for x in r]) for r in t.collect()) for t in (out, again)]
    assert plain[0] == plain[1]


def test_packing_of_awkward_rows(docs):
    slow = packing.token_ids(queries.tokenizer_path()).slow
    got = packing.pack(docs, queries.tokenizer_path()).collect()
    assert sum(r.length for r in got) == sum(len(slow.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect())
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in got) and sum(r.doc_id is None for r in got) >= 3


def test_pages_of_awkward_rows(spark, docs):
    long = "<html " + "data-x='1' " * 200 + 'lang="de"><body>' + "<a href='http://x.org/'>x</a>" * 2000 + "</body></html>"
    rows = [(1, "http://a.com/en/x", long), (1, "http://a.com/en/x", long), (None, None, None), (2, "", ""), (3, "http://b.net/" + "p" * 100_000, None), (4, "HTTP://A.COM:80/es/", "<html xml:lang='fr'>")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for run in (url_filter.filter_urls, lambda p: language_id.page_languages(p, docs)):
        out = run(pages)
        assert out.count() == len(rows) and run(pages.limit(0)).count() == 0
        assert len({str(r) for r in out.where("page_id = 1").collect()}) == 1
    found = pages.select(language_id.markup_language(F.col("html")).alias("l")).collect()
    assert [r.l for r in found] == ["de", "de", None, None, None, None]
    codes = spark.createDataFrame([("<html lang=fil>",), ("<HTML LANG='EN-us'>",), ("<html lang = pt>",)], "h string")
    assert [r[0] for r in codes.select(language_id.markup_language(F.col("h"))).collect()] == [None, "en", "pt"]


def test_vectors_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    base = [[float(x) for x in rng.normal(0, 1, 8)] for _ in range(3)]
    rows = [(0, base[0], 1), (0, base[0], 1), (50, base[0], 1), (None, base[0], 1), (100, base[1], None), (150, [float("nan")] * 8, 1), (200, None, 1), (250, [0.0] * 8, 2), (300, [1.0, 2.0], 1), (350, [1.0, 2.0], 2), (400, [1e6] * 8, 1), (450, [], 1), (50, base[2], 1)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    out = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_classes(df).collect()}
    assert (0, 3, 0) in out and (None, 3, 0) in out and (100, 0, 100) in out and (300, 0, 300) in out and embedding_dedup.embedding_classes(df).count() == len(rows)
    top = topk_search.top_k(df).collect()
    ints = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(np.isfinite(v)):
            w = [int(np.floor(256 * x)) for x in v]
            ints[i] = min(ints.get(i, w), w)
    want = set()
    for q, a in ints.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints.items() if i != q and len(b) == len(a))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in top} == want
    assert topk_search.top_k(df.limit(0)).count() == embedding_dedup.embedding_classes(df.limit(0)).count() == 0


def test_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(9)
    u = rng.normal(size=(1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.9805 * u + np.sqrt(1 - 0.9805**2) * w
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([u, v]))]
    got = {r.vec_id: r.component_id for r in embedding_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[1500 + i] == got[i] for i in range(1500)) >= 1490


def test_lower_and_longer_texts_keep_their_evidence():
    table = np.log(np.array([[0.6, 0.4]] * language_id.BUCKETS))
    data = np.frombuffer(b"abcd" * 5000, np.uint8)
    found = language_id.text_scores(data, np.array([0, 10, len(data)]), table)
    per_gram = language_id.TEMPER * np.log([0.6, 0.4])
    assert np.allclose(found[0, :2], 8 * per_gram) and np.allclose(found[1, :2], (len(data) - 12) * per_gram)


def test_convolution_equals_plain_loops():
    rng = np.random.default_rng(5)
    net = quality.start_network()
    net["mean"], net["top"], net["b"] = (rng.normal(0, 0.4, quality.FILTERS).astype(np.float32) for _ in range(3))
    texts = [b"", b"Short one.", bytes(rng.integers(1, 250, 500).astype(np.uint8))]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = quality.scores(net, np.frombuffer(b"".join(texts), np.uint8), at)
    for text, p in zip(texts, got):
        halves = max(2, -(-len(text) // quality.HALF))
        vectors = quality.BYTES[np.frombuffer(text.ljust(halves * quality.HALF, b"\0"), np.uint8)]
        spots = []
        for s in range(0, len(vectors), quality.STEP):
            window = vectors[s : s + 2 * quality.STEP]
            window = np.concatenate([window, np.zeros((2 * quality.STEP - len(window), quality.WIDTH))])
            spots.append(np.maximum(window.reshape(-1) @ net["w"] + net["b"], 0))
        per = quality.HALF // quality.STEP
        chunks = np.array([np.max(spots[h * per : (h + 2) * per], axis=0) for h in range(halves - 1)])
        z = chunks.mean(axis=0) @ net["mean"] + chunks.max(axis=0) @ net["top"] + net["c"][0]
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-4


def test_posteriors_equal_a_plain_computation(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(9001, "<html lang='fr'> abc def ghi", None, None, 0), (9002, "<html lang=xx> the and", None, "src1", 0), (9003, None, "en", "src1", 0), (9004, "12", None, "lone", 0)], docs.schema)
    docs = spark.createDataFrame(docs.union(odd).collect(), docs.schema)
    languages, table, fits = language_id.fit_text_model(docs, "doc_id", "text", "lang")
    rows = []
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        codes = language_id._codes(data) if len(data) > 2 else np.zeros(0, int)
        sums = language_id.TEMPER * table[codes].astype(np.float64).sum(axis=0) if len(codes) else np.zeros(len(languages))
        own = np.exp(sums - sums.max())
        own /= own.sum()
        letters = any(b >= 128 or chr(b).isalpha() for b in data.tolist())
        like = language_id.like_fitted(sums[None], np.array([float(len(codes))]), fits)[0] > 0
        said = re.search(r"<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2})(?![a-z])", (r.text or "").lower())
        rows.append((r.doc_id, r.source, sums, own, letters and like, said and said[1]))
    evident = [x for x in rows if x[4]]
    every = (sum(x[3] for x in evident) + 1) / (len(evident) + len(languages))
    told = [x for x in evident if x[5] in languages]
    sure = (sum(languages[int(x[2].argmax())] == x[5] for x in told) + 4) / (len(told) + 5)
    want = {}
    for i, source, sums, own, ok, said in rows:
        host = [x for x in evident if x[1] == source] if source is not None else []
        if host:
            prior = (np.maximum(sum(x[3] for x in host) - own * ok, 0) + language_id.ALPHA * every) / (len(host) - ok + language_id.ALPHA)
        else:
            prior = every
        spoken = np.array([(np.log(sure) if said == lang else np.log((1 - sure) / (len(languages) - 1))) if said in languages else 0.0 for lang in languages])
        logs = sums + np.log(prior + 1e-9) + spoken
        share = np.exp(logs - logs.max())
        want[i] = (languages[int(logs.argmax())], 1 / share.sum()) if ok else ("und", 0.0)
    got = {r.doc_id: (r.id_language, r.id_probability) for r in language_id.document_languages(docs, columns=["doc_id"]).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def plain_mix(rows):
    """{(id, text): copies} of (id, text, source) rows by the definition, one source after the other."""
    import hashlib

    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    free, want, total = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    while free:
        level = (mixing.SHARE * total - sum(want.values())) / sum(free.values())
        over = [s for s in free if level * free[s] > mixing.MOST * sizes[s]]
        for s in over or list(free):
            want[s] = mixing.MOST * sizes[s] if over else level * free[s]
            del free[s]
    out = {}
    for s in order:
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        whole = int(rate + 1e-12)
        p, rest, upto = max(rate - whole, 0.0), want[s] - whole * sizes[s], 0
        ranked = []
        for i, text, source in rows:
            if source == s:
                name = f"0:{-1 if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}"
                u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                ranked.append((u / (1 - u), i, text, len((text or "").encode().split())))
        for _, i, text, size in sorted(ranked, key=lambda r: (r[0], r[1] or 0)):
            out[i, text] = whole + (p > 0 and upto <= rest and 2 * (rest - upto) >= size)
            upto += size
    return out


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_pairs import brute_lines, brute_ngrams

    from engram.llm._common import materialize

    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 150")
    docs = spark.createDataFrame(docs.collect(), docs.schema).withColumn("own", F.lit("x"))
    kept = materialize(stages["language_id"](spark, docs, sf_dir), "one")
    keep = {r.doc_id for r in language_id.document_languages(docs).where("id_keep").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in keep}

    lined = materialize(stages["line_dedup"](spark, kept, sf_dir), "two")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want, texts = brute_lines(rows), dict(rows)
    blank = {i for i, t in rows if not (t or "").strip(" \t\r\n")}
    got = {r.doc_id: r.text for r in lined.collect()}
    assert set(got) == set(want) | blank
    assert all(got[i] == "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n in want[i] or not x.strip(" \t\r")) for i in want)

    single = materialize(stages["ngram_join"](spark, lined, sf_dir), "three")
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    root = {i: r for i, _, r in brute_ngrams(rows, 5, 8, 10)}
    assert sorted((r.doc_id, r.text) for r in single.collect()) == sorted((i, t) for i, t in rows if root[i] == i)

    mixed = materialize(stages["mixing"](spark, single, sf_dir), "four")
    copies = plain_mix([(r.doc_id, r.text, r.source) for r in single.collect()])
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id, r.text] = taken.get((r.doc_id, r.text), 0) + 1
    assert taken == {k: n for k, n in copies.items() if n}

    slow = packing.token_ids(queries.tokenizer_path()).slow
    pieces = {}
    for r in stages["packing"](spark, mixed, sf_dir).collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    want = {}
    for (i, text), n in taken.items():
        want[i] = want.get(i, 0) + n * (len(slow.encode(text or "", add_special_tokens=False).ids) + 1)
    assert pieces == want
