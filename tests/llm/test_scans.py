"""Scans, classifiers, packing, mixing and the pipeline."""

import collections
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("engram.llm")
from engram.llm import language_id, license_scan, mixing, packing, quality, queries, url_filter  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_url_parts_and_rules(spark):
    urls = {
        0: "https://A.Example.com/en/1?x#y", 1: "http://www.example.com/en/", 2: "x.net/es/", 3: None, 4: "ftp://q.net/es/a",
        5: "http://net/fr/", 6: "http://com", 7: "http://com/", 8: "http://notcom/x", 9: "http://a.b.com?u=http://c.net/es/", 10: "", 11: "http://m.www.example.com/en/z\nq", 12: "http://x.org#a/b",
    }
    df = spark.createDataFrame([(i, u, None, "h") for i, u in urls.items()], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        best = None
        for verdict, rule in url_filter.RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        return host, path, best and best[0], best[1] if best else "allow"

    assert {i: g[:3] for i, g in got.items()} == {i: judge(u)[:3] for i, u in urls.items()}
    assert all(got[i][3] == judge(u)[3] for i, u in urls.items() if judge(u)[2])
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_trust_and_distrust_follow_links(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TOLERANCE", 0.01)

    def page(i, host, *to):
        return (i, f"http://{host}/en/x", "".join(f'<a href="https://{t}/p">' for t in to))

    rows = [
        page(0, "good.com", "friend.org"), page(1, "friend.org", "far.org"), page(2, "far.org"),
        page(3, "shady.org", "bad.example.com"), page(4, "deep.org", "shady.org"), page(5, "bad.example.com", "good.com"), page(6, "alone.org"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.filter_urls(df).collect()}
    assert [got[h].verdict for h in ("friend.org", "far.org", "shady.org", "deep.org", "alone.org")] == ["allow", "allow", "block", "block", "allow"]
    # against a plain power iteration
    hosts = sorted({r.host for r in got.values()})
    edges = [("good.com", "friend.org"), ("friend.org", "far.org"), ("shady.org", "bad.example.com"), ("deep.org", "shady.org"), ("bad.example.com", "good.com")]

    def walk(edges, seed):
        start = np.array([1.0 if h == seed else 0.0 for h in hosts])
        x = start.copy()
        for _ in range(300):
            sent = np.zeros(len(hosts))
            for a, b in edges:
                sent[hosts.index(b)] += x[hosts.index(a)] / sum(e[0] == a for e in edges)
            x = start * (1 - 0.85 * sent.sum()) + 0.85 * sent
        return x

    trust, distrust = walk(edges, "good.com"), walk([(b, a) for a, b in edges], "bad.example.com")
    for i, h in enumerate(hosts):
        assert abs(got[h].trust - trust[i]) < 5e-4 and abs(got[h].distrust - distrust[i]) < 5e-4


def test_distrust_reaches_along_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TOLERANCE", 0.01)
    hosts = ["bad.example.com", *(f"h{i}.org" for i in range(24))]
    rows = [(i, f"http://{h}/en/x", f"<a href='http://{hosts[i - 1]}/'>" if i else "") for i, h in enumerate(hosts)]
    got = {r.host: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # all that flows ends at the chain's far end and returns to the seed
    share = (1 - 0.85) / (1 - 0.85 ** len(hosts))
    assert all(abs(got[h].distrust - share * 0.85**i) < 5e-4 for i, h in enumerate(hosts))
    assert [got[h].verdict for h in hosts[1:]] == ["block" if share * 0.85**i >= url_filter.LEAST else "allow" for i in range(1, len(hosts))]


def test_license_base_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("k").alias("labels"))
    odd = spark.createDataFrame([
        (9001, None, ""), (9002, "", ""), (9003, "Under  THE mit-license under the MIT LICENSE!", ""), (9004, "CC-BY-NC by nc", ""),
        (9005, "apache license version 20", ""), (9006, "éunder the mit license", ""), (9007, "mit " * 50_000 + "under the mit license", ""),
        (9008, "This work is licensed under the GNU General Public License, version 3.", ""), (9009, "licensed under GNU public version three general license", ""),
    ], docs.schema)
    rows = docs.union(odd)
    got = {r.doc_id: r for r in license_scan.scan_licenses(rows).collect()}
    for doc_id, text in rows.select("doc_id", "text").collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        spots, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            spots += at
            labels |= {label} if at else set()
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(spots), min(spots, default=None), max(spots, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert "gpl-3" in got[9008].labels and got[9009].labels == ""
    assert license_scan.scan_licenses(rows.limit(0)).count() == 0


def test_positional_matches_equal_brute_force():
    rng = np.random.default_rng(8)
    known = license_scan.read_templates(license_scan.TEMPLATES)
    held = {w: int(rng.integers(0, 50)) for _, words, _ in known for w in words}
    index = license_scan.build_index(1000, held, known)
    rare = []
    for _, words, _ in known:
        rare.append(set(sorted(set(words), key=lambda w: (held[w], w))[: license_scan.RARE]))
    for _ in range(60):
        text = []
        for _ in range(4):
            label, words, keys = known[int(rng.integers(len(known)))]
            copy = list(words)
            for _ in range(int(rng.choice([0, 1, 3, len(copy) // 3]))):
                copy[int(rng.integers(len(copy)))] = b"other"
            text += [b"filler"] * int(rng.integers(0, 4)) + copy[: int(rng.integers(len(copy) // 2, len(copy) + 1))]
        want = []
        for t, (label, words, keys) in enumerate(known):
            for at in range(len(text)):
                there = text[at : at + len(words)]
                agree = [a == b for a, b in zip(words, there)]
                seen = sum(ok and w in rare[t] for ok, w in zip(agree, words))
                phrases = all(text[at + p : at + p + len(k)] == k for p, k in keys)
                if seen >= len(rare[t]) - 1 and phrases and sum(agree) / len(words) >= license_scan.AGREE:
                    want.append((label, at, sum(agree) / len(words)))
        got = license_scan.scan_text(text, index, known)
        assert sorted((m["label"], m["start"], m["share"]) for m in got["matches"]) == sorted(want)
    assert license_scan.scan_text(license_scan.words_of(license_scan.MIT_TEXT), index, known)["labels"].startswith("mit")


def test_language_accuracy_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34 !!", None, "src0", 8), (9003, "12 34 !!", None, "src0", 8)], docs.schema)
    rows = docs.unionByName(odd).withColumn("host", F.lit("clash"))
    got = language_id.document_languages(rows)
    assert got.columns == rows.columns + ["id_language", "id_probability", "id_keep"] and got.count() == rows.count()
    assert not got.where("doc_id >= 9000 and id_keep").count()
    known = docs.where("length(text) > 60").select("doc_id")
    judged = got.join(known, "doc_id").agg(F.avg((F.col("lang") == F.col("id_language")).cast("double")).alias("right"), F.avg(F.col("id_keep").cast("double")).alias("kept")).first()
    assert judged.right > 0.97 and judged.kept > 0.99
    assert language_id.document_languages(rows.limit(0)).count() == 0


def test_languages_outside_the_model_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = np.random.default_rng(6)

    def words(letters, n):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(n))

    foreign = ["абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "日本語中文字漢学校生大小山川", "bcdfghjklmnpqrstvwxz", "qxzjkvw"]
    rows = [(10_000 + i, words(x, n), None, "src0", 0) for i, (x, n) in enumerate((x, n) for x in foreign for n in (40, 400))]
    got = language_id.document_languages(docs.unionByName(spark.createDataFrame(rows, docs.schema)))
    assert got.where("doc_id >= 10000 and (id_keep or id_language <> 'und')").count() == 0
    clean = got.where("doc_id < 10000 and length(text) > 60").agg(F.avg(F.col("id_keep").cast("double"))).first()[0]
    assert clean > 0.99


def test_short_texts_are_tested_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = ["qzxj vkwq xzq", "zq wx", "東京", "мир", "привет мир", "qwrtp zxcvb"]
    pieces = [" ".join(r.text.split()[9 : 9 + n]) for n in (1, 2, 3) for r in docs.where("length(text) > 200").orderBy("doc_id").limit(60).collect()]
    rows = [(10_000 + i, x, None, "src0", 0) for i, x in enumerate([*junk, *pieces])]
    got = language_id.document_languages(docs.unionByName(spark.createDataFrame(rows, docs.schema)))
    named = {r.doc_id - 10_000: r.id_language for r in got.where("doc_id >= 10000").collect()}
    assert [named[i] for i in range(len(junk))] == ["und"] * len(junk)
    assert sum(named[i] == "und" for i in range(len(junk), len(rows))) <= len(pieces) // 50


def test_unseen_trigrams_favour_no_language(spark):
    rows = [(i, "the cat sat on the mat and ran " * 20, "en") for i in range(30)] + [(100, "der hund lief in den wald ", "de")]
    languages, table, _ = language_id.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert languages == ["de", "en"] and np.allclose(table.min(axis=0)[0], table.min(axis=0)[1]) and np.allclose(np.exp(table).sum(axis=0), 1, atol=1e-3)


def test_page_evidence_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    page = '<html lang="{}"><body>zx</body></html>'
    rows = [(0, "https://h.example.org/fr/1", page.format("fr")), (1, "https://h.example.org/x", page.format("de")), (2, None, None), (3, "https://a.de/", "<p>a b</p>")]
    got = {r.page_id: r for r in language_id.page_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[0].id_language == "fr" and got[3].id_language == "de" and not got[2].id_keep
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    right = language_id.page_languages(pages, docs).where("id_language = regexp_extract(url, '//[^/]*/([a-z]+)/', 1)").count()
    assert right >= 0.95 * pages.count()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels)
    judged = got.where("held_out").join(labels, "doc_id").toPandas()
    good, bad = judged[judged.quality == 1].score.to_numpy(), judged[judged.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert ((judged.score >= 0.3) == (judged.predicted == 1)).all()
    ids = [r[0] for r in got.where("held_out").select("doc_id").limit(50).collect()]
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def test_quality_gradient_and_slices(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (0, 5, 64, 65, 700)]
    labels = np.array([0, 1, 0, 1, 1], np.float32)
    net = quality.start_network()
    net["mean"][:], net["top"][:] = rng.normal(0, 0.3, quality.FILTERS), rng.normal(0, 0.3, quality.FILTERS)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)

    def loss(n):
        p = quality.scores(n, data, at)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    g = quality._gradients(net, texts, labels)
    for key, spot in [("w", (3, 2)), ("w", (60, 5)), ("b", (1,)), ("mean", (4,)), ("top", (6,)), ("c", (0,))]:
        up, down = ({k: v.astype(np.float64) for k, v in net.items()} for _ in range(2))
        up[key][spot] += 1e-3
        down[key][spot] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - g[key][spot]) < 2e-3
    whole = quality.scores(net, data, at)
    monkeypatch.setattr(quality, "SLICE", 128)
    assert np.allclose(whole, quality.scores(net, data, at), atol=1e-5)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "A" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (9, None)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).count() == 4
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("start"))
    odd = spark.createDataFrame([(9001, None, 0), (9002, "", 0), (9003, "a <|endoftext|> b  　\n\n 'll é", 0), (9004, "word " * 30_000, 0), (9005, "q" * 9000, 0)], docs.schema)
    rows = docs.union(odd).repartition(3).persist()
    slow = Tokenizer.from_file(queries.tokenizer_path())
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.pack(rows, queries.tokenizer_path()).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text, _ in rows.collect():
        want = [*slow.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(pieces[doc_id], key=lambda p: p[0])
        assert np.concatenate([p[1] for p in got]).tolist() == want and all(p[2] == len(want) for p in got)
        assert [p[0] for p in got] == np.cumsum([0, *(len(p[1]) for p in got[:-1])]).tolist()
    total = padding = 0
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
        n = sum(n for _, n in parts)
        assert n <= 2048
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding < 0.02 * total + 3 * 2048
    rows.unpersist()
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\r\n", "\u3000", "\xa0", "\x0b", "\x85"])
def test_long_white_space_is_encoded(space):
    tokens = packing.token_ids(queries.tokenizer_path())
    for text in (space * 1_000_000, "word" + space * 400_000, space * 400_000 + "word", "a b" + space * 9999 + " x"):
        assert tokens.encode([text]) == [tokens.slow.encode(text, add_special_tokens=False).ids]


def test_best_cuts_equal_brute_force():
    rng = np.random.default_rng(4)
    for window in (10, 16, 17):
        padding = lambda n: 0 if n & (n - 1) == 0 else window - n  # noqa: B023, E731
        for _ in range(30):
            places = np.cumsum(rng.integers(1, 9, 14))
            penalty = rng.integers(0, 6, 14)
            cost = {0: 0}
            for j, p in zip(places.tolist(), penalty.tolist()):
                cost[j] = min(c + padding(j - i) + p for i, c in cost.items() if j - i <= window)
            want, j = [], int(places[-1])
            pen = dict(zip(places.tolist(), penalty.tolist()))
            while j:  # the earliest of the best
                want.append(j)
                j = min(i for i in cost if i < j and j - i <= window and cost[i] + padding(j - i) + pen[j] == cost[j])
            assert packing.best_cuts(places, penalty, window).tolist() == want[::-1]


def test_powers_of_two_are_not_padded():
    assert packing.best_cuts(np.array([1024, 1536]), np.array([0, 0])).tolist() == [1024, 1536]
    assert packing.best_cuts(np.array([1, 2, 4, 2048]), np.array([0, 0, 0, 0])).tolist() == [2048]
    assert packing.best_cuts(np.array([1]), np.array([0])).tolist() == [1]
    assert packing.best_cuts(np.array([1024]), np.array([48])).tolist() == [1024]


def test_mixing_reaches_targets(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    again = {(r.id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()}
    assert {(r.id, r.copies) for r in rows} == again and len(rows) == docs.count()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    largest = collections.Counter()
    for r in rows:
        assert 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    total = sum(sizes.values())
    want, free = {}, dict(zip(sorted(sizes), [5, 2, 1] * len(sizes)))
    while True:
        level = (1.5 * total - sum(want.values())) / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            del free[s]
    want |= {s: level * w for s, w in free.items()}
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * total and abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", None, "x"), (1, "a b c", None, "x"), (None, "d e", "s", "x"), (2, None, "s", "x"), (3, "", "t", "x"), (4, "é f g\x0bh", "", "x")], "doc_id long, text string, source string, size string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 6 and sorted(r.size for r in rows) == [0, 0, 2, 3, 3, 3]
    assert mixing.mixed_documents(docs).columns == docs.columns
    taken = sum(r.copies for r in rows)
    assert mixing.mixed_documents(docs).count() == taken
    assert mixing.mix(docs.limit(0)).count() == 0


def test_oracles_agree(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    for t in ("documents", "embeddings", "pages", "labels"):
        duckdb.sql(f"create or replace view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = duckdb.sql(sql).df()
        got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        order = list(want.columns[:3])
        a, b = (x.sort_values(order).reset_index(drop=True) for x in (want, got))
        assert len(a) == len(b)
        for c in want.columns:
            assert (a[c].isna() == b[c].isna()).all(), (name, c)
            x, y = a[c][a[c].notna()], b[c][b[c].notna()]
            if not pd.api.types.is_numeric_dtype(x):
                assert x.tolist() == y.tolist(), (name, c)
            else:
                assert np.allclose(x.to_numpy(float), y.to_numpy(float), rtol=1e-12), (name, c)


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").persist()
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mixing", "packing"]
    from engram.llm._common import materialize

    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), name)
        assert out.columns == columns
        if name != "mixing":
            assert 0 < out.count() <= n
        docs, n = out, out.count()
    pieces = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
