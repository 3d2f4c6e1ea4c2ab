"""Pair and search operators against brute force, with the awkward rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("engram.llm")
from engram.llm import embedding_dedup, line_dedup, ngram_join, topk_search  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_ngrams(rows, k, num, den):
    sets = {}
    for i, text in rows:
        data = (text or "").encode().lower()
        w = data.split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = components(list(sets), links)
    return {(i, len(sets[i]), root[i]) for i in sets}


def near_copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([4, 14, 40, 150, 900]))]
        for _ in range(rng.choice([2, 9, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(copy) // 40])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "One"), (i + 4, "oNE"), (i + 5, "a b"), (i + 6, "É"), (i + 7, "é"), (i + 8, "x y z"), (i + 9, "y " * 40_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_ngram_classes_equal_brute_force(spark, k, num, den, monkeypatch):
    import engram.llm._common as common

    monkeypatch.setattr(common, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngram_join, "BUNDLE", 30)
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, key string, x long").repartition(5)
    got = {tuple(r) for r in ngram_join.ngram_classes(df, k=k, num=num, den=den).collect()}
    assert got == brute_ngrams(rows, k, num, den)


def test_ngram_repeated_rows_null_ids_and_empty_table(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (3, text.upper()), (9, "other words are here now")], "doc_id long, text string")
    got = sorted(((r[0] is None, r[0] or 0, r[2]) for r in ngram_join.ngram_classes(df).collect()))
    assert got == [(False, 3, 3), (False, 7, 3), (False, 7, 3), (False, 9, 9), (True, 0, 3)]
    assert sorted(r.doc_id or 0 for r in ngram_join.drop_near_copies(df).collect()) == [3, 9]
    assert ngram_join.ngram_classes(df.limit(0)).count() == 0


def test_near_copies_leave_one_row_of_each_class(spark):
    a, b, c = ("one two three four five six", "red green blue black white grey", "north south east west up down")
    rows = [
        (3, a, "s"), (7, a.upper(), "s"), (7, b, "s"), (8, b, "s"), (9, b.title(), "s"),  # id 7 on texts of two classes
        (20, c, "t"), (20, c, "s"), (20, c, "s"), (21, c, "s"), (None, c, "s"),  # repeated rows of the kept id
        (None, "only null ids stand on this text", "s"), (None, "only null ids stand on this text", "s"), (None, "only null IDS stand on this text", "s"),
        (None, "and on this one as well now", "s"), (30, None, "s"), (31, "", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = ngram_join.drop_near_copies(df)
    assert out.columns == df.columns
    got = [(r.doc_id, (r.text or "").lower(), r.source) for r in out.collect()]
    want = [(3, a, "s"), (7, b, "s"), (20, c, "s"), (None, "only null ids stand on this text", "s"), (None, "and on this one as well now", "s"), (30, "", "s"), (31, "", "s")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_copies_with_odd_ids_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([i, i // 3, None]), t) for i, t in near_copies(5)]
    rows += rng.sample(rows, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    root = {i: r for i, _, r in brute_ngrams([(n, t) for n, (_, t) in enumerate(rows)], 5, 8, 10)}
    classes, loose = {}, []
    for n, (i, t) in enumerate(rows):
        if (t or "").encode().split():
            classes.setdefault(root[n], []).append((i is None, i or 0))
        else:
            loose.append((i is None, i or 0))
    want = sorted([min(ids) for ids in classes.values()] + loose)
    out = ngram_join.drop_near_copies(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == want


def test_each_text_is_fetched_once_and_alone(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(x) for x in base] + [" ".join(x[:-1] + ["end"]) for x in base]
    rows = [(None, t) for t in texts] * 5 + [(1, t + " more") for t in texts]
    places, written = [], ngram_join.materialize

    def kept(df, name):
        out = written(df, name)
        if name == "wanted":
            places.append(out)
        return out

    monkeypatch.setattr(ngram_join, "materialize", kept)
    monkeypatch.setattr(ngram_join, "discard", lambda df: None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_classes(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1}
    # a key gathers the places of one set only, and stands on one text
    sets = places[0].select(F.size(F.array_distinct("places.x")).alias("n")).collect()
    assert len(sets) == 48 and {r.n for r in sets} == {1}


def test_shingle_words_cut_at_ascii_space_only():
    from engram.llm._text import word_hashes

    texts = [b"", b"Ab ab", "x y z".encode(), b"a\x0bb\x0cc\td\r\ne", b"q" * 3_000_000 + b" r"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, first = word_hashes(np.frombuffer(b"".join(texts), np.uint8), at)
    assert np.diff(first).tolist() == [len(t.split()) for t in texts]
    assert h[0] == h[1] and len(set(h.tolist())) == len(h) - 1


def brute_embeddings(rows, threshold):
    sound = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound[i] = (np.array(v, float) / np.linalg.norm(v), label)
    links = [(a, b) for a, b in itertools.combinations(sound, 2) if sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0]) and sound[a][0] @ sound[b][0] >= threshold]
    root = components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {(i, n[i], root[i], root[i] == i) for i in n}


def test_embedding_classes_equal_brute_force(spark, monkeypatch):
    import engram.llm._common as common

    monkeypatch.setattr(common, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(20):
            base = rng.normal(0, 1, 64)
            for _ in range(int(rng.choice([1, 3, 30]))):
                rows.append((i, [float(x) for x in np.float32(base + rng.normal(0, rng.choice([0.0, 0.03, 0.1]), 64))], label))
                i += 1
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0]]
    rows += [(i + j, v, 1) for j, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {tuple(r) for r in embedding_dedup.embedding_classes(df).collect()}
    want = brute_embeddings(rows, 0.98)
    assert {g[0] for g in got} == {w[0] for w in want}
    lost = sum(w[1] for w in want) - sum(g[1] for g in got)
    assert 0 <= lost <= 0.005 * sum(w[1] for w in want)
    exact = dict((w[0], w) for w in want)
    assert all(g[1] <= exact[g[0]][1] for g in got)
    assert embedding_dedup.embedding_classes(df.limit(0)).count() == 0


def test_embedding_classes_of_extreme_components(spark):
    rows = [(1, [1e200, 1e200], "a"), (2, [1e-200, 1e-200], "a"), (3, [1.0, 1.01], "a"), (4, [1e-200, 5e-200], "a"), (5, [5e-324, 5e-324], "a"), (6, [-1e300, 0.0], "a")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10 ** rng.integers(3, 7)]) for i in range(150)]
    rows += [(1000, [1e300, 1.0, 1.0]), (1001, [9e6, 0.0, 0.0]), (50, [2.0**54, 0.0, 0.0]), (1003, [0.0, 0.0, 0.0])]
    sound = {}
    for i, v in rows:
        if sum((256 * x) * (256 * x) for x in v) < 2.0**62:
            ints = [math.floor(256 * x) for x in v]
            sound[i] = min(sound.get(i, ints), ints)
    want = set()
    for q in (i for i in sound if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 16))]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(120)]  # many equal vectors: ties by id
    bad = [(500, None), (550, [float("nan")] * 16), (600, [None] * 16)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").repartition(7)
    got = {tuple(r) for r in topk_search.top_k(df).collect()}
    ints = {i: np.floor(256 * np.float64(np.float32(v))).astype(int) for i, v in rows}
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk_search.top_k(few).count() == 2
    assert topk_search.top_k(df.limit(0)).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_lines(rows, least=16):
    def normal(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\r"))

    first, order = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        for n, raw in enumerate((text or "").split("\n")):
            line = normal(raw)
            if line and line not in first:
                first[line] = (i, n)
                order.append(line)
    kept = {}
    for j, line in enumerate(order):
        if not any(len(line) >= least and len(o) >= least and one_edit(line, o) for o in order[:j]):
            kept.setdefault(first[line][0], []).append(first[line][1])
    return kept


def line_rows(seed=1):
    rng = random.Random(seed)
    letters = "abcdefghé ß"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 16, 17, 40, 41, 200]))) for _ in range(40)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(line) + 1)
                line = rng.choice([line[:p] + rng.choice(letters) + line[p:], line[:p] + line[p + 1 :], line[:p] + rng.choice(letters) + line[p + 1 :]])
            lines.append(rng.choice([line, line.upper() if line.isascii() else line, f"  {line}\t"]))
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    rows += [(90, None), (91, ""), (92, "\n \n"), (93, "z" * 3000), (94, "z" * 3001), (95, "z" * 3002)]
    rng.shuffle(rows)
    return rows


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, line string").repartition(4)
    want = brute_lines(rows)
    got = {r.id: sorted(r.lines) for r in line_dedup.kept_lines(df, "doc_id", "text").collect()}
    assert got == {i: sorted(n) for i, n in want.items()}
    texts = dict(rows)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    blank = {i for i, t in rows if not (t or "").strip(" \t\r\n")}
    assert set(out) == set(want) | blank
    for i in want:
        lines = texts[i].split("\n")
        assert out[i] == "\n".join(x for n, x in enumerate(lines) if n in want[i] or not x.strip(" \t\r"))
    assert all(out[i] == texts[i] for i in blank)
    report = {r.doc_id: (r.n_lines, r.n_kept, r.kept) for r in line_dedup.line_report(df).collect()}
    assert all(report[i] == (sum(bool(x.strip(" \t\r")) for x in (t or "").split("\n")), len(want.get(i, [])), i in want or i in blank) for i, t in rows)


def test_line_dedup_repeated_rows_null_ids_and_empty_table(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line), (1, line), (2, line + "!"), (None, line), (None, "quite another line stands here")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[1]) for r in line_dedup.dedup_lines(df).collect()) == [(0, "quite another line stands here"), (1, line), (1, line)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_deletion_keys_meet():
    keys, places = line_dedup.deletion_keys("abcd")
    shorter, _ = line_dedup.deletion_keys("abd")
    changed, _ = line_dedup.deletion_keys("abxd")
    assert keys[2] == shorter[-1] == changed[2] and places.tolist() == [0, 1, 2, 3, -1]


def test_scanned_lines_in_slices(monkeypatch):
    import pyarrow as pa

    texts = [t for _, t in line_rows(3)] + ["é" * 40 + "\nABC é\n\n", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["id", "text_hash", "text"])
    whole = pa.Table.from_batches(line_dedup.scan_lines([batch])).to_pylist()
    monkeypatch.setattr(line_dedup, "SLICE", 64)
    assert pa.Table.from_batches(line_dedup.scan_lines([batch])).to_pylist() == whole
    want = {}
    for i, text in enumerate(texts):
        for n, raw in enumerate((text or "").split("\n")):
            line = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw.strip(" \t\r"))
            if line:
                want[i, n] = line
    assert {(r["id"], r["number"]): r["n"] for r in whole} == {k: len(v) for k, v in want.items()}
    hashes = {(r["h1"], r["h2"]): want[r["id"], r["number"]] for r in whole}
    assert len(hashes) == len(set(want.values())) and all(hashes[r["h1"], r["h2"]] == want[r["id"], r["number"]] for r in whole)
    counted = line_dedup._count_lines(pa.array(texts)).to_pylist()
    assert counted == [sum(k[0] == i for k in want) for i in range(len(texts))]
