"""Filter interactions against every order applied in turn."""

import itertools
import math
import random
import re

from engram.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    return (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
    )


def plain(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = [(s or "", i, (*fails(t or ""), (t or "") in first and i != first[t or ""])) for i, t, s in docs]
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, x in labels if d is not None and x == 1}
    out = set()
    for part in {r[0] for r in rows}:
        own, steps, share = [r for r in rows if r[0] == part], [], [0] * 5
        for order in itertools.permutations(range(5)):
            left, gone = own, []
            for step, f in enumerate(order):
                hit = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                share[f] += len(hit)
                steps.append((
                    "".join("ABCDE"[x] for x in order), step + 1, len(left), len(hit), sum(r[2][f] for r in gone),
                    sum(r[2][f] and sum(r[2]) == 1 for r in own), sum(r[1] in good for r in hit), sum(r[1] in toxic for r in hit), f,
                ))
                gone = gone + hit
        out |= {(part, *s[:-1], share[s[-1]]) for s in steps}
    return out


def run(spark, docs, labels):
    got = A.filter_interactions(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    found = {tuple(r) for r in got}
    assert len(found) == len(got)
    return found


def test_random_documents(spark):
    draw, docs = random.Random(3), []
    for i in range(120):
        words = [draw.choice(["alpha", "beta", "GAMMA", "d&d", "é", *map(str, range(draw.choice([3, 90])))]) for _ in range(draw.choice([0, 10, 49, 50, 60, 80]))]
        docs.append((i, draw.choice([" ", "\n", "\t"]).join(words), draw.choice(["a", "a", "b", "", None])))
    docs += [(200 + i, docs[draw.randrange(40)][1], draw.choice(["a", "b", None])) for i in range(40)]
    docs += [(5, docs[5][1], "a"), (None, docs[6][1], "b"), (None, "only nulls", "c"), (None, "only nulls", "c"), (7, None, None), (9000, "", "a")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 300, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    assert run(spark, docs, labels) == plain(docs, labels)


def test_edges(spark):
    assert run(spark, [], []) == set()
    exact = [
        (0, " ".join(f"w{i}" for i in range(50)), "p"), (1, " ".join(f"w{i}" for i in range(49)), "p"),
        (2, " ".join(f"w{i % 65}" for i in range(100)), "p"), (3, " ".join(f"w{i % 64}" for i in range(100)), "p"), (4, "A" * 5 + "b" * 95, "p"), (5, "A" * 6 + "é" * 94, "p"),
    ]
    assert run(spark, exact, []) == plain(exact, [])
    one = {r[2]: r for r in run(spark, [(1, "x", "s")] * 1000, [(1, 1, 1)]) if r[1] == "ABCDE"}
    assert one[1][3:] == (0, 1000, 0, 1000, 1000, 1000, 120_000) and one[5][3:] == (0, 0, 0, 0, 0, 0, 0)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x", "s", 1, 2, 3, 4)], DOCS + ", part int, mask int, digest int, first int")
    labels = spark.createDataFrame([(1, 1, 0, 9, 9)], LABELS + ", good int, part int")
    assert A.filter_interactions(docs, labels).count() == 600


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(A, "PIECE", 10)
    text = "ab  cd\tab " * 50 + "x" * 100 + " ab"
    assert A.word_counts(text.encode()) == (len(text.split()), len(set(text.split())))


def test_plain_changes_visit_every_order():
    row, seen = list(range(5)), {tuple(range(5))}
    for level in A.plain_changes(5):
        row[level], row[level + 1] = row[level + 1], row[level]
        seen.add(tuple(row))
    assert len(seen) == math.factorial(5)


def test_swapped_diagrams_hold_the_same_counts():
    draw = random.Random(8)
    counts = {m: (draw.randint(1, 9), draw.randint(0, 1), draw.randint(0, 2)) for m in draw.sample(range(32), 20)}
    diagram = A.Diagram(counts, 5)
    for level in [0, 3, 1, 2, 0, 1, 3, 3]:
        diagram.swap(level)
        held = {}

        def walk(node, depth, mask):
            if depth == 5:
                held[mask] = diagram.total[node]
            else:
                for to, bit in ((diagram.low[node], 0), (diagram.high[node], 1 << diagram.order[depth])):
                    if to:
                        walk(to, depth + 1, mask | bit)

        walk(diagram.root, 0, 0)
        assert held == counts
