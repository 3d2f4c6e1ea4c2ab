"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from engram.llm import conversation_repair as R
from engram.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
LAWFUL = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, repaired rows) by a search over (rows done, role initials so far folded to a state)."""
    heap, done = [(0, "", 0, "", ())], {}
    best = None
    while heap:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if at == len(rows) and LAWFUL.match(roles):
            best = min(best or (cost, audit, kept), (cost, audit, kept))
        if (at, roles) in done and done[at, roles] <= (cost, audit):
            continue
        done[at, roles] = (cost, audit)
        steps = [(5, "I", at, r, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            _, _, role, text = rows[at]
            steps.append((2, "D", at + 1, None, None))
            if found[at] not in ("blank", "duplicate"):
                more = 5 if found[at] == "truncated" else 0
                steps.append((more, "K", at + 1, role, (role, text)))
                steps += [(more + 1, "R", at + 1, r, (r, text)) for r in ("user", "assistant")]
        for price, letter, to, role, row in steps:
            after = roles if role is None else roles + (role[:1] or "-")
            if re.match(r"(s?(ua)*u?)\Z", after) and len(after) <= len(rows) + 4:
                heapq.heappush(heap, (cost + price, audit + letter, to, after, kept if row is None else (*kept, row)))
    return best


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == conv])
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        found = faults(own)
        turns = {t for _, t, _, _ in own if t is not None}
        initials = [r[2][:1] for r in own]
        cost, audit, kept = cheapest(own, found)
        text = "\n".join(f"{a}:{b}" for a, b in kept)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def run(spark, rows, schema=SCHEMA, **more):
    got = R.repair_damaged(spark.createDataFrame(rows, schema)).collect()
    found = {r.conv_id: (*(r[c] for c in R.COUNTS), r.audit, r.repaired_sha256) for r in got}
    assert len(found) == len(got)
    return found


def test_random_conversations(spark):
    draw = random.Random(5)
    texts = ["Yes.", "No?", "open", " \n", "", None, "é!  \n", "a.b", "word. more"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "User"]
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(0, 7)):
            rows.append((conv, draw.choice([turn, turn, turn, 2, None, turn + 40]), draw.choice(roles), draw.choice(texts)))
    for conv in range(60, 110):  # mostly lawful ones
        rows += [(conv, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(draw.randint(1, 6))]
    rows += [(None, 0, "user", "hi."), (None, 1, "assistant", "ho.")]
    assert run(spark, rows) == plain(rows)


def test_every_short_signature():
    """All strings of up to four rows, in an order that shares suffixes and in another."""
    letters = "suaoSUAOx"
    cases = ["".join(c) for n in range(5) for c in itertools.product(letters, repeat=n)]
    sorted_cases, mixed = sorted(cases, key=lambda s: s[::-1]), random.Random(1).sample(cases, len(cases))
    one, other = R.Suffixes(), R.Suffixes()
    found = {s: one.solve(s) for s in sorted_cases}
    assert found == {s: other.solve(s) for s in mixed}
    assert one.made == len(cases) < other.made  # each node once: the suffixes are the strings themselves
    name = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for s in random.Random(2).sample(cases, 400):
        rows = [(0, 0, name[c.lower()], "") for c in s]
        cost, audit, _ = cheapest(rows, ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in s])
        assert found[s] == (cost, audit), s


def test_awkward(spark):
    assert run(spark, []) == {}
    nothing = hashlib.sha256(b"").hexdigest()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kept = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    assert run(spark, [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    rows = [(kept, 0, "user", "x.")] * 3000 + [(kept, None, None, None)]
    found = run(spark, rows)[kept]
    assert found[:4] == (0, 1, 2999, 0) and found[5] == 2 + 2999 * 2 + 2 and found[6] == "D" * 3001  # all go rather than an answer of 5 be put in
    extra = spark.createDataFrame([(kept, 0, "user", "x.", 1, 2, 3)], SCHEMA + ", n int, head int, signature int")
    assert R.repair_damaged(extra).columns == ["conv_id", *R.COUNTS, "audit", "repaired_sha256"]
    long = [(kept, t, "user" if t % 2 == 0 else "assistant", "z" * 5000 + ".") for t in range(3000)]
    (row,) = run(spark, long).values()
    hurt = damage(long)
    assert sum(row[1:4]) == sum(f != "" for f in faults(hurt)) and len(row[6].replace("I", "")) == len(hurt) and run(spark, long)[kept] == row
    named = run(spark, [("c", 1, "user", "x.")], "conv_id string, turn int, role string, text string")
    assert set(named) == {"c"}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, sf_dir).collect()
    assert {r.conv_id: (*(r[c] for c in R.COUNTS), r.audit, r.repaired_sha256) for r in got} == plain(rows)
