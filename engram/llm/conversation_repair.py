"""Repair of conversations whose turns are damaged: counts of faults, the
cheapest edits that give a lawful sequence of roles, and the repaired text.

A conversation's rows, by turn, become a string of signatures: role initial and
fault.  Lawful are the role initials ``(s?(ua)+)?``.  Keeping a row costs 0, a
new role (user or assistant) 1, deletion 2, an empty row put in 5; blank and
repeated rows must go, and each truncated row that stays adds 5.

All different signature strings form one automaton that shares suffixes: a node
is a suffix, and its cost-to-go and best next edit, for each state of the
grammar, are worked out once for all conversations that end in it.  Strings come
sorted from their ends, so that a task holds one path of nodes, no more.

Damage (for tests and the numbered query) is drawn by crc32 of ``conv:turn``.

Awkward rows: nulls count as one space wherever they are text (role, text, the
key of the damage), so a null text is blank and a null role is neither system,
user nor assistant; a null conversation id is one conversation; null turns come
first and count for no gap.  Rows of one turn are ordered by role and text, both
by bytes, so repeated rows are neighbours.  An empty table gives no rows.

Memory: a task holds the signatures and edits of one conversation (about 40
bytes a row), never its texts; these stream through in order, as one SHA-256
over a conversation's text asks for.  Rows equal in all columns come as a row
and a number, and a text repeated within a conversation is told from its first
by a key that holds the turn as well, so neither makes a hot group.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.llm._common import materialize, prepare

SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
FAR = 1 << 60

#: States: nothing yet, after system, after user, after assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only state that a row of a chosen role (user or assistant) leads to.
CHOSEN = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
AT_END = (0, FAR, FAR, 0)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage, n times each."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20))
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    return out.select(
        "conv_id", "turn",
        F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("n"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Different (conv_id, turn, role, text) with their number ``n``, and whether
    the same role and text stood under an earlier turn (``again``)."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    once = once.withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    first = once.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at")
    )
    met = once.join(
        first.select("c", "s", F.col("at.turn").alias("t"), F.lit(True).alias("leads")),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")) & F.col("turn").eqNullSafe(F.col("t")), "left",
    )
    return met.select("conv_id", "turn", "role", "text", "n", F.col("leads").isNull().alias("again"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``marked`` with the role's initial and the first row's signature:
    ``x`` blank, ``d`` repeated; else s, u, a or o, a capital where truncated."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    sign = F.when(bare == "", F.lit("x")).when(F.col("again"), F.lit("d")).when(~F.substring(bare, -1, 1).isin(*ENDS), F.upper(letter)).otherwise(letter)
    return rows.withColumn("initial", initial).withColumn("sign", sign)


SIGNED = "signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


class _Conversation:
    def __init__(self, conv):
        self.conv, self.signs = conv, bytearray()
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn, initial: str, sign: str, n: int) -> None:
        if turn is not None and turn != self.last:
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        more = "x" if sign == "x" else "d"
        self.signs += (sign + more * (n - 1)).replace("d", "x").encode()
        self.blank += n if sign == "x" else 0
        self.duplicate += (n if sign == "d" else n - 1) if sign != "x" else 0
        self.truncated += sign.isupper()
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += n - 1
        self.before = initial

    def row(self) -> tuple:
        gaps = 0 if self.low is None else int(self.high - self.low + 1 - self.turns)
        return self.conv, self.signs.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024, weight: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        now = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, initial, sign, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "sign", "n"))):
                if now is None or now.conv != conv:
                    if now is not None:
                        yield now.row()
                    now = _Conversation(conv)
                now.add(turn, initial, sign, n)
        if now is not None:
            yield now.row()

    yield from _deferred(rows(), lambda: kind, ["signature", "gaps", "blank", "duplicate", "truncated", "illegal"])


def _deferred(rows: Iterator[tuple], kind, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of (conv_id, text, numbers ...), the id's type known with the first row."""
    first = next(rows, None)
    if first is None:
        return

    def again() -> Iterator[tuple]:
        yield first
        yield from rows

    types = [pa.string() if isinstance(x, str) else pa.int64() for x in first[1:]]
    yield from _batches(again(), pa.schema([("conv_id", kind()), *zip(names, types)]))


def signatures(faulty: DataFrame) -> DataFrame:
    """A row a conversation: signature string and counts of its faults."""
    kind = dict(faulty.dtypes)["conv_id"]
    ordered = faulty.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "initial", "sign", "n")
    return ordered.mapInArrow(_sign, f"conv_id {kind}, {SIGNED}")


class Suffixes:
    """The path of automaton nodes of one signature string, from its end.

    Node i is the suffix of length i; for each of the four grammar states it has
    the cost-to-go and the first edit of the best audit.  Edits that start with
    different letters never lead to equal audits, and those with the same letter
    lead to one state, so the least audit follows from the letters.
    """

    def __init__(self) -> None:
        self.path, self.costs, self.edits = "", array("q"), bytearray()
        self.made = 0
        self._settle(AT_END, "    ")

    def _settle(self, base: tuple, letters: str) -> None:
        cost, edit = list(base), list(letters)
        for _ in range(3):  # two rows put in one after the other are the most that pays
            for q in range(4):
                put = INSERT + cost[CHOSEN[q]]
                if put < cost[q] or (put == cost[q] and "I" < edit[q] and edit[q] != " "):
                    cost[q], edit[q] = put, "I"
        self.costs.extend(cost)
        self.edits += "".join(edit).encode()
        self.made += 1

    def _extend(self, sign: str) -> None:
        after = self.costs[-4:]
        cost, edit = [], []
        for q in range(4):
            best = (DELETE + after[q], "D")
            if sign != "x":
                stays = TRUNCATED if sign.isupper() else 0
                if (to := NEXT.get((q, sign.lower()))) is not None:
                    best = min(best, (stays + after[to], "K"))
                best = min(best, (stays + REROLE + after[CHOSEN[q]], "R"))
            cost.append(best[0])
            edit.append(best[1])
        self._settle(tuple(cost), "".join(edit))

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, audit); nodes shared with the string before are not made again."""
        ends, shared = signature[::-1], 0
        most = min(len(ends), len(self.path))
        while shared < most and ends[shared] == self.path[shared]:
            shared += 1
        del self.costs[4 * (shared + 1) :]
        del self.edits[4 * (shared + 1) :]
        for sign in ends[shared:]:
            self._extend(sign)
        self.path = ends
        audit, at, q = bytearray(), len(signature), 0
        while at or self.edits[q] != 32:
            edit = self.edits[4 * at + q]
            audit.append(edit)
            if edit == 73:  # I
                q = CHOSEN[q]
                continue
            if edit == 75:  # K
                q = NEXT[q, ends[at - 1].lower()]
            elif edit == 82:  # R
                q = CHOSEN[q]
            at -= 1
        return self.costs[4 * len(signature)], audit.decode()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes = Suffixes()
    rows = ((s, *nodes.solve(s)) for batch in batches for s in batch.column("signature").to_pylist())
    yield from _batches(rows, pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def cheapest_edits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each different signature string."""
    different = signed.select("signature").distinct().withColumn("ends", F.reverse("signature"))
    ordered = different.repartitionByRange("ends").sortWithinPartitions("ends").select("signature")
    return ordered.mapInArrow(_solve, "signature string, cost long, audit string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Repair:
    """Takes a conversation's rows in order and hashes what the audit leaves of them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.begun = audit, 0, 0, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        if self.begun:
            self.sha.update(b"\n")
        self.begun = True
        self.sha.update(role.encode() + b":")
        self.sha.update(text.encode())

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = CHOSEN[self.state]
            self._put(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state, role[:1]]
            self._put(role, text)
        elif edit == "R":
            self.state = CHOSEN[self.state]
            self._put(ROLE[self.state], text)

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        head = now = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            names = ("conv_id", "head", "role", "text", "n", *COUNTS)
            for conv, is_head, role, text, n, *counts in zip(*(batch.column(c).to_pylist() for c in names)):
                if is_head:
                    if head is not None:
                        yield head[0], head[1], now.digest(), *head[2:]
                    head, now = (conv, text, *counts), _Repair(text)
                elif head is not None and head[0] == conv:
                    for _ in range(n):
                        now.row(role, text)
        if head is not None:
            yield head[0], head[1], now.digest(), *head[2:]

    yield from _deferred(rows(), lambda: kind, ["audit", "repaired_sha256", *COUNTS])


def repair(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conv_id of ``originals``, from ``rows`` (conv_id,
    turn, role, text, n).  Conversations without rows have zeros, no edits and
    the hash of nothing; rows of other conversations are left out."""
    prepare(rows.sparkSession)
    found = materialize(with_faults(marked(rows)), "turns")
    signed = materialize(signatures(found), "signatures")
    solved = signed.join(cheapest_edits(signed), "signature")
    every = originals.select("conv_id").distinct().select(F.col("conv_id").alias("c"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]
    heads = every.join(solved, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"), F.lit(True).alias("head"), F.lit(None).cast(dict(found.dtypes)["turn"]).alias("turn"),
        F.lit("").alias("role"), F.coalesce("audit", F.lit("")).alias("text"), F.lit(0).cast("long").alias("n"), *zero,
    )
    turns = found.select("conv_id", F.lit(False).alias("head"), "turn", "role", "text", "n", *(F.lit(0).cast("long").alias(c) for c in COUNTS))
    ordered = heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "text")
    kind = dict(found.dtypes)["conv_id"]
    out = ordered.mapInArrow(_repair, f"conv_id {kind}, audit string, repaired_sha256 string, {', '.join(f'{c} long' for c in COUNTS)}")
    return out.select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the conversations after ``damaged``."""
    return repair(damaged(conversations), conversations)
