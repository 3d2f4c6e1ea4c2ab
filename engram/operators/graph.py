"""Graph operators: co-activity edges, rings, components, ranks, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from engram.operators import blocks, ranks
from engram.operators.blocks import COUNT, PATH, RING, ring_blocks
from engram.operators.labels import of_links, of_meetings
from engram.operators.steps import join_split, spent, written


def near_in_time(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, width: int) -> DataFrame:
    """Rows of equal key whose times differ by at most ``width``.

    A range join as an equi-join: times fall into cells of ``width``, and the
    right side stands in its cell and both neighbours.  A hot key is spread
    over its cells.
    """
    a = left.withColumn("_cell", F.floor(F.col(left_ts) / width))
    b = right.withColumn("_cell", F.explode(F.array(*(F.floor(F.col(right_ts) / width) + d for d in (-1, 0, 1)))))
    return a.join(b, [*key, "_cell"]).where(F.abs(F.col(left_ts) - F.col(right_ts)) <= width).drop("_cell")


def coedit_pairs(edits: DataFrame, width: int | None) -> DataFrame:
    """(a, b, page, ta, tb) for two actors of one page, a < b; within ``width`` if given."""
    a = edits.select("page", F.col("actor").alias("a"), F.col("ts_us").alias("ta"))
    b = edits.select("page", F.col("actor").alias("b"), F.col("ts_us").alias("tb"))
    if width is None:
        a, b = a.select("page", "a").distinct(), b.select("page", "b").distinct()
        return join_split(a, b, ["page"]).where("a < b")
    return near_in_time(a, b, ["page"], "ta", "tb", width).where("a < b")


def coedited_windowed(edits: DataFrame, width: int) -> DataFrame:
    """(a, b, shared, closest_us) over pairs of edits within ``width``; pairs are made
    where the edits of two groups of actors lie, and are not shuffled."""
    return blocks.windowed(edits, width)


def coedited_weight(edits: DataFrame) -> DataFrame:
    """(a, b, weight): number of pages both edited."""
    return blocks.weights(edits)


def rings(edits: DataFrame, width: int, since: int | None = None, until: int | None = None, anchor: str | None = None) -> DataFrame:
    """Coordination rings: a and b meet on page x, b and c on another page y,
    all four edits within ``width``.

    One row a fingerprint (its actors and pages, each sorted), with the
    smallest span and closeness 1 - span / width.  Paths are made where the edits
    of two groups of pages lie, and are not shuffled.
    """
    e, rows, plain = _ring_edits(edits, since, until)
    found = ring_blocks(e, rows, width, anchor, RING)
    if not plain:
        found = found.groupBy("actors", "pages").agg(F.min("span_us").alias("span_us"))
    return found.withColumn("closeness", 1 - F.col("span_us") / width)


def ring_paths(edits: DataFrame, width: int, since: int | None = None, until: int | None = None, anchor: str | None = None) -> DataFrame:
    """(actors, pages, a, mid, c, x, y, t_min, t_max, span_us, closeness): of each
    ring the path a - x - mid - y - c of the smallest span, then of the earliest
    start, then of the smallest names."""
    e, rows, plain = _ring_edits(edits, since, until)
    found = ring_blocks(e, rows, width, anchor, PATH)
    if not plain:
        best = F.min(F.struct("span_us", "t_min", "a", "mid", "c", "x", "y", "t_max")).alias("p")
        found = found.groupBy("actors", "pages").agg(best).select("actors", "pages", *(f"p.{c}" for c in ("a", "mid", "c", "x", "y", "t_min", "t_max", "span_us")))
    return found.withColumn("closeness", 1 - F.col("span_us") / width)


def _ring_edits(edits: DataFrame, since: int | None, until: int | None) -> tuple[DataFrame, int, bool]:
    """The edits of the range, their number, and whether no name holds the bar that
    fingerprints are joined by; else different rings can have one fingerprint."""
    e = edits.where("actor is not null and page is not null and ts_us is not null")
    e = e.select("actor", "page", F.col("ts_us").cast("long").alias("ts_us"))
    if since is not None:
        e = e.where(F.col("ts_us") >= since)
    if until is not None:
        e = e.where(F.col("ts_us") <= until)
    seen = e.agg(F.count("*").alias("n"), F.max(F.contains("actor", F.lit("|")) | F.contains("page", F.lit("|"))).alias("barred")).first()
    return e, seen["n"], not seen["barred"]


def ring_verdict(found: DataFrame, least: float = 0.5) -> DataFrame:
    """(rings, ring_score, should_open_case) of a set of rings."""
    return _opened(found.agg(F.count("*").alias("rings"), F.coalesce(F.max("closeness"), F.lit(0.0)).alias("ring_score")), least)


def _opened(verdict: DataFrame, least: float) -> DataFrame:
    return verdict.withColumn("should_open_case", (F.col("rings") > 0) & (F.col("ring_score") >= least))


def verdict_of(edits: DataFrame, width: int, least: float = 0.5) -> DataFrame:
    """``ring_verdict`` of the rings of edits, counted in the tasks that find them."""
    e, rows, plain = _ring_edits(edits, None, None)
    if not plain:
        return ring_verdict(rings(edits, width), least)
    found = ring_blocks(e, rows, width, None, COUNT)
    score = F.coalesce(1 - F.min("span_us") / width, F.lit(0.0))
    return _opened(found.agg(F.coalesce(F.sum("rings"), F.lit(0)).alias("rings"), score.alias("ring_score")), least)


def ablation(history: DataFrame, event: DataFrame, width: int) -> DataFrame:
    """Verdicts (arm, rings, ring_score, should_open_case) of one event with its
    history (warm) and alone (cold)."""
    warm = history.unionByName(event).dropDuplicates(["event_id"])
    both = [verdict_of(e, width).select(F.lit(arm).alias("arm"), "rings", "ring_score", "should_open_case") for arm, e in (("warm", warm), ("cold", event))]
    return both[0].unionByName(both[1])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable, over undirected edges."""
    both = edges.select(F.col(a).alias("s"), F.col(b).alias("d")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("d"), F.min("s")).alias("next")).withColumn("component", F.col("next")), "labels")
    while True:
        known = labels.select("node", F.col("next").alias("component"))
        heard = both.join(known.withColumnRenamed("node", "s"), "s").groupBy(F.col("d").alias("node")).agg(F.min("component").alias("other"))
        up = known.select(F.col("node").alias("next"), F.col("component").alias("up"))
        step = known.join(heard, "node").withColumn("next", F.least("component", "other")).drop("other")
        step = written(step.join(up, "next", "left").select("node", "component", F.least("next", "up").alias("next")), "labels", moved=F.count_if(F.col("next") != F.col("component")))
        spent(labels)
        labels = step
        if not labels.seen["moved"]:
            spent(both)
            return labels.select("node", F.col("next").alias("component"))


#: Edges from which on a step of ranks is a plan of its own.
MANY_EDGES = 5_000_000


def coedit_links(edits: DataFrame, width: int) -> DataFrame:
    """(a, bs): with whom each actor has met within ``width``, of a < b; an actor
    can have several rows, each link is in one."""
    return blocks.links(edits, width)


def pagerank(edges: DataFrame, nodes: DataFrame, n_total: int, tolerance: float = 1e-7, most: int = 500, damping: float = 0.85, stride: int = 6) -> DataFrame:
    """(node, score) of unweighted ranks over directed edges (a, b), or (a, bs) with
    some of a node's edges in an array a row, to within ``tolerance`` in all; ``n_total`` nodes share the mass, those outside ``nodes``
    too.  More than ``most`` steps raise.

    Mass that ends at a node without edges goes to all nodes alike, which only
    scales the ranks: they are the sum of what a uniform start hands on, step by
    step, divided by the total at the end.  A step is then one join and one sum
    over what was handed on last, without a number from the driver, so ``stride``
    steps are one plan (one, where edges are many: written ranks have a known size,
    and while that is small the edges are not shuffled); a node meets itself in the join as well, and so keeps its
    sum.  What a step hands on bounds what is still to come.
    """
    packed = edges if "bs" in edges.columns else edges.select("a", F.array("b").alias("bs"))
    packed = written(packed, "edges", n=F.sum(F.size("bs").cast("long")))
    stride = stride if (packed.seen["n"] or 0) < MANY_EDGES else 1
    fan = packed.groupBy("a").agg(F.sum(F.size("bs").cast("long")).alias("fan"))
    fan = fan.select("a", (F.lit(damping) / F.col("fan")).alias("share"))
    own = nodes.select(F.col("node").alias("a"), F.array("node").alias("bs"), F.lit(None).cast("double").alias("share"))
    if stride > 1:
        ways = written(packed.join(fan, "a").select("a", "bs", "share").union(own), "ways")
    else:
        fan = written(fan, "fan")
    each = 1.0 / n_total
    rank = nodes.select("node", F.lit(each).alias("given"), F.lit(each).alias("kept"))
    for _ in range(0, most, stride):
        for _ in range(stride):
            now = rank.select(F.col("node").alias("a"), "given", "kept")
            if stride > 1:
                met = ways.join(now, "a")
            else:
                shared = written(now.join(fan, "a").select("a", "share", "given", "kept"), "shares")
                met = packed.join(shared, "a").select("a", "bs", "share", "given", "kept").union(own.join(now, "a").select("a", "bs", "share", "given", "kept"))
            met = met.select(F.explode("bs").alias("b"), "share", "given", "kept")
            given = F.coalesce(F.sum(F.col("given") * F.col("share")), F.lit(0.0))
            rank = met.groupBy(F.col("b").alias("node")).agg(given.alias("given"), (given + F.sum(F.when(F.col("share").isNull(), F.col("kept")))).alias("kept"))
        rank = written(rank, "rank", given=F.sum("given"), kept=F.sum("kept"), n=F.count(F.lit(1)))
        total = (rank.seen["kept"] or 0.0) + (n_total - rank.seen["n"]) * each
        if (rank.seen["given"] or 0.0) * damping / (1 - damping) <= tolerance * total:
            spent(packed, ways if stride > 1 else fan)
            return rank.select("node", (F.col("kept") / total).alias("score"))
    raise RuntimeError(f"ranks still move by {rank.seen['given']} after {most} steps")


def label_propagation(edges: DataFrame) -> DataFrame:
    """(node, label): labels that have settled, so that each node has one of the
    most frequent labels among its neighbours.

    A node moves only to a label that strictly more of its neighbours have (the
    smallest of the most frequent).  Of neighbours that would move to different
    labels, only those to the label first in that step's order of hashes move;
    so no move spoils another's, every step adds to the edges whose ends agree,
    and the steps end by themselves.
    """
    return of_links(edges)


def coedit_labels(edits: DataFrame, width: int) -> DataFrame:
    """``label_propagation`` over the actors who edit one page within ``width``; the
    links are made, and stay, as numbers in arrays."""
    return of_meetings(edits, width)


def ringleader(links: DataFrame, actors: DataFrame, n_total: int, k: int = 5, settled: bool = True) -> dict[str, DataFrame]:
    """Who leads and with whom, over co-edit links (a, b).

    ``influence`` (place, node, score, score_vs_baseline): the ``k`` best ranked,
    against the mean of all actors; ``communities`` (component, size, place,
    node): components of two and more; ``cell``: that of the first in rank;
    ``label_propagation``: the same by settled labels, left out without ``settled``.
    """
    links = written(links.select("a", "b").distinct(), "links")
    found = _led(pagerank(links, actors, n_total), components(links), k)
    if settled:
        found["label_propagation"] = cell_members(label_propagation(links).withColumnRenamed("label", "component"))
    return found


def coedit_ranks(edits: DataFrame, width: int, n_total: int, tolerance: float) -> DataFrame:
    """``pagerank`` (node, score) of all actors over the links of those who edit one page
    within ``width``; links are made, and stay, as numbers in blocks."""
    return ranks.of_meetings(edits, width, n_total, tolerance)


def coedit_leaders(edits: DataFrame, width: int, n_total: int, k: int = 5) -> dict[str, DataFrame]:
    """``ringleader`` (without settled labels) of the actors who edit one page within
    ``width``; scores are so near that their ratio to the mean has its first digits."""
    ranked, labels = ranks.with_components(edits, width, n_total, 1e-7 / max(n_total, 1))
    return _led(ranked, labels, k)


def _led(ranked: DataFrame, labels: DataFrame, k: int) -> dict[str, DataFrame]:
    """``influence``, ``communities`` and ``cell`` of ``ringleader``."""
    by_rank = Window.orderBy(F.desc("score"), "node")
    top = ranked.orderBy(F.desc("score"), "node").limit(k).withColumn("place", F.row_number().over(by_rank))
    top = written(top.crossJoin(ranked.agg(F.avg("score").alias("mean"))), "leaders")  # k rows
    cells_of = written(cell_members(labels), "cells")
    leader = top.where("place = 1").select("node")
    own = cells_of.join(leader, "node", "left_semi").select("component")
    return {
        "influence": top.select("place", "node", "score", (F.col("score") / F.col("mean")).alias("score_vs_baseline")),
        "communities": cells_of, "cell": cells_of.join(own, "component", "left_semi").select(*cells_of.columns),
    }


def cells(labels: DataFrame, least: int = 2) -> DataFrame:
    """Components of at least ``least`` members: (component, size)."""
    return labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)


def cell_members(labels: DataFrame, least: int = 2) -> DataFrame:
    """(component, size, place, node): the members of each cell in order, a row
    each, so that a cell of any size stays rows."""
    from engram.operators.steps import numbered

    large = labels.join(cells(labels, least), "component")
    return numbered(large, "component", ["node"], "place").select("component", "size", "place", "node")


def supersede_pairs(claims: DataFrame) -> DataFrame:
    """(newer, older, relation) of neighbouring claims of a subject and
    predicate whose texts differ; of equal date: contradicts.  Claims are in order
    of date, session where they have one, and id."""
    session = ["session_id"] if "session_id" in claims.columns else []
    order = Window.partitionBy("subject", "predicate").orderBy("valid_us", *session, "id")
    seen = claims.where("subject is not null and predicate is not null").select(
        F.col("id").alias("newer"), F.lag("id").over(order).alias("older"), "text", "valid_us",
        F.lag("text").over(order).alias("old_text"), F.lag("valid_us").over(order).alias("old_valid"),
    )
    relation = F.when(F.col("valid_us") == F.col("old_valid"), "contradicts").otherwise("supersedes")
    return seen.where("older is not null and text <> old_text").select("newer", "older", relation.alias("relation"))


def supersede_heads(pairs: DataFrame, clocks: DataFrame) -> DataFrame:
    """(id, head, depth, via): for each superseded id the end of its chain of
    newer claims, the steps to it, and the first of them.

    Where chains fork the longest path wins, then the newest head, then the
    smaller id.  ``clocks``: (id, clock); a missing clock counts as 0.  Ids on a
    cycle, and those all of whose paths run into one, have no row.

    Stretches without forks are jumped over by doubling, so a long chain costs
    few rounds; forks are then settled from the heads down, each once.
    """
    ups = written(pairs.select(F.col("older").alias("id"), F.col("newer").alias("up")).distinct(), "ups")
    newer = ups.groupBy("id").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    # stretches: one newer claim; anchor = the head or fork at their end
    jump = written(newer.where("n = 1").select("id", F.col("up").alias("anchor"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")), "jumps", moved=F.count_if("moved"))
    longest = jump.seen["moved"]
    while jump.seen["moved"]:
        ahead = jump.select(F.col("id").alias("anchor"), F.col("anchor").alias("far"), F.col("steps").alias("more"))
        step = jump.join(ahead, "anchor", "left").select("id", F.coalesce("far", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved"))
        # more steps than there are claims: on a cycle, or led into one
        after = written(step.where(F.col("steps") <= longest), "jumps", moved=F.count_if("moved"))
        spent(jump)
        jump = after
    lost = jump.select("id", "anchor", "steps")
    # an anchor must be a head or a fork; what ends elsewhere ended at a cycle
    single = newer.where("n = 1").select(F.col("id").alias("anchor"))
    lost = lost.join(single, "anchor", "left_anti")
    heads = ups.select(F.col("up").alias("id")).distinct().join(newer.select("id"), "id", "left_anti")
    zero = F.lit(0).cast("long")
    best = heads.join(clocks.select("id", "clock"), "id", "left").select("id", F.col("id").alias("head"), F.coalesce(F.col("clock").cast("long"), zero).alias("clock"), zero.alias("depth"), F.lit(None).cast(dict(ups.dtypes)["up"]).alias("via"))
    done = written(best, "settled")
    ways = ups.join(newer.where("n > 1").select("id"), "id", "left_semi").join(lost.select(F.col("id").alias("up"), "anchor", "steps"), "up", "left")
    ways = ways.join(single.select(F.col("anchor").alias("up"), F.lit(True).alias("goes_on")), "up", "left").where("goes_on is null or anchor is not null")
    ways = ways.select("id", F.col("up").alias("via"), F.coalesce("anchor", "up").alias("anchor"), (F.coalesce("steps", zero) + 1).alias("steps"))
    # forks still open; a round takes in what the last one settled, and nothing else
    kind = dict(ups.dtypes)["up"]
    open_ = ways.withColumns({"head": F.lit(None).cast(kind), "clock": zero, "depth": zero})
    fresh, settled_all = done, [done]
    while True:
        known = fresh.select(F.col("id").alias("anchor"), F.col("head").alias("_h"), F.col("clock").alias("_c"), F.col("depth").alias("_d"))
        met = open_.join(known, "anchor", "left").select("id", "via", "anchor", "steps", F.coalesce("head", "_h").alias("head"), F.when(F.col("head").isNotNull(), F.col("clock")).otherwise(F.coalesce("_c", zero)).alias("clock"), F.when(F.col("head").isNotNull(), F.col("depth")).otherwise(F.coalesce("_d", zero)).alias("depth"))
        by_id = Window.partitionBy("id")
        best = F.row_number().over(by_id.orderBy(F.desc(F.col("depth") + F.col("steps")), F.desc("clock"), "head", "via"))
        met = met.withColumn("left", F.count_if(F.col("head").isNull()).over(by_id)).withColumn("best", best)
        met = written(met.where("left > 0 or best = 1").drop("best"), "forks", ready=F.count_if(F.col("left") == 0))
        if not met.seen["ready"]:
            break
        fresh = met.where("left = 0").select("id", "head", "clock", (F.col("depth") + F.col("steps")).alias("depth"), "via")
        settled_all.append(fresh)
        open_ = met.where("left > 0").drop("left")
    done = settled_all[0]
    for more in settled_all[1:]:
        done = done.unionByName(more)
    first = newer.where("n = 1").select("id", F.col("up").alias("via"))
    plain = lost.join(done.select(F.col("id").alias("anchor"), "head", "depth"), "anchor").join(first, "id")
    plain = plain.select("id", "head", (F.col("depth") + F.col("steps")).alias("depth"), "via")
    return done.where("via is not null").select("id", "head", "depth", "via").unionByName(plain)


def lineage(hits: DataFrame, heads: DataFrame, most: int | None = None) -> DataFrame:
    """(id, step, node): of each hit the claims from itself (step 0) up to its
    head along ``via``, or its first ``most`` steps.  A hit without a newer
    claim has its own row only.

    The known stretch of every path doubles each round, and so do the jumps it
    grows by, so a chain costs rounds in the logarithm of its length.
    """
    found = hits.select("id").distinct().select("id", F.lit(0).cast("long").alias("step"), F.col("id").alias("node"))
    jump, span, short = heads.select("id", F.col("via").alias("far")), 1, most is not None and most < 8
    if not short:
        found, jump = written(found, "lineage"), written(jump, "jumps")
    while most is None or span <= most:
        more = found.join(jump.select(F.col("id").alias("node"), "far"), "node").select("id", (F.col("step") + span).alias("step"), F.col("far").alias("node"))
        more = more if most is None else more.where(F.col("step") <= most)
        if not short:
            more = written(more, "lineage")
            if more.isEmpty():
                break
        found, span = found.unionByName(more), 2 * span
        ahead = jump.join(jump.select(F.col("id").alias("far"), F.col("far").alias("farther")), "far").select("id", F.col("farther").alias("far"))
        jump = ahead if short else written(ahead, "jumps")
    return found


def reaches(edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """Of the proposed (src, dst) edges those that would close a cycle: dst
    already reaches src, or both are one.

    All cycles lie in what is left of edges and proposals when those that
    nothing leads to, or that lead nowhere, are taken off again and again; only
    there is it searched from each proposal, so an acyclic graph costs no search.
    """
    wanted = proposals.select("src", "dst").distinct()
    every = edges.select("src", "dst").union(wanted).where("src <> dst").distinct()
    core = written(every, "core")
    n = core.count()
    while n:
        kept = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        after = written(kept.select("src", "dst"), "core")
        spent(core)
        core, before, n = after, n, after.count()
        if n == before:
            break
    loops = wanted.where("src = dst")
    if not n:
        return loops
    held = edges.select("src", "dst").distinct().join(core, ["src", "dst"], "left_semi")
    step = written(held.select(F.col("src").alias("from"), F.col("dst").alias("to")), "held")
    found = written(wanted.join(core, ["src", "dst"], "left_semi").select("src", "dst", F.col("dst").alias("at")), "reached")
    front = found
    while True:
        front = front.join(step, front["at"] == step["from"]).select("src", "dst", F.col("to").alias("at")).distinct().join(found, ["src", "dst", "at"], "left_anti")
        front = written(front, "front")
        if front.isEmpty():
            return found.where("at = src").select("src", "dst").distinct().union(loops)
        found = written(found.union(front), "reached")
