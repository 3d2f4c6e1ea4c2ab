"""URL filter: host rules, and link-graph propagation where no rule speaks.

Links of the pages make a graph of hosts.  Hosts of whose pages at least half
are allowed by a rule are trusted seeds, hosts of whose pages at least half
are blocked are blocked seeds.  Trust spreads from trusted seeds along links
(personalised PageRank); distrust spreads from blocked seeds against the
links, since who links to blocked hosts is suspect.  A host is blocked where
its distrust reaches ``least`` of the seeds' mean share and outweighs its
trust.  A page's rule, where one fits, always decides.  Propagation goes on
until what is still to come is a small part of the smallest share that counts.

Null urls and urls without ``://`` have empty host and path, no rule and the
verdict allow.  Repeated rows are judged each, their links counted once.  Urls
and markup are read whole.  Ties between trust and distrust are allowed.
Other columns are ignored, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from engram.llm._common import discard, materialize

# The rules (verdict, host/path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Share passed on a link, distrust (in seeds' mean shares) that blocks a host,
#: and the part of it by which shares may still move when propagation ends.
DAMPING, LEAST, TOLERANCE = 0.85, 0.05, 1e-3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"(?s)\A([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """Distinct links (src, dst) between different hosts, from absolute addresses in the markup."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"), F.lit(1))
    return (
        pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(links)).alias("dst"))
        .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst").distinct()
    )


def propagate(hosts: DataFrame, edges: DataFrame, tolerance: float) -> DataFrame:
    """(host, trust, distrust): PageRank from the seeds, distrust on reversed edges.

    ``hosts`` has (host, good, bad) with the seeds' weights, each summing to 1
    or to 0.  What hosts without links hold returns to the seeds.  Ends when
    all that later rounds could still move is below ``tolerance``: each moves at
    most DAMPING times what the one before it moved.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("fan"))
    back = edges.groupBy("dst").agg(F.count("*").alias("fan"))
    ways = edges.join(out, "src").select("src", "dst", (1 / F.col("fan")).alias("good"), F.lit(0.0).alias("bad")).union(
        edges.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0), 1 / F.col("fan"))
    )
    ways = materialize(ways, "ways")
    ends = ways.groupBy(F.col("src").alias("host")).agg(F.max(F.col("good") > 0).alias("sends"), F.max(F.col("bad") > 0).alias("gives"))
    no, zero = F.lit(False), F.lit(0.0)
    state = materialize(
        hosts.join(ends, "host", "left").select("host", "good", "bad", F.coalesce("sends", no).alias("sends"), F.coalesce("gives", no).alias("gives"), F.col("good").alias("trust"), F.col("bad").alias("distrust"), zero.alias("moved")),
        "trust",
    )
    # one table and one row of sums a round: what moved, and what the next round's senders hold
    sums = [F.sum("moved").alias("moved"), F.sum(F.when(F.col("sends"), F.col("trust"))).alias("t"), F.sum(F.when(F.col("gives"), F.col("distrust"))).alias("d")]
    held = state.agg(*sums).first()
    while held["t"] or held["d"]:
        sent = ways.join(state.select(F.col("host").alias("src"), "trust", "distrust"), "src").select(
            F.col("dst").alias("host"), (F.col("good") * F.col("trust")).alias("t"), (F.col("bad") * F.col("distrust")).alias("d")
        ).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        trust = F.col("good") * (1 - DAMPING * (held["t"] or 0.0)) + DAMPING * F.coalesce("t", zero)
        distrust = F.col("bad") * (1 - DAMPING * (held["d"] or 0.0)) + DAMPING * F.coalesce("d", zero)
        moved = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        after = materialize(
            state.drop("moved").join(sent, "host", "left").select("host", "good", "bad", "sends", "gives", trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved")),
            "trust",
        )
        discard(state, shuffles=False)
        state, held = after, after.agg(*sums).first()
        if held["moved"] * DAMPING / (1 - DAMPING) < tolerance:
            break
    discard(ways)
    return state


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str]] = RULES
) -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust) for every page."""
    url = F.col(url_col).cast("string")
    judged = pages.select(
        F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html")
    ).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    edges = materialize(host_edges(judged, "html"), "host-links")
    counts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("fit.verdict") == "allow").alias("allowed"), F.count_if(F.col("fit.verdict") == "block").alias("blocked")
    )
    seen = counts.unionByName(
        edges.select(F.col("dst").alias("host")).distinct().select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked"))
    ).groupBy("host").agg(F.sum("n").alias("n"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    seeded = materialize(
        seen.select("host", F.when((F.col("n") > 0) & (2 * F.col("allowed") >= F.col("n")), 1.0).otherwise(0.0).alias("good"), F.when((F.col("n") > 0) & (2 * F.col("blocked") >= F.col("n")) & (F.col("blocked") > F.col("allowed")), 1.0).otherwise(0.0).alias("bad")),
        "host-seeds",
    )
    total = seeded.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    good, bad = max(total["g"] or 0.0, 1.0), max(total["b"] or 0.0, 1.0)
    ranked = propagate(seeded.select("host", (F.col("good") / good).alias("good"), (F.col("bad") / bad).alias("bad")), edges, TOLERANCE * LEAST / bad)
    verdicts = materialize(
        ranked.select("host", "trust", "distrust", ((F.col("distrust") >= LEAST / bad) & (F.col("distrust") > F.col("trust"))).alias("bad_host")),
        "host-verdicts",
    )
    for spent in (edges, seeded, ranked):
        discard(spent)
    return judged.drop("html").join(verdicts, "host", "left").select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
