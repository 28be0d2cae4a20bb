"""URL filter by rules and by trust and distrust that spread over the links between hosts.

Rules name a host and the beginning of a path; the longest that fits a url decides it.  The
other urls are judged by their host.  Hosts are the nodes of a graph: a link of a page to
another host is an edge, and every host is linked both ways with the domain above it.  Trust
is PageRank personalised to the hosts' shares of allowed pages and follows the edges, distrust
to their shares of blocked pages and goes against them.  As a rank also says how well linked
a host is, each is divided by the rank of a walk that begins at all hosts alike: the quotients
say how much of what reaches a host comes from allowed (blocked) pages.  A host whose distrust
reaches ``THRESHOLD`` and is more than its trust is blocked.

Everything here is DataFrame code.  Links are counted per pair of hosts before they move; the
walk's rows are ranks of hosts and counts, never pages.  A host with very many edges has them
dealt to several tasks, and its rank goes to each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import LOWER, UPPER, Scratch

#: Of ``(verdict, host, path)``; an empty path fits every path.
Rules = Sequence[tuple[str, str, str]]
RULES: Rules = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
#: Rules are tried against every url; a longer list is refused.
MOST_RULES = 1000
DAMPING, STEPS = 0.85, 20
THRESHOLD = 0.4
#: Quotients of sums in another order differ by less.
SLACK = 1e-9
#: Edges of a host that go to one task.
DEALT = 100_000
#: Hosts whose verdicts are sent to all tasks, a hash table of some 64 MB; more of them meet the pages in a shuffle.
SENT_HOSTS = 500_000
#: Tasks that share a host's pages there.
DEALS = 16
#: An address with a host of its own in an attribute that links; group 1 is the host.
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s"'<>]+)"""


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z folded; empty without."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule that fits, as ``struct(verdict, rule)``; null if none does.

    A rule fits its host and all hosts below it.  Of rules of one length that with the longer
    host wins, then one that blocks.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if any(verdict not in ("allow", "block") for verdict, *_ in rules):
        raise ValueError("a rule's verdict is allow or block")
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, at, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(begin)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(at + begin).alias("rule"))).otherwise(found)
    return found


def _above(host: Column) -> Column:
    """The domain above a host; null for one of two labels or less, or that is a number."""
    labels = F.size(F.split(host, r"\."))
    return F.when((labels > 2) & ~host.rlike(r"(^|\.)[0-9]*$") & ~host.contains(":"), F.regexp_extract(host, r"^[^.]*\.(.*)$", 1))


def edges(pages: DataFrame) -> DataFrame:
    """``a, b, n``: links from host ``a`` to another host ``b``; a domain counts as one link both ways."""
    at = F.col("at")
    linked = pages.select(host(F.col("url")).alias("a"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("b"))
    linked = linked.select("a", F.translate("b", UPPER, LOWER).alias("b")).filter("a <> '' AND a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    hosts = pages.select(host(F.col("url")).alias("at")).union(linked.select(F.col("b").alias("at"))).filter("at <> ''").distinct()
    # a host, the domain above it, the one above that: as many rows as a name has labels
    labels = F.split(at, r"\.")
    line = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    chain = hosts.select(F.explode(line).alias("at")).distinct().select("at", _above(at).alias("up")).filter("up IS NOT NULL")
    up = chain.select(F.col("at").alias("a"), F.col("up").alias("b"), F.lit(1).cast("long").alias("n"))
    down = chain.select(F.col("up").alias("a"), F.col("at").alias("b"), F.lit(1).cast("long").alias("n"))
    return linked.union(up).union(down).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _flows(links: DataFrame) -> DataFrame:
    """``src, dst, against, part, share, parts``: what each step hands on, along and against the links."""
    along = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(False).alias("against"), "n")
    back = links.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(True).alias("against"), "n")
    both = along.union(back)
    out = both.groupBy("src", "against").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    dealt = out.select("src", "against", "total", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # hosts with several parts are few: at most one for DEALT edges
    heavy = F.broadcast(out.filter("parts > 1").select("src", "against", F.col("parts").alias("p")))
    both = both.join(heavy, ["src", "against"], "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("p", F.lit(1))).cast("int"))
    share = DAMPING * F.col("n") / F.col("total")
    return both.join(dealt, ["src", "against", "part"]).select("src", "dst", "against", "part", "parts", share.alias("share"))


def spread(seeds: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, trust, distrust`` from ``host, allowed, blocked``, shares of a host's pages.

    The ranks are sums of ``STEPS`` steps of the walk beside its begin.  Only hosts that
    something reaches have rows.
    """
    flows = scratch.keep(_flows(links), "flows")
    fanned = flows.filter("parts > 1").select(F.col("src").alias("host"), "against", "parts").distinct()
    begin = seeds.select("host", F.lit(False).alias("against"), F.col("allowed").alias("own"), F.lit(1.0).alias("every")).union(
        seeds.select("host", F.lit(True), F.col("blocked"), F.lit(1.0))
    )
    steps = [scratch.keep(begin, "step-0")]
    for k in range(1, STEPS + 1):
        now = steps[-1].join(F.broadcast(fanned), ["host", "against"], "left")
        part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        now = now.select(F.col("host").alias("src"), "against", "own", "every", part)
        moved = flows.join(now, ["src", "against", "part"]).groupBy(F.col("dst").alias("host"), "against").agg(
            F.sum(F.col("own") * F.col("share")).alias("own"), F.sum(F.col("every") * F.col("share")).alias("every")
        )
        steps.append(scratch.keep(moved, f"step-{k}"))
        if steps[-1].isEmpty():
            break
    walked = steps[0]
    for step in steps[1:]:
        walked = walked.union(step)
    ranks = walked.groupBy("host", "against").agg((F.sum("own") / F.sum("every")).alias("rank"))
    pick = lambda against: F.coalesce(F.max(F.when(F.col("against") == against, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(pick(False).alias("trust"), pick(True).alias("distrust"))


def judge(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path; as a host that nothing
    reaches it has no distrust, and is allowed where no rule fits.  Null html has no links.
    Repeated rows are each judged, and each counts among its host's pages; an empty table has
    no rows; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "trust")
    url = F.col("url").cast("string")
    ruled = pages.select("page_id", host(url).alias("host"), path(url).alias("path")).withColumn("first", first_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("first.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = scratch.keep(
        ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "seeds"
    )
    links = scratch.keep(edges(pages.select(url.alias("url"), F.col("html").cast("string").alias("html"))), "edges")
    ranks = scratch.keep(spread(seeds, links, scratch), "ranks")
    bad = (F.col("distrust") >= THRESHOLD - SLACK) & (F.col("distrust") > F.col("trust") + SLACK)
    blocked = scratch.keep(ranks.select(F.col("host").alias("at"), "trust", "distrust", bad.alias("bad")), "verdicts")
    by_host = F.when(F.coalesce("bad", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    if blocked.count() <= SENT_HOSTS:
        met = ruled.join(F.broadcast(blocked), F.col("host") == F.col("at"), "left")
    else:  # one host may have a third of all pages: each host's pages go to several tasks
        dealt = blocked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
        key = F.pmod(F.xxhash64("page_id", "path"), F.lit(DEALS)).cast("int")
        met = ruled.withColumn("key", key).join(dealt, (F.col("host") == F.col("at")) & (F.col("key") == F.col("deal")), "left")
    return met.select(
        "page_id", "host", "path", F.col("first.rule").alias("rule"), F.coalesce("first.verdict", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
