"""Sharding by balanced label propagation, all in DataFrame operations.

Documents are joined by links; a link is a set of documents, and two documents of one link
in different shards are cut apart.  Labels start from a hash.  In a round every link counts
its members in each shard and names the shard that it would gather in; a document whose
links gain by it asks to move there.  Each shard admits the best askers that its quota
leaves room for.  A link with more members than a shard can hold gathers in as many shards
as it fills.  After the rounds a repair moves the fewest documents, unlinked ones first,
until row counts are at most one apart (law ``rows``).

Only ids, labels and counts are shuffled, never texts.  Counts per link and shard are made
before the shuffle, so a link of a third of all rows costs ``SHARDS`` rows a task; ranks are
made in buckets of bounded size (``_ranked``), never in one task for a shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch

SHARDS, ROUNDS = 40, 4
#: Room for linked documents in a shard, against an even share of them, during the rounds.
SLACK = 1.10
#: Rows that one bucket of a ranking holds on average.
BUCKET = 20_000


def _ranked(df: DataFrame, group: str, order: list[str], key: str, rows: int, into: str = "rank") -> DataFrame:
    """Gapless 0-based ranks in each group: by ``order``'s small classes, then a hash of ``key``.

    ``order`` are columns of few values.  Rows of a class go to hash buckets of about
    ``BUCKET`` rows; a bucket is ranked by a window and offset by the counts before it.
    """
    n = max(1, rows // BUCKET)
    part = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)))
    cell = [group, *order, "_b"]
    sizes = part.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(*order, "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*cell).orderBy(F.xxhash64(key, F.lit(1)), key)
    out = part.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, cell)
    return out.withColumn(into, (F.col("_r") + F.col("_o")).cast("long")).drop("_b", "_r", "_o")


def _votes(state: DataFrame, links: DataFrame) -> DataFrame:
    """``link, shard, n``: members of each link in each shard."""
    return links.join(state.select("node", "shard"), "node").groupBy("link", "shard").agg(F.count("*").alias("n"))


def _goals(votes: DataFrame, space: list[int], quota: int, turn: int) -> DataFrame:
    """``link, goal, reach, needed, place``: the shards a link gathers in, as many as it fills.

    ``reach`` is how many of its members a shard could hold in the end, by the room it has
    left.  Beside the shards that have members, each round offers one more, drawn by a hash.
    A link is in at most ``SHARDS`` shards, which bounds the window.
    """
    sizes = votes.groupBy("link").agg(F.sum("n").alias("size")).filter("size > 1")
    drawn = F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(len(space))).cast("int")
    other = sizes.select("link", drawn.alias("shard"), F.lit(0).cast("long").alias("n"))
    offers = votes.union(other).groupBy("link", "shard").agg(F.max("n").alias("n")).join(sizes, "link")
    room = F.get(F.array(*(F.lit(x) for x in space)), F.col("shard"))
    reach = F.col("n") + F.least(room, F.col("size") - F.col("n"))
    best = Window.partitionBy("link").orderBy(F.desc("reach"), F.desc("n"), F.xxhash64("link", "shard"), "shard")
    ranked = offers.withColumn("reach", reach).withColumn("place", F.row_number().over(best))
    needed = F.ceil(F.col("size") / F.lit(quota))
    return ranked.filter(F.col("place") <= needed).select("link", F.col("shard").alias("goal"), "reach", needed.alias("needed"), "place")


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``node, shard`` for each of ``nodes`` (distinct ``node``), row counts at most one apart.

    ``links`` has ``link, node``; links of one document and nodes that are not there count
    for nothing.  The result depends on the values alone, not on how the rows are dealt.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "shards")
    start = F.pmod(F.xxhash64("node", F.lit("start")), F.lit(shards)).cast("int")
    total = nodes.count()
    quota = max(1, total // shards)
    base = scratch.keep(nodes.select("node", start.alias("shard")), "state-0")
    # links whose members are all here, with two at least
    real = links.join(nodes.select("node"), "node", "left_semi").distinct()
    many = real.groupBy("link").agg(F.count("*").alias("size")).filter("size > 1").select("link")
    tied = scratch.keep(real.join(many, "link", "left_semi"), "links")
    # only linked documents move in the rounds; the others make way in the repair
    linked = scratch.keep(base.join(tied.select("node").distinct(), "node", "left_semi"), "linked-0")
    # where unlinked documents make up less than the slack, a shard may for now hold too many
    room = max(quota, int(linked.count() * SLACK / shards))

    for turn in range(1, rounds + 1):
        votes = scratch.keep(_votes(linked, tied), f"votes-{turn}")
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        space = [max(0, room - held.get(s, 0)) for s in range(shards)]
        goals = scratch.keep(_goals(votes, space, quota, turn), f"goals-{turn}")
        # members outside their link's goals wish for one of them, drawn by their hash
        member = tied.join(linked.withColumnRenamed("shard", "at"), "node")
        outside = member.join(goals.select("link", F.col("goal").alias("at")), ["link", "at"], "left_anti")
        needed = goals.filter("place = 1").select("link", "needed")
        drawn = outside.join(needed, "link").withColumn("place", F.pmod(F.xxhash64("node"), F.col("needed")) + 1)
        own = votes.select("link", F.col("shard").alias("at"), F.col("n").alias("own"))
        gain = (
            drawn.join(goals.select("link", "place", "goal", "reach"), ["link", "place"]).join(own, ["link", "at"])
            .groupBy("node", "at", "goal").agg(F.sum(F.col("reach") - F.col("own")).alias("gain"))
        )
        best = gain.groupBy("node").agg(F.max(F.struct("gain", "goal")).alias("b")).select("node", "b.goal", "b.gain")
        askers = best.filter("gain > 0").withColumn("class", -F.floor(F.log2("gain")).cast("int"))
        limits = F.array(*(F.lit(x) for x in space))
        admitted = _ranked(askers.select("node", "goal", "class"), "goal", ["class"], "node", total).filter(
            F.col("rank") < F.get(limits, F.col("goal"))
        )
        moved = linked.join(admitted.select("node", "goal"), "node", "left").select("node", F.coalesce("goal", "shard").alias("shard"))
        linked = scratch.keep(moved, f"linked-{turn}")
        scratch.drop(f"linked-{turn - 1}")
        scratch.drop(f"votes-{turn}")
        scratch.drop(f"goals-{turn}")

    state = base.join(linked.withColumnRenamed("shard", "now").withColumn("tied", F.lit(1)), "node", "left").select(
        "node", F.coalesce("now", "shard").alias("shard"), F.coalesce("tied", F.lit(0)).alias("tied")
    )
    return _evened(scratch.keep(state, "propagated"), scratch, total, shards)


def _evened(state: DataFrame, scratch: Scratch, total: int, shards: int) -> DataFrame:
    """Move what a shard has beyond its share, unlinked documents first, to where room is."""
    share = [total // shards + (s < total % shards) for s in range(shards)]
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over = [max(0, held.get(s, 0) - share[s]) for s in range(shards)]
    room = [max(0, share[s] - held.get(s, 0)) for s in range(shards)]
    if not sum(over):
        return state.select("node", "shard")
    ranked = _ranked(state, "shard", ["tied"], "node", total)
    first = [sum(over[:s]) for s in range(shards)]
    number = F.get(F.array(*map(F.lit, first)), F.col("shard")) + F.col("rank")
    leaves = F.col("rank") < F.get(F.array(*map(F.lit, over)), F.col("shard"))
    # the k-th leaver of all takes the k-th free place of all
    bounds, acc = [], 0
    for s in range(shards):
        acc += room[s]
        bounds.append((acc, s))
    target = reduce(lambda rest, b: F.when(number < b[0], F.lit(b[1])).otherwise(rest), reversed(bounds), F.lit(None).cast("int"))
    return ranked.select("node", F.when(leaves, target).otherwise(F.col("shard")).alias("shard"))


def text_links(sized: DataFrame) -> DataFrame:
    """``link, node``: the documents that share a text, by its digest."""
    return sized.filter("digest IS NOT NULL").select(F.col("digest").alias("link"), "node")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; links: equal texts.

    Null texts have size 16 and crc32 of nothing and are not linked; empty texts are linked
    with one another.  Rows that repeat a doc_id and text are each a document of its own
    (told apart by a number), as are null doc_ids.  Slots count from 0 in each shard.
    Columns besides doc_id and text are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sized")
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    read = docs.select(
        "doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(raw)).alias("digest"),
    )
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    # a node is a document: its id, and a number where rows repeat it
    rows = scratch.keep(read.withColumn("lone", spread), "rows")
    numbered = rows.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "digest", "lone").orderBy("size")))
    node = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("digest", F.lit("-")), "again", "lone")
    sized = scratch.keep(numbered.withColumn("node", node), "nodes")
    placed = propagate(sized.select("node"), text_links(sized), shards, rounds)
    kept = scratch.keep(sized.join(placed, "node").select("node", "doc_id", "size", "text_crc32", "shard"), "placed")
    slotted = _ranked(kept, "shard", [], "node", kept.count(), "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def cut_links(placed: DataFrame, links: DataFrame) -> DataFrame:
    """One row ``links, cut, members, apart``: links, those in several shards, and the members
    outside their link's largest part."""
    votes = _votes(placed, links)
    each = votes.groupBy("link").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("parts")).filter("n > 1")
    return each.agg(
        F.count("*").alias("links"), F.count(F.when(F.col("parts") > 1, 1)).alias("cut"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("apart"),
    )
