"""Traversal of trees given as edge tables, by their Euler tours.

Every edge is two darts, one each way.  After a dart into a node comes the dart out of it that
follows, in the order of edge numbers, the one back; so the darts of a tree make one ring, which
is cut at its root.  Sums along the list to its end come from pointer jumping: in each round a
dart adds the sum of the dart that it points to and takes over that dart's pointer, so a round
is one equi-join and the rounds are the logarithm of the longest list, however deep a tree is.
What an edge has below it is the difference of the sums at its two darts.

All trees of a table go through the same rounds; no tree is collected in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators.columns import AlignmentError
from cladeframe.session import Shelf

KEY = ["tree_id", "dart"]


def darts(edges: DataFrame) -> DataFrame:
    """``(tree_id, dart, src, dst, after)``: both darts of every edge and the one that follows in the ring."""
    ends = lambda dart, src, dst: F.struct(dart.alias("dart"), F.col(src).alias("src"), F.col(dst).alias("dst"))
    twice = (F.col("edge_id") * 2).cast("long")
    both = edges.select("tree_id", F.inline(F.array(ends(twice, "u", "v"), ends(twice + 1, "v", "u"))))
    around = Window.partitionBy("tree_id", "src").orderBy("dart")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("dart").over(around), F.first("dart").over(whole))
    # the dart that comes after t in its node follows the twin of t, which leads into the node
    out = both.withColumn("following", following)
    return out.select("tree_id", F.col("dart").bitwiseXOR(F.lit(1)).alias("dart"), F.col("dst").alias("src"), F.col("src").alias("dst"),
                      F.col("following").alias("after"))


def suffix_sums(lists: DataFrame, weights: list[str], shelf: Shelf, name: str) -> DataFrame:
    """``(tree_id, dart, *weights)`` with each weight summed from the dart to the end of its list.

    ``lists(tree_id, dart, after, *weights)``; the last dart of a list has no ``after``.
    """
    longest = lists.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    current = shelf.keep(lists.select(*KEY, "after", *weights), f"{name}-0")
    for turn in range(1, max(0, longest - 1).bit_length() + 1):
        ahead = current.select("tree_id", F.col("dart").alias("after"), F.col("after").alias("further"), *[F.col(w).alias(f"{w}_on") for w in weights])
        joined = current.join(ahead, ["tree_id", "after"], "left")
        sums = [(F.col(w) + F.coalesce(F.col(f"{w}_on"), F.lit(0))).cast(current.schema[w].dataType).alias(w) for w in weights]
        following = shelf.keep(joined.select(*KEY, F.col("further").alias("after"), *sums), f"{name}-{turn}")
        shelf.drop(f"{name}-{turn - 1}")
        current = following
    if not current.filter("after IS NOT NULL").isEmpty():
        raise AlignmentError("the edges are not a tree")
    return current.drop("after")


def _cut(ring: DataFrame, roots: DataFrame) -> DataFrame:
    """Rings opened before the smallest dart out of each tree's root."""
    first = ring.join(roots, "tree_id").filter("src = root").groupBy("tree_id").agg(F.min("dart").alias("begin"))
    return ring.join(first, "tree_id").withColumn("after", F.when(F.col("after") != F.col("begin"), F.col("after"))).drop("begin")


def inner_roots(edges: DataFrame) -> DataFrame:
    """``(tree_id, root)``: the smallest node with several edges; of a single edge its smaller end."""
    ends = edges.select("tree_id", F.explode(F.array("u", "v")).alias("node"))
    degree = ends.groupBy("tree_id", "node").agg(F.count("*").alias("n"))
    return degree.groupBy("tree_id").agg(F.min(F.struct(F.col("n") == 1, "node"))["node"].alias("root"))


def _tour(nodes: DataFrame, edges: DataFrame, roots: DataFrame, shelf: Shelf) -> DataFrame:
    return shelf.keep(
        _cut(darts(edges), roots).join(nodes.select("tree_id", F.col("node_id").alias("dst"), F.col("is_tip"), "name"), ["tree_id", "dst"]),
        "tour",
    )


def _pairs(sums: DataFrame, weights: list[str]) -> DataFrame:
    """Per edge: sums of its earlier dart (down) and the later one (back), told apart by ``rest``."""
    one = F.struct(F.col("rest"), "dart", *weights)
    both = sums.groupBy("tree_id", F.shiftright("dart", 1).cast("int").alias("edge_id")).agg(F.max(one).alias("down"), F.min(one).alias("back"))
    return both


def traversal(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(tree_id, edge_id, parent, node_id, depth, preorder, first_tip, n_tips)`` of every edge.

    ``nodes(tree_id, node_id, name, is_tip)`` and ``edges(tree_id, edge_id, u, v)`` of any number
    of trees, whose edges need no direction; ``roots(tree_id, root)`` are the nodes to start from,
    where absent the smallest inner ones.  Edges of a node follow their numbers.  ``preorder``
    counts nodes with the root as 0, ``first_tip`` the tips met before.  Edges that are not one
    tree are an error.
    """
    shelf = Shelf(edges.sparkSession, "tour")
    roots = inner_roots(edges) if roots is None else roots
    tour = _tour(nodes, edges, roots, shelf)
    one, tip = F.lit(1).cast("long"), F.col("is_tip").cast("long")
    order = suffix_sums(tour.select(*KEY, "after", one.alias("rest"), tip.alias("tips")), ["rest", "tips"], shelf, "order")
    pairs = shelf.keep(_pairs(order, ["tips"]), "pairs")
    # now darts have a direction: down counts as a node met and a step deeper, back as a step up
    turn = pairs.select("tree_id", F.col("down.dart").alias("dart"), F.lit(True).alias("is_down"))
    steps = tour.join(turn, KEY, "left").select(
        *KEY, "after", F.coalesce(F.col("is_down"), F.lit(False)).cast("long").alias("met"), F.when(F.col("is_down"), 1).otherwise(-1).cast("long").alias("rise")
    )
    walked = suffix_sums(steps, ["met", "rise"], shelf, "walk")
    total = order.groupBy("tree_id").agg(F.max("rest").alias("n_darts"), F.max_by("tips", "rest").alias("all_tips"))
    found = pairs.withColumn("dart", F.col("down.dart")).join(walked, KEY).join(total, "tree_id").join(
        tour.select(*KEY, F.col("src").alias("parent"), F.col("dst").alias("node_id")), KEY
    )
    return found.select(
        "tree_id", "edge_id", "parent", "node_id",
        # to the end of the list every step down is taken back
        (1 - F.col("rise")).cast("int").alias("depth"), (F.col("n_darts") / 2 - F.col("met") + 1).cast("int").alias("preorder"),
        (F.col("all_tips") - F.col("down.tips")).cast("int").alias("first_tip"), (F.col("down.tips") - F.col("back.tips")).cast("int").alias("n_tips"),
    )


def tip_marks(name: Column) -> list[Column]:
    """Two numbers of 60 bits for a name; sums of them over a set of tips are its fingerprint."""
    digest = F.md5(name.cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]


def split_fingerprints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(tree_id, edge_id, split_key, size)``: a key of fixed width for the split of every edge.

    The key adds up marks of the tips on the smaller side, at exactly half on the side with the
    first tip name, so trees with the same tips have the same key for the same split; no row
    carries names.  Two unlike tip sets share a key with a probability of about 2^-120.
    """
    shelf = Shelf(edges.sparkSession, "splits")
    tour = _tour(nodes, edges, inner_roots(edges), shelf)
    tips = nodes.filter("is_tip")
    lowest = tips.groupBy("tree_id").agg(F.min("name").alias("lowest"))
    tip, zero = F.col("is_tip"), F.lit(0).cast("decimal(38,0)")
    marks = [F.when(tip, m).otherwise(zero).alias(f"mark{k}") for k, m in enumerate(tip_marks(F.col("name")))]
    weighted = tour.join(lowest, "tree_id").select(
        *KEY, "after", F.lit(1).cast("long").alias("rest"), tip.cast("long").alias("tips"),
        (tip & (F.col("name") == F.col("lowest"))).cast("long").alias("least"), *marks,
    )
    weights = ["rest", "tips", "least", "mark0", "mark1"]
    sums = suffix_sums(weighted, weights, shelf, "marks")
    whole = tips.groupBy("tree_id").agg(
        F.count("*").alias("all_tips"), *[F.sum(m).alias(f"all_mark{k}") for k, m in enumerate(tip_marks(F.col("name")))]
    )
    below = lambda w: F.col(f"down.{w}") - F.col(f"back.{w}")
    pairs = _pairs(sums, weights[1:]).join(whole, "tree_id")
    other = (2 * below("tips") > F.col("all_tips")) | ((2 * below("tips") == F.col("all_tips")) & (below("least") == 0))
    side = lambda w: F.when(other, F.col(f"all_{w}") - below(w)).otherwise(below(w))
    return pairs.select(
        "tree_id", "edge_id", F.concat_ws("-", side("tips"), *[side(m).cast("string") for m in ("mark0", "mark1")]).alias("split_key"),
        side("tips").cast("int").alias("size"),
    )
