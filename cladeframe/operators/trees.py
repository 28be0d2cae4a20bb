"""Trees as tables: Newick in and out, traversal order, split sets and their algebra.

A tree is one text per row.  Reading it numbers the nodes in preorder and gives every
branch the interval of tips below it; after that a split is a slice of the tree's tip
list, and comparing trees is an equi-join on split keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators.columns import AlignmentError

BRANCH_SCHEMA = (
    "tree_id string, edge_id int, parent int, node_id int, len double, name string, "
    "is_tip boolean, label string, depth int, height int, first_tip int, n_tips int"
)
_TOKEN = re.compile(r"\s*([(),;]|:\s*[-+0-9.eE]+|[^\s(),:;]+)")


def parse_newick(text: str) -> list[dict]:
    """Branches of one tree in preorder; a bifurcating root is dissolved.

    Each entry is a node with the branch to its parent; the root has no branch.
    """
    root: dict = {"kids": [], "name": None, "len": None}
    node, path = root, []
    for token in _TOKEN.findall(text):
        if token == "(":
            path.append(node)
            node = {"kids": [], "name": None, "len": None}
            path[-1]["kids"].append(node)
        elif token == ",":
            node = {"kids": [], "name": None, "len": None}
            path[-1]["kids"].append(node)
        elif token == ")":
            node = path.pop()
        elif token == ";":
            break
        elif token[0] == ":":
            node["len"] = float(token[1:])
        else:
            node["name"] = token.strip("'\"")
    if path:
        raise AlignmentError("unbalanced brackets in a tree")
    if len(root["kids"]) == 2:
        keep, gone = root["kids"] if root["kids"][0]["kids"] else root["kids"][::-1]
        if keep["kids"]:
            joined = None if keep["len"] is None and gone["len"] is None else (keep["len"] or 0) + (gone["len"] or 0)
            gone["len"] = joined
            keep["len"] = None
            keep["kids"].append(gone)
            root = keep
    order: list[dict] = []
    todo = [(root, -1, 0)]
    tips = 0
    while todo:
        node, parent, depth = todo.pop()
        me = len(order)
        order.append(
            {
                "edge_id": me - 1 if parent >= 0 else None,
                "parent": parent if parent >= 0 else None,
                "node_id": me,
                "len": node["len"],
                "name": None if node["kids"] else node["name"],
                "is_tip": not node["kids"],
                "label": node["name"] if node["kids"] else None,
                "depth": depth,
                "height": 0,
                "first_tip": tips,
                "n_tips": 0 if node["kids"] else 1,
            }
        )
        tips += not node["kids"]
        todo.extend((kid, me, depth + 1) for kid in reversed(node["kids"]))
    for row in reversed(order):
        if row["parent"] is not None:
            up = order[row["parent"]]
            up["n_tips"] += row["n_tips"]
            up["height"] = max(up["height"], row["height"] + 1)
    return order


def explode_trees(trees: DataFrame) -> DataFrame:
    """``(tree_id, newick)`` -> one row per node with the branch to its parent.

    ``edge_id`` is the preorder number of the branch, ``depth`` the level below the
    root, ``height`` the longest path down to a tip, and ``first_tip``/``n_tips`` the
    tips below in preorder.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in BRANCH_SCHEMA.split(", ")]
        for pdf in batches:
            for tree_id, text in zip(pdf["tree_id"], pdf["newick"]):
                out = pd.DataFrame(parse_newick(text))
                out["tree_id"] = tree_id
                for c in ("edge_id", "parent"):
                    out[c] = out[c].astype("Int32")
                yield out[columns]

    return trees.select(F.col("tree_id").cast("string").alias("tree_id"), "newick").mapInPandas(rows, BRANCH_SCHEMA)


def nodes_of(branches: DataFrame) -> DataFrame:
    return branches.select("tree_id", "node_id", "name", "is_tip", "label")


def edges_of(branches: DataFrame) -> DataFrame:
    return branches.filter("edge_id is not null").select(
        "tree_id", "edge_id", F.col("parent").alias("u"), F.col("node_id").alias("v"), "len"
    )


def newick_from_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(tree_id, newick)``: one text per tree, written from an inner node.

    A group is one tree, which the output row has to hold anyway.
    """

    def write(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        name = {k: v for k, v, t in zip(n["node_id"], n["name"], n["is_tip"]) if t}
        near: dict[int, list[tuple[int, float, int]]] = {}
        for k, u, v, w in zip(e["edge_id"], e["u"], e["v"], e["len"]):
            near.setdefault(u, []).append((k, v, w))
            near.setdefault(v, []).append((k, u, w))
        root = next((u for u in sorted(near) if u not in name), min(near))
        text: dict[int, str] = {}
        todo = [(root, None, False)]
        while todo:
            node, up, ready = todo.pop()
            kids = [(k, o, w) for k, o, w in sorted(near[node]) if o != up]
            if not ready and kids:
                todo.append((node, up, True))
                todo.extend((o, node, False) for _, o, _ in kids)
                continue
            inner = ",".join(f"{text[o]}:{w:g}" for _, o, w in kids)
            text[node] = f"({inner})" if kids and node not in name else name[node]
            if node in name and kids:  # a two-tip tree is written from its first tip
                text[node] = f"({name[node]}:0,{inner})"
        return pd.DataFrame({"tree_id": [key[0]], "newick": [text[root] + ";"]})

    return (
        nodes.groupBy("tree_id").cogroup(edges.groupBy("tree_id")).applyInPandas(write, "tree_id string, newick string")
    )


def write_newick(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    newick_from_edges(nodes, edges).select("newick").write.text(path)


def tip_order(branches: DataFrame) -> DataFrame:
    """``(tree_id, serial, name)``: tips numbered by name within each tree."""
    tips = branches.filter("is_tip")
    names = F.array_sort(F.collect_list("name"))
    return tips.groupBy("tree_id").agg(names.alias("n")).select(
        "tree_id", F.posexplode("n").alias("serial", "name")
    )


def canonical_side(tips: Column, all_tips: Column) -> Column:
    """The smaller side of a split, sorted; at exactly half the side with the first tip name."""
    n, total = F.size(tips), F.size(all_tips)
    first = F.array_min(all_tips)
    flip = (n * 2 > total) | ((n * 2 == total) & ~F.array_contains(tips, first))
    return F.array_sort(F.when(flip, F.array_except(all_tips, tips)).otherwise(tips))


def split_key(tips: Column) -> Column:
    """Fixed-width key of a sorted tip set, so joins and shuffles do not carry names."""
    return F.sha2(F.array_join(tips, ","), 256)


def splits(branches: DataFrame) -> DataFrame:
    """``(tree_id, edge_id, split_key, size, tips)``, one row per branch."""
    in_order = F.array_sort(F.collect_list(F.struct("first_tip", "name")))
    tips = branches.filter("is_tip").groupBy("tree_id").agg(
        F.transform(in_order, lambda t: t["name"]).alias("all_tips")
    )
    below = F.slice("all_tips", F.col("first_tip") + 1, F.col("n_tips"))
    return (
        branches.filter("edge_id is not null")
        .select("tree_id", "edge_id", "first_tip", "n_tips")
        .join(tips, "tree_id")
        .select("tree_id", "edge_id", canonical_side(below, F.col("all_tips")).alias("tips"))
        .select("tree_id", "edge_id", split_key(F.col("tips")).alias("split_key"), F.size("tips").alias("size"), "tips")
    )


def tip_sets_equal(branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(t1, t2, equal)``: whether two trees have the same tip names."""
    key = branches.filter("is_tip").groupBy("tree_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ","), 256).alias("k")
    )
    one = key.select(F.col("tree_id").alias("t1"), F.col("k").alias("k1"))
    two = key.select(F.col("tree_id").alias("t2"), F.col("k").alias("k2"))
    return pairs.join(one, "t1").join(two, "t2").select("t1", "t2", (F.col("k1") == F.col("k2")).alias("equal"))


def tree_distance(split_sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(t1, t2, n_shared, n_splits, dist)`` for the requested pairs of trees.

    ``dist = 1 - shared / splits of t2``.  Work is the splits of the named pairs:
    a split common to many trees produces no extra rows.
    """
    keys = split_sets.select("tree_id", "split_key").distinct()
    of_two = pairs.join(keys.withColumnRenamed("tree_id", "t2"), "t2")
    found = keys.select(F.col("tree_id").alias("t1"), "split_key", F.lit(1).alias("hit"))
    return (
        of_two.join(found, ["t1", "split_key"], "left")
        .groupBy("t1", "t2")
        .agg(F.count("hit").alias("n_shared"), F.count("*").alias("n_splits"))
        .withColumn("dist", 1 - F.col("n_shared") / F.col("n_splits"))
    )


def split_sets_equal(split_sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(t1, t2, contained)``: every split of t2 occurs in t1; sizes must agree."""
    sizes = split_sets.groupBy("tree_id").agg(F.count("*").alias("n"))
    d = tree_distance(split_sets, pairs)
    one = sizes.select(F.col("tree_id").alias("t1"), F.col("n").alias("n1"))
    two = sizes.select(F.col("tree_id").alias("t2"), F.col("n").alias("n2"))
    bad = F.raise_error(F.concat(F.lit("split sets of different size: "), F.col("t1"), F.lit(" "), F.col("t2")))
    return (
        d.join(one, "t1")
        .join(two, "t2")
        .select(
            "t1", "t2",
            F.when(F.col("n1") != F.col("n2"), bad.cast("boolean"))
            .otherwise(F.col("n_shared") == F.col("n_splits"))
            .alias("contained"),
        )
    )


def drop_cloned_tips(split_sets: DataFrame, cloned: list[str]) -> DataFrame:
    """Remove cloned tips from every split and make the sides canonical again."""
    gone = F.array(*[F.lit(n) for n in cloned])
    all_tips = split_sets.groupBy("tree_id").agg(
        F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set("tips"))), gone)).alias("all_tips")
    )
    kept = split_sets.join(all_tips, "tree_id").select(
        "tree_id", "edge_id", canonical_side(F.array_except("tips", gone), F.col("all_tips")).alias("tips")
    )
    return kept.select(
        "tree_id", "edge_id", split_key(F.col("tips")).alias("split_key"), F.size("tips").alias("size"), "tips"
    )


def transfer_lengths(branches: DataFrame, donors: DataFrame) -> DataFrame:
    """``(tree_id, edge_id, len)``: lengths of the donor tree's equal splits.

    Trees are matched by ``tree_id``; a split the donor lacks is an error.
    """
    have = splits(branches).select("tree_id", "edge_id", "split_key")
    give = splits(donors).join(donors.select("tree_id", "edge_id", "len"), ["tree_id", "edge_id"]).select(
        "tree_id", "split_key", F.col("len").alias("_len"), F.lit(True).alias("_hit")
    )
    bad = F.raise_error(F.concat(F.lit("split not found in the donor tree, edge "), F.col("edge_id").cast("string")))
    return have.join(give, ["tree_id", "split_key"], "left").select(
        "tree_id", "edge_id", F.when(F.col("_hit").isNull(), bad.cast("double")).otherwise(F.col("_len")).alias("len")
    )


def locate_edges(split_sets: DataFrame, wanted: DataFrame, branches: DataFrame) -> DataFrame:
    """``(tree_id, want_id, edge_id)``: the branch whose split is ``wanted.tips`` or its complement."""
    all_tips = branches.filter("is_tip").groupBy("tree_id").agg(F.array_sort(F.collect_list("name")).alias("all_tips"))
    keyed = wanted.join(all_tips, "tree_id").select(
        "tree_id", "want_id", split_key(canonical_side(F.col("tips"), F.col("all_tips"))).alias("split_key")
    )
    bad = F.raise_error(F.concat(F.lit("no branch splits off tip set "), F.col("want_id").cast("string")))
    return keyed.join(split_sets.select("tree_id", "split_key", "edge_id"), ["tree_id", "split_key"], "left").select(
        "tree_id", "want_id", F.when(F.col("edge_id").isNull(), bad.cast("int")).otherwise(F.col("edge_id")).alias("edge_id")
    )


def generation_cycle(history: DataFrame) -> DataFrame:
    """``(gen, same_as, period)``: generations whose split set repeats an earlier one.

    ``history(gen, split_key)``; each generation is reduced to one digest first.
    """
    digest = history.groupBy("gen").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_set("split_key")), ","), 256).alias("h")
    )
    earlier = F.lag("gen").over(Window.partitionBy("h").orderBy("gen"))
    return (
        digest.select("gen", earlier.alias("same_as"))
        .filter("same_as IS NOT NULL")
        .withColumn("period", F.col("gen") - F.col("same_as"))
    )
