"""Building trees and alignments from unaligned sequences, and refining them.

Many trees grow at once: every table has a ``tree_id``, and one step adds the next sequence to
each tree that has one left.  So the number of steps is that of the largest tree, not of all
sequences, and the work of a step is spread over the trees, their column blocks and their edges.
The driver holds the number of the step.  The state of a step is a set of written tables, of
which only the last stays.  As long as a tree is small (``TREE_CELLS``, and ``ORDER_IDS`` for its
order), one task takes its steps one after the other; the steps beyond that are jobs.

A tree begins with its closest pair, aligned with free ends, and then takes the sequences in
greedy order of distance.  A sequence goes to the edge whose profile it fits best; all rows get
the columns that it opens.  Nodes and edges have numbers that follow from the rank ``k`` of the
sequence: the first two are nodes 0 and 1 with edge 0 between them; a later one is node ``2k-1``
on the new inner node ``2k-2``, with the new edges ``2k-3`` and ``2k-2``.  Trees that exist are
extended in the same way, and a target tree can say where each sequence goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions import kernels as K
from cladeframe.functions import residues as R
from cladeframe.operators import pairwise as W
from cladeframe.operators import profiles as P
from cladeframe.operators import tours as U
from cladeframe.operators import traces as X
from cladeframe.operators.place import Scores
from cladeframe.session import Shelf

# Scores of the first pair and of a later step, and the end of the refinement.
PAIR_SCORES = Scores(gap_open=-5, gap_extend=-3, match=3, match_flag=0)
STEP_SCORES = Scores(gap_open=-4, gap_extend=-1, match=2, match_flag=-2)
MOST_GENERATIONS = 100
#: Profile cells that one task scores.
SCORE_CELLS = 1 << 20
#: Tips times a bound on the columns, up to which one task holds a tree and takes its steps.
TREE_CELLS = 1 << 21
#: Generations of a small tree that one task takes before they are written.
ROUND = 10
#: Ids of a tree, up to which one task holds its square of distances.
ORDER_IDS = 1 << 10
#: Gap likelihoods do not enter the boolean profiles, so any frequency will do.
ANY_FREQ = 0.5

ROW = ["tree_id", "i", "node_id", "name", "seq"]
EDGE = ["tree_id", "edge_id", "u", "v"]


@dataclass(frozen=True)
class Forest:
    """``rows(tree_id, i, node_id, name, seq)``, aligned within each tree, and ``edges(tree_id, edge_id, u, v)``."""

    rows: DataFrame
    edges: DataFrame

    def nodes(self) -> DataFrame:
        """``(tree_id, node_id, name, is_tip)``: tips and the inner nodes of the edges."""
        tips = self.rows.select("tree_id", "node_id", "name", F.lit(True).alias("is_tip"))
        ends = self.edges.select("tree_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
        inner = ends.join(tips, ["tree_id", "node_id"], "left_anti")
        return tips.unionByName(inner.select("tree_id", "node_id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("is_tip")))


def _dealt(df: DataFrame) -> DataFrame:
    """Trees over tasks; a number that is given keeps small tables from being put together in one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "tree_id")


def addition_orders(distances: DataFrame) -> DataFrame:
    """``(tree_id, rank, i)``: the order in which each tree takes its ids.

    ``distances(tree_id, i, j, dist)`` is a full square for each tree.  First the closest pair,
    then always the id with the least total distance to those taken; ties go to the smallest id.
    Trees of up to ``ORDER_IDS`` ids are one task each, others go in steps.
    """
    sizes = distances.groupBy("tree_id").agg(F.count("*").alias("n"))
    large = F.col("n") > ORDER_IDS * ORDER_IDS
    kind = {c: distances.schema[c].dataType.simpleString() for c in ("tree_id", "i")}
    whole = lambda squares: _dealt(squares).groupBy("tree_id").applyInPandas(_order, f"tree_id {kind['tree_id']}, rank int, i {kind['i']}")
    if sizes.filter(large).isEmpty():
        return whole(distances)
    part = lambda which: distances.join(sizes.filter(which), "tree_id", "left_semi")
    return whole(part(~large)).union(_orders_by_steps(part(large)))


def _order(key, square: pd.DataFrame) -> pd.DataFrame:
    """The order of one tree, from its square of distances."""
    ids = np.sort(square["i"].unique())
    dist = np.zeros((ids.size, ids.size), square["dist"].dtype)
    dist[np.searchsorted(ids, square["i"]), np.searchsorted(ids, square["j"])] = square["dist"]
    return pd.DataFrame({"tree_id": [key[0]] * ids.size, "rank": range(ids.size), "i": ids[_greedy(dist)]})


def _greedy(dist: np.ndarray) -> list[int]:
    n = len(dist)
    if n == 1:
        return [0]
    apart = np.flatnonzero(~np.eye(n, dtype=bool))
    order = [int(k) for k in divmod(apart[dist.ravel()[apart].argmin()], n)]
    left = np.setdiff1d(np.arange(n), order)
    total = dist[order[0], left] + dist[order[1], left]
    while left.size:
        k = int(total.argmin())
        order.append(int(left[k]))
        total, left = np.delete(total + dist[left[k], left], k), np.delete(left, k)
    return order


def _orders_by_steps(distances: DataFrame) -> DataFrame:
    """Orders of large trees.

    A step writes the running totals of the ids that are left; an order is the smallest entry of
    each of these tables, so no id passes the driver.
    """
    shelf = Shelf(distances.sparkSession, "order")
    closest = distances.filter("i <> j").groupBy("tree_id").agg(F.min(F.struct("dist", "i", "j")).alias("m"))
    pair = shelf.keep(closest.select("tree_id", F.col("m.i").alias("a"), F.col("m.j").alias("b")), "pair")
    single = distances.groupBy("tree_id").agg(F.min("i").alias("i"), F.count("*").alias("n")).filter("n = 1")
    first = pair.select("tree_id", F.posexplode(F.array("a", "b")).alias("rank", "i"))
    begun = distances.join(pair, "tree_id").filter("(i = a OR i = b) AND j <> a AND j <> b")
    left = shelf.keep(begun.groupBy("tree_id", F.col("j").alias("i")).agg(F.sum("dist").alias("total")), "left/rank=2")
    most = left.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    best = lambda table: table.agg(F.min(F.struct("total", "i"))["i"].alias("i"))
    for rank in range(3, 2 + most):
        taken = best(left.groupBy("tree_id")).withColumnRenamed("i", "taken")
        more = distances.join(taken, "tree_id").filter("i = taken").select("tree_id", F.col("j").alias("i"), "dist", "taken")
        sums = left.join(more, ["tree_id", "i"]).filter("i <> taken").select("tree_id", "i", (F.col("total") + F.col("dist")).alias("total"))
        left = shelf.keep(sums, f"left/rank={rank}")
    all_left = distances.sparkSession.read.parquet(f"{shelf.root}/left")
    later = best(all_left.groupBy("tree_id", "rank")).select("tree_id", F.col("rank").cast("int").alias("rank"), "i")
    return first.union(later).union(single.select("tree_id", F.lit(0), "i"))


def local_distances(seqs: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(tree_id, i, j, dist)``, full squares: local alignment scores against the mean self score."""
    scores = W.mirror(W.local_scores(seqs, matrix, within="tree_id"))
    own = scores.filter("i = j").select("tree_id", "i", F.col("score").alias("own"))
    both = scores.join(own, ["tree_id", "i"]).join(own.select("tree_id", F.col("i").alias("j"), F.col("own").alias("own_j")), ["tree_id", "j"])
    return both.select("tree_id", "i", "j", (1 - F.col("score") / ((F.col("own") + F.col("own_j")) / 2)).alias("dist"))


def aligned_distances(rows: DataFrame) -> DataFrame:
    """``(tree_id, i, j, dist)`` from the rows of each tree's alignment.

    The smallest and the greatest score of a tree only shift and stretch its distances, which
    changes no order, so the distance is the score with its sign turned.
    """
    scores = W.mirror(W.aligned_scores(rows, within="tree_id", key="i"))
    return scores.select("tree_id", "i", "j", (-F.col("score")).cast("long").alias("dist"))


def _symbols(seq: str, alpha: R.Alphabet) -> np.ndarray:
    return alpha.byte_index()[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def _opened(ops: str, ref: str, seq: str):
    return X.realize_two_sided(F.col(ops), F.col(ref), F.col(seq))


def _pair_ops(a: str, b: str, alpha: R.Alphabet) -> str:
    bit = lambda s: (np.int64(1) << _symbols(s, alpha).astype(np.int64)).astype(np.int64)
    sp = PAIR_SCORES
    _, text = K.trace_pairs(bit(a)[:, None], np.zeros((len(a), 1), bool), [bit(b)], sp.match, sp.match_flag, sp.gap_open, sp.gap_extend)
    return text[0].decode()


def _first_pairs(picked: DataFrame, alpha: R.Alphabet) -> DataFrame:
    """Rows of the trees' first one or two sequences, aligned with free ends at the cost of ``PAIR_SCORES``."""
    two = picked.filter("rank < 2").groupBy("tree_id").agg(
        *[F.max(F.when(F.col("rank") == k, F.struct("i", "node_id", "name", "seq"))).alias(w) for k, w in enumerate("ab")]
    )

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ops = []
            for a, b in zip(pdf["ref"], pdf["seq"], strict=True):
                ops.append(_pair_ops(a, b, alpha))
            yield pd.DataFrame({"tree_id": pdf["tree_id"], "ops": ops})

    kind = picked.schema["tree_id"].dataType.simpleString()
    pairs = two.filter("b IS NOT NULL").select("tree_id", F.col("a.seq").alias("ref"), F.col("b.seq").alias("seq"))
    met = two.join(pairs.mapInPandas(trace, f"tree_id {kind}, ops string"), "tree_id", "left")
    met = met.withColumn("ref", F.col("a.seq")).withColumn("seq", F.col("b.seq"))
    top, low = _opened("ops", "ref", "seq")
    row = lambda side, seq: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ("i", "node_id", "name")], seq.alias("seq"))
    both = F.when(F.col("b").isNull(), F.array(row("a", F.col("ref")))).otherwise(F.array(row("a", top), row("b", low)))
    return met.select("tree_id", F.inline(both))


def _best(state: np.ndarray, flag: np.ndarray, seq: str, alpha: R.Alphabet) -> tuple[int, int, str]:
    """The first of the best profiles (cols, profiles) for a sequence, its score and the trace on it."""
    query, states, sp = _symbols(seq, alpha), alpha.state_table(), STEP_SCORES
    per = max(1, SCORE_CELLS // max(1, state.shape[0]))
    costs = sp.match, sp.match_flag, sp.gap_open, sp.gap_extend
    parts = [K.profile_scores(state[:, lo : lo + per], flag[:, lo : lo + per], states, [query], *costs)[0] for lo in range(0, state.shape[1], per)]
    got = np.concatenate(parts)
    e = int(got.argmax())
    _, ops = K.trace_pairs(state[:, [e]], flag[:, [e]], [states[query]], *costs)
    return e, int(got[e]), ops[0].decode()


def _picks(rows: DataFrame, edges: DataFrame, fresh: DataFrame, n_tips: int, alpha: R.Alphabet) -> DataFrame:
    """``(tree_id, edge_id, score, ops)``: of every tree in ``fresh`` the best edge for its sequence and the trace on it.

    Profiles are made in blocks of columns and scored in groups of edges; each group traces its
    own best edge, and the groups' winners meet.  Of equal scores the smallest edge wins.  A
    sequence that names the ends ``p`` and ``q`` of an edge goes there whatever its score.
    ``n_tips`` is a bound on the tips of a tree.
    """
    trees = fresh.select("tree_id")
    rows, edges = rows.join(trees, "tree_id", "left_semi"), edges.join(trees, "tree_id", "left_semi")
    named = (F.least("u", "v") == F.least("p", "q")) & (F.greatest("u", "v") == F.greatest("p", "q"))
    edges = edges.join(fresh.select("tree_id", "p", "q"), "tree_id").withColumn("wanted", F.coalesce(named, F.lit(True)))
    block = max(1, P.CELLS_PER_TASK // max(1, n_tips))
    width = rows.groupBy("tree_id").agg(F.max(F.length("seq")).alias("width"))
    sized = edges.join(width, "tree_id")
    kind = rows.schema["tree_id"].dataType.simpleString()
    cut = P.column_blocks(rows.select(F.struct("tree_id", "node_id").alias("name"), R.normalize_seq(F.col("seq"), alpha).alias("seq")), block)
    tips = cut.select(F.col("name.tree_id").alias("tree_id"), "block", F.col("name.node_id").alias("node_id"), "seq")
    last = F.floor((F.col("width") - 1) / block).cast("int")
    per_group = F.greatest(F.lit(1), F.floor(F.lit(SCORE_CELLS) / F.col("width"))).cast("int")
    copies = sized.select(*EDGE, "wanted", F.lit(1.0).alias("len"), F.floor(F.col("edge_id") / per_group).cast("int").alias("part"),
                          F.explode(F.sequence(F.lit(0), last)).alias("block"))

    def profiles(key, tip_rows: pd.DataFrame, edge_rows: pd.DataFrame) -> pd.DataFrame:
        edge_rows = edge_rows.sort_values("edge_id", ignore_index=True)
        state, _, flag = P.edge_vectors(edge_rows, tip_rows, alpha, ANY_FREQ)
        out = pd.DataFrame({"tree_id": key[0], "part": edge_rows["part"], "edge_id": edge_rows["edge_id"], "block": key[1],
                            "state": list(state), "flag": list((flag == P.FLAG_GAP).astype(np.int32))})
        return out[edge_rows["wanted"]]

    pieces = tips.groupBy("tree_id", "block").cogroup(copies.groupBy("tree_id", "block")).applyInPandas(
        profiles, f"tree_id {kind}, part int, edge_id int, block int, state array<int>, flag array<int>"
    )
    # every group of a tree's edges gets the one sequence
    parts = sized.filter("wanted").select("tree_id", F.floor(F.col("edge_id") / per_group).cast("int").alias("part")).distinct()
    asked = fresh.select("tree_id", "seq").join(parts, "tree_id")

    def score(key, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["block", "edge_id"], ignore_index=True)
        ids = found["edge_id"][found["block"] == 0].to_numpy()
        whole = lambda column: np.concatenate([np.vstack(list(g[column])).T for _, g in found.groupby("block")])
        e, best, ops = _best(whole("state"), whole("flag") == 1, asked["seq"].iloc[0], alpha)
        return pd.DataFrame({"tree_id": [key[0]], "edge_id": [ids[e]], "score": [best], "ops": [ops]})

    groups = pieces.groupBy("tree_id", "part").cogroup(asked.groupBy("tree_id", "part"))
    best = groups.applyInPandas(score, f"tree_id {kind}, edge_id int, score long, ops string").groupBy("tree_id").agg(
        F.max(F.struct("score", (-F.col("edge_id")).alias("turned"), "ops")).alias("m")
    )
    return best.select("tree_id", (-F.col("m.turned")).alias("edge_id"), F.col("m.score").alias("score"), F.col("m.ops").alias("ops"))


def _grown(rows: DataFrame, edges: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the opened columns and the new row; edges with the picked one split in three."""
    met = rows.join(picks.select("tree_id", "ops"), "tree_id", "left").withColumn("none", F.lit(""))
    top, _ = _opened("ops", "seq", "none")
    old = met.select("tree_id", "i", "node_id", "name", F.when(F.col("ops").isNull(), F.col("seq")).otherwise(top).alias("seq"))
    _, low = _opened("ops", "none", "seq")
    new = picks.withColumn("none", F.lit("")).select("tree_id", "i", "node_id", "name", low.alias("seq"))
    edge = lambda e, u, v: F.struct(e.alias("edge_id"), u.alias("u"), v.alias("v"))
    e, u, v, inner = (F.col(c) for c in ("edge_id", "u", "v", "inner"))
    three = F.array(edge(e, u, inner), edge(F.col("first_edge"), inner, v), edge(F.col("first_edge") + 1, inner, F.col("node_id")))
    at = picks.select("tree_id", F.col("edge_id").alias("at"), "inner", "node_id", "first_edge")
    split = edges.join(at, "tree_id", "left")
    return old.unionByName(new), split.select("tree_id", F.inline(F.when(e == F.col("at"), three).otherwise(F.array(edge(e, u, v)))))


def _wide(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("utf-32-le"), np.uint32)


def _narrow(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)


def _steps(rows: np.ndarray, codes: np.ndarray, nodes: list[int], ends: dict, asked: list[dict], alpha: R.Alphabet):
    """Characters of all rows and ``{edge: (u, v)}`` of one tree after a step for each of ``asked``.

    ``rows`` are the texts that are written and ``codes`` those that profiles are made of; both get the same columns.
    """
    nodes, ends = list(nodes), dict(ends)
    for a in asked:
        tips = pd.DataFrame({"node_id": nodes, "seq": [r.tobytes().decode("latin-1") for r in codes]})
        edges = pd.DataFrame([(e, u, v, 1.0) for e, (u, v) in sorted(ends.items())], columns=["edge_id", "u", "v", "len"])
        state, _, flag = P.edge_vectors(edges, tips, alpha, ANY_FREQ)
        p, q = a["p"], a["q"]
        wanted = np.array([p is None or q is None or {u, v} == {p, q} for u, v in zip(edges["u"], edges["v"])])
        e, _, ops = _best(state[wanted].T, flag[wanted].T == P.FLAG_GAP, a["seq"], alpha)
        rows, codes = _with_row(rows, _wide(a["row"]), ops), _with_row(codes, _narrow(a["known"]), ops)
        at, inner, first = int(edges["edge_id"][wanted].iloc[e]), a["inner"], a["first_edge"]
        u, v = ends[at]
        ends |= {at: (u, inner), first: (inner, v), first + 1: (inner, a["node_id"])}
        nodes.append(a["node_id"])
    return rows, ends


def _with_row(cells: np.ndarray, text: np.ndarray, ops: str) -> np.ndarray:
    """Rows with the columns that a trace opens, and the traced text as a row below them."""
    op = np.frombuffer(ops.encode(), np.uint8)
    out = np.full((len(cells) + 1, op.size), ord("-"), cells.dtype)
    out[:-1, op != ord("2")], out[-1, op != ord("1")] = cells, text
    return out


def _early(forest: Forest, asked: DataFrame, alpha: R.Alphabet, shelf: Shelf) -> Forest:
    """``forest`` with the sequences ``asked`` of small trees, each tree's in the order of their ranks in one task."""
    trees = asked.select("tree_id").distinct()
    mine, others = (lambda df: df.join(trees, "tree_id", "left_semi")), (lambda df: df.join(trees, "tree_id", "left_anti"))
    none = [F.lit(None).cast("int").alias(c) for c in ("inner", "first_edge", "p", "q")]
    new = asked.select("rank", *ROW, *[F.col(c).cast("int").alias(c) for c in ("inner", "first_edge", "p", "q")])
    held = mine(forest.rows).select(F.lit(-1).alias("rank"), *ROW, *none).unionByName(new)
    # a new row is written as its trace would give it, an old one as it is
    upper = F.when(F.col("rank") < 0, F.col("seq")).otherwise(F.translate("seq", R.LOWER, R.UPPER))
    held = held.withColumn("row", upper).withColumn("known", R.normalize_seq(upper, alpha))

    def grown(key, held: pa.Table, tree: pa.Table) -> pa.Table:
        held = held.sort_by("rank")
        every = held.drop_columns(["i", "name"]).to_pylist()
        old, asked = [r for r in every if r["rank"] < 0], [r for r in every if r["rank"] >= 0]
        start = {r["edge_id"]: (r["u"], r["v"]) for r in tree.to_pylist()}
        matrix = lambda code, c: np.vstack([code(r[c]) for r in old])
        rows, ends = _steps(matrix(_wide, "row"), matrix(_narrow, "known"), [r["node_id"] for r in old], start, asked, alpha)
        edges = [(e, *ends[e]) for e in sorted(ends)]
        texts = [r.tobytes().decode("utf-32-le") for r in rows]
        both = lambda c: pa.chunked_array([*held.column(c).chunks, pa.nulls(len(edges), held.schema.field(c).type)])
        of_edges = lambda k: pa.array([None] * held.num_rows + [x[k] for x in edges], pa.int32())
        one = pa.repeat(key[0], held.num_rows + len(edges))
        return pa.table({"tree_id": one, "i": both("i"), "node_id": both("node_id"), "name": both("name"),
                         "seq": pa.array(texts + [None] * len(edges), pa.string()), "edge_id": of_edges(0), "u": of_edges(1), "v": of_edges(2)})

    kind = {c: forest.rows.schema[c].dataType.simpleString() for c in ("tree_id", "i")}
    schema = f"tree_id {kind['tree_id']}, i {kind['i']}, node_id int, name string, seq string, edge_id int, u int, v int"
    both_of = _dealt(held).groupBy("tree_id").cogroup(_dealt(mine(forest.edges)).groupBy("tree_id"))
    out = shelf.keep(both_of.applyInArrow(grown, schema), "early")
    rows, edges = out.filter("edge_id IS NULL").select(*ROW), out.filter("edge_id IS NOT NULL").select(*EDGE)
    return Forest(others(forest.rows).select(*ROW).unionByName(rows), others(forest.edges).select(*EDGE).unionByName(edges))


def _grow(forest: Forest, picked: DataFrame, first: int, n_tips: int, alpha: R.Alphabet, shelf: Shelf) -> Forest:
    """Add the sequences of rank ``first`` and later, one rank after the other.

    ``picked(tree_id, rank, i, name, seq, node_id, inner, first_edge, p, q)`` also says which
    numbers a sequence's tip, inner node and first new edge get; ``n_tips`` is a bound on the
    tips before.  A step opens at most the columns of its sequence, which bounds a tree's size.
    """
    size = forest.rows.groupBy("tree_id").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("width"))
    so_far = Window.partitionBy("tree_id").orderBy("rank")
    cells = (F.col("n") + F.count("*").over(so_far)) * (F.col("width") + F.sum(F.length("seq")).over(so_far))
    sized = picked.filter(F.col("rank") >= first).join(size, "tree_id").withColumn("small", cells <= TREE_CELLS)
    asked = shelf.keep(sized.select(*picked.columns, "small"), "asked")
    small, picked = asked.filter("small").drop("small"), asked.filter("NOT small").drop("small")
    n_small, start, last = asked.agg(F.count_if("small"), *[f(F.when(~F.col("small"), F.col("rank"))) for f in (F.min, F.max)]).first()
    if n_small:
        forest = _early(forest, small, alpha, shelf)
    for rank in range(start or 0, (-1 if last is None else last) + 1):
        fresh = picked.filter(F.col("rank") == rank)
        best = _picks(forest.rows, forest.edges, fresh, n_tips + rank - first, alpha)
        picks = shelf.keep(best.join(fresh.drop("rank", "p", "q"), "tree_id"), f"picks-{rank}")
        rows, edges = _grown(forest.rows, forest.edges, picks)
        forest = Forest(shelf.keep(rows.select(*ROW), f"rows-{rank}"), shelf.keep(edges.select(*EDGE), f"edges-{rank}"))
        for name in (f"rows-{rank - 1}", f"edges-{rank - 1}", f"picks-{rank}"):
            shelf.drop(name)
    return forest


def _from_pairs(picked: DataFrame, alpha: R.Alphabet, shelf: Shelf) -> Forest:
    rows = shelf.keep(_first_pairs(picked, alpha).select(*ROW), "rows-1")
    ends = picked.filter("rank < 2").groupBy("tree_id").agg(
        *[F.max(F.when(F.col("rank") == k, F.col("node_id"))).alias(w) for k, w in enumerate("uv")]
    )
    start = ends.filter("v IS NOT NULL").select("tree_id", F.lit(0).alias("edge_id"), "u", "v")
    return _grow(Forest(rows, shelf.keep(start, "edges-1")), picked, 2, 2, alpha, shelf)


#: A sequence without a place that is given.
NOWHERE = ["CAST(NULL AS int) AS p", "CAST(NULL AS int) AS q"]


def build(seqs: DataFrame, orders: DataFrame, alpha: str | R.Alphabet = R.DNA) -> Forest:
    """The trees of ``seqs(tree_id, i, name, seq)``, cleaned residues, in the order ``orders(tree_id, rank, i)``.

    A tree of one sequence has a row and no edge.  Sequences without residues must be left out.
    """
    a, shelf = R.alphabet(alpha), Shelf(seqs.sparkSession, "forest")
    rank = F.col("rank")
    picked = seqs.join(orders, ["tree_id", "i"]).select(
        "tree_id", "rank", "i", "name", "seq", F.when(rank < 2, rank).otherwise(2 * rank - 1).alias("node_id"),
        (2 * rank - 2).alias("inner"), (2 * rank - 3).alias("first_edge"), *map(F.expr, NOWHERE),
    )
    return _from_pairs(shelf.keep(picked, "picked"), a, shelf)


def extend(forest: Forest, seqs: DataFrame, orders: DataFrame, alpha: str | R.Alphabet = R.DNA) -> Forest:
    """``forest`` with the sequences of ``seqs(tree_id, i, name, seq)`` added in the order ``orders(tree_id, rank, i)``, from 0.

    Trees need an edge to begin with; new numbers follow the greatest ones of each tree.
    """
    a, shelf = R.alphabet(alpha), Shelf(seqs.sparkSession, "forest")
    rank = F.col("rank")
    tops = forest.edges.groupBy("tree_id").agg(F.max(F.greatest("u", "v")).alias("top"), F.max("edge_id").alias("top_edge"))
    picked = seqs.join(orders, ["tree_id", "i"]).join(tops, "tree_id").select(
        "tree_id", "rank", "i", "name", "seq", (F.col("top") + 2 * rank + 2).alias("node_id"), (F.col("top") + 2 * rank + 1).alias("inner"),
        (F.col("top_edge") + 2 * rank + 1).alias("first_edge"), *map(F.expr, NOWHERE),
    )
    n_tips = forest.rows.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return _grow(forest, shelf.keep(picked, "picked"), 0, n_tips, a, shelf)


def joints(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """``(tree_id, rank, inner, p, q)``: where each tip joins the tree of the tips of lower rank.

    ``tips(tree_id, rank, node_id)`` are all tips of the binary trees ``edges(tree_id, u, v)``.
    They are taken off again from the last one on: the tip's inner node goes with it, and its
    other two neighbours ``p`` and ``q`` become the ends of one edge.
    """
    shelf = Shelf(edges.sparkSession, "joints")
    last = tips.agg(F.max("rank")).first()[0] or 0
    current = shelf.keep(edges.select("tree_id", "u", "v"), f"left-{last + 1}")
    if last < 2:
        return current.select("tree_id", F.lit(0).alias("rank"), F.col("u").alias("inner"), F.col("u").alias("p"), F.col("v").alias("q")).filter("false")
    for rank in range(last, 1, -1):
        off = tips.filter(F.col("rank") == rank).select("tree_id", F.col("node_id").alias("tip"))
        darts = current.select("tree_id", F.col("u").alias("src"), F.col("v").alias("dst")).union(current.select("tree_id", "v", "u"))
        inner = darts.join(off, "tree_id").filter("src = tip").select("tree_id", "tip", F.col("dst").alias("inner"))
        near = darts.join(inner, "tree_id").filter("src = inner AND dst <> tip")
        joint = near.groupBy("tree_id", "tip", "inner").agg(F.min("dst").alias("p"), F.max("dst").alias("q"))
        joint = shelf.keep(joint.select("tree_id", "inner", "p", "q"), f"joints/rank={rank}")
        met = current.join(joint, "tree_id", "left")
        rest = met.filter("inner IS NULL OR (u <> inner AND v <> inner)").select("tree_id", "u", "v")
        current = shelf.keep(rest.union(joint.select("tree_id", "p", "q")), f"left-{rank}")
        shelf.drop(f"left-{rank + 1}")
    found = edges.sparkSession.read.parquet(f"{shelf.root}/joints")
    return found.select("tree_id", F.col("rank").cast("int").alias("rank"), "inner", "p", "q")


def along(seqs: DataFrame, orders: DataFrame, nodes: DataFrame, edges: DataFrame, alpha: str | R.Alphabet = R.DNA) -> Forest:
    """Alignments of ``seqs`` built along target trees: each sequence goes to its own place in the target.

    ``nodes(tree_id, node_id, name, is_tip)`` and ``edges(tree_id, u, v)`` are binary trees whose
    tips are the names of ``seqs``; the result has their nodes.  A sequence that is no tip of its
    target is left out, and a tip without a sequence is an error.
    """
    a, shelf = R.alphabet(alpha), Shelf(seqs.sparkSession, "along")
    tips = nodes.filter("is_tip").select("tree_id", "node_id", "name")
    bad = F.raise_error(F.concat(F.lit("no sequence for tip "), F.col("name")))
    placed = tips.join(seqs.join(orders, ["tree_id", "i"]), ["tree_id", "name"], "left")
    placed = shelf.keep(placed.withColumn("rank", F.when(F.col("i").isNull(), bad.cast("int")).otherwise(F.col("rank"))), "tips")
    rank = F.col("rank")
    picked = placed.join(joints(edges, placed.select("tree_id", "rank", "node_id")), ["tree_id", "rank"], "left").select(
        "tree_id", "rank", "i", "name", "seq", "node_id", "inner", (2 * rank - 3).alias("first_edge"), "p", "q"
    )
    return _from_pairs(shelf.keep(picked, "picked"), a, shelf)


def from_nothing(seqs: DataFrame, matrix: DataFrame, alpha: str | R.Alphabet = R.DNA) -> Forest:
    """Trees and alignments of unaligned sequences, in the order of their local distances."""
    shelf = Shelf(seqs.sparkSession, "distances")
    return build(seqs, addition_orders(shelf.keep(local_distances(seqs, matrix), "local")), alpha)


def split_digests(forest: Forest) -> DataFrame:
    """``(tree_id, digest)``: one value for the set of a tree's splits; trees without edges have none."""
    keys = U.split_fingerprints(forest.nodes(), forest.edges).select("tree_id", "split_key").distinct()
    # sums of marks again, so that a large tree's splits are not put in one array
    marks = [F.sum(m).cast("string") for m in U.tip_marks(F.col("split_key"))]
    return keys.groupBy("tree_id").agg(F.concat_ws("-", F.count("*"), *marks).alias("digest"))


@dataclass(frozen=True)
class Refined:
    """The last ``forest`` and ``history(tree_id, gen, digest)``; ``ends(tree_id, gen, same_as, period)``."""

    forest: Forest
    history: DataFrame
    ends: DataFrame


def refine(seqs: DataFrame, matrix: DataFrame, alpha: str | R.Alphabet = R.DNA, most: int = MOST_GENERATIONS) -> Refined:
    """Build trees, then build them again from their alignments' distances until their splits repeat.

    Generation 0 is the first one that is made from an alignment.  A tree whose set of splits
    equals that of an earlier generation is done: ``period`` is the distance to the latest such
    generation.  Done trees leave the work; the others go on for at most ``most`` generations,
    and then have no row in ``ends``.  Small trees take ``ROUND`` generations at once in a task each,
    large ones go by jobs; tables of their earlier generations are removed.
    """
    shelf = Shelf(seqs.sparkSession, "refine")
    forest = from_nothing(seqs, matrix, alpha)
    n, residues = F.count("*"), F.sum(F.length("seq"))
    sizes = seqs.groupBy("tree_id").agg(((n <= ORDER_IDS) & (n * residues <= TREE_CELLS)).alias("small"))
    sizes = shelf.keep(sizes, "sizes")
    n_small, n_large = sizes.agg(F.count_if("small"), F.count_if(~F.col("small"))).first()
    by = {True: _refined_in_rounds, False: _refined_by_jobs}
    if not (n_small and n_large):
        return by[not n_large](seqs, forest, alpha, most)
    of = lambda df, small: df.join(sizes.filter("small" if small else "NOT small"), "tree_id", "left_semi")
    one, two = (by[s](of(seqs, s), Forest(of(forest.rows, s), of(forest.edges, s)), alpha, most) for s in by)
    whole = Forest(one.forest.rows.unionByName(two.forest.rows), one.forest.edges.unionByName(two.forest.edges))
    return Refined(whole, one.history.unionByName(two.history), one.ends.unionByName(two.ends))


def _digest(names: list[str], nodes: list[int], ends: dict[int, tuple[int, int]]) -> str:
    """The value of :func:`split_digests` for one tree."""
    if not ends:
        return "none"
    marks = lambda text: np.array([int(hashlib.md5(text.encode()).hexdigest()[at : at + 15], 16) for at in (0, 15)], object)
    tips = {node: (name == min(names), np.array([1, *marks(name)], object)) for node, name in zip(nodes, names)}
    u, v = (np.array(side) for side in zip(*ends.values()))
    parent, child, levels = P.rooted_at(u, v, int(u[0]))
    nothing = (False, np.zeros(3, object))
    below = {node: tips.get(node, nothing) for node in {*u.tolist(), *v.tolist()}}
    whole = sum(weight for _, weight in tips.values())
    keys = set()
    for level in reversed(levels):
        for k in level:
            a, (least, weight) = int(parent[k]), below[int(child[k])]
            below[a] = below[a][0] or least, below[a][1] + weight
            other = 2 * weight[0] > whole[0] or (2 * weight[0] == whole[0] and not least)
            keys.add("-".join(map(str, whole - weight if other else weight)))
    return "-".join(map(str, [len(keys), *sum(marks(key) for key in keys)]))


def _generation(members: list[dict], dist: np.ndarray, alpha: R.Alphabet):
    """Rows in the order of ``members``, their nodes and the edges of one tree that is built by ``dist``."""
    order = _greedy(dist)
    nodes = [k if k < 2 else 2 * k - 1 for k in range(len(order))]
    picked = [members[m] | {"node_id": node, "inner": 2 * k - 2, "first_edge": 2 * k - 3, "p": None, "q": None} for k, (m, node) in enumerate(zip(order, nodes))]
    rows, codes, ends = _wide(picked[0]["seq"])[None], _narrow(picked[0]["known"])[None], {}
    if len(order) > 1:
        ops, ends = _pair_ops(picked[0]["seq"], picked[1]["seq"], alpha), {0: (0, 1)}
        rows, codes = _with_row(rows, _wide(picked[1]["row"]), ops), _with_row(codes, _narrow(picked[1]["known"]), ops)
    rows, ends = _steps(rows, codes, nodes[:2], ends, picked[2:], alpha)
    back = np.argsort(order)
    return [rows[k].tobytes().decode("utf-32-le") for k in back], [nodes[k] for k in back], ends


def _refined_in_rounds(seqs: DataFrame, forest: Forest, alpha: str | R.Alphabet, most: int) -> Refined:
    a, shelf = R.alphabet(alpha), Shelf(seqs.sparkSession, "rounds")
    kind = {c: seqs.schema[c].dataType.simpleString() for c in ("tree_id", "i")}

    def take(first: int, last: int):
        def rounds(key, held: pa.Table, past: pa.Table) -> pa.Table:
            held = held.sort_by("i")
            upper = [s.translate(str.maketrans(R.LOWER, R.UPPER)) for s in held.column("seq").to_pylist()]
            members = [{"seq": s, "row": r, "known": k} for s, r, k in zip(held.column("seq").to_pylist(), upper, held.column("known").to_pylist())]
            names, rows = held.column("name").to_pylist(), held.column("aligned").to_pylist()
            seen = dict(zip(past.column("digest").to_pylist(), past.column("gen").to_pylist()))
            found, nodes, ends = [], [], {}
            for gen in range(first, last if rows else first):  # a tree that is done has only its past
                texts = np.vstack([_narrow(s) for s in rows])
                dist = -np.vstack([W.row_scores(x, texts) for x in texts]).astype(np.int64)
                rows, nodes, ends = _generation(members, dist, a)
                digest = _digest(names, nodes, ends)
                same = seen.get(digest)
                found.append((gen, digest, same))
                if same is not None:
                    break
                seen[digest] = gen
            edges = [(e, *ends[e]) for e in sorted(ends)]
            n, n_edges, n_found = len(rows), len(edges), len(found)
            of_rows = lambda c: pa.chunked_array([*held.column(c).chunks, pa.nulls(n_edges + n_found, held.schema.field(c).type)])
            column = lambda head, mid, tail, type_: pa.array([*(head or [None] * n), *(mid or [None] * n_edges), *(tail or [None] * n_found)], type_)
            of_edges = lambda k: column(None, [e[k] for e in edges], None, pa.int32())
            of_found = lambda k, type_: column(None, None, [f[k] for f in found], type_)
            return pa.table({
                "tree_id": pa.repeat(key[0], n + n_edges + n_found), **{c: of_rows(c) for c in ("i", "name", "seq", "known")},
                "aligned": column(rows, None, None, pa.string()), "node_id": column(nodes, None, None, pa.int32()),
                "edge_id": of_edges(0), "u": of_edges(1), "v": of_edges(2),
                "gen": of_found(0, pa.int32()), "digest": of_found(1, pa.string()), "same_as": of_found(2, pa.int32()),
            })

        return rounds

    schema = f"tree_id {kind['tree_id']}, i {kind['i']}, name string, seq string, known string, aligned string, node_id int, edge_id int, u int, v int, gen int, digest string, same_as int"
    members = ["tree_id", "i", "name", "seq", "known", "aligned"]
    left = seqs.withColumn("known", R.normalize_seq(F.col("seq"), a)).join(
        forest.rows.select("tree_id", "i", F.col("seq").alias("aligned")), ["tree_id", "i"]
    ).select(*members)
    history = seqs.sparkSession.createDataFrame([], f"tree_id {kind['tree_id']}, gen int, digest string")
    done, ends = [], []
    for first in range(0, most, ROUND):
        # fresh aliases: the two sides of a cogroup must not share column identities
        past = history.select(*[F.col(c).alias(c) for c in history.columns])
        both = _dealt(left).groupBy("tree_id").cogroup(_dealt(past).groupBy("tree_id"))
        out = shelf.keep(both.applyInArrow(take(first, min(most, first + ROUND)), schema), f"round-{first}")
        found = out.filter("digest IS NOT NULL")
        history = found.select("tree_id", "gen", "digest") if not first else history.union(found.select("tree_id", "gen", "digest"))
        ends.append(found.filter("same_as IS NOT NULL").select("tree_id", "gen", "same_as", (F.col("gen") - F.col("same_as")).alias("period")))
        over = ends[-1].select("tree_id")
        going = out.join(over, "tree_id", "left_anti")
        left = going.filter("aligned IS NOT NULL").select(*members)
        if first + ROUND >= most or left.isEmpty():
            done.append(out)
            break
        done.append(out.join(over, "tree_id", "left_semi"))
    if not done:
        return Refined(forest, history, history.select("tree_id", "gen", F.col("gen").alias("same_as"), F.col("gen").alias("period")))
    union = lambda tables: reduce(DataFrame.union, tables)
    whole = union(done)
    rows = whole.filter("aligned IS NOT NULL").select("tree_id", "i", "node_id", "name", F.col("aligned").alias("seq"))
    return Refined(Forest(rows, whole.filter("edge_id IS NOT NULL").select(*EDGE)), history, union(ends))


def _refined_by_jobs(seqs: DataFrame, forest: Forest, alpha: str | R.Alphabet, most: int) -> Refined:
    spark, shelf = seqs.sparkSession, Shelf(seqs.sparkSession, "generations")
    kind = seqs.schema["tree_id"].dataType.simpleString()
    done_rows, done_edges, history, ends = [], [], [], []
    left = seqs
    for gen in range(most):
        orders = addition_orders(shelf.keep(aligned_distances(forest.rows), f"aligned-{gen}"))
        forest = build(left, orders, alpha)
        forest = Forest(shelf.keep(forest.rows, f"rows-{gen}"), shelf.keep(forest.edges, f"edges-{gen}"))
        shelf.drop(f"aligned-{gen}")
        digests = split_digests(forest).withColumn("gen", F.lit(gen))
        # a tree of one sequence has no splits, which is the same in every generation
        alone = forest.rows.join(forest.edges.select("tree_id"), "tree_id", "left_anti").select("tree_id", F.lit("none").alias("digest"), F.lit(gen).alias("gen"))
        history.append(shelf.keep(digests.unionByName(alone).select("tree_id", "gen", "digest"), f"history-{gen}"))
        if gen:
            earlier = history[0]
            for table in history[1:-1]:
                earlier = earlier.union(table)
            same = history[-1].join(earlier.select("tree_id", "digest", F.col("gen").alias("before")), ["tree_id", "digest"])
            found = same.groupBy("tree_id", "gen").agg(F.max("before").alias("same_as"))
            ends.append(shelf.keep(found.withColumn("period", F.col("gen") - F.col("same_as")), f"ends-{gen}"))
            done_rows.append(shelf.keep(forest.rows.join(ends[-1].select("tree_id"), "tree_id", "left_semi"), f"done-rows-{gen}"))
            done_edges.append(shelf.keep(forest.edges.join(ends[-1].select("tree_id"), "tree_id", "left_semi"), f"done-edges-{gen}"))
            going = lambda df: df.join(ends[-1].select("tree_id"), "tree_id", "left_anti")
            forest, left = Forest(going(forest.rows), going(forest.edges)), shelf.keep(going(left), f"left-{gen}")
            if left.isEmpty():
                break
    union = lambda tables, schema: tables[0] if len(tables) == 1 else union([tables[0].union(tables[1]), *tables[2:]], schema) if tables else spark.createDataFrame([], schema)
    past = union(history, f"tree_id {kind}, gen int, digest string")
    over = union(ends, f"tree_id {kind}, gen int, same_as int, period int")
    whole = Forest(union([*done_rows, forest.rows.select(*ROW)], ""), union([*done_edges, forest.edges.select(*EDGE)], ""))
    return Refined(whole, past, over)
