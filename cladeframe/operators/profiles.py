"""Ancestral profile of every tree edge, from an alignment and an unrooted binary tree.

The work is independent per alignment column, so the alignment is cut into column
blocks and each block meets its own copy of the tree in a cogroup.  A task holds
(tips x block) residues; the block is sized from the tip count, so memory per task is
bounded for any tree, and neither the tree nor the alignment passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import residues as R
from cladeframe.functions.gapmodel import gap_transition_array
from cladeframe.operators.columns import AlignmentError, gap_frequency

# Flag bits of the boolean gap rule.
FLAG_GAP = 1
FLAG_OPEN = 2

CELLS_PER_TASK = 1 << 22
PROFILE_SCHEMA = "edge_id int, state array<int>, aux array<int>, gapp array<double>"


def column_blocks(msa: DataFrame, block: int) -> DataFrame:
    """``(name, block, seq)``: each row cut into pieces of ``block`` columns."""
    n_blocks = F.ceil(F.length("seq") / block).cast("int")
    return msa.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).select(
        "name", "block", F.substr("seq", F.col("block") * block + 1, F.lit(block)).alias("seq")
    )


def rooted_at(u: np.ndarray, v: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Orient edges away from ``root``: per edge (parent, child), and edges by depth."""
    ends: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        ends.setdefault(a, []).append(k)
        ends.setdefault(b, []).append(k)
    parent, child = u.copy(), v.copy()
    seen = np.zeros(u.size, dtype=bool)
    levels, front = [], [root]
    while front:
        level, nxt = [], []
        for node in front:
            for k in ends[node]:
                if not seen[k]:
                    seen[k] = True
                    other = int(v[k]) if u[k] == node else int(u[k])
                    parent[k], child[k] = node, other
                    level.append(k)
                    nxt.append(other)
        if level:
            levels.append(np.array(level))
        front = nxt
    if not seen.all():
        raise AlignmentError("the tree is not connected")
    return parent, child, levels


def _fitch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = a & b
    return np.where(both == 0, a | b, both)


class _Vectors:
    """State, gap likelihoods and gap flag of a set of directed edges, for one column block."""

    def __init__(self, n: int, width: int) -> None:
        self.state = np.zeros((n, width), dtype=np.int32)
        self.lik = np.zeros((n, 2, width))
        self.flag = np.zeros((n, width), dtype=np.int8)
        self.tip = np.zeros(n, dtype=bool)

    def take(self, k: np.ndarray):
        return self.state[k], self.lik[k], self.flag[k], self.tip[k]

    def put(self, k: np.ndarray, joined) -> None:
        self.state[k], self.lik[k], self.flag[k] = joined


def _combine(one, two, p_one: np.ndarray, p_two: np.ndarray):
    """Join two child vectors through their branch matrices."""
    state = _fitch(one[0], two[0])
    lik = np.matmul(p_one, one[1]) * np.matmul(p_two, two[1])
    top = lik.max(axis=1, keepdims=True)
    lik = np.where(top > 0, lik / np.where(top > 0, top, 1), lik)  # only the ratio is used
    inner = ~(one[3] | two[3])[:, None]
    gap_one = np.where(inner, one[2] == FLAG_GAP, (one[2] & FLAG_GAP) != 0)
    gap_two = np.where(inner, two[2] == FLAG_GAP, (two[2] & FLAG_GAP) != 0)
    flag = np.where(
        gap_one & gap_two, FLAG_GAP, np.where(gap_one | gap_two, FLAG_GAP | FLAG_OPEN, 0)
    ).astype(np.int8)
    return state, lik, flag


class _Sweep:
    """One tree oriented away from ``root`` with the tip residues of one column block."""

    def __init__(self, edges: pd.DataFrame, tips: pd.DataFrame, alpha: R.Alphabet, gap_freq: float, root: int) -> None:
        u, v = edges["u"].to_numpy(), edges["v"].to_numpy()
        node_of = tips["node_id"].to_numpy()
        raw = [np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8) for s in tips["seq"]]
        self.codes = alpha.state_table()[alpha.byte_index()[np.vstack(raw)]].astype(np.int32)
        self.gap_state = alpha.gap_state
        degree = np.bincount(np.concatenate([u, v]) - min(u.min(), v.min()))
        if set(np.unique(degree[degree > 0])) - {1, 3}:
            raise AlignmentError("the tree is not binary")
        self.n = u.size
        self.p = gap_transition_array(gap_freq, edges["len"].to_numpy())
        self.parent, self.child, self.levels = rooted_at(u, v, root)
        self.row = {int(n): k for k, n in enumerate(node_of)}
        self.children: dict[int, list[int]] = {}
        for k, a in enumerate(self.parent.tolist()):
            self.children.setdefault(a, []).append(k)

    def tip_values(self, nodes: np.ndarray):
        state = self.codes[[self.row[int(n)] for n in nodes]]
        gap = state == self.gap_state
        lik = np.stack([np.where(gap, 0.0, 1.0), np.where(gap, 1.0, 0.0)], axis=1)
        return state, lik, np.where(gap, FLAG_GAP, 0).astype(np.int8)

    def below(self) -> _Vectors:
        """Per edge, the vector of the subtree on its far side."""
        out = _Vectors(self.n, self.codes.shape[1])
        for level in reversed(self.levels):
            leaf = np.array([int(c) in self.row for c in self.child[level]])
            at_tip, inner = level[leaf], level[~leaf]
            if at_tip.size:
                out.put(at_tip, self.tip_values(self.child[at_tip]))
                out.tip[at_tip] = True
            if inner.size:
                pair = np.array([self.children[int(c)] for c in self.child[inner]])
                one, two = pair[:, 0], pair[:, 1]
                out.put(inner, _combine(out.take(one), out.take(two), self.p[one], self.p[two]))
        return out

    def above(self, below: _Vectors) -> _Vectors:
        """Per edge, the vector of everything on its near side (root must be a tip)."""
        out = _Vectors(self.n, self.codes.shape[1])
        first = self.levels[0]
        out.put(first, self.tip_values(self.parent[first]))
        out.tip[first] = True
        up_edge = {int(c): k for k, c in enumerate(self.child)}
        for level in self.levels[1:]:
            via = np.array([up_edge[int(a)] for a in self.parent[level]])
            twin = np.array([next(s for s in self.children[int(self.parent[k])] if s != k) for k in level])
            out.put(level, _combine(out.take(via), below.take(twin), self.p[via], self.p[twin]))
        return out


def edge_vectors(edges: pd.DataFrame, tips: pd.DataFrame, alpha: R.Alphabet, gap_freq: float):
    """``(state, likelihoods, flag)`` of every edge for one column block.

    Two sweeps from a tip: towards it every edge gets the vector of the subtree below,
    back out the vector of everything else; joined they describe the edge.
    """
    sweep = _Sweep(edges, tips, alpha, gap_freq, int(tips["node_id"].iloc[0]))
    below = sweep.below()
    above = sweep.above(below)
    every = np.arange(sweep.n)
    return _combine(below.take(every), above.take(every), sweep.p, sweep.p)


def subtree_vectors(edges: pd.DataFrame, tips: pd.DataFrame, alpha: R.Alphabet, gap_freq: float, root: int):
    """Subtree vectors per edge away from ``root``, and the node at each far end."""
    sweep = _Sweep(edges, tips, alpha, gap_freq, root)
    return sweep.below(), sweep.child


def per_column_block(
    msa: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block: int | None = None,
) -> DataFrame:
    """Run ``task(tip rows, edge rows)`` once per column block of the alignment.

    The tree is copied to the blocks as rows, the alignment is cut; a task holds at most
    about ``CELLS_PER_TASK`` residues.
    """
    tips = nodes.filter("is_tip").select("node_id", "name")
    if block is None:
        block = max(1, CELLS_PER_TASK // max(1, tips.count()))
    rows = column_blocks(msa, block).join(tips, "name").select("block", "node_id", "seq")
    last_block = msa.agg(F.floor((F.max(F.length("seq")) - 1) / block).cast("int")).scalar()
    copies = (
        edges.select("edge_id", "u", "v", "len")
        .withColumn("_last", last_block)
        .withColumn("block", F.explode(F.sequence(F.lit(0), "_last")))
        .drop("_last")
    )
    columns = [f.split()[0] for f in schema.split(", ")]

    def checked(tip_rows: pd.DataFrame, edge_rows: pd.DataFrame) -> pd.DataFrame:
        if tip_rows.empty or edge_rows.empty:
            return pd.DataFrame({c: [] for c in columns})
        return task(tip_rows, edge_rows)

    return rows.groupBy("block").cogroup(copies.groupBy("block")).applyInPandas(checked, schema)


def edge_profiles(
    msa: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    gap_model: str = "pgap",
    alpha: str | R.Alphabet = R.DNA,
    gap_freq: float | None = None,
    block: int | None = None,
) -> DataFrame:
    """``profiles(edge_id, state, aux, gapp)`` of every edge of one tree.

    ``msa`` holds the rows of the tips only (see ``drop_gap_columns``).  ``aux`` is 1
    where the edge looks like a gap: with ``pgap`` where the gap likelihood is larger,
    with ``cgap`` by the boolean rule (then bit 2 marks an open gap).
    ``gapp`` is the posterior of a residue.
    """
    a = R.alphabet(alpha)
    msa = msa.select("name", R.normalize_seq(F.col("seq"), a).alias("seq"))
    if gap_freq is None:
        gap_freq = gap_frequency(msa, alpha=a).first()["gap_freq"]
    freq, model = float(gap_freq), gap_model

    def task(tip_rows: pd.DataFrame, edge_rows: pd.DataFrame) -> pd.DataFrame:
        edge_rows = edge_rows.sort_values("edge_id", ignore_index=True)
        state, lik, flag = edge_vectors(edge_rows, tip_rows, a, freq)
        aux = (lik[:, 0] < lik[:, 1]).astype(np.int32) if model == "pgap" else flag.astype(np.int32)
        num = lik[:, 0] * (1 - freq)
        return pd.DataFrame(
            {
                "edge_id": edge_rows["edge_id"],
                "block": int(tip_rows["block"].iloc[0]),
                "state": list(state),
                "aux": list(aux),
                "gapp": list(num / (num + lik[:, 1] * freq)),
            }
        )

    schema = "edge_id int, block int, state array<int>, aux array<int>, gapp array<double>"
    pieces = per_column_block(msa, nodes, edges, task, schema, block)
    ordered = F.array_sort(F.collect_list(F.struct("block", "state", "aux", "gapp")))
    joined = pieces.groupBy("edge_id").agg(ordered.alias("p"))
    return joined.select("edge_id", *[F.flatten(F.col(f"p.{c}")).alias(c) for c in ("state", "aux", "gapp")])


def profiles_long(profiles: DataFrame) -> DataFrame:
    """``(edge_id, col, state, aux, gapp)``."""
    zipped = F.arrays_zip("state", "aux", "gapp")
    return profiles.select("edge_id", F.posexplode(zipped).alias("col", "v")).select(
        "edge_id", "col", "v.state", "v.aux", "v.gapp"
    )
