"""Probabilistic placement: queries against the inner nodes of a labelled tree.

A node profile joins the node's ancestral base probabilities with the gap probability
swept up the tree; scores are log-odds against background frequencies.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import kernels as K
from cladeframe.functions import residues as R
from cladeframe.functions.gapmodel import LOG_ODDS_FLOOR
from cladeframe.operators import profiles as P
from cladeframe.operators.columns import base_frequencies, gap_frequency
from cladeframe.operators.place import BROADCAST_BYTES, residue_slices, _symbols, body_schema, by_own_profile, in_blocks, spread

# Gap opening and extension, the background gap frequency, the score tie width.
DELTA, EPSILON = 1e-4, 1e-3
BACKGROUND_GAP = 0.715
TIE = 1e-4
NODE_BLOCK = 64
#: Of one node and column: four base scores, two weights, and the table they are made from.
NODE_CELL_BYTES = 96


def node_gap_probs(msa: DataFrame, nodes: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    """``(node_id, gap)``: probability of a gap per column at every inner node below ``root``."""
    msa = msa.select("name", R.normalize_seq(F.col("seq")).alias("seq"))
    freq = float(gap_frequency(msa).first()["gap_freq"])

    def task(tip_rows: pd.DataFrame, edge_rows: pd.DataFrame) -> pd.DataFrame:
        edge_rows = edge_rows.sort_values("edge_id", ignore_index=True)
        below, child = P.subtree_vectors(edge_rows, tip_rows, R.DNA, freq, root)
        inner = ~below.tip
        num = below.lik[inner, 1] * freq
        prob = num / (below.lik[inner, 0] * (1 - freq) + num)
        return pd.DataFrame(
            {"node_id": child[inner], "block": int(tip_rows["block"].iloc[0]), "gap": list(prob)}
        )

    pieces = P.per_column_block(msa, nodes, edges, task, "node_id int, block int, gap array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("block", "gap")))
    return pieces.groupBy("node_id").agg(F.flatten(F.transform(ordered, lambda b: b["gap"])).alias("gap"))


def node_profiles(anc_probs: DataFrame, nodes: DataFrame, gaps: DataFrame) -> DataFrame:
    """``(node_id, p, gap)``: base probabilities by node label, columns in order."""
    per_node = anc_probs.groupBy("node_label").agg(F.array_sort(F.collect_list(F.struct("col", "p"))).alias("c"))
    labelled = nodes.select("node_id", F.col("label").cast("int").alias("node_label"))
    return (
        per_node.join(labelled, "node_label")
        .join(gaps, "node_id")
        .select("node_id", F.transform("c", lambda x: x["p"]).alias("p"), "gap")
    )


def clean_queries(queries: DataFrame) -> DataFrame:
    """Only A, C, G and T take part (U counts as T)."""
    return queries.withColumn("seq", R.query_residues(F.col("seq"), R.DNA4))


class _Nodes:
    def __init__(self, table: pa.Table, background: np.ndarray, gap_freq: float) -> None:
        ids = table.column("node_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.node_id = ids[order]
        p = np.array(table.column("p").to_pylist(), dtype=float)[order]  # nodes, columns, 4
        gap = np.array(table.column("gap").to_pylist(), dtype=float)[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            floor = lambda x: np.maximum(LOG_ODDS_FLOOR, np.where(x > 0, np.log(np.where(x > 0, x, 1)), -np.inf))
            self.match = np.ascontiguousarray(floor(p / background).transpose(1, 2, 0))
            self.residue = floor((1 - gap) / (1 - gap_freq)).T
            self.gap = floor(gap / gap_freq).T

    def __len__(self) -> int:
        return self.node_id.size


def _acgt(batch: dict) -> list[np.ndarray]:
    return _symbols(batch["seq"], R.DNA4)


def _within(score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of every entry that ties with its row's best."""
    row, col = np.nonzero(score > score.max(axis=1, keepdims=True) - TIE)
    return row, ids[col], score[row, col]


def best_node(
    queries: DataFrame,
    profiles: DataFrame,
    background: list[float],
    gap_freq: float = BACKGROUND_GAP,
    delta: float = DELTA,
    epsilon: float = EPSILON,
    path: str = "max",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(seq_id, node_id, score)``: highest log-odds, ties within 1e-4 to the smallest node.

    Queries stay in place and meet one broadcast block of profiles at a time.  A block
    offers every node that ties with its own best, with that node's score, so that the
    merge sees whatever may tie with the best of all.
    """
    n, w = _shape(profiles)
    bg = np.asarray(background, dtype=float)
    schema = "seq_id long, node_id int, score double"
    queries = spread(queries.select("seq_id", "seq"))

    def body(rows: dict, prof: _Nodes) -> pa.Table:
        syms = _acgt(rows)
        score = np.empty((len(syms), len(prof)))
        for lo in range(0, len(prof), NODE_BLOCK):
            s = slice(lo, lo + NODE_BLOCK)
            score[:, s] = K.log_odds_scores(
                prof.match[:, :, s], prof.residue[:, s], prof.gap[:, s], syms, delta, epsilon, path
            )
        row, node, value = _within(score, prof.node_id)
        return pa.table(
            {
                "seq_id": pa.array(np.asarray(rows["seq_id"], dtype=np.int64)[row]),
                "node_id": pa.array(node.astype(np.int32)),
                "score": pa.array(value),
            }
        )

    offers = in_blocks(
        queries, profiles, "node_id", n * w * NODE_CELL_BYTES, broadcast_bytes, lambda t: _Nodes(t, bg, gap_freq), body, schema
    )
    best = offers.groupBy("seq_id").agg(F.max("score").alias("best"))
    tied = offers.join(best, "seq_id").filter(F.col("score") > F.col("best") - TIE)
    return tied.groupBy("seq_id").agg(F.min("node_id").alias("node_id"), F.max("best").alias("score"))


def _shape(profiles: DataFrame) -> tuple[int, int]:
    """(nodes, columns); an error if there are none."""
    r = profiles.agg(F.count("*").alias("n"), F.max(F.size("gap")).alias("w")).first()
    if not r["n"]:
        raise ValueError("no profiles")
    return int(r["n"]), int(r["w"])


def trace_nodes(
    placed: DataFrame,
    profiles: DataFrame,
    background: list[float],
    gap_freq: float = BACKGROUND_GAP,
    delta: float = DELTA,
    epsilon: float = EPSILON,
) -> DataFrame:
    """``(seq_id, node_id, score, ops)`` for ``placed(seq_id, seq, node_id)``.

    Each query meets only its node; the queries of a popular node are split by a salt.  A
    node without a profile is an error.
    """
    bg = np.asarray(background, dtype=float)
    _shape(profiles)
    schema = "seq_id long, node_id int, score double, ops string"

    def cell(q: pa.Table, p: pa.Table) -> pa.Table:
        if q.num_rows and not p.num_rows:
            raise ValueError(f"no profile for node {q.column('node_id')[0]}")
        found = [pa.table({f.name: pa.array([], f.type) for f in body_schema(schema)})]
        prof = _Nodes(p, bg, gap_freq) if q.num_rows else None
        for rows in residue_slices(q):
            score, ops = K.log_odds_traces(
                prof.match[:, :, 0], prof.residue[:, 0], prof.gap[:, 0], _acgt(rows), delta, epsilon
            )
            found.append(
                pa.table(
                    {
                        "seq_id": pa.array(rows["seq_id"], pa.int64()),
                        "node_id": pa.array(rows["node_id"], pa.int32()),
                        "score": pa.array(score),
                        "ops": pa.array([o.decode() for o in ops], pa.string()),
                    }
                )
            )
        return pa.concat_tables(found)

    return by_own_profile(placed.select("seq_id", "seq", "node_id"), profiles, "node_id", cell, schema)


def background_frequencies(msa: DataFrame) -> list[float]:
    """Base frequencies of the reference rows in the order A, C, G, T."""
    rows = {r["base"]: r["freq"] for r in base_frequencies(msa).collect()}
    return [rows[b] for b in "ACGT"]
