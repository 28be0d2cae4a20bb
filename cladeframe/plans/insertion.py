"""Adding sequences to a tree and its alignment, one after the other.

A step is a distributed job on the whole alignment; the driver keeps the ids that the step
made and nothing else.  Steps depend on one another, so their number is the run's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import residues as R
from cladeframe.operators import columns as C
from cladeframe.operators import place as L
from cladeframe.operators import profiles as P
from cladeframe.operators import traces as X
from cladeframe.operators import trees as T
from cladeframe.plans import forest as N
from cladeframe.session import cut_lineage

# Scores of an insertion step, and the length of the branches that it makes.
SCORES = L.Scores(gap_open=-4, gap_extend=-1, match=2, match_flag=-2)
BRANCH = 1.0


@dataclass(frozen=True)
class Grown:
    """A tree and the alignment of its tips: ``nodes``, ``edges`` and ``msa(name, seq)``."""

    nodes: DataFrame
    edges: DataFrame
    msa: DataFrame


def insert(tree: Grown, name: str, seq: str, edge_id: int | None = None, alpha: str | R.Alphabet = R.DNA) -> Grown:
    """Place one sequence on its best edge, or on ``edge_id``, and split that edge.

    All rows get the columns that the sequence opens; the edge becomes three, of length 1,
    that meet in a new inner node.  Of equal scores the smallest edge wins.
    """
    spark = tree.msa.sparkSession
    profiles = cut_lineage(P.edge_profiles(tree.msa, tree.nodes, tree.edges, gap_model="cgap", alpha=alpha))
    query = L.clean_queries(spark.createDataFrame([(0, name, seq)], "seq_id long, name string, seq string"), alpha)
    if edge_id is None:
        edge_id = L.best_edge(query, profiles, scores=SCORES, alpha=alpha).first()["edge_id"]
    placed = query.withColumn("edge_id", F.lit(edge_id))
    traced = cut_lineage(X.with_gapped(L.trace(placed, profiles, SCORES, alpha), placed))
    aligned = X.extended_alignment(tree.msa, traced, L.profile_shape(profiles)[1], alpha=alpha).select("name", "seq")
    return Grown(*_split(tree, name, edge_id), cut_lineage(aligned))


def _split(tree: Grown, name: str, edge_id: int) -> tuple[DataFrame, DataFrame]:
    spark = tree.nodes.sparkSession
    top_node = tree.nodes.agg(F.max("node_id")).first()[0]
    top_edge = tree.edges.agg(F.max("edge_id")).first()[0]
    old = tree.edges.filter(F.col("edge_id") == edge_id).first()
    if old is None:
        raise ValueError(f"no edge {edge_id}")
    inner, tip = top_node + 1, top_node + 2
    nodes = tree.nodes.select("node_id", "name", "is_tip").union(
        spark.createDataFrame([(inner, None, False), (tip, name, True)], "node_id int, name string, is_tip boolean")
    )
    fresh = [(edge_id, old["u"], inner, BRANCH), (top_edge + 1, inner, old["v"], BRANCH), (top_edge + 2, inner, tip, BRANCH)]
    edges = tree.edges.filter(F.col("edge_id") != edge_id).select("edge_id", "u", "v", "len").union(
        spark.createDataFrame(fresh, "edge_id int, u int, v int, len double")
    )
    return cut_lineage(nodes), cut_lineage(edges)


def start(msa: DataFrame, nodes: DataFrame, edges: DataFrame, alpha: str | R.Alphabet = R.DNA) -> Grown:
    """The tree's own rows, without columns that hold nothing but gaps."""
    kept = C.drop_gap_columns(msa, nodes.filter("is_tip"), alpha)
    return Grown(nodes.select("node_id", "name", "is_tip"), edges.select("edge_id", "u", "v", "len"), cut_lineage(kept))


def insert_in_order(tree: Grown, sequences: DataFrame, alpha: str | R.Alphabet = R.DNA) -> Grown:
    """Insert ``sequences(rank, name, seq)`` one after the other, from rank 0 on.

    Edges that stay as they are keep their lengths.
    """
    root = F.lit(0).alias("tree_id")
    tips = tree.msa.join(tree.nodes.filter("is_tip").select("name", "node_id"), "name")
    forest = N.Forest(tips.select(root, F.lit(-1).cast("long").alias("i"), "node_id", "name", "seq"), tree.edges.select(root, "edge_id", "u", "v"))
    seqs = L.clean_queries(sequences, alpha).select(root, F.col("rank").cast("long").alias("i"), "name", "seq")
    grown = N.extend(forest, seqs, sequences.select(root, "rank", F.col("rank").cast("long").alias("i")), alpha)
    kept = tree.edges.select("edge_id", "u", "v", "len")
    edges = grown.edges.join(kept, ["edge_id", "u", "v"], "left").select("edge_id", "u", "v", F.coalesce("len", F.lit(BRANCH)).alias("len"))
    return Grown(grown.nodes().select("node_id", "name", "is_tip"), edges, grown.rows.select("name", "seq"))


def insert_guided(tree: Grown, name: str, seq: str, beside: list[str], branches: DataFrame, **kw) -> Grown:
    """Insert on the branch that parts the tips ``beside`` from the others.

    ``branches`` are the exploded branches of the same tree, with its edge numbers; a tip set
    that no branch splits off is an error.
    """
    wanted = branches.select("tree_id").distinct().withColumn("want_id", F.lit(0)).withColumn(
        "tips", F.array(*(F.lit(b) for b in sorted(beside)))
    )
    edge_id = T.locate_edges(T.splits(branches), wanted, branches).first()["edge_id"]
    return insert(tree, name, seq, edge_id, **kw)
