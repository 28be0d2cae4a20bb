"""Whole jobs put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import residues as R
from cladeframe.operators import columns as C
from cladeframe.operators import logodds as G
from cladeframe.operators import place as L
from cladeframe.operators import profiles as P
from cladeframe.operators import traces as X
from cladeframe.session import cut_lineage


@dataclass(frozen=True)
class Placement:
    """``placed(seq_id, name, edge_id|node_id, score)``, ``traces(.., ops)`` and ``aligned(name, seq, kind)``."""

    placed: DataFrame
    traces: DataFrame
    aligned: DataFrame


def place_job(
    msa: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, bounds: DataFrame | None = None,
    ref_gaps: bool = True, alpha: str | R.Alphabet = R.DNA, **kw,
) -> Placement:
    """Clean, place, trace, check and align ``queries(seq_id, name, seq)``.

    ``bounds(name, start, end)`` limits queries to inclusive columns of the reduced
    reference; null or absent bounds mean the full width.  A trace whose score differs from
    the placement's is an error.
    """
    refs = cut_lineage(C.drop_gap_columns(msa, nodes.filter("is_tip"), alpha))
    profiles = cut_lineage(P.edge_profiles(refs, nodes, edges, alpha=alpha))
    cleaned = L.clean_queries(queries.select("seq_id", "name", "seq"), alpha)
    if bounds is not None:
        cleaned = cleaned.join(bounds.select("name", "start", "end"), "name", "left")
    # read twice: texts are cleaned and spread once
    cleaned = cut_lineage(L.spread(cleaned) if kw.get("spread_queries", True) else cleaned)
    best = L.best_edge(cleaned, profiles, alpha=alpha, ends=True, **{**kw, "spread_queries": False})
    placed = cut_lineage(cleaned.join(best, "seq_id"))
    traces = cut_lineage(L.trace(placed, profiles, alpha=alpha, checked=True, **kw))
    width = L.profile_shape(profiles)[1]
    aligned = X.extended_alignment(refs, traces, width, ref_gaps, alpha)
    return Placement(placed.select("seq_id", "name", "edge_id", "score"), traces.select("seq_id", "edge_id", "score", "ops"), aligned)


def node_job(
    msa: DataFrame, nodes: DataFrame, edges: DataFrame, anc_probs: DataFrame, root: int, queries: DataFrame,
    ref_gaps: bool = True, **kw,
) -> Placement:
    """The same by log-odds against the inner nodes, from supplied ancestral probabilities."""
    refs = cut_lineage(C.drop_gap_columns(msa, nodes.filter("is_tip")))
    profiles = cut_lineage(G.node_profiles(anc_probs, nodes, G.node_gap_probs(refs, nodes, edges, root)))
    background = G.background_frequencies(refs)
    cleaned = G.clean_queries(queries.select("seq_id", "name", "seq"))
    placed = cut_lineage(cleaned.join(G.best_node(cleaned, profiles, background, **kw), "seq_id"))
    traces = cut_lineage(G.trace_nodes(placed, profiles, background))
    width = int(profiles.agg(F.max(F.size("gap"))).first()[0])
    aligned = X.extended_alignment(refs, X.with_gapped(traces, placed), width, ref_gaps)
    return Placement(placed.select("seq_id", "name", "node_id", "score"), traces, aligned)


@dataclass(frozen=True)
class Candidates:
    """``scored(seq_id, edge_id, rank, ops, score)`` of the k best edges, each score worked out from the operations,
    and ``report``: the distinct alignments among them."""

    scored: DataFrame
    report: DataFrame


def candidates(queries: DataFrame, profiles: DataFrame, k: int, **kw) -> Candidates:
    """Trace cleaned ``queries(seq_id, name, seq)`` on their k best edges."""
    top = cut_lineage(L.top_edges(queries, profiles, k, **kw).drop("score").join(queries.select("seq_id", "seq"), "seq_id"))
    traced = L.trace(top, profiles, **kw).select("seq_id", "edge_id", "ops")
    scored = cut_lineage(L.rescored(traced, queries, profiles).join(top.select("seq_id", "edge_id", "rank"), ["seq_id", "edge_id"]))
    return Candidates(scored, X.distinct_traces(scored))
