"""Column bounds per query from tabular hits and a partition table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import residues as R
from cladeframe.operators.columns import AlignmentError


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit per query: highest bit score, first line on ties.

    A max of a struct aggregates map-side, so a query with a third of all hits costs
    one row per task.
    """
    rest = [c for c in hits.columns if c not in ("qs_name", "bit_score", "line_no")]
    top = F.max(F.struct("bit_score", (-F.col("line_no")).alias("_first"), *rest)).alias("t")
    return hits.groupBy("qs_name").agg(top).select(
        "qs_name", F.col("t.bit_score").alias("bit_score"), (-F.col("t._first")).alias("line_no"),
        *[F.col(f"t.{c}").alias(c) for c in rest],
    )


def query_hits(queries: DataFrame, best: DataFrame, missing: str = "error") -> DataFrame:
    """Queries with their best hit; a query without one is an error or gets full width."""
    joined = queries.select("name").join(best.withColumnRenamed("qs_name", "name"), "name", "left")
    if missing == "full":
        return joined
    bad = F.raise_error(F.concat(F.lit("no hit for query "), F.col("name")))
    return joined.withColumn("ref_name", F.when(F.col("ref_name").isNull(), bad.cast("string")).otherwise(F.col("ref_name")))


def hit_columns(best: DataFrame, msa: DataFrame, alpha: str | R.Alphabet = R.DNA) -> DataFrame:
    """Hit positions as alignment columns: adds ``col_start`` and ``col_end``.

    The reference row's residue-to-column map is joined once per hit and indexed twice.
    Rows no hit names are dropped before their maps are built.
    """
    used = msa.join(best.select(F.col("ref_name").alias("name")).distinct(), "name", "left_semi")
    maps = used.select(F.col("name").alias("ref_name"), R.nongap_map(F.col("seq"), alpha).alias("_m"))
    lost = F.raise_error(F.concat(F.lit("hit names an unknown reference: "), F.col("ref_name")))
    outside = F.raise_error(F.concat(F.lit("hit outside of reference "), F.col("ref_name")))
    at = lambda pos: (
        F.when(F.col("ref_name").isNull(), F.lit(None).cast("int"))
        .when(F.col("_m").isNull(), lost.cast("int"))
        .when((pos < 0) | (pos >= F.size("_m")), outside.cast("int"))
        .otherwise(F.get(F.col("_m"), pos))
    )
    return best.join(maps, "ref_name", "left").select(
        *best.columns, at(F.col("ref_start")).alias("col_start"), at(F.col("ref_end")).alias("col_end")
    )


def assign_partition(placed_hits: DataFrame, parts: DataFrame) -> DataFrame:
    """First partition (file order) that contains the hit's columns; none -> null bounds.

    The partition list is bounded by the alignment width and travels as one sorted
    array, so the interval test is a filter inside each row instead of a theta join.
    """
    listed = parts.agg(F.array_sort(F.collect_list(F.struct("ord", "gene_name", "start", "end")))).scalar()
    inside = F.filter(
        F.col("_p"), lambda p: (F.col("col_start") >= p["start"]) & (F.col("col_end") <= p["end"])
    )
    return (
        placed_hits.withColumn("_p", listed)
        .withColumn("_hit", F.get(inside, F.lit(0)))
        .select(
            *placed_hits.columns,
            F.col("_hit.gene_name").alias("gene_name"),
            F.col("_hit.start").alias("start"),
            F.col("_hit.end").alias("end"),
        )
    )


def query_bounds(
    queries: DataFrame, hits: DataFrame, msa: DataFrame, parts: DataFrame, missing: str = "error"
) -> DataFrame:
    """``(name, gene_name, start, end)`` per query; inclusive columns, null for full width."""
    named = query_hits(queries, best_hits(hits), missing)
    return assign_partition(hit_columns(named, msa), parts).select("name", "gene_name", "start", "end")


def gene_bounds(parts: DataFrame, gene: str) -> tuple[int, int]:
    """Bounds of one named gene for a whole run."""
    r = parts.filter(F.col("gene_name") == gene).orderBy("ord").select("start", "end").first()
    if r is None:
        raise AlignmentError(f"no partition named {gene}")
    return r["start"], r["end"]
