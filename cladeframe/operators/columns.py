"""Column-wise algebra over alignments ``msa(name, seq)``.

Per-column statistics explode residues once and aggregate by column.  The map-side
partial aggregate leaves at most one row per alignment column in each task, so
the shuffle is (tasks x columns) rows however many sequences there are, and no
column can be "hot".  Column selections go the other way: the mask is one array
of alignment width, read as a scalar subquery, and every row filters itself in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import residues as R


class AlignmentError(ValueError):
    """Input that the operator must refuse."""


def to_long(msa: DataFrame) -> DataFrame:
    """``(name, col, ch)``, one row per residue."""
    return msa.select("name", F.posexplode(R.chars(F.col("seq"))).alias("col", "ch"))


def to_wide(msa_long: DataFrame) -> DataFrame:
    """Inverse of :func:`to_long`; a group is one alignment row, bounded by its width."""
    cells = F.array_sort(F.collect_list(F.struct("col", "ch")))
    return msa_long.groupBy("name").agg(
        F.array_join(F.transform(cells, lambda c: c["ch"]), "").alias("seq")
    )


def tree_rows(msa: DataFrame, tips: DataFrame) -> DataFrame:
    """Alignment rows that are tips of the tree (``tips(name)``)."""
    return msa.join(tips.select("name"), "name", "left_semi")


def extra_rows(msa: DataFrame, tips: DataFrame) -> DataFrame:
    """Alignment rows that are not tips; they become additional queries."""
    return msa.join(tips.select("name"), "name", "left_anti")


def missing_tips(msa: DataFrame, tips: DataFrame) -> DataFrame:
    """Tips without an alignment row."""
    return tips.select("name").join(msa.select("name"), "name", "left_anti")


def require_all_tips(msa: DataFrame, tips: DataFrame, show: int = 20) -> None:
    """Raise if any tip lacks an alignment row, naming the first few."""
    names = [r["name"] for r in missing_tips(msa, tips).orderBy("name").limit(show).collect()]
    if names:
        raise AlignmentError("tree tips missing from the alignment: " + ", ".join(names))


def all_queries(queries: DataFrame, msa: DataFrame, tips: DataFrame) -> DataFrame:
    """Query set plus the alignment rows outside the tree (UNION ALL)."""
    return queries.select("name", "seq").unionByName(extra_rows(msa, tips).select("name", "seq"))


def illegal_residues(msa: DataFrame, alpha: str | R.Alphabet = R.DNA) -> DataFrame:
    """Residues of the alignment outside the alphabet, with row name and 1-based column."""
    bad = R.dropped_chars(R.normalize_seq(F.col("seq"), alpha), alpha) != ""
    return (
        to_long(msa.filter(bad))
        .filter(~R.is_known(R.normalize_seq(F.col("ch"), alpha), alpha))
        .select("name", (F.col("col") + 1).alias("col"), "ch")
    )


def bad_characters(queries: DataFrame, alpha: str | R.Alphabet = R.DNA, strict: bool = False) -> DataFrame:
    """Characters deleted from the queries: ``(ch, n_chars, n_seqs)``."""
    text = F.col("seq") if strict else R.normalize_seq(F.col("seq"), alpha)
    per_seq = (
        queries.select(F.explode(R.chars(R.dropped_chars(text, alpha))).alias("ch"), "name")
        .filter("ch <> ''")
        .groupBy("ch", "name")
        .agg(F.count("*").alias("n"))
    )
    return per_seq.groupBy("ch").agg(
        F.sum("n").alias("n_chars"), F.count("*").alias("n_seqs")
    )


def column_stats(msa: DataFrame, gap_chars: str = "-") -> DataFrame:
    """``(col, n_rows, n_nongap, n_gap)`` per alignment column."""
    nongap = ~F.lit(gap_chars).contains(F.col("ch"))
    return (
        to_long(msa)
        .groupBy("col")
        .agg(F.count("*").alias("n_rows"), F.count_if(nongap).alias("n_nongap"))
        .withColumn("n_gap", F.col("n_rows") - F.col("n_nongap"))
    )


def column_coverage(msa: DataFrame, gap_chars: str = "-") -> DataFrame:
    """``(col, covered)``: whether any row has a residue there."""
    nongap = ~F.lit(gap_chars).contains(F.col("ch"))
    return to_long(msa).groupBy("col").agg(F.bool_or(nongap).alias("covered"))


def column_gap_frequency(msa: DataFrame) -> DataFrame:
    """Smoothed gap frequency per column, ``(gaps + 1) / (rows + 2)``."""
    return column_stats(msa, "-?.Nn").select(
        "col", ((F.col("n_gap") + 1) / (F.col("n_rows") + 2)).alias("gap_freq")
    )


def gap_frequency(msa: DataFrame, normalized: bool = True, alpha: str | R.Alphabet = R.DNA) -> DataFrame:
    """One row ``(n_gap, n_total, gap_freq)``; ``normalized=False`` counts ``-`` only."""
    seq = F.col("seq")
    n_gap = R.gap_count(seq, alpha) if normalized else F.length(seq) - F.length(F.regexp_replace(seq, "-", ""))
    return (
        msa.select(n_gap.alias("g"), F.length("seq").alias("n"))
        .agg(F.sum("g").alias("n_gap"), F.sum("n").alias("n_total"))
        .withColumn("gap_freq", F.col("n_gap") / F.col("n_total"))
    )


def base_frequencies(msa: DataFrame) -> DataFrame:
    """``(base, n, freq)`` over A, C, G, T (case folded, U counted as T).

    Counted with string lengths per row and one global sum: no explode, and the
    shuffle is one row per task.
    """
    seq = R.normalize_seq(F.col("seq"), R.DNA)
    per_row = [
        (F.length(seq) - F.length(F.regexp_replace(seq, b, ""))).alias(b) for b in "ACGT"
    ]
    total = msa.select(*per_row).agg(*[F.sum(b).alias(b) for b in "ACGT"])
    all_bases = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    entries = F.array(
        *[F.struct(F.lit(b).alias("base"), F.col(b).alias("n"), (F.col(b) / all_bases).alias("freq")) for b in "ACGT"]
    )
    return total.select(F.explode(entries).alias("e")).select("e.base", "e.n", "e.freq")


def _mask(kept: DataFrame) -> Column:
    """``kept(col)`` as one boolean array, usable inside any row expression.

    Between two kept columns the array is padded with ``false``.  It has alignment
    width at most: no larger than one residue row.
    """
    cols = F.array_sort(F.collect_list("col"))
    runs = F.transform(
        F.col("cols"),
        lambda c, k: F.concat(
            F.array_repeat(F.lit(False), c - F.coalesce(F.get(F.col("cols"), k - 1), F.lit(-1)) - 1),
            F.array(F.lit(True)),
        ),
    )
    return kept.agg(cols.alias("cols")).select(F.flatten(runs).alias("mask")).scalar()


def select_columns(msa: DataFrame, kept: DataFrame) -> DataFrame:
    """Keep the alignment columns listed in ``kept(col)``, for all rows."""
    picked = F.filter(R.chars(F.col("seq")), lambda c, i: F.get(F.col("_mask"), i))
    return (
        msa.withColumn("_mask", _mask(kept))
        .withColumn("seq", F.array_join(picked, ""))
        .drop("_mask")
    )


def drop_gap_columns(msa: DataFrame, tips: DataFrame | None = None, alpha: str | R.Alphabet = R.DNA) -> DataFrame:
    """Rows of the tree without the columns that are gaps in all of them."""
    refs = tree_rows(msa, tips) if tips is not None else msa
    refs = refs.withColumn("seq", R.normalize_seq(F.col("seq"), alpha))
    return select_columns(refs, column_coverage(refs).filter("covered"))


def covered_by_queries(msa: DataFrame, tips: DataFrame) -> DataFrame:
    """All rows, restricted to columns in which some non-tree row has a residue."""
    covered = column_coverage(extra_rows(msa, tips), "-?Nn").filter("covered")
    return select_columns(msa, covered)


def well_filled(msa: DataFrame) -> DataFrame:
    """All rows, restricted to columns with residues in at least half of the rows (floored)."""
    kept = column_stats(msa).filter(F.col("n_nongap") >= F.floor(F.col("n_rows") / 2))
    return select_columns(msa, kept)


def cut_partition(msa: DataFrame, parts: DataFrame, gene: str) -> DataFrame:
    """The columns of one named gene; the first partition of that name counts."""
    hit = parts.filter(F.col("gene_name") == gene).agg(
        F.min_by(F.struct("start", "end"), "ord").alias("r")
    )
    cut = msa.withColumn("_r", hit.scalar())
    missing = F.raise_error(F.lit(f"no partition named {gene}"))
    return cut.select(
        "name",
        F.when(F.col("_r").isNull(), missing.cast("string"))
        .otherwise(
            F.substr("seq", F.col("_r.start") + 1, F.col("_r.end") - F.col("_r.start") + 1)
        )
        .alias("seq"),
    )


def cut_all_partitions(msa: DataFrame, parts: DataFrame) -> DataFrame:
    """Every gene of every row: ``(gene_name, name, seq)``; one narrow pass over the rows.

    The partition list travels as one array (its length is bounded by the alignment width).
    """
    genes = parts.agg(F.collect_list(F.struct("gene_name", "start", "end")).alias("g")).scalar()
    return (
        msa.withColumn("_g", F.explode(genes))
        .select(
            F.col("_g.gene_name").alias("gene_name"),
            "name",
            F.substr("seq", F.col("_g.start") + 1, F.col("_g.end") - F.col("_g.start") + 1).alias("seq"),
        )
    )


def merge_by_prefix(msa: DataFrame, prefix: str, first_input: str, sep: str = ".") -> DataFrame:
    """Merge rows whose names share ``prefix...`` up to ``sep``; others pass through once.

    Rows are folded by (group, column), so a group of any size is merged with map-side
    partial aggregates; the group is never collected.  Two residues in one column
    are an error.  ``first_input`` names a column that orders the inputs: a
    name outside the prefix keeps the sequence of the lowest one.
    """
    is_pref = F.col("name").startswith(prefix)
    group = F.substring_index("name", sep, 1)
    width = msa.agg(F.max(F.length("seq")).alias("w")).scalar()
    # gaps leave a row before it is exploded
    residues = F.filter(F.transform(R.chars(F.col("seq")), lambda c, i: F.struct(i.alias("col"), c.alias("ch"))), lambda x: x["ch"] != "-")
    cells = (
        msa.filter(is_pref)
        .select(group.alias("name"), F.inline(residues))
        .groupBy("name", "col")
        .agg(F.max("ch").alias("ch"), F.count("*").alias("n"))
    )
    checked = cells.select(
        "name",
        "col",
        F.when(
            F.col("n") > 1,
            F.raise_error(
                F.concat(F.lit("two residues in column "), F.col("col").cast("string"), F.lit(" of "), F.col("name"))
            ).cast("string"),
        )
        .otherwise(F.col("ch"))
        .alias("ch"),
    )
    filled = checked.groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("col", "ch"))).alias("m")
    )
    merged = filled.withColumn("_w", width).select("name", R.row_of_cells(F.col("m"), F.col("_w")).alias("seq"))
    all_gap = (
        msa.filter(is_pref).select(group.alias("name")).distinct().join(merged.select("name"), "name", "left_anti")
    ).withColumn("_w", width).select("name", F.expr("repeat('-', _w)").alias("seq"))
    rest = msa.filter(~is_pref)
    rest = rest.groupBy("name").agg(F.min_by("seq", F.col(first_input)).alias("seq"))
    return rest.unionByName(merged).unionByName(all_gap)


def alignment_summary(msa: DataFrame) -> DataFrame:
    """One row: ``(n_rows, max_name_len, min_len, max_len, uniform)``."""
    return msa.agg(
        F.count("*").alias("n_rows"),
        F.max(F.length("name")).alias("max_name_len"),
        F.min(F.length("seq")).alias("min_len"),
        F.max(F.length("seq")).alias("max_len"),
    ).withColumn("uniform", F.col("min_len") == F.col("max_len"))


def alignment_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two alignments of the same names: share of equal states, and the strict form.

    Strict counts the positions where both rows have seen the same number of gaps.
    One join on ``name``; everything else is per-row array arithmetic.
    """
    pair = a.select("name", R.chars(F.col("seq")).alias("x")).join(
        b.select("name", R.chars(F.col("seq")).alias("y")), "name"
    )
    state = lambda c: F.when(
        F.instr(F.lit(R.DNA_SYMBOLS[:-1]), R.normalize_seq(c)) > 0, R.normalize_seq(c)
    ).otherwise(F.lit("-"))
    same = F.size(
        F.filter(F.zip_with("x", "y", lambda p, q: state(p) == state(q)), lambda v: v)
    )
    step = F.zip_with(
        "x", "y", lambda p, q: (p == "-").cast("int") - (q == "-").cast("int")
    )
    folded = F.aggregate(
        step,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            (acc["d"] + s).alias("d"),
            (acc["n"] + F.when(acc["d"] + s == 0, 1).otherwise(0)).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return pair.select(
        "name", (same / F.size("x")).alias("agreement"), (folded / F.size("x")).alias("strict")
    )
