"""From operation strings to aligned rows, with columns opened for insertions.

An operation string and its residues are merged into one text per query - upper case
on a column, ``-`` for a skipped column, lower case for an insertion - and everything
after that is string work per row plus one small aggregate over insert lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions import residues as R

OPENED_BYTES = 1 << 24  # of opened rows that a task holds at once


def gapped(ops: Column, seq: Column) -> Column:
    """Merge operations and residues: ``0`` -> upper, ``1`` -> ``-``, ``2`` -> lower case."""
    steps = F.regexp_extract_all(ops, F.lit("1*[02]"), F.lit(0))
    placed = F.zip_with(
        steps,
        R.chars(seq),
        lambda t, c: F.concat(
            F.repeat(F.lit("-"), F.length(t) - 1),
            F.when(F.right(t, F.lit(1)) == "0", c).otherwise(F.translate(c, R.UPPER, R.LOWER)),
        ),
    )
    tail = _ends_with(ops, "1")
    body = F.when(F.length(seq) > 0, F.array_join(placed, "")).otherwise(F.lit(""))
    return F.concat(body, F.repeat(F.lit("-"), tail))


def _ends_with(ops: Column, op: str) -> Column:
    """How often an operation stands at the end; a pattern would try every run of it on the way."""
    return F.length(ops) - F.length(F.rtrim(ops, F.lit(op)))


def column_tokens(gapped_seq: Column) -> Column:
    """One text per alignment column: the insertions before it, then its character.

    The last entry holds the insertions after the last column.
    """
    return F.regexp_extract_all(gapped_seq, F.lit("[a-z]*[^a-z]|[a-z]*$"), F.lit(0))


def with_gapped(traces: DataFrame, queries: DataFrame) -> DataFrame:
    """Join traces with their residues and add ``gapped``."""
    return traces.join(queries.select("seq_id", "name", "seq"), "seq_id").withColumn(
        "gapped", gapped(F.col("ops"), F.col("seq"))
    )


def realize(ops: Column, seq: Column) -> Column:
    """Aligned text without insertions: its length is the alignment width."""
    return F.regexp_replace(gapped(ops, seq), "[a-z]", "")


def realize_two_sided(ops: Column, ref: Column, seq: Column) -> tuple[Column, Column]:
    """Both rows of a pairwise alignment: the reference gets ``-`` at insertions."""
    steps = F.regexp_extract_all(ops, F.lit("2*[01]"), F.lit(0))
    top = F.zip_with(
        steps, R.chars(ref), lambda t, c: F.concat(F.repeat(F.lit("-"), F.length(t) - 1), c)
    )
    tail = _ends_with(ops, "2")
    return (
        F.concat(F.array_join(top, ""), F.repeat(F.lit("-"), tail)),
        F.translate(gapped(ops, seq), R.LOWER, R.UPPER),
    )


def position_map(ops: Column) -> Column:
    """Alignment column of each residue; an insertion maps to the next column."""
    tokens = F.regexp_extract_all(ops, F.lit("2*[01]|2+$"), F.lit(0))
    return F.flatten(
        F.transform(tokens, lambda t, i: F.array_repeat(i, F.length(F.regexp_replace(t, "1", ""))))
    )


def insert_budget(traces: DataFrame) -> DataFrame:
    """``ref_gaps(pos, n)``: most residues any trace inserts before each column.

    Positions without insertions are absent.  The shuffle holds one row per position
    and batch, however many traces there are.
    """

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            raw = [(s or "").encode() for s in rb.column(0).to_pylist()]
            begun = np.cumsum([0, *map(len, raw)]) // OPENED_BYTES
            for part in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(begun[:-1])) + 1):
                pos, n = _longest_runs([raw[k] for k in part])
                yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(n, pa.int32())], names=["pos", "n"])

    return traces.select("ops").mapInArrow(longest, "pos int, n int").groupBy("pos").agg(F.max("n").alias("n"))


def _longest_runs(ops: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Columns before which residues are inserted, and the most that any of the traces inserts there."""
    chars = np.frombuffer(b"".join(s + b"0" for s in ops), np.uint8)  # a run ends with its trace
    inserted = chars == ord("2")
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inserted, [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    seen = np.cumsum(~inserted)
    ends = np.cumsum([len(s) + 1 for s in ops])
    row = np.searchsorted(ends, start, side="right")
    pos = seen[start] - np.concatenate([[0], seen[ends - 1]])[row]
    most = np.zeros(int(pos.max(initial=-1)) + 1, np.int64)
    np.maximum.at(most, pos, size)
    return np.flatnonzero(most), most[most > 0]


def budget_array(ref_gaps: DataFrame, width: int) -> Column:
    """The budget as one array of ``width + 1`` integers, as a scalar subquery."""
    as_map = F.map_from_entries(F.collect_list(F.struct("pos", "n")))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(width)),
        lambda p: F.coalesce(F.try_element_at(F.col("m"), p), F.lit(0)),
    )
    return ref_gaps.agg(as_map.alias("m")).select(dense.alias("b")).scalar()


def output_width(ref_gaps: DataFrame, width: int) -> DataFrame:
    """One row ``(n_cols, n_inserted, width)``."""
    return ref_gaps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_inserted")).select(
        F.lit(width).cast("long").alias("n_cols"),
        "n_inserted",
        (F.lit(width) + F.col("n_inserted")).alias("width"),
    )


def output_columns(ref_gaps: DataFrame, width: int) -> DataFrame:
    """``(pos, out_col)``: where each column lands once insert columns are open.

    The frame has alignment-width rows, so its single-partition running sum is bounded.
    """
    spark = ref_gaps.sparkSession
    n = F.coalesce("n", F.lit(0))
    pos = spark.range(width).select(F.col("id").cast("int").alias("pos"))
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return pos.join(ref_gaps, "pos", "left").select("pos", (F.col("pos") + F.sum(n).over(w)).alias("out_col"))


def open_reference(refs: DataFrame, ref_gaps: DataFrame, width: int, alpha: str | R.Alphabet = R.DNA) -> DataFrame:
    """Reference rows with insert columns as gaps: ``(name, seq)``."""
    out = F.zip_with(
        R.chars(R.normalize_seq(F.col("seq"), alpha)),
        F.slice("_b", 1, width),
        lambda c, n: F.concat(F.repeat(F.lit("-"), n), c),
    )
    return refs.withColumn("_b", budget_array(ref_gaps, width)).select(
        "name",
        F.concat(F.array_join(out, ""), F.expr(f"repeat('-', _b[{width}])")).alias("seq"),
    )


def open_queries(gapped_traces: DataFrame, ref_gaps: DataFrame, width: int) -> DataFrame:
    """Query rows over the opened columns: ``(seq_id, name, seq)``.

    Insertions fill their block from the left; before the first column they end at it.  The
    budget, one number a column, goes to the tasks.
    """
    n = np.zeros(width + 1, np.int64)
    for pos, most in ref_gaps.select("pos", "n").collect():  # at most one row a column
        n[pos] = most
    per = max(1, OPENED_BYTES // max(1, width + int(n.sum())))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for lo in range(0, rb.num_rows, per):
                part = rb.slice(lo, per)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _opened(part.column(2), n)], names=["seq_id", "name", "seq"])

    asked = gapped_traces.select("seq_id", "name", F.col("gapped").alias("seq"))
    return asked.mapInArrow(rows, asked.schema)


def _opened(texts: pa.Array, n: np.ndarray) -> pa.Array:
    """Gapped texts written over the opened columns, all of a batch at once; ``n`` is the budget of each position."""
    absent = texts.is_null().to_numpy(zero_copy_only=False)
    raw = [(s or "").encode() for s in texts.to_pylist()]
    size = np.array([len(s) for s in raw], np.int64)
    chars = np.frombuffer(b"".join(raw), np.uint8)
    first = np.cumsum(size) - size
    row, at = np.repeat(np.arange(size.size), size), np.arange(chars.size)
    inserted = (chars >= 97) & (chars <= 122)
    seen = np.concatenate([[0], np.cumsum(~inserted)])
    if np.any((seen[first + size] - seen[first] != n.size - 1) & ~absent):
        raise ValueError(f"a row does not have {n.size - 1} columns")
    col = seen[:-1] - seen[first][row]
    # an insertion's number in its run, and the length of the run before the first column
    before = np.maximum(np.maximum.accumulate(np.where(inserted, -1, at)), first[row] - 1) if at.size else at
    lead = np.bincount(row[inserted & (col == 0)], minlength=size.size)
    block = np.arange(n.size) + np.cumsum(n) - n
    width = int(block[-1] + n[-1])
    inside = at - before - 1 + np.where(col == 0, n[0] - lead[row], 0)
    if np.any(inserted & ((inside < 0) | (at - before > n[col]))):
        raise ValueError("an insertion is longer than its budget")
    out = np.full((size.size, width), ord("-"), np.uint8)
    out[row, block[col] + np.where(inserted, inside, n[col])] = np.where(inserted, chars - 32, chars)
    offsets = pa.py_buffer((np.arange(size.size + 1) * width).astype(np.int32))
    valid = pa.array(~absent).buffers()[1]
    return pa.Array.from_buffers(pa.string(), size.size, [valid, offsets, pa.py_buffer(out)])


def extended_alignment(
    refs: DataFrame, gapped_traces: DataFrame, width: int, ref_gaps: bool = True, alpha: str | R.Alphabet = R.DNA
) -> DataFrame:
    """``aligned(name, seq, kind)``: reference rows, then query rows."""
    if ref_gaps:
        budget = insert_budget(gapped_traces)
        top = open_reference(refs, budget, width, alpha)
        low = open_queries(gapped_traces, budget, width).select("name", "seq")
    else:
        top = refs.select("name", R.normalize_seq(F.col("seq"), alpha).alias("seq"))
        low = gapped_traces.select("name", F.regexp_replace("gapped", "[a-z]", "").alias("seq"))
    return top.withColumn("kind", F.lit("ref")).unionByName(low.withColumn("kind", F.lit("qs")))


def chop_overhang(aligned: DataFrame) -> DataFrame:
    """Blank residues outside ``start..end`` (inclusive); adds ``chopped``.

    Null bounds leave the row alone.
    """
    head = F.substr("seq", F.lit(1), F.col("start"))
    tail = F.substr("seq", F.col("end") + 2)
    kept = F.concat(
        F.regexp_replace(head, ".", "-"),
        F.substr("seq", F.col("start") + 1, F.col("end") - F.col("start") + 1),
        F.regexp_replace(tail, ".", "-"),
    )
    new = F.when(F.col("start").isNull() | F.col("end").isNull(), F.col("seq")).otherwise(kept)
    return aligned.withColumn("chopped", ~new.eqNullSafe(F.col("seq"))).withColumn("seq", new)


def overhang_report(chopped: DataFrame, show: int = 20) -> DataFrame:
    """The first names that lost residues, with the total."""
    hit = chopped.filter("chopped")
    total = hit.agg(F.count("*")).scalar()
    return hit.select("name").orderBy("name").limit(show).withColumn("n_total", total)


def placement_quality(original: DataFrame, traces: DataFrame, alpha: str | R.Alphabet = R.DNA) -> DataFrame:
    """``quality(name, share)`` for queries that arrived aligned.

    ``original(seq_id, name, seq)`` are the gapped rows; the share counts residues that
    came back to their own column.
    """
    singles = F.lit(R.alphabet(alpha).residues())
    home = F.filter(
        F.transform(
            R.chars(R.normalize_seq(F.col("seq"), alpha)),
            lambda c, i: F.when(singles.contains(c), i).otherwise(F.lit(-1)),
        ),
        lambda i: i >= 0,
    )
    both = original.select("seq_id", "name", home.alias("home")).join(
        traces.select("seq_id", position_map(F.col("ops")).alias("got")), "seq_id"
    )
    same = F.size(F.filter(F.zip_with("home", "got", lambda p, q: p == q), lambda v: v))
    return both.select("name", F.when(F.size("home") > 0, same / F.size("home")).alias("share"))


def mean_quality(quality: DataFrame) -> DataFrame:
    return quality.agg(F.avg("share").alias("mean_share"), F.count("share").alias("n"))


def distinct_traces(traces: DataFrame) -> DataFrame:
    """One row per distinct candidate alignment of a query: the lowest edge that gives it."""
    return traces.groupBy("seq_id", "ops").agg(
        F.min("edge_id").alias("edge_id"), F.min_by("score", "edge_id").alias("score")
    )
