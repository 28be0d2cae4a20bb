"""All-pairs and set-against-set scores of sequences and series.

The result of these operators is one number per pair, so the pairs are inherent; the
inputs are what gets blocked.  Each row is hashed to a block and copied to the grid
cells of that block (half of the grid when a set meets itself); a cell is one task with a
bounded number of rows on either side.  Hash blocks of unique ids cannot be hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions import kernels as K
from cladeframe.functions import residues as R
from cladeframe.operators.place import residue_slices, spread
from cladeframe.session import cut_lineage

BLOCK_WEIGHT = 1 << 16  # residues or samples per block
PAIRS_PER_BATCH = 1 << 19  # result rows of a cell made at once
MOST_TASKS = 1 << 13  # of the cells of one set
SERIES_WEIGHT = 1 << 15  # samples and ids per block of series
ID_WEIGHT = 16  # of an id beside its samples: what its result rows cost
CLASS_IDS = 256  # ids of equal series in one row
PRIMER_BYTES = 1 << 20
PROFILES_PER_PASS = 32

# Gap costs and weights of the distance and primer jobs.
GAP_OPEN, GAP_EXTEND = -5, -2
PRIMER_MATCH, PRIMER_MISMATCH = 5, -3
PRIMER_SHARE = 0.9
BASE_WEIGHT = 1000
PAIR_MATCH, PAIR_MISMATCH = 3, 0


def _n_blocks(rows: DataFrame, weight: Column, block: int) -> int:
    # a row costs one besides its residues, so that empty ones fill blocks too
    r = rows.agg(F.sum(weight + 1).alias("w"), F.count("*").alias("n")).first()
    return int(max(1, min(r["n"], max(-(-int(r["w"] or 0) // block), 8))))


def _most_blocks(rows: DataFrame, within: str, weight: Column, block: int) -> int:
    """Blocks of the heaviest group; lighter ones have blocks of fewer rows, some of none."""
    heaviest = rows.groupBy(within).agg(F.sum(weight + 1).alias("w")).agg(F.max("w")).first()[0]
    return int(max(1, -(-int(heaviest or 0) // block)))


def _cells(
    left: DataFrame,
    right: DataFrame | None,
    weight: Column,
    body: Callable[[pa.Table, pa.Table], np.ndarray],
    key_type: str,
    value_type: str,
    block: int,
    within: str | None = None,
) -> DataFrame:
    """``(i, j, value)`` for all pairs: ``i <= j`` of one set, or every i of ``left`` and j of ``right``.

    With ``within``, a column of one set, only pairs of rows that agree in it; it is returned too.
    Rows with ``m`` stand for those ids, and ``i`` is that of their class, which may have more rows,
    told apart by ``q``: the pairs are those of all ids.  A cell gives its pairs in batches.
    """
    half, classed = right is None, "m" in left.columns
    keys = ["bi", "bj"] if within is None else [within, "bi", "bj"]
    nl = _n_blocks(left, weight, block) if within is None else _most_blocks(left, within, weight, block)
    nr = nl if half else _n_blocks(right, weight, block)
    at = lambda n: F.pmod(F.xxhash64("i", *["q"] * classed), F.lit(n)).cast("int")
    one = left.withColumn("bi", at(nl)).withColumn(
        "bj", F.explode(F.sequence(F.col("bi") if half else F.lit(0), F.lit(nr - 1)))
    )
    # a set's block meets itself in a cell that has it once
    two = (left if half else right).select(*left.columns).withColumn("bj", at(nr)).withColumn(
        "bi", F.explode(F.sequence(F.lit(0), F.col("bj") if half else F.lit(nl - 1)))
    )
    two = two.filter("bi < bj") if half else two
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        a, b = (rows.filter(pc.equal(rows.column("side"), k)).combine_chunks() for k in (0, 1))
        itself = half and rows.column("bi")[0] == rows.column("bj")[0]
        b = a if itself else b
        if a.num_rows == 0 or b.num_rows == 0:
            return
        values = body(a, b)
        (ids, of), (others, to) = _ids(a), _ids(b)
        per = max(1, PAIRS_PER_BATCH // max(1, to.size))
        for lo in range(0, of.size, per):
            x = np.arange(lo, min(lo + per, of.size))
            value = pa.array(values[of[x]].take(to, axis=1).ravel(), kinds[value_type])
            x, y = np.repeat(x, to.size), np.tile(np.arange(to.size), x.size)
            i, j = ids.take(pa.array(x)), others.take(pa.array(y))
            if half:
                forward = pc.less_equal(i, j)
                if itself:
                    ci, cj = a.column("i").take(pa.array(of[x])), b.column("i").take(pa.array(to[y]))
                    kept = pc.or_(pc.less(ci, cj), pc.and_(pc.equal(ci, cj), forward)) if classed else forward
                    i, j, value, forward = (c.filter(kept) for c in (i, j, value, forward))
                i, j = pc.if_else(forward, i, j), pc.if_else(forward, j, i)
            out = pa.table({"i": i, "j": j, "value": value})
            if within is not None:
                out = out.add_column(0, within, a.column(within).take(pa.array(np.zeros(out.num_rows, np.int64))))
            yield from out.combine_chunks().to_batches()

    group = "" if within is None else f"{within} {left.schema[within].dataType.simpleString()}, "
    sides = one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))
    if within is None:  # a number that is given keeps cells of few bytes from meeting in few tasks
        cells = nl * (nl + 1) // 2 if half else nl * nr
        sides = sides.repartition(min(max(cells, 1), MOST_TASKS), *keys)
    return sides.groupBy(*keys).applyInArrow(cell, f"{group}i {key_type}, j {key_type}, value {value_type}")


def _ids(rows: pa.Table) -> tuple[pa.ChunkedArray | pa.Array, np.ndarray]:
    """The ids that the rows of a cell stand for, and the row of each."""
    if "m" not in rows.column_names:
        return rows.column("i"), np.arange(rows.num_rows)
    members = rows.column("m").combine_chunks()
    return members.flatten(), np.repeat(np.arange(rows.num_rows), members.value_lengths().to_numpy(zero_copy_only=False))


def matrix_array(matrix: DataFrame) -> tuple[str, np.ndarray]:
    """A scoring matrix ``(a, b, score)`` as symbols and a dense array (symbols squared).

    Symbols are bytes, so a matrix has at most 65,536 rows; more are an error.
    """
    rows = matrix.limit(65_537).toPandas()
    if len(rows) > 65_536:
        raise ValueError("a scoring matrix has at most 65,536 rows")
    symbols = "".join(sorted(set(rows["a"])))
    at = {c: k for k, c in enumerate(symbols)}
    out = np.zeros((len(symbols), len(symbols)), dtype=np.int64)
    for a, b, s in zip(rows["a"], rows["b"], rows["score"]):
        out[at[a], at[b]] = s
    return symbols, out


def _encode(seqs, symbols: str, drop: bool) -> list[np.ndarray]:
    """Symbol positions; other residues are dropped, or become one extra symbol."""
    table = np.full(256, len(symbols), dtype=np.int64)
    for k, c in enumerate(symbols):
        table[ord(c)] = table[ord(c.lower())] = k
    out = []
    for s in seqs:
        x = table[np.frombuffer((s or "").encode("latin-1", "replace"), dtype=np.uint8)]
        out.append(x[x < len(symbols)] if drop else x)
    return out


def local_scores(
    left: DataFrame,
    matrix: DataFrame,
    right: DataFrame | None = None,
    gap_open: int = GAP_OPEN,
    gap_extend: int = GAP_EXTEND,
    block: int = BLOCK_WEIGHT,
    within: str | None = None,
) -> DataFrame:
    """Local alignment score of all pairs: ``(i, j, score)`` from ``(i, seq)``.

    One set: pairs with ``i <= j``, the diagonal included; with ``within`` only pairs of rows
    that agree in that column, which comes first in the result.  Residues outside the
    matrix are dropped first.  A sequence without residues scores 0.
    """
    symbols, dense = matrix_array(matrix)

    def body(a: pa.Table, b: pa.Table) -> np.ndarray:
        queries = _encode(a.column("seq").to_pylist(), symbols, True)
        profiles = _encode(b.column("seq").to_pylist(), symbols, True)
        order = np.argsort([p.size for p in profiles], kind="stable")
        out = np.zeros((len(queries), len(profiles)), dtype=np.int64)
        for lo in range(0, order.size, PROFILES_PER_PASS):
            pick = order[lo : lo + PROFILES_PER_PASS]
            out[:, pick] = K.matrix_scores([profiles[k] for k in pick], queries, dense, gap_open, gap_extend, True)
        return np.maximum(out, 0).astype(np.int32)

    key = dict(left.dtypes)["i"].replace("bigint", "long")
    columns = ["i", "seq"] if within is None else [within, "i", "seq"]
    cells = _cells(left.select(*columns), None if right is None else right.select("i", "seq"),
                   F.length("seq"), body, key, "int", block, within)
    return cells.withColumnRenamed("value", "score")


def mirror(scores: DataFrame) -> DataFrame:
    """Half matrix -> square matrix."""
    return scores.unionByName(
        scores.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in scores.columns if c not in "ij"])
    )


def normalize_distance(scores: DataFrame, mode: str = "mean") -> DataFrame:
    """Add ``dist``: against the mean self score, or min-max over all scores."""
    if mode == "minmax":
        span = scores.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
        return (
            scores.withColumn("_s", span)
            .withColumn("dist", 1 - (F.col("score") - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo")))
            .drop("_s")
        )
    own = scores.filter("i = j")
    a = own.select("i", F.col("score").alias("_a"))
    b = own.select("j", F.col("score").alias("_b"))
    return (
        scores.join(a, "i")
        .join(b, "j")
        .withColumn("dist", 1 - F.col("score") / ((F.col("_a") + F.col("_b")) / 2))
        .select(*scores.columns, "dist")
    )


def closest_pair(distances: DataFrame) -> DataFrame:
    """One row ``(i, j, dist)``: the smallest distance between different sequences."""
    best = F.min(F.struct("dist", "i", "j")).alias("m")
    return distances.filter("i <> j").agg(best).select("m.i", "m.j", "m.dist")


def length_order(seqs: DataFrame) -> DataFrame:
    """``(i, length, rank)`` by (length, i), ranked without one global sort task.

    Rows are dealt out by ranges of (length, i), so one length may fill many partitions;
    a window ranks each range, and the ranges' counts give the offsets.
    """
    rows = seqs.select("i", F.length("seq").alias("length"))
    dealt = cut_lineage(rows.repartitionByRange("length", "i").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("length", "i"))
    return dealt.join(F.broadcast(offsets), "_part").select("i", "length", (F.col("_off") + inside - 1).alias("rank"))


def primer_scores(
    seqs: DataFrame,
    primers: DataFrame,
    match: int = PRIMER_MATCH,
    mismatch: int = PRIMER_MISMATCH,
    gap_open: int = GAP_OPEN,
    gap_extend: int = GAP_EXTEND,
    symbols: str = "ACGT",
) -> DataFrame:
    """Free-shift score of every sequence against every primer: ``(seq_id, primer_id, score, share)``.

    ``share`` is the score over a full match.  The primer list is measured; within
    ``PRIMER_BYTES`` it is broadcast and the sequences stay where they are.  A longer
    list is grouped into pieces of that size and the sequences pass over each.
    """
    size = primers.agg(F.sum(F.length("seq"))).first()[0] or 0
    n_parts = max(1, -(-int(size) // PRIMER_BYTES))
    dense = np.full((len(symbols) + 1, len(symbols) + 1), mismatch, dtype=np.int64)
    dense[np.arange(len(symbols)), np.arange(len(symbols))] = match
    sc = seqs.sparkSession.sparkContext
    seqs = spread(seqs.select("seq_id", "seq"))
    out = None
    for part in range(n_parts):
        piece = primers.filter(F.pmod(F.xxhash64("primer_id"), F.lit(n_parts)) == part).toPandas()
        piece = piece.assign(k=piece["seq"].str.len()).sort_values(["k", "primer_id"])
        held = sc.broadcast(
            (piece["primer_id"].to_numpy(np.int32), _encode(piece["seq"].tolist(), symbols, False))
        )

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, encoded = held.value
            for held_rows in (rows for rb in batches for rows in residue_slices(pa.Table.from_batches([rb]))):
                queries = _encode(held_rows["seq"], symbols, False)
                got = np.empty((len(queries), len(ids)), dtype=np.int64)
                for lo in range(0, len(ids), PROFILES_PER_PASS):
                    got[:, lo : lo + PROFILES_PER_PASS] = K.matrix_scores(
                        encoded[lo : lo + PROFILES_PER_PASS], queries, dense, gap_open, gap_extend, False, True
                    )
                flat = got.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.asarray(held_rows["seq_id"], np.int64), len(ids))),
                        pa.array(np.tile(ids, len(queries))),
                        pa.array(flat.astype(np.int32), mask=flat == np.iinfo(np.int32).min),
                    ],
                    names=["seq_id", "primer_id", "score"],
                )

        scored = seqs.select("seq_id", "seq").mapInArrow(rows, "seq_id long, primer_id int, score int")
        out = scored if out is None else out.unionByName(scored)
    full = primers.select("primer_id", (F.length("seq") * match).alias("_full"))
    return out.join(full, "primer_id").select(
        "seq_id", "primer_id", "score", (F.col("score") / F.col("_full")).alias("share")
    )


def primer_matches(seqs: DataFrame, primers: DataFrame, share: float = PRIMER_SHARE, **kw) -> DataFrame:
    """Sequences that reach ``share`` of a full match with all primers."""
    ok = (
        primer_scores(seqs, primers, **kw)
        .groupBy("seq_id")
        .agg(F.bool_and(F.coalesce(F.col("share") >= share, F.lit(False))).alias("ok"))
        .filter("ok")
    )
    return seqs.join(ok.select("seq_id"), "seq_id", "left_semi")


def sample_matching(seqs: DataFrame, primers: DataFrame, n: int = 10, seed: int = 0, **kw) -> DataFrame:
    """A random ``n`` of the matching sequences; none at all is an error."""
    picked = uniform_sample(primer_matches(seqs, primers, **kw), n, seed)
    if picked.isEmpty():
        raise ValueError("no sequence matches all primers")
    return picked


def primer_weights(seqs: DataFrame, primers: DataFrame, **kw) -> DataFrame:
    """``(seq_id, weight)``: base weight plus scaled primer shares."""
    term = F.floor(F.col("share") * BASE_WEIGHT * 10)
    return primer_scores(seqs, primers, **kw).groupBy("seq_id").agg(
        (F.lit(BASE_WEIGHT) + F.sum(F.coalesce(term, F.lit(0)))).alias("weight")
    )


def bernoulli_sample(seqs: DataFrame, rate: float = 0.1, seed: int | None = None) -> DataFrame:
    return seqs.sample(False, rate, seed)


def uniform_sample(seqs: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` random rows: a top-n of random keys, so each task sends at most n rows."""
    return seqs.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def weighted_sample(seqs: DataFrame, n: int = 10, seed: int | None = None) -> DataFrame:
    """``n`` rows without replacement, in proportion to ``weight`` (> 0), in one pass.

    Exponential keys divided by the weights: the n smallest have the distribution of
    successive weighted draws.
    """
    key = -F.ln(1 - F.rand(seed)) / F.col("weight")
    return seqs.filter("weight > 0").withColumn("_k", key).orderBy("_k").limit(n).drop("_k")


def aligned_pair_score(a: Column, b: Column) -> Column:
    """Score of two aligned rows: match 3, mismatch 0, gap runs -5 then -2 per column.

    Columns that are gaps in both rows are removed first, so they do not end a run.
    """
    kinds = F.filter(
        F.zip_with(
            R.chars(a), R.chars(b),
            lambda x, y: F.when((x == "-") & (y == "-"), F.lit("b"))
            .when(x == "-", F.lit("x")).when(y == "-", F.lit("y"))
            .when(x == y, F.lit("m")).otherwise(F.lit("n")),
        ),
        lambda k: k != "b",
    )
    text = F.array_join(kinds, "")
    opened = F.regexp_count(text, F.lit("x+|y+"))
    gaps = F.regexp_count(text, F.lit("[xy]"))
    matches = F.regexp_count(text, F.lit("m"))
    return matches * PAIR_MATCH + opened * GAP_OPEN + (gaps - opened) * GAP_EXTEND


def aligned_scores(msa: DataFrame, block: int = BLOCK_WEIGHT, within: str | None = None, key: str = "name") -> DataFrame:
    """``(i, j, score)`` of all pairs of rows of one alignment (``i <= j``, names or ``key`` as ids).

    With ``within``, a column that numbers alignments, of all pairs of rows of each alignment.
    """

    def body(a: pa.Table, b: pa.Table) -> np.ndarray:
        xs, ys = (
            np.vstack([np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in t.column("seq").to_pylist()])
            for t in (a, b)
        )
        return np.vstack([row_scores(x, ys) for x in xs]).astype(np.int32)

    rows = msa.select(*([] if within is None else [within]), F.col(key).alias("i"), "seq")
    kind = dict(rows.dtypes)["i"].replace("bigint", "long")
    cells = _cells(rows, None, F.length("seq"), body, kind, "int", block, within)
    return cells.withColumnRenamed("value", "score")


def row_scores(x: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Scores of one row against many, over the columns that are not gaps in both."""
    gx, gy = np.broadcast_to(x == 45, ys.shape), ys == 45
    seen = ~(gx & gy)
    kind = np.where(gx, 1, np.where(gy, 2, 0))
    kind = np.where(seen, kind, -1)
    # the kind of the previous seen column, carried over the columns left out
    last = np.maximum.accumulate(np.where(seen, np.arange(x.size), -1), axis=1)
    prev = np.concatenate([np.full((ys.shape[0], 1), -1), last[:, :-1]], axis=1)
    before = np.where(prev >= 0, np.take_along_axis(kind, np.maximum(prev, 0), axis=1), 0)
    gap = kind > 0
    fresh = gap & (before != kind)
    same = (kind == 0) & (x == ys)
    return same.sum(1) * PAIR_MATCH + fresh.sum(1) * GAP_OPEN + (gap & ~fresh).sum(1) * GAP_EXTEND


def dtw_distances(series: DataFrame, right: DataFrame | None = None, block: int = SERIES_WEIGHT) -> DataFrame:
    """Dynamic-time-warping distance of all pairs: ``(i, j, dist)`` from ``(key, v)``.

    Equal series are one class while distances are worked out; a cell writes the pairs of all ids
    of its classes, so no pair of ids is shuffled and every pair of keys has its row.
    """

    def body(a: pa.Table, b: pa.Table) -> np.ndarray:
        xs, ys = (_arrays(t.column("v").combine_chunks()) for t in (a, b))
        return K.dtw_distances(xs, ys)

    rows = lambda d: d.filter(F.size("v") > 0).select(F.col("key").alias("i"), "v")
    sides = [cut_lineage(rows(d)) for d in (series, right) if d is not None]
    classes = [_classes(d) for d in sides]
    weight = F.size("v") + F.lit(ID_WEIGHT)
    if any(c is not None for c in classes):
        alone = lambda d: d.select("i", "v", F.lit(0).cast("long").alias("q"), F.array("i").alias("m"))
        sides = [alone(d) if c is None else c for d, c in zip(sides, classes, strict=True)]
        weight = F.size("v") + F.size("m") * ID_WEIGHT
    cells = _cells(sides[0], sides[1] if len(sides) > 1 else None, weight, body, "long", "double", block)
    return cells.withColumnRenamed("value", "dist")


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.split(values, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _classes(rows: DataFrame) -> DataFrame | None:
    """Rows ``(i, v, q, m)`` for the distinct ``v``: the least id, and the ids, some ``CLASS_IDS`` of them in each row.

    Nothing where there are no copies.
    """
    first = cut_lineage(rows.groupBy("v").agg(F.min("i").alias("c"), F.count("*").alias("n")))
    if first.count() == rows.count():
        return None
    dealt = rows.join(first, "v").withColumn("q", F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / CLASS_IDS)))
    return cut_lineage(dealt.groupBy("c", "v", "q").agg(F.collect_list("i").alias("m")).select(F.col("c").alias("i"), "v", "q", "m"))


def dtw_paths(pairs: DataFrame) -> DataFrame:
    """Distance and warping path of given pairs ``(i, j, x, y)``: ``path`` of (step in x, step in y)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [K.dtw_path(np.asarray(x), np.asarray(y)) for x, y in zip(pdf["x"], pdf["y"])]
            yield pd.DataFrame(
                {
                    "i": pdf["i"], "j": pdf["j"],
                    "dist": [d for d, _ in got],
                    "path": [[{"a": a, "b": b} for a, b in p] for _, p in got],
                }
            )

    return pairs.select("i", "j", "x", "y").mapInPandas(
        rows, "i long, j long, dist double, path array<struct<a:int,b:int>>"
    )
