"""Scoring queries against edge profiles, and tracing the chosen ones.

Every query must meet every profile, so the question is only which side moves.

* For scoring, queries stay where they are.  Profiles go to the tasks as a broadcast of at
  most ``BROADCAST_BYTES``; more profiles are cut into blocks of that size, each block makes
  one pass over the queries, and every pass gives its own best edges to one small merge.
  Neither side is copied over a grid and query text is not shuffled.
* For tracing, a query needs its own edge alone: within the byte limit the profiles are
  broadcast, beyond it both sides are joined on (edge, salt), where only edges with more
  than ``SALT_QUERIES`` queries have more than one salt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions import kernels as K
from cladeframe.functions import residues as R

BROADCAST_BYTES = 48 << 20
PROFILE_CELL_BYTES = 5  # state and flag of one profile column
EDGES_PER_ROUND = 16  # profiles scored before the best score so far may rule out others
SALT_QUERIES = 20_000  # queries of one edge in one tracing task


@dataclass(frozen=True)
class Scores:
    """Placement scores.  Fixed values: the default scheme."""

    gap_open: int = -3
    gap_extend: int = -1
    match: int = 2
    match_flag: int = -3


@dataclass(frozen=True)
class Penalties:
    """Costs of the penalty scheme.  Fixed values: its defaults."""

    gap_open: int = 3
    gap_extend: int = 1
    mismatch: int = 1
    match_flag: int = 3


@dataclass(frozen=True)
class ProfileSet:
    """Profiles as arrays: ``state`` and ``flag`` are (columns, edges), edges ascending."""

    edge_id: np.ndarray
    state: np.ndarray
    flag: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> "ProfileSet":
        ids = table.column("edge_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = lambda name: np.vstack([np.asarray(x.values) for x in table.column(name)])[order].T
        # a column is skipped for free only when it is flagged as a closed gap
        return ProfileSet(ids[order], np.ascontiguousarray(rows("state")), np.ascontiguousarray(rows("aux") == 1))

    def slice(self, start: int, end: int) -> "ProfileSet":
        return ProfileSet(self.edge_id, self.state[start : end + 1], self.flag[start : end + 1])


def profile_shape(profiles: DataFrame) -> tuple[int, int]:
    """(edges, columns); one row to the driver."""
    r = profiles.agg(F.count("*").alias("n"), F.max(F.size("state")).alias("w")).first()
    return int(r["n"]), int(r["w"] or 0)


def work_cells(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row ``(n_queries, n_residues, n_edges, n_cols, cells)``: the size of a scoring job."""
    shape = profiles.agg(
        F.struct(F.count("*").alias("e"), F.max(F.size("state")).cast("long").alias("w"))
    ).scalar()
    return (
        queries.agg(F.count("*").alias("n_queries"), F.sum(F.length("seq")).alias("n_residues"))
        .withColumn("_s", shape)
        .select(
            "n_queries",
            "n_residues",
            F.col("_s.e").alias("n_edges"),
            F.col("_s.w").alias("n_cols"),
            (F.col("n_residues") * F.col("_s.e") * F.col("_s.w")).alias("cells"),
        )
    )


def clean_queries(queries: DataFrame, alpha: str | R.Alphabet = R.DNA, strict: bool = False) -> DataFrame:
    """``seq`` reduced to its single residues; other columns stay."""
    return queries.withColumn("seq", R.query_residues(F.col("seq"), alpha, strict))


def spread(queries: DataFrame) -> DataFrame:
    """Queries in place where the scan has enough splits, else dealt out over the cores.

    The estimate is the plan's own, from file sizes; nothing is read for it.
    """
    spark = queries.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(queries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return queries if size // split >= 4 * cores else queries.repartition(4 * cores, "seq_id")


def _symbols(seqs, alpha: R.Alphabet) -> list[np.ndarray]:
    table = alpha.byte_index()
    return [table[np.frombuffer((s or "").encode("latin-1", "replace"), dtype=np.uint8)] for s in seqs]


def _bounds_groups(batch: dict, n_cols: int):
    """Rows of a batch grouped by their inclusive column range."""
    starts, ends = batch.get("start"), batch.get("end")
    n = len(batch["seq_id"])
    if starts is None:
        return [(0, n_cols - 1, np.arange(n))]
    lo = np.array([0 if x is None else x for x in starts])
    hi = np.array([n_cols - 1 if x is None else x for x in ends])
    groups = pd.DataFrame({"lo": lo, "hi": hi}).groupby(["lo", "hi"]).indices
    return [(a, b, rows) for (a, b), rows in groups.items()]


def _score_rows(batch: dict, prof: ProfileSet, alpha: R.Alphabet, sp: Scores, top_k: int, ends: bool = False) -> pa.Table:
    """The ``top_k`` best edges of each query in one cell (score desc, edge asc), with ``ends`` and where each is reached.

    For the best edge alone, profiles go in rounds by the most that they can score: a query leaves
    when its best score is above that of all that are left.
    """
    syms = _symbols(batch["seq"], alpha)
    states = alpha.state_table()
    edges_per_pass = max(1, min(prof.edge_id.size, (1 << 17) // max(1, prof.state.shape[0])))
    ruled = top_k == 1 and max(sp.gap_open, sp.gap_extend) <= 0
    if ruled:
        edges_per_pass = min(edges_per_pass, EDGES_PER_ROUND)
    none = np.iinfo(np.int32).min
    score = np.full((len(syms), prof.edge_id.size), none, dtype=np.int64)
    end_row = np.zeros_like(score) if ends else None
    for lo, hi, rows in _bounds_groups(batch, prof.state.shape[0]):
        part = prof.slice(int(lo), int(hi))
        rows = rows[[syms[r].size > 0 for r in rows]]
        most = np.where(part.flag, max(0, sp.match_flag, sp.match + sp.match_flag), max(0, sp.match)).sum(axis=0)
        order = np.argsort(-most, kind="stable")
        for e in range(0, order.size, edges_per_pass):
            pick = np.sort(order[e : e + edges_per_pass])
            if ruled and e:
                # edges that even a full match would leave below the best so far have nothing to add
                rows = rows[score[rows].max(axis=1) <= most[pick].max()]
            if rows.size == 0:
                break
            reached = np.zeros((rows.size, pick.size), dtype=np.int64) if ends else None
            score[rows[:, None], pick] = K.profile_scores(
                part.state[:, pick], part.flag[:, pick], states, [syms[r] for r in rows],
                sp.match, sp.match_flag, sp.gap_open, sp.gap_extend, reached,
            )
            if ends:
                end_row[rows[:, None], pick] = reached
    k = min(top_k, prof.edge_id.size)
    best = score.argmax(axis=1)[:, None] if k == 1 else np.argsort(-score, axis=1, kind="stable")[:, :k]
    picked = np.take_along_axis(score, best, axis=1).ravel()
    found = pa.table(
        {
            "seq_id": pa.array(np.repeat(np.asarray(batch["seq_id"], dtype=np.int64), k)),
            "edge_id": pa.array(prof.edge_id[best].ravel().astype(np.int32)),
            "score": pa.array(picked.astype(np.int32), mask=picked == np.iinfo(np.int32).min),
        }
    )
    if not ends:
        return found
    return found.append_column("end_row", pa.array(np.take_along_axis(end_row, best, axis=1).ravel().astype(np.int32)))


def _gapped(ops: str, seq: str) -> str:
    """``traces.gapped`` of one query: residues in place of ``0``, in lower case of ``2``, and ``-`` of ``1``."""
    steps = np.frombuffer(ops.encode(), np.uint8)
    out = np.full(steps.size, ord("-"), np.uint8)
    residues = steps != ord("1")
    out[residues] = np.frombuffer((seq or "").encode(), np.uint8) + 32 * (steps[residues] == ord("2")).astype(np.uint8)
    return out.tobytes().decode()


def _trace_rows(batch: dict, prof: ProfileSet, alpha: R.Alphabet, sp: Scores) -> pa.Table:
    """Score and operations of each query on the edge it names; skips outside its range.

    Queries that have a name get their gapped text too, and their scores must be those they came with.
    """
    syms = _symbols(batch["seq"], alpha)
    states = alpha.state_table()
    wanted = np.asarray(batch["edge_id"])
    col = np.minimum(np.searchsorted(prof.edge_id, wanted), prof.edge_id.size - 1)
    missing = prof.edge_id[col] != wanted
    if missing.any():
        raise ValueError(f"no profile for edge {wanted[missing][0]}")
    score = np.empty(len(syms), dtype=np.int64)
    ops: list[str] = [""] * len(syms)
    n_cols = prof.state.shape[0]
    for lo, hi, rows in _bounds_groups(batch, n_cols):
        part = prof.slice(int(lo), int(hi))
        got, text = K.trace_pairs(
            part.state[:, col[rows]], part.flag[:, col[rows]], [states[syms[r]] for r in rows],
            sp.match, sp.match_flag, sp.gap_open, sp.gap_extend,
            None if "end_row" not in batch else np.asarray(batch["end_row"])[rows],
        )
        score[rows] = got
        for r, t in zip(rows, text):
            ops[r] = "1" * int(lo) + t.decode() + "1" * int(n_cols - 1 - hi)
    found = pa.table(
        {
            "seq_id": pa.array(np.asarray(batch["seq_id"], dtype=np.int64)),
            "edge_id": pa.array(np.asarray(batch["edge_id"], dtype=np.int32)),
            "score": pa.array(score.astype(np.int32), mask=score == np.iinfo(np.int32).min),
            "ops": pa.array(ops, pa.string()),
        }
    )
    if "name" not in batch:
        return found
    for seq_id, want, got in zip(batch["seq_id"], batch["score"], found.column("score").to_pylist(), strict=True):
        if want != got:
            raise ValueError(f"trace score differs for sequence {seq_id}")
    gapped = pa.array([_gapped(o, s) for o, s in zip(ops, batch["seq"], strict=True)], pa.string())
    return found.append_column("name", pa.array(batch["name"], pa.string())).append_column("gapped", gapped)


def residue_slices(table: pa.Table, residues: int = 1 << 21) -> Iterator[dict]:
    """Slices of a table by residue count, so a batch of long texts stays small."""
    lens = np.array([len(s or "") for s in table.column("seq").to_pylist()], dtype=np.int64)
    cut = np.cumsum(lens) // residues
    starts = np.flatnonzero(np.diff(cut, prepend=-1))
    for a, b in zip(starts, list(starts[1:]) + [table.num_rows]):
        yield table.slice(int(a), int(b - a)).to_pydict()


def in_blocks(
    queries: DataFrame, profiles: DataFrame, key: str, size: int, broadcast_bytes: int, load: Callable, body: Callable, schema: str
) -> DataFrame:
    """Union of ``body(rows, block)`` over queries in place and blocks of profiles under the byte limit.

    Only one block at a time passes through the driver.
    """
    n_blocks = max(1, -(-size // max(1, broadcast_bytes)))
    sc = queries.sparkSession.sparkContext

    def one(held) -> Callable:
        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for rows in residue_slices(pa.Table.from_batches([rb])):
                    yield from body(rows, held.value).to_batches()

        return stream

    parts = []
    for k in range(n_blocks):
        table = profiles.filter(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == k).toArrow()
        if table.num_rows:
            parts.append(queries.mapInArrow(one(sc.broadcast(load(table))), schema))
    return reduce(DataFrame.union, parts)


def by_own_profile(placed: DataFrame, profiles: DataFrame, key: str, cell: Callable, schema: str) -> DataFrame:
    """``cell(queries, profile)`` for the queries of each profile, popular ones split by a salt."""
    salts = placed.groupBy(key).agg(F.ceil(F.count("*") / F.lit(SALT_QUERIES)).cast("int").alias("_n"))
    left = placed.join(salts, key).withColumn("_salt", F.pmod(F.xxhash64("seq_id"), F.col("_n")).cast("int")).drop("_n")
    right = profiles.join(salts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left.groupBy(key, "_salt").cogroup(right.groupBy(key, "_salt")).applyInArrow(cell, schema)


def body_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def top_edges(
    queries: DataFrame,
    profiles: DataFrame,
    k: int = 1,
    scores: Scores = Scores(),
    alpha: str | R.Alphabet = R.DNA,
    spread_queries: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
    ends: bool = False,
) -> DataFrame:
    """``(seq_id, edge_id, score, rank)``: the k best edges of each query.

    ``queries(seq_id, seq[, start, end])`` hold cleaned residues; ``start``/``end`` limit
    the alignment to an inclusive column range (null: whole width).  Order is score
    descending, then edge ascending.  A query without residues has a null score.  With ``ends``
    there is ``end_row`` too, the first residue with which the score is reached.
    ``profiles`` should be materialised: it is measured before it is used.
    """
    a = R.alphabet(alpha)
    cols = ["seq_id", "seq"] + [c for c in ("start", "end") if c in queries.columns]
    n_edges, n_cols = profile_shape(profiles)
    if n_edges == 0:
        raise ValueError("no profiles")
    size = n_edges * n_cols * PROFILE_CELL_BYTES
    if queries.isStreaming and (k > 1 or size > broadcast_bytes):
        raise ValueError("a stream is placed on its best edge, over profiles of one block")
    asked = queries.select(*cols)
    part = in_blocks(
        spread(asked) if spread_queries and not queries.isStreaming else asked,
        profiles.select("edge_id", "state", "aux"), "edge_id", size, broadcast_bytes, ProfileSet.of,
        lambda rows, prof: _score_rows(rows, prof, a, scores, k, ends), "seq_id long, edge_id int, score int" + ", end_row int" * ends,
    )
    if k == 1 and queries.isStreaming:
        return part.withColumn("rank", F.lit(1))
    if k == 1:
        top = F.max(F.struct(F.coalesce("score", F.lit(-(1 << 31))).alias("s"), (-F.col("edge_id")).alias("e"), "score", *["end_row"] * ends))
        return part.groupBy("seq_id").agg(top.alias("t")).select(
            "seq_id", (-F.col("t.e")).alias("edge_id"), F.col("t.score").alias("score"), *["t.end_row"] * ends, F.lit(1).alias("rank")
        )
    w = Window.partitionBy("seq_id").orderBy(F.col("score").desc_nulls_last(), "edge_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_edge(queries: DataFrame, profiles: DataFrame, **kw) -> DataFrame:
    """``(seq_id, edge_id, score)``: highest score, ties to the smallest edge id."""
    return top_edges(queries, profiles, 1, **kw).drop("rank")


def cheapest_edge(
    queries: DataFrame, profiles: DataFrame, penalties: Penalties = Penalties(), spread_queries: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(seq_id, edge_id, penalty)``: the edge of least penalty for each query, ties to the smallest edge id.

    ``queries(seq_id, seq)`` hold pure A, C, G and T.  The penalty is that of the query within
    the band of its free shifts along the profile, which has to be longer; a query that is not
    shorter, or has no residues, has a null edge and penalty.
    """
    n_edges, n_cols = profile_shape(profiles)
    if n_edges == 0:
        raise ValueError("no profiles")
    states = R.DNA.state_table()
    cells = max(1, (1 << 17) // max(1, n_cols))

    def body(batch: dict, prof: ProfileSet) -> pa.Table:
        syms = _symbols(batch["seq"], R.DNA)
        fits = np.array([0 < q.size < n_cols for q in syms], bool)
        edge, least = np.zeros(len(syms), np.int32), np.full(len(syms), np.iinfo(np.int32).max, np.int64)
        for e in range(0, prof.edge_id.size, cells) if fits.any() else ():
            part = slice(e, e + cells)
            got = K.penalty_scores(
                prof.state[:, part], prof.flag[:, part], states, [q for q, f in zip(syms, fits, strict=True) if f],
                penalties.gap_open, penalties.gap_extend, penalties.mismatch, penalties.match_flag,
            )
            at = got.argmin(axis=1)
            value = got[np.arange(len(got)), at]
            better = value < least[fits]
            where = np.flatnonzero(fits)[better]
            least[where], edge[where] = value[better], prof.edge_id[part][at[better]]
        return pa.table({"seq_id": pa.array(np.asarray(batch["seq_id"], dtype=np.int64)), "edge_id": pa.array(edge, mask=~fits),
                         "penalty": pa.array(least.astype(np.int32), mask=~fits)})

    asked = queries.select("seq_id", "seq")
    size = n_edges * n_cols * PROFILE_CELL_BYTES
    parts = in_blocks(spread(asked) if spread_queries else asked, profiles.select("edge_id", "state", "aux"), "edge_id", size, broadcast_bytes,
                      ProfileSet.of, body, "seq_id long, edge_id int, penalty int")
    least = F.min(F.when(F.col("penalty").isNotNull(), F.struct("penalty", "edge_id"))).alias("m")
    return parts.groupBy("seq_id").agg(least).select("seq_id", F.col("m.edge_id").alias("edge_id"), F.col("m.penalty").alias("penalty"))


def trace(
    placed: DataFrame,
    profiles: DataFrame,
    scores: Scores = Scores(),
    alpha: str | R.Alphabet = R.DNA,
    spread_queries: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
    checked: bool = False,
) -> DataFrame:
    """``(seq_id, edge_id, score, ops)`` for ``placed(seq_id, seq, edge_id[, start, end])``.

    ``ops`` is the forward operation string: 0 residue on a column, 1 column skipped,
    2 residue inserted.  With ``checked`` the rows of ``placed`` also have ``name`` and ``score``:
    another score of the trace is an error, and the result has ``name`` and ``gapped`` too, so
    neither the check nor the aligned text needs a join.  Where ``placed`` has ``end_row`` as well,
    only the residues that an alignment ending there can reach are swept, once.
    """
    a = R.alphabet(alpha)
    cols = ["seq_id", "seq", "edge_id"] + ["name", "score"] * checked + [c for c in ("start", "end", "end_row") if c in placed.columns]
    n_edges, n_cols = profile_shape(profiles)
    if n_edges == 0:
        raise ValueError("no profiles")
    schema = "seq_id long, edge_id int, score int, ops string" + ", name string, gapped string" * checked
    asked, slim = placed.select(*cols), profiles.select("edge_id", "state", "aux")
    body = lambda rows, prof: _trace_rows(rows, prof, a, scores)
    size = n_edges * n_cols * PROFILE_CELL_BYTES
    if size <= broadcast_bytes:
        asked = spread(asked) if spread_queries and not placed.isStreaming else asked
        return in_blocks(asked, slim, "edge_id", size, broadcast_bytes, ProfileSet.of, body, schema)

    def cell(q: pa.Table, p: pa.Table) -> pa.Table:
        if q.num_rows and not p.num_rows:
            raise ValueError(f"no profile for edge {q.column('edge_id')[0]}")
        found = [pa.table({f.name: pa.array([], f.type) for f in body_schema(schema)})]
        return pa.concat_tables(found + [body(rows, ProfileSet.of(p)) for rows in residue_slices(q)])

    return by_own_profile(asked, slim, "edge_id", cell, schema)


def checked_traces(traces: DataFrame, placed: DataFrame) -> DataFrame:
    """Traces whose score differs from the score that chose the edge raise an error."""
    want = placed.select("seq_id", F.col("score").alias("_want"))
    same = F.col("score").eqNullSafe(F.col("_want"))
    wrong = F.raise_error(F.concat(F.lit("trace score differs for sequence "), F.col("seq_id").cast("string")))
    return (
        traces.join(want, "seq_id")
        .withColumn("score", F.when(same, F.col("score")).otherwise(wrong.cast("int")))
        .drop("_want")
    )


def rescored(traces: DataFrame, queries: DataFrame, profiles: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """``traces`` with ``score`` worked out again from their operations alone.

    ``traces(seq_id, edge_id, ops[, start, end])`` may have several edges of a query;
    ``queries(seq_id, seq)`` hold cleaned DNA residues and ``profiles`` their edges.  The first
    and the last run of skips or insertions within the column range are free shifts.  A trace
    without residues has a null score.  Rows meet their own query and profile, nothing else.
    """
    bounded = "start" in traces.columns
    lo = F.coalesce("start", F.lit(0)) if bounded else F.lit(0)
    hi = F.coalesce("end", F.size("_state") - 1) if bounded else F.size("_state") - 1
    inside = F.substr("ops", lo + 1, F.length("ops") - lo - (F.size("_state") - 1 - hi))
    body = F.when(F.col("_in").startswith("1"), F.ltrim("_in", F.lit("1"))).otherwise(F.ltrim("_in", F.lit("2")))
    walked = F.when(F.col("_body").endswith("1"), F.rtrim("_body", F.lit("1"))).otherwise(F.rtrim("_body", F.lit("2")))
    shift = F.length("_in") - F.length("_body")
    skipped = F.col("_in").startswith("1")
    codes = F.transform(R.chars(F.col("_seq")), lambda c: F.instr(F.lit(R.DNA.residues()), c))

    def step(a, op):
        flagged = F.get("_aux", a["col"]) == 1
        met = F.get("_state", a["col"]).bitwiseAND(F.get("_codes", a["res"])) != 0
        gap = F.when(a["before"] == op, scores.gap_extend).otherwise(scores.gap_open)
        match = F.when(met, scores.match).otherwise(0) + F.when(flagged, scores.match_flag).otherwise(0)
        gain = F.when(op == "0", match).when((op == "1") & flagged, 0).otherwise(gap)
        return F.struct(
            (a["col"] + (op != "2").cast("int")).alias("col"), (a["res"] + (op != "1").cast("int")).alias("res"),
            op.alias("before"), (a["score"] + gain).alias("score"),
        )

    first = F.struct(
        (lo + F.when(skipped, shift).otherwise(0)).alias("col"), F.when(skipped, 0).otherwise(shift).alias("res"),
        F.lit("").alias("before"), F.lit(0).alias("score"),
    )
    total = F.aggregate(F.filter(F.split("_walked", ""), lambda c: c != ""), first, step)["score"]
    own = traces.join(queries.select("seq_id", F.col("seq").alias("_seq")), "seq_id").join(
        profiles.select("edge_id", F.col("state").alias("_state"), F.col("aux").alias("_aux")), "edge_id"
    )
    ready = own.withColumn("_in", inside).withColumn("_body", body).withColumn("_walked", walked).withColumn("_codes", codes)
    return ready.withColumn("score", F.when(F.length("_seq") > 0, total)).select(*dict.fromkeys([*traces.columns, "score"]))
