"""Ranked lexical search with geometric blocks in every posting list.

The texts become vectors over the terms that a group of items asks for, which are written.  A
task makes the index of a chunk of vectors in its memory: each term's posting list is cut into
blocks of like documents, which gather round representatives by the cosine of short random
projections, and each block keeps a summary, the greatest weight of its documents in every
coordinate.  An item's product with a summary is therefore never below the score of a document
in the block.  A search takes the blocks of the item's lists in order of that bound, scores
their documents, and leaves out only the blocks whose bound is below the item's tenth score so
far; the lists that together cannot reach that score are not opened.  So the result is that of
a full scan.

Texts never move: they are counted where they are read, and only each task's ten best of an
item meet.  A lost task makes its chunks again from the written vectors.  The items are asked in
groups of at most ``TERMS`` distinct terms, with vectors for each group; the counts behind the
weights cover all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from cladeframe.llm.common import Scratch

TOP = 10
TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct terms and items of a group; an item that alone has more terms is a group of its own.
TERMS, ITEMS = 4096, 4096
#: Cells of a chunk's matrix, documents times terms, and documents of a block.
CELLS, BLOCK = 4 << 20, 64
#: A list of no more documents is one block without a summary, which is opened when its turn comes.
SHORT = 16
#: Texts counted at a time.
ROWS = 500
#: Directions of the random projections, and the step of a summary's rounded-up weights.
DIRECTIONS, STEP = 16, 4096
#: Blocks opened at first; twice as many each time.
OPENED = 16
#: Tasks that share an item's rows before they all meet.
DEALS = 32


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a whole UTF-8 text, A-Z folded; null has none."""
    return re.findall(TERM, text.lower()) if text else []


def _binary(text: str) -> Column:
    return F.col(text).cast("string").cast("binary")


def asked(items: DataFrame) -> DataFrame:
    """``item, item_id, term, times`` of every row of ``items`` with a term; ``item`` numbers the rows."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t, n) for k, text in enumerate(batch.column("text").to_pylist()) for t, n in Counter(terms(text)).items()]
            at = pa.array([k for k, *_ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(at), batch.column("item_id").take(at), pa.array([t.decode() for _, t, _ in rows], pa.string()),
                 pa.array([n for *_, n in rows], pa.int64())],
                ["item", "item_id", "term", "times"],
            )

    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", _binary("text").alias("text"))
    return numbered.mapInArrow(run, f"item long, item_id {kind}, term string, times long")


def groups(table: DataFrame) -> Iterator[list[tuple[int, object, list[tuple[str, int]]]]]:
    """Items ``(item, item_id, [(term, times)])`` in groups of at most ``ITEMS`` with ``TERMS`` distinct terms.

    The driver reads them one after the other and holds one group at a time.
    """
    whole = table.groupBy("item").agg(F.first("item_id").alias("item_id"), F.sort_array(F.collect_list(F.struct("term", "times"))).alias("terms"))
    group, seen = [], set()
    for row in whole.toLocalIterator():
        own = {t["term"] for t in row["terms"]}
        if group and (len(seen | own) > TERMS or len(group) == ITEMS):
            yield group
            group, seen = [], set()
        group.append((row["item"], row["item_id"], [(t["term"], t["times"]) for t in row["terms"]]))
        seen |= own
    if group:
        yield group


def vectors(docs: DataFrame, place: dict[str, int]) -> DataFrame:
    """``doc_id, n, coords, tf`` of every row: all its terms counted, and those of ``place`` with their number.

    Rows without a term are left out, as they count in nothing and cannot be found.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = {t.encode(): k for t, k in place.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            keep, n, coords, tf = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                counted = Counter(terms(text.as_py()))
                if counted:
                    mine = sorted((known[t], c) for t, c in counted.items() if t in known)
                    keep.append(k)
                    n.append(counted.total())
                    coords.append(np.array([c for c, _ in mine], np.int32))
                    tf.append(np.array([c for _, c in mine], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(coords, pa.list_(pa.int32())),
                 pa.array(tf, pa.list_(pa.int64()))],
                ["doc_id", "n", "coords", "tf"],
            )

    return docs.select("doc_id", _binary("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, coords array<int>, tf array<long>")


def _blocks(impact: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lists of a chunk: first block of each term, begins of the blocks, their documents, their summaries.

    ``summary`` is a block's row of the summaries, -1 for a short list, which is one block without.

    ``impact`` has a row for each document and a column for each term.
    """
    n_docs, n_terms = impact.shape
    low = (-(-impact // STEP)).astype(np.uint8)
    sketch = (impact * weight.astype(np.float32)) @ np.random.default_rng(7).standard_normal((n_terms, DIRECTIONS), np.float32)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-30)
    held, owner = np.nonzero(impact.T)
    ends = np.searchsorted(held, np.arange(n_terms + 1))
    sizes, members, summaries = np.diff(ends), owner.astype(np.int32), []
    n_blocks, cuts = (sizes > 0).astype(np.int64), {}
    for t in np.flatnonzero(sizes > SHORT).tolist():
        docs = owner[ends[t] : ends[t + 1]]
        near = np.argmax(sketch[docs] @ sketch[docs[::BLOCK]].T, axis=1)
        order = np.argsort(near, kind="stable")
        docs, near = docs[order], near[order]
        cuts[t] = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
        members[ends[t] : ends[t + 1]] = docs
        n_blocks[t] = len(cuts[t])
        summaries += [low[block].max(axis=0) for block in np.split(docs, cuts[t][1:])]
    of_term = np.concatenate([[0], np.cumsum(n_blocks)])
    begins, summary = np.full(of_term[-1] + 1, len(members), np.int64), np.full(of_term[-1], -1, np.int32)
    begins[of_term[:-1][sizes > 0]] = ends[:-1][sizes > 0]
    n = 0
    for t, starts in cuts.items():
        begins[of_term[t] : of_term[t + 1]] = ends[t] + starts
        summary[of_term[t] : of_term[t + 1]] = np.arange(n, n + len(starts))
        n += len(starts)
    return of_term, begins, members, summary, np.array(summaries, np.uint8).reshape(-1, n_terms)


class Chunk:
    """The index of some documents: vectors, posting lists, their blocks and summaries.

    ``n_docs`` documents have ``length`` terms in all.  A term counts in a document with
    ``(10^9 tf) div (1000 tf + 8 m)``, where ``m = 25 + (75 n n_docs) div length``.
    """

    def __init__(self, rows: list[pa.RecordBatch], weight: np.ndarray, n_docs: int, length: int):
        table = pa.Table.from_batches(rows).combine_chunks()
        n, coords = table["n"].to_numpy(), table["coords"].combine_chunks()
        sizes = np.diff(coords.offsets.to_numpy())
        tf = table["tf"].combine_chunks().flatten().to_numpy()
        m = np.repeat(25 + 75 * n * n_docs // length, sizes)
        self.doc_ids = table["doc_id"]
        self.dense = np.zeros((len(n), len(weight)), np.int32)
        self.dense[np.repeat(np.arange(len(n)), sizes), coords.flatten().to_numpy()] = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        self.of_term, self.begins, self.members, self.summary, self.summaries = _blocks(self.dense, weight)
        self.most = self.dense.max(axis=0, initial=0)

    def best(self, places: np.ndarray, weights: np.ndarray, least: int) -> tuple[list[tuple[int, int]], int]:
        """``(score, document)`` of the documents that may be among the best, and the documents scored.

        ``least`` is a score that ``TOP`` documents elsewhere have reached; 1 if there are none.
        """
        # rare and heavy lists first; the last lists are opened only while they could together reach the least score
        order = np.argsort(-weights * self.most[places].astype(np.int64), kind="stable")
        places, weights = places[order], weights[order]
        left = np.cumsum((weights * self.most[places])[::-1])[::-1]
        seen = np.zeros(len(self.dense), bool)
        scores = np.zeros(len(self.dense), np.int64)
        opened = 0
        for first in range(0, len(places), 4):
            if left[first] < least:
                break
            mine = places[first : first + 4]
            blocks = np.concatenate([np.arange(self.of_term[t], self.of_term[t + 1]) for t in mine])
            rows = self.summary[blocks]
            bounds = np.full(len(blocks), left[0])
            bounds[rows >= 0] = (self.summaries[rows[rows >= 0][:, None], places].astype(np.int64) * STEP) @ weights
            blocks = blocks[np.argsort(-bounds, kind="stable")]
            bounds = np.sort(bounds)[::-1]
            at, take = 0, OPENED
            while at < len(blocks) and bounds[at] >= least:
                some = blocks[at : at + take][bounds[at : at + take] >= least]
                docs = np.unique(np.concatenate([self.members[self.begins[b] : self.begins[b + 1]] for b in some]))
                docs = docs[~seen[docs]]
                seen[docs] = True
                scores[docs] = self.dense[docs[:, None], places].astype(np.int64) @ weights
                opened += len(docs)
                if np.count_nonzero(scores) >= TOP:
                    least = max(least, int(np.partition(scores, -TOP)[-TOP]))
                at, take = at + take, 2 * take
        reached = np.flatnonzero(scores >= least)
        return [(int(scores[d]), int(d)) for d in reached], opened


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together and cut so that each list has ``most`` rows, the last fewer."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            held.append(part)
            batch, rows = batch.slice(part.num_rows), rows + part.num_rows
            if rows == most:
                yield held
                held, rows = [], 0
    if held:
        yield held


def search(found: DataFrame, group: list, place: dict[str, int], weight: np.ndarray, n_docs: int, length: int, item_kind: DataType) -> DataFrame:
    """``item, item_id, doc_id, score``: of each task the ``TOP`` documents of every item of the group.

    A task makes the index of one chunk of ``vectors`` after the other, and asks it for all
    items of the group; what an item has found so far bounds its search of the next chunk.
    """
    doc_kind = found.schema["doc_id"].dataType
    questions = []
    for item, item_id, said in group:
        own = np.array([place[t] for t, _ in said], np.int64)
        questions.append((item, item_id, own, weight[own] * np.array([n for _, n in said], np.int64)))
    types = [pa.int64(), to_arrow_type(item_kind), to_arrow_type(doc_kind), pa.int64()]
    most = max(1, CELLS // max(1, len(weight)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in questions]
        for rows in _chunks(batches, most):
            chunk = Chunk(rows, weight, n_docs, length)
            for q, (_, _, own, weights) in enumerate(questions):
                here, _ = chunk.best(own, weights, best[q][-1][0] if len(best[q]) == TOP else 1)
                if here:
                    more = ((score, chunk.doc_ids[d].as_py()) for score, d in here)
                    best[q] = sorted([*best[q], *more], key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:TOP]
        rows = [(*questions[q][:2], doc_id, score) for q, kept in enumerate(best) for score, doc_id in kept]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "item_id", "doc_id", "score"]
        )

    return found.mapInArrow(run, f"item long, item_id {item_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score long")


def first(found: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: of all tasks' rows each item's ``TOP``, met in two turns."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(DEALS))).orderBy(*order)
    left = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= TOP)
    whole = left.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= TOP)
    return whole.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``TOP`` documents with a score above 0.

    Equal scores go by ascending doc_id, rows without one last.  Texts that are null or have no
    term are not counted, not found, and ask for nothing.  Rows of ``docs`` that repeat count and
    are found each; rows of ``items`` that repeat an id are asked each by its own text, with ranks
    of their own.  Where either table is empty, so is the result.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "blocks")
    item_kind, doc_kind = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    table = scratch.keep(asked(items.select("item_id", "text")), "asked")
    out = []
    for k, group in enumerate(groups(table)):
        place = {t: n for n, t in enumerate(sorted({t for *_, said in group for t, _ in said}))}
        found = scratch.keep(vectors(docs.select("doc_id", "text"), place), f"vectors-{k}")
        n_docs, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(place), np.int64)
        for row in found.select(F.explode("coords").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect():
            df[row["c"]] = row["n"]
        weight = np.array([int(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        out.append(scratch.keep(search(found, group, place, weight, n_docs, max(1, length), item_kind), f"found-{k}"))
        scratch.drop(f"vectors-{k}")
    if not out:
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score long")
    return first(reduce(DataFrame.union, out))
