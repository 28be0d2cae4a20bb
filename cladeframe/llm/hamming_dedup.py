"""Near-duplicate groups: b-bit MinHash signatures joined by a multi-index Hamming join.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence).  Its
signature has ``CHUNKS * WIDTH`` symbols of 8 bits, one per hash function.  Two signatures
with fewer than ``CHUNKS * (ERRORS + 1)`` differing symbols have, by the pigeonhole
principle, a chunk with at most ``ERRORS`` differing symbols.  Every chunk is therefore
indexed once for each choice of ``ERRORS`` symbols to leave out: all pairs under that
distance meet in a bucket.  With 12 chunks of 6 symbols and one error that is every pair with
at most 23 of 72 symbols apart, and a pair at Jaccard 0.75 meets with probability
1 - (1 - P(Bin(6, 1/4) <= 1))^12 = 0.9999, one at 0.85 with 0.9999999.  Pairs that meet are
confirmed on their full sets.

Nothing emits all pairs of a bucket.  Equal sets are one class first.  Then come rounds in
which each member is compared with one leader of its bucket, at first the smallest, then one
drawn by a hash for each bucket; what these links join needs no further comparison.  Only
members outside their bucket's largest component are compared with the others after that.

Before sets are compared, a pair must pass a bound: a set's parity sketch holds for each of
``PARITY`` bits whether an odd number of its shingles fall on it.  Two sketches differ in at
most as many bits as the sets differ in shingles, which at Jaccard 0.75 is a seventh of both
sizes together.  For long texts, whose sketches fill up, the bound is the expected number of
bits and 5.5 standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch
from cladeframe.llm.components import components

SHINGLE = 5
CHUNKS, WIDTH, ERRORS = 12, 6, 1
PARITY = 1024
PERCENT = 75
#: Rounds of comparisons with leaders.
LEADERS = 2
#: So many ids are sent to every task (a hash table of some 32 MB); more are joined by a shuffle.
SENT_IDS = 1_000_000

_SEED = np.random.default_rng(20240229)
_FACTORS = _SEED.integers(0, 2**63, CHUNKS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _SEED.integers(0, 2**63, CHUNKS * WIDTH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Word -> 64-bit hash; emptied when it holds 50,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 50_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text.

    ``bytes.lower`` folds A-Z alone and ``bytes.split`` cuts at 0x20 and 0x09-0x0D alone,
    which is the word rule of this operator.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(0xD6E8FEB86659FD93) + w[k : len(w) - size + 1 + k])
    return np.unique(out)


def signature(values: np.ndarray) -> np.ndarray:
    """``CHUNKS`` 64-bit words, each with ``WIDTH`` symbols of 8 bits in its low bytes."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        block = values[at : at + 2048, None] * _FACTORS + _OFFSETS
        np.minimum(low, block.min(axis=0), out=low)
    symbols = (_mixed(low) >> np.uint64(56)).reshape(CHUNKS, WIDTH)
    shifts = np.arange(WIDTH, dtype=np.uint64) * np.uint64(8)
    return (symbols << shifts).sum(axis=1, dtype=np.uint64)


def parity(values: np.ndarray) -> np.ndarray:
    """``PARITY`` bits as 64-bit words: which of them an odd number of shingles falls on."""
    odd = np.bincount((values >> np.uint64(17)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


#: Columns that go with a set: its signature and its parity sketch.
CARRIED = [*(f"c{k}" for k in range(CHUNKS)), *(f"p{k}" for k in range(PARITY // 64))]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        ids, rows = batch.column("doc_id"), []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), hashes)
            two = (s.sum(dtype=np.uint64), (_mixed(s) * (s | np.uint64(1))).sum(dtype=np.uint64))
            rows.append(np.concatenate([np.array([len(s), *two], np.uint64), signature(s), parity(s)]))
        table = np.array(rows, np.uint64).reshape(-1, 3 + len(CARRIED)).view(np.int64)
        names = ["n_shingles", "h1", "h2", *CARRIED]
        columns = [pa.array(np.ascontiguousarray(table[:, k])) for k in range(table.shape[1])]
        yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, h1, h2`` and sketches; h1 and h2 tell sets of one size apart."""
    sketches = ", ".join(f"{c} long" for c in CARRIED)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_signed, f"doc_id long, n_shingles long, h1 long, h2 long, {sketches}")


def _keys() -> Column:
    """One 64-bit key for each chunk and symbol left out."""
    out = []
    for chunk in range(CHUNKS):
        for symbol in range(WIDTH):
            mask = sum(0xFF << (8 * s) for s in range(WIDTH) if s != symbol)
            out.append(F.xxhash64(F.lit(chunk), F.lit(symbol), F.col(f"c{chunk}").bitwiseAND(F.lit(mask))))
    return F.array(*out)


def _plausible(left: str, right: str) -> Column:
    """What every pair at the similarity meets, but for one in some ten million long ones."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    bits = reduce(
        lambda n, k: n + F.bit_count(F.col(f"{left}.p{k}").bitwiseXOR(F.col(f"{right}.p{k}"))), range(PARITY // 64), F.lit(0)
    )
    most = (a + b) * ((100.0 - PERCENT) / (100.0 + PERCENT))
    expected = PARITY / 2 * (1 - F.exp(most * (-2 / PARITY))) + 5.5 * PARITY**0.5 / 2
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT) & (bits <= F.least(most + 1e-6, expected))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common >= PERCENT * (len(both) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate ``(a, b)`` those whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirmed, "a long, b long")


def _set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, shingles`` of the documents in ``ids``, which must be a written table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    wanted = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return texts.join(wanted, "id", "left_semi").mapInArrow(_sets, "id long, shingles binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Null, empty and all-space texts have the empty set and are linked with nothing.  Rows
    that repeat a doc_id are grouped each by its own text, and repeated rows stay repeated.
    A null doc_id is linked with nothing, has a null component and is kept.  Columns besides
    doc_id and text are not read.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    signed = scratch.keep(signatures(docs), "signed")
    whole = ["n_shingles", "h1", "h2"]
    classes = scratch.keep(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*whole)
        .agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in CARRIED)),
        "classes",
    )
    slim = classes.select("id", "n_shingles", *CARRIED)
    keyed = classes.select("id", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    buckets = scratch.keep(keyed.join(shared.select("key"), "key", "left_semi"), "buckets")

    tried = sets = groups = None
    for turn in range(LEADERS + 1):
        placed = buckets.withColumn("component", F.col("id"))
        if groups is not None:
            placed = buckets.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # the leader: the smallest id, then in each bucket another draw
        draw = F.col("id") if turn == 0 else F.xxhash64("id", "key", F.lit(turn))
        leader = placed.groupBy("key").agg(
            F.min("component").alias("m"), F.max("component").alias("n"), F.min(F.struct(draw.alias("d"), "id", "component")).alias("l")
        ).filter("m < n")
        if turn < LEADERS:
            met = placed.join(leader, "key").filter(F.col("component") != F.col("l.component"))
            pairs = met.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct().alias("p")
            pairs = (
                pairs.join(slim.alias("x"), F.col("p.a") == F.col("x.id")).join(slim.alias("y"), F.col("p.b") == F.col("y.id"))
                .filter(_plausible("x", "y")).select("p.a", "p.b")
            )
        else:
            # all members of mixed buckets, and those outside the largest component of theirs
            sizes = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
            largest = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("most"), F.count("*").alias("parts"))
            largest = largest.filter("parts > 1").select("key", F.col("most.component").alias("largest"))
            mixed = placed.join(largest, "key").join(slim, "id")
            pairs = mixed.filter("component <> largest").alias("x").join(
                mixed.alias("y"),
                (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
                & ((F.col("y.component") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id")))
                & _plausible("x", "y"),
            ).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs-{turn}")
        tried = pairs if tried is None else tried.union(pairs)
        ends = _ends(pairs) if sets is None else _ends(pairs).join(sets.select("id"), "id", "left_anti")
        fresh = scratch.keep(_set_table(docs, scratch.keep(ends, f"ends-{turn}")), f"sets-{turn}")
        sets = fresh if sets is None else sets.union(fresh)
        found = scratch.keep(_links(pairs, sets), f"links-{turn}")
        # what is joined so far has one row for each id; the new links are added to it
        links = found if groups is None else groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found)
        groups = components(links, scratch, f"groups-{turn}")
    # the result reads the signatures, the classes and the last groups alone
    for name in ("buckets", *(f"{kind}-{turn}" for kind in ("pairs", "ends", "sets", "links") for turn in range(LEADERS + 1))):
        scratch.drop(name)

    of_class = classes.join(groups, "id", "left").select(*whole, F.coalesce("component", "id").alias("component_id"))
    known = signed.filter("doc_id IS NOT NULL").select("doc_id", *whole).join(of_class, whole, "left")
    known = known.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    known = known.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    unknown = signed.filter("doc_id IS NULL").select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    return known.union(unknown)
