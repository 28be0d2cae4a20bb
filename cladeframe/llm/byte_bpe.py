"""Byte-level BPE with recursive DuckDB queries, one database in memory for each task.

A task cuts its texts into pieces by the tokenizer's pattern.  Distinct new pieces become
token lists of single bytes; a recursive query lays them out as token-position rows, joins
those with the merge table, and contracts each piece's leftmost pair of minimum rank until no
piece has a pair left.  Decoding joins token ids with the vocabulary and puts their bytes
together by an ordered aggregation.

A long piece is cut into short stretches, which are encoded each by itself.  Ids are those of
the whole piece where every two neighbours, taken alone, encode to themselves: the first
contraction across a border would be the minimum of its two tokens as well.  So borders are
tested by their two tokens, and around one that fails a window is encoded again, twice as wide
in each turn, until all hold.  A window that is long itself takes a second recursive query,
which contracts all non-overlapping occurrences of the minimum pair at once, up to the first
whose result could merge with a neighbour at a lower rank.

The merge table holds every split of a vocabulary entry into two entries, which is the rule
of rank files: two neighbours merge when their bytes together are an entry.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer pieces are cut into stretches of so many bytes; tokens on each side of a first window.
LONG, REACH = 48, 4
#: Bytes of pieces in one query, and what its database may hold.
BLOCK, MEMORY = 1 << 18, "192MB"
#: Pieces, and characters of pieces, kept in a task before they go; text characters per step.
KEPT, KEPT_CHARS, STEP = 300_000, 8 << 20, 1 << 20
#: Tokens put together by one group of the ordered aggregation.
RUN = 4096
#: A vocabulary file is sent to every task; a larger one is refused.
MOST_BYTES = 64 << 20

SHORT_SQL = """
WITH RECURSIVE state(w, ids) AS (
  SELECT w, ids FROM fresh
  UNION ALL
  SELECT s.w, s.ids[1 : b.x & 4294967295] || [CAST(b.x >> 32 AS INTEGER)] || s.ids[(b.x & 4294967295) + 3 :]
  FROM state s JOIN (
    SELECT c.w, min((CAST(m.merged AS BIGINT) << 32) + c.p) AS x
    FROM (SELECT w, p, ids[p + 1] AS t, ids[p + 2] AS n
          FROM (SELECT w, ids, unnest(range(len(ids) - 1)) AS p FROM state)) c
    JOIN merges m ON m.l = c.t AND m.r = c.n GROUP BY c.w) b ON b.w = s.w
) SELECT w, arg_min(ids, len(ids)) AS ids FROM state GROUP BY w
"""

LONG_SQL = """
WITH RECURSIVE state(w, ids) USING KEY (w) AS (
  SELECT w, ids FROM fresh
  UNION
  SELECT w, list(CASE WHEN taken THEN merged ELSE t END ORDER BY p)
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY p), false) AS gone
    FROM (
      SELECT w, p, t, merged, coalesce(merged = low, false) AND p <= coalesce(stop, p) AND
        (p - coalesce(max(CASE WHEN merged IS DISTINCT FROM low THEN p END) OVER (PARTITION BY w ORDER BY p), -1)) % 2 = 1 AS taken
      FROM (
        SELECT *, min(CASE WHEN merged = low AND unsafe THEN p END) OVER (PARTITION BY w) AS stop
        FROM (
          SELECT c.w, c.p, c.t, m.merged, min(m.merged) OVER (PARTITION BY c.w) AS low,
            m.twice OR coalesce(a.merged < m.merged, false) OR coalesce(b.merged < m.merged, false) AS unsafe
          FROM (SELECT w, p, ids[p] AS before, ids[p + 1] AS t, ids[p + 2] AS n, ids[p + 3] AS after
                FROM (SELECT w, ids, unnest(range(len(ids))) AS p FROM state)) c
          LEFT JOIN merges m ON m.l = c.t AND m.r = c.n
          LEFT JOIN merges a ON a.l = m.merged AND a.r = c.after
          LEFT JOIN merges b ON b.l = c.before AND b.r = m.merged)
        WHERE low IS NOT NULL)))
  WHERE NOT gone GROUP BY w
) SELECT w, ids FROM state
"""

DECODE_SQL = "SELECT g, string_agg(v.hex, '' ORDER BY said.p) AS hex FROM said JOIN vocabulary v ON v.id = said.id GROUP BY g ORDER BY g"


def read_ranks(path: str) -> bytes:
    """The rank file as it is; read where the job is declared and sent with its tasks."""
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a rank file may have at most {MOST_BYTES} bytes")
    return raw


class Coder:
    """One task's database: vocabulary, merge table, and the pieces met so far."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.bytes = {b: a for a, b in self.ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [
            (self.ranks[token[:k]], self.ranks[token[k:]], merged)
            for token, merged in self.ranks.items()
            for k in range(1, len(token)) if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        left, right, merged = (np.array(c, np.int32) for c in zip(*splits, strict=True))
        # whether two results side by side would merge at a lower rank than their own
        double = {token: self.ranks.get(token + token) for token in self.ranks}
        twice = {r: double[t] is not None and double[t] < r for t, r in self.ranks.items()}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.execute("SET enable_progress_bar = false")
        merges = pa.table({"l": left, "r": right, "merged": merged, "twice": [twice[m] for m in merged.tolist()]})
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [k.hex() for k in self.ranks]})
        for name, given in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", given)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self._clear()

    def _query(self, sql: str, given: pa.Table, name: str) -> pa.Table:
        self.db.register(name, given)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _merged(self, pieces: list[bytes], sql: str) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int32)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.single[data]))
        out = self._query(sql, pa.table({"w": pa.array(np.arange(len(pieces), dtype=np.int32)), "ids": ids}), "fresh")
        out = out.combine_chunks().sort_by("w")["ids"].combine_chunks()
        out = out.chunk(0) if isinstance(out, pa.ChunkedArray) else out
        bounds, values = out.offsets.to_numpy(), out.values.to_numpy()
        return [values[bounds[k] : bounds[k + 1]] for k in range(len(pieces))]

    def _contracted(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings by contraction alone, in blocks of ``BLOCK`` bytes."""
        found: list[np.ndarray | None] = [None] * len(pieces)
        for long, sql in ((False, SHORT_SQL), (True, LONG_SQL)):
            places = [k for k, b in enumerate(pieces) if (len(b) > LONG) == long]
            block = np.cumsum([len(pieces[k]) for k in places]) // BLOCK
            for _, group in groupby(zip(block.tolist(), places, strict=True), key=itemgetter(0)):
                at = [k for _, k in group]
                for k, ids in zip(at, self._merged([pieces[k] for k in at], sql), strict=True):
                    found[k] = ids
        return found

    def _hold(self, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], bool]:
        """Whether two neighbouring tokens, taken alone, encode to themselves."""
        listed = list(pairs)
        alone = self._contracted([self.bytes[a] + self.bytes[b] for a, b in listed])
        return {p: ids.tolist() == list(p) for p, ids in zip(listed, alone, strict=True)}

    def _stretched(self, piece: bytes) -> np.ndarray:
        """Ids of a long piece from those of its stretches."""
        parts = self._contracted([piece[k : k + LONG] for k in range(0, len(piece), LONG)])
        ids = np.concatenate(parts)
        doubtful = np.cumsum([len(p) for p in parts])[:-1]
        known: dict[tuple[int, int], bool] = {}
        reach = REACH
        while len(doubtful):
            pairs = list(zip(ids[doubtful - 1].tolist(), ids[doubtful].tolist(), strict=True))
            known.update(self._hold(set(pairs) - known.keys()))
            bad = doubtful[[not known[p] for p in pairs]]
            # windows that overlap or touch are one
            first = np.concatenate([[True], bad[1:] - bad[:-1] > 2 * reach]) if len(bad) else np.empty(0, bool)
            begins = np.maximum(bad[first] - reach, 0)
            ends = np.minimum(bad[np.append(first[1:], True)] + reach, len(ids)) if len(bad) else begins
            again = self._contracted([b"".join(map(self.bytes.__getitem__, ids[a:b].tolist())) for a, b in zip(begins, ends, strict=True)])
            out, edges, at, done = [], [], 0, 0
            for a, b, window in zip(begins.tolist(), ends.tolist(), again, strict=True):
                out += [ids[done:a], window]
                at += a - done
                edges += [at, at + len(window)]
                at, done = at + len(window), b
            ids = np.concatenate([*out, ids[done:]])
            doubtful = np.unique([e for e in edges if 0 < e < len(ids)]).astype(np.int64)
            reach *= 2
        return ids

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet."""
        fresh = [p for p in pieces if p not in self.known]
        if not fresh:
            return
        raw = [p.encode("utf-8") for p in fresh]
        found: list[np.ndarray | None] = [
            np.array([self.ranks[b]], np.int32) if b in self.ranks else None for b in raw
        ]
        places = [k for k, b in enumerate(raw) if found[k] is None and len(b) <= LONG]
        for k, ids in zip(places, self._contracted([raw[k] for k in places]), strict=True):
            found[k] = ids
        for k, b in enumerate(raw):
            if found[k] is None:
                found[k] = self._stretched(b)
        self.held += sum(map(len, fresh))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.flat = np.concatenate([self.flat, *found])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > KEPT or self.held > KEPT_CHARS:
            self._clear()
        self._learn({p for pieces in cut for p in pieces})
        out = []
        for pieces in cut:
            index = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            sizes = self.sizes[index]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            places = np.arange(total) + np.repeat(self.starts[index] - (ends - sizes), sizes)
            out.append(self.flat[places])
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id sequence; an id outside the vocabulary is an error."""
        groups = [max(1, -(-len(s) // RUN)) for s in sequences]
        ids = np.concatenate([np.empty(0, np.int32), *sequences])
        first = np.cumsum([0, *groups])
        g = np.concatenate([np.empty(0, np.int64), *(f + np.arange(len(s)) // RUN for f, s in zip(first, sequences, strict=False))])
        said = pa.table({"g": g.astype(np.int32), "p": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)})
        out = self._query(DECODE_SQL, said, "said")
        parts: dict[int, bytes] = {k: bytes.fromhex(h) for k, h in zip(out["g"].to_pylist(), out["hex"].to_pylist(), strict=True)}
        whole = [b"".join(parts.get(k, b"") for k in range(first[i], first[i + 1])) for i in range(len(sequences))]
        if len(ids) and not np.isin(ids, np.fromiter(self.ranks.values(), np.int32, len(self.ranks))).all():
            raise ValueError("an id is not in the vocabulary")
        return whole


@lru_cache(maxsize=1)
def _coder(raw: bytes, pattern: str) -> Coder:
    return Coder(raw, pattern)


def _steps(batch: pa.RecordBatch, column: str, size: Callable) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``STEP`` characters or ids each, one row at least."""
    sizes, begin, total = size(batch.column(column)), 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > STEP:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _text_sizes(column: pa.Array) -> list[int]:
    return [len(x.as_py() or "") for x in column]


def _list_sizes(column: pa.Array) -> list[int]:
    return [len(x) if x.is_valid else 0 for x in column]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key, ids`` for every row: the whole text's token ids, without special tokens.

    Null and empty texts have no ids.  Repeated rows and keys stay as they are, other
    columns are not read, an empty table stays empty.
    """
    raw = read_ranks(path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw, pattern)
        for batch in batches:
            for a, b in _steps(batch, "text", _text_sizes):
                part = batch.slice(a, b - a)
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, bytes`` of every id list, of which a null one has no bytes."""
    raw = read_ranks(path)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw, "")
        for batch in batches:
            for a, b in _steps(batch, "ids", _list_sizes):
                part = batch.slice(a, b - a)
                found = coder.decode([np.array(x or [], np.int32) for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], [key, "bytes"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: encoded, then decoded from the ids alone.

    Both directions run in one task, so that no id list leaves it.  Null and empty texts
    have 0 tokens and the digests of nothing.
    """
    raw = read_ranks(path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw, pattern)
        for batch in batches:
            for a, b in _steps(batch, "text", _text_sizes):
                part = batch.slice(a, b - a)
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
                decoded = coder.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
