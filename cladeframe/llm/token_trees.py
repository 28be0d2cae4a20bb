"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A text is cut into pre-tokens by the tokenizer's pattern.  Runs of ``LEAF`` of them are the
leaves of a binary tree; every node holds the characters, pre-tokens and tokens below it.
An edit descends by characters to the first pre-token that could feel it, reads the new text
from that pre-token's start until a cut beyond the edit falls on an old one, encodes the
pre-tokens in between alone, and updates the sums on the paths above the leaves it touched.

Why that is enough: the pattern is matched from left to right and looks at most two
characters beyond a match, so a pre-token that ends two or more characters before an edit
stands; and what follows a cut depends only on the text after it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.byte_bpe import read_ranks

LEAF = 32
#: Characters beyond a match that the pattern may look at.
AHEAD = 2
#: A leaf that grows beyond this many pre-tokens makes the tree be laid out again.
MOST = 8 * LEAF

EDITS = "array<struct<start:int,end:int,replacement:string>>"


class _Known(dict):
    """Pre-token -> number of its tokens; emptied when it holds 400,000."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class Counter:
    """Cuts texts by the pattern and counts the tokens of single pre-tokens."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = _Known(self.encoding).__getitem__


@lru_cache(maxsize=1)
def _counter(raw: bytes, pattern: str) -> Counter:
    return Counter(raw, pattern)


class TokenTree:
    """Leaves of pre-token lengths and token counts, and an implicit binary tree of sums."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        self.touched = 0
        pieces = counter.pattern.findall(text)
        self._lay_out(list(map(len, pieces)), list(map(counter.tokens, pieces)))

    def _lay_out(self, chars: list[int], tokens: list[int]) -> None:
        n = max(1, -(-len(chars) // LEAF))
        self.width = 1 << (n - 1).bit_length()
        self.leaves = [
            (chars[k * LEAF : (k + 1) * LEAF], tokens[k * LEAF : (k + 1) * LEAF]) if k < n else ([], []) for k in range(self.width)
        ]
        # sums[i] covers sums[2i] and sums[2i + 1]; columns: characters, pre-tokens, tokens
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        self.sums[self.width : self.width + n] = [(sum(c), len(c), sum(t)) for c, t in self.leaves[:n]]
        size = self.width
        while size > 1:
            half = size // 2
            self.sums[half:size] = self.sums[size : 2 * size : 2] + self.sums[size + 1 : 2 * size : 2]
            size = half

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 2])

    @property
    def n_pieces(self) -> int:
        return int(self.sums[1, 1])

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last one that is not empty, and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def _put(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (chars, tokens)
        node = leaf + self.width
        self.sums[node] = (sum(chars), len(chars), sum(tokens))
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Put ``replacement`` in the place of characters ``start`` to ``end`` of the text as it is now."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        grown = len(replacement) - (end - start)
        new = self.text[:start] + replacement + self.text[end:]
        # the first pre-token whose match looked at the edit
        first, at = self._leaf_at(max(0, start - AHEAD))
        chars, tokens = self.leaves[first]
        k = 0
        while k < len(chars) and at + chars[k] <= start - AHEAD:
            at += chars[k]
            k += 1
        head = (chars[:k], tokens[:k])
        # old pre-tokens from there on, leaf by leaf, until old and new cuts meet beyond the edit
        leaf, old, begin = first, at, at
        rest, taken = (chars[k:], tokens[k:]), 0
        fresh: tuple[list[int], list[int]] = ([], [])
        for m in self.counter.pattern.finditer(new, at):
            if begin >= start + len(replacement):
                while old + grown < begin and (taken < len(rest[0]) or leaf + 1 < self.width):
                    if taken == len(rest[0]):
                        leaf, taken = leaf + 1, 0
                        rest = self.leaves[leaf]
                        continue
                    old += rest[0][taken]
                    taken += 1
                if old + grown == begin and old >= end:
                    break
            begin = m.end()
            fresh[0].append(m.end() - m.start())
            fresh[1].append(self.counter.tokens(m.group()))
        else:
            leaf, taken, rest = self.width - 1, len(self.leaves[-1][0]), self.leaves[-1]
        self.touched += len(fresh[0])
        self.text = new
        tail = (rest[0][taken:], rest[1][taken:])
        for between in range(first + 1, leaf + 1):
            if self.sums[between + self.width, 1]:
                self._put(between, [], [])
        if leaf == first:
            self._put(first, head[0] + fresh[0] + tail[0], head[1] + fresh[1] + tail[1])
        else:
            self._put(first, head[0] + fresh[0], head[1] + fresh[1])
            self._put(leaf, *tail)
        if max(len(self.leaves[first][0]), len(self.leaves[leaf][0])) > MOST:
            self._lay_out([c for x, _ in self.leaves for c in x], [t for _, x in self.leaves for t in x])


def attach_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with an ``edits`` column from ``(key, start, end, replacement)`` rows.

    A document's edits are one array by definition of the operator.  Documents without
    edits have none; edits of unknown documents are left out.
    """
    rows = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("replacement").cast("string").alias("replacement"))
    each = edits.groupBy(key).agg(F.collect_list(rows).alias("edits"))
    return docs.drop("edits").join(each, key, "left")


def masking_edits(text: Column, pattern: str, replacement: str) -> Column:
    """The edits that put ``replacement`` in the place of every match; places in code points."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    gaps = F.transform(F.split(t, pattern, -1), F.char_length)
    sizes = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.char_length)
    rows = F.filter(F.arrays_zip(gaps.alias("g"), sizes.alias("s")), lambda x: x["s"].isNotNull())
    none = F.array().cast(EDITS)
    walked = F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["s"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["s"]).alias("end"), F.lit(replacement).alias("replacement")))).alias("out"),
        ),
    )["out"]
    return F.when(t.rlike(pattern), walked).otherwise(none)


def recount(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """``key, n_pieces, n_tokens`` before the edits, ``n_edits, n_reencoded, n_pieces_after, n_tokens_after``.

    ``docs`` has ``text`` and ``edits``; places are code points of the text as it is read, and
    edits are applied from the last place to the first.  Of edits that overlap, the one that
    starts first counts (of one start, the one that ends first); null edits and edits with a
    null in them do not count; places beyond the text are moved to its end.  Null and empty
    texts have no tokens but may be edited.  Repeated rows are counted each by itself.
    ``with_text`` adds ``edited``, the text after the edits.
    """
    raw = read_ranks(path)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_pieces", "n_tokens", "n_edits", "n_reencoded", "n_pieces_after", "n_tokens_after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(raw, pattern)
        for batch in batches:
            rows, texts = [], []
            for text, edits in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = TokenTree(text.as_py() or "", counter)
                before = (tree.n_pieces, tree.n_tokens)
                valid = [e for e in edits.as_py() or [] if e and None not in e.values()]
                chosen, reached = [], 0
                for e in sorted(valid, key=lambda e: (e["start"], e["end"], e["replacement"])):
                    a, b = (min(max(e[x], 0), len(tree.text)) for x in ("start", "end"))
                    if a >= reached and b >= a:
                        chosen.append((a, b, e["replacement"]))
                        reached = max(b, a + (a == b))
                for a, b, replacement in reversed(chosen):
                    tree.edit(a, b, replacement)
                rows.append((*before, len(chosen), tree.touched, tree.n_pieces, tree.n_tokens))
                texts.append(tree.text if with_text else None)
            table = np.array(rows, np.int64).reshape(-1, 6)
            columns = [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in table.T)]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names + ["edited"] * with_text)

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + ", edited string" * with_text
    slim = docs.select(key, F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return slim.mapInArrow(run, schema)
