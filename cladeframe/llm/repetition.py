"""Quality rules by repetition: maximal repeated substrings of a text from its suffix array.

The symbols are the text's words.  Several texts are sorted together, each closed by a
symbol of its own, so that no repeat reaches over an end.  Prefix doubling gives the suffix
array; the ranks of every doubling are kept, and from them the longest common prefix of
neighbouring suffixes follows by halving steps.  A run of neighbours that share at least
``LEAST_WORDS`` words is an interval of one repeated substring; the longest prefix that a
suffix shares with either neighbour is the maximal repeat that starts there.  The union of
those repeats is the covered part of the text.

A text fails if its repeats cover more than ``MOST_COVERED`` of its word bytes, or if one
repeat has more than ``MOST_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Repeats from this many words on count; shorter ones are ordinary speech.
LEAST_WORDS = 6
MOST_COVERED, MOST_WORDS = 0.3, 100
#: Base rules: fewer words, or more than this share of words in repeated 3-word windows, fail.
BASE_WORDS, BASE_WINDOW, BASE_SHARE = 50, 3, 50
#: Words sorted together; a longer text is sorted alone.
STEP = 200_000

# Symbols counted by the base rules, and what separates words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of an array of integers, and the ranks of prefixes of 1, 2, 4, ... symbols.

    The last symbol must occur once.  A rank is the place of its group's first suffix; only
    suffixes that still share a rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.ones(n, bool)
    first[1:] = symbols[order][1:] != symbols[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank], 1
    shared = np.bincount(rank, minlength=n)[rank] > 1
    left = np.flatnonzero(shared)
    while len(left):
        second = rank[left + step]
        by = np.lexsort((second, rank[left]))
        left, second = left[by], second[by]
        old = rank[left]
        at = np.arange(len(left))
        group = np.ones(len(left), bool)
        group[1:] = old[1:] != old[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        fresh = old + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[left] = fresh
        levels.append(rank)
        alone = np.append(part, True)
        left, step = left[~(alone[:-1] & alone[1:])], step * 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    return array, levels


def common_prefixes(array: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix and the one before it in the array; 0 for the first."""
    out = np.zeros(len(array), np.int64)
    near = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    a, b = array[near], array[near - 1]
    shared = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + shared] == levels[k][b + shared]
        shared += same.astype(np.int64) << k
    out[near] = shared
    return out


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the places inside any [start, end)."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


@dataclass
class Repeats:
    """Of one text: place and length, in words, of each maximal repeat; intervals; masks."""

    starts: np.ndarray
    lengths: np.ndarray
    intervals: int
    in_repeats: np.ndarray
    in_windows: np.ndarray


def repeats(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[Repeats]:
    """Repeats of several texts, each given as its words."""
    ids: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.empty(bounds[-1], np.int64)
    for k, t in enumerate(texts):
        symbols[bounds[k] : bounds[k + 1] - 1] = [ids.setdefault(w, len(ids)) for w in t]
    # the same word in two texts is two symbols, and every end is a symbol of its own
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    ends = bounds[1:] - 1
    symbols += text_of * (len(ids) + 1)
    symbols[ends] = (len(texts) + 1) * (len(ids) + 1) + np.arange(len(texts))
    array, levels = suffix_order(symbols)
    lcp = common_prefixes(array, levels)
    after = np.append(lcp[1:], 0)
    longest = np.empty(len(array), np.int64)
    longest[array] = np.maximum(lcp, after)
    long_run = lcp >= least
    opening = array[np.flatnonzero(long_run & ~np.concatenate([[False], long_run[:-1]]))]
    intervals = np.bincount(text_of[opening], minlength=len(texts))
    at = np.flatnonzero(longest >= least)
    in_repeats = covered(at, at + longest[at], len(array))
    window = np.flatnonzero(longest >= BASE_WINDOW)
    in_windows = covered(window, window + BASE_WINDOW, len(array))
    out = []
    for k in range(len(texts)):
        a, b = bounds[k], bounds[k + 1] - 1
        own = at[np.searchsorted(at, a) : np.searchsorted(at, b)]
        out.append(Repeats(own - a, longest[own], int(intervals[k]), in_repeats[a:b], in_windows[a:b]))
    return out


_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "covered_share double, longest_repeat long, n_intervals long, kept boolean"
)


def _measure(texts: list[str]) -> Iterator[tuple]:
    cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    for text, words, found in zip(texts, cut, repeats(cut), strict=True):
        n = len(words)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        n_repeat = int(found.in_windows.sum())
        sizes = np.fromiter(map(len, words), np.int64, n)
        share = float(sizes[found.in_repeats].sum() / sizes.sum()) if n else 0.0
        longest = int(found.lengths.max()) if len(found.lengths) else 0
        failed = n < BASE_WORDS or 100 * n_repeat > BASE_SHARE * n
        yield (
            n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            n_repeat, failed, share, longest, found.intervals, not failed and share <= MOST_COVERED and longest <= MOST_WORDS,
        )


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in groups of about ``STEP`` words."""
    group, size = [], 0
    for t in texts:
        n = len(t) // 6
        if group and size + n > STEP:
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group


def rules(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and the measures and verdicts of every row.

    Null, empty and all-space texts have no words and fail the base rule.  Repeated rows
    are measured each by itself; columns besides ``key`` and text are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in _groups([t or "" for t in batch.column("text").to_pylist()]):
                columns = [pa.array(c) for c in zip(*_measure(group), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), *columns], [key, *names])
                done += len(group)

    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, {_SCHEMA}")


def spans(docs: DataFrame, least: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """``key, start, length, words``: every maximal repeat of every text, places in words.

    A text without a repeat has no row.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                found = repeats([words], least)[0]
                said = [b" ".join(words[a : a + n]).decode("utf-8", "replace") for a, n in zip(found.starts, found.lengths, strict=True)]
                keys = batch.column(0).take(pa.array(np.full(len(said), k)))
                columns = [keys, pa.array(found.starts), pa.array(found.lengths), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "start", "length", "words"])

    slim = docs.select(key, F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{key}` {kind}, start long, length long, words string")
