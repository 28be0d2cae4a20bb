"""Spelling variants by search schemes over bidirectional FM-indexes of the vocabulary.

Two words are near if one inserted, deleted or replaced code point turns one into the other.
The edit lies in one half of a word, so the other half stands unchanged in its neighbour.
Words are sent to blocks by their halves: a word asks where its own left and its own right
half are kept, and is kept under the halves that words one longer, equally long or one shorter
would ask for.  A block's words, delimited, make one text with an index in both directions.
Each asked half is matched exactly from the middle of the word outwards to the delimiter; then
its rank interval is extended across the other half, with one error, up to the delimiter there.

A block has at most some ``BLOCK`` words and as many questions.  A half that more words share
is split into parts, and every part of its questions meets every part of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import LOWER, UPPER, Scratch

SHORTEST, LEAST_N, DROP_EACH = 6, 5, 199
#: A near word is the form of a word that is so many times rarer.
TIMES = 5
BLOCK = 4096
#: Halves sent to all tasks, a table of some 32 MB; more of them meet the words in a shuffle.
SENT_HALVES = 500_000
LETTERS = "A-Za-zÀ-ÿ"


def runs(text: Column) -> Column:
    """Maximal runs of letters of a whole text, A-Z folded; null has none."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # lower() may fold more than A-Z only where the text has other than ASCII characters
    folded = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.split(folded, f"[^{LETTERS}]+")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: words of ``SHORTEST`` code points or more that occur ``LEAST_N`` times or more.

    Where ``DROP_EACH`` divides the crc32 of ``<doc_id>:<run>`` the run loses one code point, so
    that the texts have misspellings; a row without an id loses none.
    """
    said = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(runs(F.col("text"))).alias("run"))
    said = said.filter(F.char_length("run") >= SHORTEST)
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    hit = F.col("id").isNotNull() & (F.col("h") % DROP_EACH == 0)
    words = said.withColumn("h", h).select(F.when(hit, dropped).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_N)


def routed(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``block, word, n, left, asks``: words and questions of every block."""
    size = F.char_length("word")
    middle = F.floor(size / 2).cast("int")
    out = []
    for left in (True, False):
        asked = middle if left else size - middle
        around = [F.floor((size + d) / 2).cast("int") if left else size + d - F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)]
        lengths = F.array_distinct(F.filter(F.array(*around), lambda x: x >= (SHORTEST // 2 if left else SHORTEST - SHORTEST // 2)))
        cut = lambda k: F.substring("word", F.lit(1), k) if left else F.substring("word", size - k + 1, k)
        for asks, column in ((True, F.array(asked)), (False, lengths)):
            rows = words.select("word", "n", F.explode(column).alias("k"))
            out.append(rows.select("word", "n", F.lit(left).alias("left"), F.lit(asks).alias("asks"), cut(F.col("k")).alias("half")))
    rows = reduce(DataFrame.union, out)
    full = rows.groupBy("left", "half").agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK)
    full = scratch.keep(full.withColumn("parts", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows"), "full")
    bins = max(1, -(-2 * rows.count() // BLOCK))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    met = rows.join(F.broadcast(full) if full.count() <= SENT_HALVES else full, ["left", "half"], "left")
    every = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("*", own.alias("own"), every.alias("other"))
    pair = F.when(F.col("asks"), F.concat_ws("-", "own", "other")).otherwise(F.concat_ws("-", "other", "own"))
    bin_ = F.pmod(F.xxhash64("half"), F.lit(bins)).cast("string")
    block = F.when(F.col("parts").isNull(), bin_).otherwise(F.concat_ws("-", "half", pair))
    return met.select(F.concat(F.when(F.col("left"), F.lit("L")).otherwise(F.lit("R")), block).alias("block"), "word", "n", "left", "asks")


class Index:
    """FM-index of ``$word$word$...$`` in both directions.

    An interval is ``(lo, back, size)``: its first rank among the suffixes of the text, its first
    rank among those of the reversed text, and how many ranks it has.
    """

    def __init__(self, words: list[str]):
        text = np.frombuffer(f"\0{'\0'.join(words)}\0".encode("utf-32-le"), np.uint32)
        self.letters, coded = np.unique(text, return_inverse=True)
        self.word_of = np.cumsum(coded == 0) - 1
        self.suffixes, self.seen, self.below = self._table(coded)
        _, self.seen_back, self.below_back = self._table(coded[::-1])
        self.first = np.searchsorted(np.sort(coded), np.arange(len(self.letters)))
        self.size = len(coded)

    def _table(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix ranks by prefix doubling; of the letters before them, counts up to each rank."""
        n, step, rank = len(coded), 1, coded.astype(np.int64)
        while True:
            order = np.argsort(rank, kind="stable")
            ranked = rank[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if rank[order[-1]] == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            rank, step = rank * (n + 1) + after, 2 * step
        before = coded[order - 1]
        seen = np.zeros((n + 1, len(self.letters)), np.int32)
        seen[np.arange(1, n + 1), before] = 1
        np.cumsum(seen, axis=0, out=seen)
        below = np.cumsum(seen, axis=1, dtype=np.int32) - seen
        return order, seen, below

    def whole(self, n: int) -> np.ndarray:
        return np.tile(np.array([[0], [0], [self.size]], np.int64), n)

    def extend(self, at: np.ndarray, letters: np.ndarray, right: bool) -> np.ndarray:
        """Intervals with one more letter on the right or on the left; of size 0 where it does not occur."""
        seen, below = (self.seen_back, self.below_back) if right else (self.seen, self.below)
        lo, size = at[1 if right else 0], at[2]
        low, more = self.first[letters] + seen[lo, letters], below[lo + size, letters] - below[lo, letters]
        kept = at[0 if right else 1] + more
        found = seen[lo + size, letters] - seen[lo, letters]
        return np.stack([kept, low, found] if right else [low, kept, found])

    def followers(self, at: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of intervals and the letters, the delimiter not, that occur beside them."""
        seen, lo = (self.seen_back, at[1]) if right else (self.seen, at[0])
        place, letter = np.nonzero(seen[lo + at[2], 1:] - seen[lo, 1:])
        return place, letter + 1


def near_words(words: list[str], asked: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(asked, word)`` of near words that have the asked word's left (right) half unchanged."""
    index = Index(words)
    code = {chr(c): k for k, c in enumerate(index.letters.tolist())}
    unknown = len(code)
    sizes = np.array([len(w) for w in asked])
    width = int(sizes.max()) + 2
    # each question from its middle: the exact half towards the delimiter, then the other half
    spell = np.full((2, len(asked), width), unknown, np.int64)
    lengths = np.empty((2, len(asked)), np.int64)
    for k, w in enumerate(asked):
        m = len(w) // 2
        for side, part in enumerate((w[:m][::-1], w[m:]) if left else (w[m:], w[:m][::-1])):
            spell[side, k, : len(part) + 1] = [*(code.get(c, unknown) for c in part), 0]
            lengths[side, k] = len(part) + 1
    who = np.arange(len(asked))
    at = index.whole(len(asked))

    def exact(who, at, place, side, right):
        letters = spell[side, who, place]
        known = letters < unknown
        who, place, at = who[known], place[known], index.extend(at[:, known], letters[known], right)
        some = at[2] > 0
        return who[some], at[:, some], place[some]

    for j in range(int(lengths[0].max())):
        done = lengths[0, who] <= j
        more, moved, _ = exact(who[~done], at[:, ~done], np.full((~done).sum(), j), 0, not left)
        who, at = np.concatenate([who[done], more]), np.concatenate([at[:, done], moved], axis=1)
    # no error so far: (who, at) at letter j; one error made: (one, hold) at letter `place`
    one, hold, place = np.empty(0, np.int64), np.empty((3, 0), np.int64), np.empty(0, np.int64)
    found = []
    right = left
    for j in range(int(lengths[1].max()) + 1):
        inner = lengths[1, who] - 1 > j  # a letter of the word, not the delimiter, comes next
        begun = lengths[1, who] - 1 >= j
        who, at, inner = who[begun], at[:, begun], inner[begun]
        p, c = index.followers(at, right)
        wide = index.extend(at[:, p], c, right)
        other = c != spell[1, who[p], j]
        swapped = other & inner[p]
        one = np.concatenate([one, who[p[other]], who[p[swapped]], who[inner]])
        hold = np.concatenate([hold, wide[:, other], wide[:, swapped], at[:, inner]], axis=1)
        place = np.concatenate([place, np.full(other.sum(), j), np.full(swapped.sum() + inner.sum(), j + 1)])
        now = place == j
        more, moved, _ = exact(one[now], hold[:, now], place[now], 1, right)
        ended = lengths[1, more] - 1 == j
        found.append((more[ended], moved[:, ended]))
        one, hold = np.concatenate([one[~now], more[~ended]]), np.concatenate([hold[:, ~now], moved[:, ~ended]], axis=1)
        place = np.concatenate([place[~now], np.full((~ended).sum(), j + 1)])
        who, at, _ = exact(who[inner], at[:, inner], np.full(inner.sum(), j), 1, right)
    who = np.concatenate([f[0] for f in found])
    at = np.concatenate([f[1] for f in found], axis=1)
    # `$word$`: every interval has the one suffix that begins at the delimiter before the word
    both = np.unique(np.stack([who, index.word_of[index.suffixes[at[0]]]]), axis=1)
    return both[0], both[1]


def _search(table: pa.Table) -> pa.Table:
    left = table["left"][0].as_py()
    asks = table["asks"].to_numpy(zero_copy_only=False)
    keep = dict(zip(table["word"].filter(pa.array(~asks)).to_pylist(), table["n"].filter(pa.array(~asks)).to_pylist(), strict=True))
    asked = sorted(set(table["word"].filter(pa.array(asks)).to_pylist()))
    words = sorted(keep)
    rows: list[tuple[str, str, int]] = []
    if words and asked:
        for a, b in zip(*(x.tolist() for x in near_words(words, asked, left)), strict=True):
            word, near = asked[a], words[b]
            # what shares the left half has been found by it
            if word != near and (left or not near.startswith(word[: len(word) // 2])):
                rows.append((word, near, keep[near]))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, near, near_n`` of every ordered pair of near words, once; of ``word, n`` with distinct words."""
    return routed(words, scratch).groupBy("block").applyInArrow(_search, "word string, near string, near_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` of ``word, form``: the last word of its chain of forms.  Each round doubles the steps taken."""
    current, turn = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        turn += 1
        moved = scratch.keep(
            current.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            f"roots-{turn}",
        )
        current = moved.select("word", "root")
        if not moved.filter("moved").count():
            return current


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary of ``docs``.

    ``form`` is the near word of greatest n, of equal ones the smallest, if it occurs ``TIMES``
    times as often as the word or more; ``root`` is where the forms end, the word itself if it has
    none.  Null and empty texts have no words, repeated rows count each, an empty table has no
    words; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(vocabulary(docs.select("doc_id", "text")), "words")
    pairs = near_pairs(words, scratch)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.order") >= TIMES * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.order")).alias("form_n"),
    )
    judged = scratch.keep(judged, "judged")
    last = roots(judged.filter("form IS NOT NULL"), scratch)
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
