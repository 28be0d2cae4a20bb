"""Language-model scores by a probabilistic suffix tree over the symbols of the words.

A text is the sequence of its words' bytes, one blank between words, and an end.  Symbols
are the bytes that are frequent in the training texts, and one class for all others, which
share its probability evenly.  Contexts of up to ``DEPTH`` symbols are counted over all
training texts.  A context stays in the tree if its next-symbol distribution diverges from
that of the context one shorter by at least ``LEAST_GAIN`` nats over all its occurrences, or
if a longer one that ends in it stays.  Its distribution is smoothed by its parent's.  Each
symbol is scored in the state of the longest context in the tree that ends before it.  All
contexts that pass stay: up to ``STATES`` of them in a table with a cell for every symbol,
more as sorted codes of what was seen, in parts of about ``PART`` counts and one pass over
the texts for each part.

A token's probability in the tree is that of its symbols and of a close, blank or end, after
them; the end token's is that of an end rather than a blank.  It is interpolated with the
token's share of all training tokens.  As in the base, words that training has not met are
one class; its share is that of the words met once (Good and Turing's estimate).

The unigram base needs the training count of every word.  The most frequent words, at
most ``HEAVY``, are sent to every task; occurrences of other words are joined with the
counts by a shuffle, where no word is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch, largest

DEPTH, BITS = 5, 7
SYMBOLS = 1 << BITS
END, OTHER = 0, SYMBOLS - 1
#: Contexts seen less often are not tested; gain in nats that keeps one.
LEAST_COUNT, LEAST_GAIN = 50, 8.0
#: Contexts and suffixes of a tree with a cell for every symbol, 1 KB each; counts in a part of a larger one.
STATES, PART = 20000, 1 << 21
#: A part has all longer contexts that end in the same ``SPLIT`` symbols: at most 2 ** 21 and some counts.
SPLIT = 3
#: Scores that a task remembers, a power of two.
MEMO = 1 << 20
#: Weight, in observations, of the parent's distribution.
PARENT_WEIGHT = 2.0
HEAVY = 500_000
#: Weight of a token's share of the training tokens against the tree.
SHARE = 0.6
#: Symbols handled at once, and distinct counts that a task gathers before it gives them out.
STEP, KEPT = 1 << 20, 1_000_000

MASK = (1 << BITS) - 1


class _Hashes(dict):
    """Word -> signed 64-bit hash; emptied when it holds half a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value


#: The end of a text counts as a word of its own; no word has this hash but by chance.
END_HASH = xxhash.xxh3_64_intdigest(b"\x20end") - (1 << 63)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: ``lower`` folds A-Z alone, ``split`` cuts at 0x20, 0x09-0x0D alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Keys and words of whole texts, in groups of about ``STEP`` bytes."""
    for batch in batches:
        keys, group, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column("text"), strict=True):
            w = words_of(text.as_py())
            keys.append(key)
            group.append(w)
            size += sum(map(len, w)) + len(w)
            if size >= STEP:
                yield keys, group
                keys, group, size = [], [], 0
        if keys:
            yield keys, group


def _stream(group: list[list[bytes]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of several texts, each after ``DEPTH`` ends and closed by one; the bytes; the bounds."""
    parts = [b" ".join(w) for w in group]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    bounds = np.concatenate([[0], np.cumsum(sizes + DEPTH + 1)])
    raw = np.frombuffer((b"\0" * DEPTH) + (b"\0" * (DEPTH + 1)).join(parts) + b"\0", np.uint8)
    symbols = table[raw]
    for k in range(DEPTH):
        symbols[bounds[:-1] + k] = END
    symbols[bounds[1:] - 1] = END
    return symbols, raw, bounds


def byte_counts(texts: DataFrame) -> dict[int, int]:
    """How often each byte stands in the words and blanks of all texts; at most 256 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for _, group in _texts(batches):
            for w in group:
                total += np.bincount(np.frombuffer(b" ".join(w), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["byte", "n"])

    rows = texts.select(F.lit(0).alias("key"), "text").mapInArrow(run, "byte int, n long")
    return {r["byte"]: r["n"] for r in rows.groupBy("byte").agg(F.sum("n").alias("n")).collect()}


def symbol_table(counts: dict[int, int]) -> np.ndarray:
    """Byte -> symbol: the blank and the most frequent have one of their own, the others share the last."""
    own = sorted((b for b, n in counts.items() if n and b != 32), key=lambda b: (-counts[b], b))[: SYMBOLS - 3] + [32]
    table = np.full(256, OTHER, np.int64)
    table[sorted(own)] = np.arange(1, len(own) + 1)
    return table


class _Sums:
    """Counts by code, merged as they come; given out when there are many."""

    def __init__(self):
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        new, n = np.unique(codes, return_counts=True)
        both = np.concatenate([self.codes, new])
        self.codes, back = np.unique(both, return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, n]), len(self.codes)).astype(np.int64)

    def out(self, kind: int) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(self.codes), kind, np.int32)), pa.array(self.codes), pa.array(self.counts)]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, ["kind", "code", "n"])


def corpus_counts(training: DataFrame, table: np.ndarray) -> DataFrame:
    """``kind, code, n`` over all training texts: 0 words by hash, 1 runs of ``DEPTH + 1`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = _Hashes(), (_Sums(), _Sums())
        held: tuple[list, list] = ([], [])
        sizes = [0, 0]

        def flush(kind: int, least: int) -> Iterator[pa.RecordBatch]:
            if sizes[kind] > least:
                sums[kind].add(np.concatenate(held[kind]))
                held[kind].clear()
                sizes[kind] = 0
            if len(sums[kind].codes) > (KEPT if least else 0):
                yield sums[kind].out(kind)

        for _, group in _texts(batches):
            symbols, _, bounds = _stream(group, table)
            code = reduce(lambda c, k: (c << BITS) | symbols[k : len(symbols) - DEPTH + k], range(1, DEPTH + 1), symbols[: len(symbols) - DEPTH])
            # a run that ends in a text's leading ends is not one of its symbols
            at = np.ones(len(code), bool)
            for k in range(DEPTH):
                inside = bounds[1:-1] + k - DEPTH
                at[inside] = False
            every = [hashes[w] for words in group for w in words] + [END_HASH] * len(group)
            for kind, codes in ((0, np.array(every, np.int64)), (1, code[at])):
                held[kind].append(codes)
                sizes[kind] += len(codes)
                yield from flush(kind, 2 * STEP)
        for kind in (0, 1):
            yield from flush(kind, 0)

    rows = training.select(F.lit(0).alias("key"), "text").mapInArrow(run, "kind int, code long, n long")
    return rows.groupBy("kind", "code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tree:
    """States of the tree: where a further symbol back leads, and log10 of next symbols."""

    child: np.ndarray
    logs: np.ndarray
    table: np.ndarray
    other: float

    def start(self) -> float:
        """The end's score before a text's first symbol."""
        return float(self.logs[_start(self), END])

    def scorer(self, symbols: np.ndarray, at: np.ndarray) -> Callable[..., np.ndarray]:
        """Gives the scores of symbols at some or all of the places ``at``."""
        node = np.zeros(len(at), np.int32)
        left = np.arange(len(at))
        for k in range(1, DEPTH + 1):
            step = self.child[node[left], symbols[at[left] - k]]
            left, step = left[step >= 0], step[step >= 0]
            node[left] = step
        return lambda said, some=slice(None): self.logs[node[some], said].astype(np.float64)

    def outside(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray | None:
        return None


@dataclass
class Part:
    """A part of a tree: what was seen after its contexts.

    It scores the places where the last ``SPLIT`` symbols' code is in ``low`` .. ``high`` - 1.

    A run of symbols has its length marked by a bit above it.  A symbol not seen after a
    context has its score after the next shorter one, and ``backs`` of the context.
    """

    root: np.ndarray
    runs: np.ndarray
    logs: np.ndarray
    states: np.ndarray
    backs: np.ndarray
    low: int
    high: int
    table: np.ndarray
    other: float
    memo: tuple[np.ndarray, np.ndarray] | None = None

    def start(self) -> float:
        return float(self._look(np.zeros(1, np.int64))[0]) if self.low == 0 else 0.0

    def scorer(self, symbols: np.ndarray, at: np.ndarray) -> Callable[..., np.ndarray]:
        before = reduce(lambda c, k: (c << BITS) | symbols[at - k], range(DEPTH - 1, 0, -1), symbols[at - DEPTH])
        return lambda said, some=slice(None): self._known((before[some] << BITS) | said)

    def outside(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray | None:
        if self.low == 0 and self.high == 1 << BITS * SPLIT:
            return None
        last = reduce(lambda c, k: (c << BITS) | symbols[at - k], range(SPLIT - 1, 0, -1), symbols[at - SPLIT])
        return (last < self.low) | (last >= self.high)

    def _known(self, code: np.ndarray) -> np.ndarray:
        """Scores of runs of ``DEPTH + 1`` symbols, remembered by a hash: most runs are frequent ones."""
        if self.memo is None:
            self.memo = np.full(MEMO, -1, np.int64), np.zeros(MEMO, np.float32)
        held, value = self.memo
        slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - MEMO.bit_length())
        out, miss = value[slot], np.flatnonzero(held[slot] != code)
        if len(miss):
            new, first, back = np.unique(code[miss], return_index=True, return_inverse=True)
            found = self._look(new)
            out[miss] = found[back]
            slot = slot[miss[first]]
            held[slot] = new
            stays = held[slot] == new  # one of several runs that share a slot
            value[slot[stays]] = found[stays]
        return out.astype(np.float64)

    def _look(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for d in range(DEPTH, 0, -1):
            run = (code[left] & ((1 << BITS * (d + 1)) - 1)) | (1 << BITS * (d + 1))
            place, found = _find(self.runs, run)
            out[left[found]] += self.logs[place[found]]
            left = left[~found]
            place, found = _find(self.states, run[~found] >> BITS)
            out[left[found]] += self.backs[place[found]]
        out[left] += self.root[code[left] & MASK]
        return out.astype(np.float32)


def _find(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    place = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return place, table[place] == codes


def contexts(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """``depth, context, next, n`` for the contexts that stay in the tree, and all their suffixes."""
    levels = {DEPTH: runs.select("code", "n")}
    for d in range(DEPTH - 1, -1, -1):
        shorter = levels[d + 1].select(F.col("code").bitwiseAND(F.lit((1 << BITS * (d + 1)) - 1)).alias("code"), "n")
        levels[d] = scratch.keep(shorter.groupBy("code").agg(F.sum("n").alias("n")), f"level-{d}")
    split = {
        d: df.select(F.shiftright("code", BITS).alias("context"), F.col("code").bitwiseAND(F.lit(MASK)).alias("next"), "n")
        for d, df in levels.items()
    }
    tested = []
    for d in range(1, DEPTH + 1):
        total = split[d].groupBy("context").agg(F.sum("n").alias("all")).filter(f"all >= {LEAST_COUNT}")
        up = F.col("context").bitwiseAND(F.lit((1 << BITS * (d - 1)) - 1))
        parent = split[d - 1].select(F.col("context").alias("up"), "next", F.col("n").alias("up_n"))
        parent_all = split[d - 1].groupBy("context").agg(F.sum("n").alias("up_all")).withColumnRenamed("context", "up")
        each = split[d].join(total, "context").withColumn("up", up).join(parent, ["up", "next"]).join(parent_all, "up")
        ratio = F.log((F.col("n") / F.col("all")) / (F.col("up_n") / F.col("up_all")))
        gain = each.groupBy("context").agg(F.sum(F.col("n") * ratio).alias("gain")).filter(F.col("gain") >= LEAST_GAIN)
        tested.append(gain.select(F.lit(d).alias("depth"), "context", "gain"))
    gains = scratch.keep(reduce(DataFrame.union, tested), "gains")
    closed = [
        gains.filter(F.col("depth") >= d).select(F.lit(d).alias("depth"), F.col("context").bitwiseAND(F.lit((1 << BITS * d) - 1)).alias("context"))
        for d in range(DEPTH + 1)
    ]
    states = reduce(DataFrame.union, closed).distinct()
    counted = reduce(DataFrame.union, (df.select(F.lit(d).alias("depth"), "context", "next", "n") for d, df in split.items()))
    root = counted.filter("depth = 0")
    return counted.filter("depth > 0").join(states, ["depth", "context"], "left_semi").union(root)


def build(rows: pa.Table, table: np.ndarray) -> Tree:
    """The tree from the kept contexts' counts, with a cell for every symbol: for ``STATES`` contexts at most."""
    depth, context, following, n = (rows[c].to_numpy() for c in ("depth", "context", "next", "n"))
    order = np.lexsort((following, context, depth))
    depth, context, following, n = depth[order], context[order], following[order], n[order]
    states: dict[tuple[int, int], int] = {(0, 0): 0}
    for key in zip(depth.tolist(), context.tolist(), strict=True):
        states.setdefault(key, len(states))
    counts = np.zeros((len(states), SYMBOLS))
    index = np.array([states[k] for k in zip(depth.tolist(), context.tolist(), strict=True)], np.int64)
    counts[index, following] = n
    child = np.full((len(states), SYMBOLS), -1, np.int32)
    p = np.empty((len(states), SYMBOLS))
    p[0] = (counts[0] + 0.5) / (counts[0].sum() + 0.5 * SYMBOLS)
    for (d, c), k in states.items():  # shorter contexts come first
        if d:
            up = states[d - 1, c & ((1 << BITS * (d - 1)) - 1)]
            child[up, c >> BITS * (d - 1)] = k
            p[k] = (counts[k] + PARENT_WEIGHT * p[up]) / (counts[k].sum() + PARENT_WEIGHT)
    return Tree(child, np.log10(p).astype(np.float32), table, _other(table))


def _other(table: np.ndarray) -> float:
    """log10 of each byte's part of what the last symbol has."""
    return float(np.log10(1 / max(1, int((table == OTHER).sum()))))


def build_part(rows: pa.Table, low: int, high: int, table: np.ndarray) -> Part:
    """A part from ``run, n``: its contexts, those of less than ``SPLIT`` symbols and the root."""
    runs, n = rows["run"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(runs)
    runs, n = runs[order], n[order].astype(float)
    level = np.searchsorted(runs, [1 << BITS * (d + 1) for d in range(DEPTH + 2)])
    root = np.zeros(SYMBOLS)
    root[runs[: level[1]] & MASK] = n[: level[1]]
    root = (root + 0.5) / (root.sum() + 0.5 * SYMBOLS)
    p, states, backs = np.empty(len(runs)), [], []
    for d in range(1, DEPTH + 1):
        a, b = level[d], level[d + 1]
        context, index = np.unique(runs[a:b] >> BITS, return_inverse=True)
        total = np.bincount(index, n[a:b], len(context)) + PARENT_WEIGHT
        if d == 1:
            up = root[runs[a:b] & MASK]
        else:  # what follows a context follows its suffix, which is in the tree
            shorter = (runs[a:b] & ((1 << BITS * d) - 1)) | (1 << BITS * d)
            up = p[level[d - 1] + np.searchsorted(runs[level[d - 1] : a], shorter)]
        p[a:b] = (n[a:b] + PARENT_WEIGHT * up) / total[index]
        states.append(context)
        backs.append(PARENT_WEIGHT / total)
    a = level[1]
    logs = [np.log10(x).astype(np.float32) for x in (root, p[a:], np.concatenate(backs))]
    return Part(logs[0], runs[a:], logs[1], np.concatenate(states), logs[2], low, high, table, _other(table))


def parts(rows: DataFrame, table: np.ndarray) -> Iterator[Tree | Part]:
    """The whole tree from ``depth, context, next, n``, one part after the other."""
    if rows.select("depth", "context").distinct().count() <= STATES:
        yield build(rows.toArrow(), table)
        return
    run = F.expr(f"shiftleft(1L, {BITS} * (depth + 1)) | shiftleft(context, {BITS}) | next")
    last = F.col("context").bitwiseAND(F.lit((1 << BITS * SPLIT) - 1))
    cuts = [0, 1 << BITS * SPLIT]
    if rows.filter(F.col("depth") >= SPLIT).count() > PART:
        sizes = rows.filter(F.col("depth") >= SPLIT).groupBy(last.alias("last")).agg(F.count("*").alias("n")).toArrow()
        order = np.argsort(sizes["last"].to_numpy())
        cuts, held = [0], 0
        for code, n in zip(sizes["last"].to_numpy()[order].tolist(), sizes["n"].to_numpy()[order].tolist(), strict=True):
            if held and held + n > PART:
                cuts.append(code)
                held = 0
            held += n
        cuts.append(1 << BITS * SPLIT)
    for low, high in zip(cuts, cuts[1:], strict=False):
        mine = rows.filter((F.col("depth") < SPLIT) | ((last >= low) & (last < high)))
        yield build_part(mine.select(run.alias("run"), "n").toArrow(), low, high, table)


def token_scores(tree: Tree | Part, group: list[list[bytes]]) -> np.ndarray:
    """log10 probability in the tree of every token of every text, its end the last.

    Those of the parts of a tree add up to those of the tree.
    """
    empty_text = tree.start()
    full = [w for w in group if w]
    if not full:
        return np.full(len(group), empty_text)
    symbols, _, bounds = _stream(full, tree.table)
    lead = np.zeros(len(symbols), bool)
    for k in range(DEPTH):
        lead[bounds[:-1] + k] = True
    at = np.flatnonzero(~lead)
    said = symbols[at]
    scores = tree.scorer(symbols, at)
    logs = scores(said)
    logs[said == OTHER] += tree.other
    # a close is first any close, which ends its word, then an end or else a blank
    blank = tree.table[32]
    closes = np.flatnonzero((said == END) | (said == blank))
    ten = np.log(10)
    any_close = np.logaddexp(scores(END, closes) * ten, scores(blank, closes) * ten) / ten
    elsewhere = tree.outside(symbols, at)
    if elsewhere is not None:
        logs[elsewhere], any_close[elsewhere[closes]] = 0.0, 0.0
    choice = logs[closes] - any_close
    words = np.add.reduceat(logs, np.concatenate([[0], closes[:-1] + 1])) - choice
    # the choice of a blank goes to the next word, that of an end is the end token
    ends = said[closes] == END
    words[1:] += np.where(ends[:-1], 0.0, choice[:-1])
    tokens = np.full(sum(len(w) + 1 for w in group), empty_text)
    last = np.cumsum([len(w) + 1 for w in group]) - 1
    is_word = np.ones(len(tokens), bool)
    is_word[last] = False
    tokens[is_word] = words
    tokens[last[[bool(w) for w in group]]] = choice[ends]
    return tokens


def _start(tree: Tree) -> int:
    """The state before a text's first symbol."""
    node = 0
    for _ in range(DEPTH):
        if tree.child[node, END] < 0:
            break
        node = tree.child[node, END]
    return node


def _summed(tree: Tree | Part, keys: list, group: list[list[bytes]]) -> np.ndarray:
    """Scores of the tokens, with those of the parts before, which the keys carry."""
    logs = token_scores(tree, group)
    if "said" in keys[0]:
        logs += np.frombuffer(b"".join(k["said"] for k in keys), np.float64)
    return logs


def _by_parts(slim: DataFrame, trees: Iterator[Tree | Part], scratch: Scratch) -> tuple[DataFrame, Tree | Part]:
    """``slim`` with the tokens' scores of all parts but the last in its keys, and the last part."""
    tree, done = next(trees), 0
    kind = slim.schema["key"].dataType["doc_id"].dataType.simpleString()
    for after in trees:
        shared = slim.sparkSession.sparkContext.broadcast(tree)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, doc_id = batch.column(0).field("row"), batch.column(0).field("doc_id")
                at = 0
                for keys, group in _texts([batch]):
                    ends = np.cumsum([len(w) + 1 for w in group])
                    said = [x.tobytes() for x in np.split(_summed(shared.value, keys, group), ends[:-1])]
                    mine = slice(at, at + len(keys))
                    columns = [row[mine], doc_id[mine], pa.array(said, pa.binary()), batch.column(1)[mine]]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "said", "text"])
                    at += len(keys)

        found = slim.mapInArrow(run, f"row long, doc_id {kind}, said binary, text string")
        slim = scratch.keep(found, f"part-{done}").select(F.struct("row", "doc_id", "said").alias("key"), "text")
        if done:
            scratch.drop(f"part-{done - 1}")
        shared.destroy()
        tree, done = after, done + 1
    return slim, tree


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Null, empty and all-space texts are the end alone.  Without training texts every count is
    0, the base knows one class and the tree is uniform.  Repeated rows and null ids are
    scored each by itself; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    learned = training.select(F.col("text").cast("string").alias("text"))
    table = symbol_table(byte_counts(learned))
    counts = scratch.keep(corpus_counts(learned, table), "counts")
    words = counts.filter("kind = 0").select("code", "n")
    size = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once")
    ).first()
    total, distinct = size["n"], size["v"]
    # the share of new words, never quite none or all
    new = min(0.5, max(size["once"], 0.5) / total) if total else 0.5
    known_share = float(SHARE * (1 - new) / max(1, total))
    heavy = largest(words, "n", HEAVY).toArrow()
    order = np.argsort(heavy["code"].to_numpy())
    heavy_codes, heavy_counts = heavy["code"].to_numpy()[order], heavy["n"].to_numpy()[order]
    runs = scratch.keep(contexts(counts.filter("kind = 1").select("code", "n"), scratch), "tree")
    slim = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    slim, tree = _by_parts(slim, parts(runs, table), scratch)
    shared = spark.sparkContext.broadcast((tree, heavy_codes, heavy_counts))
    scale = float(np.log10(total + 0.1 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, codes, known = shared.value
        hashes = _Hashes()
        for keys, group in _texts(batches):
            logs = _summed(tree, keys, group)
            sizes = np.fromiter((len(w) + 1 for w in group), np.int64, len(group))
            every = np.full(len(logs), END_HASH)
            is_word = np.ones(len(logs), bool)
            is_word[np.cumsum(sizes) - 1] = False
            every[is_word] = [hashes[w] for words in group for w in words]
            owner = np.repeat(np.arange(len(group)), sizes)
            place = np.minimum(np.searchsorted(codes, every), max(0, len(codes) - 1))
            found = codes[place] == every if len(codes) else np.zeros(len(every), bool)
            c = known[place[found]]
            base = np.bincount(owner[found], np.log10(c + 0.1) - scale, len(group)).astype(float)
            mixed = np.logaddexp(np.log(known_share * c), np.log(1 - SHARE) + logs[found] * np.log(10)) / np.log(10)
            scores = np.bincount(owner[found], mixed, len(group)).astype(float)
            n_known = np.bincount(owner[found], minlength=len(group)).astype(np.int64)
            row = np.array([k["row"] for k in keys], np.int64)
            ids = pa.array([k["doc_id"] for k in keys], id_type)
            none = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), none, ids, pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(scores)], names
            )
            n = int((~found).sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row[owner[~found]]), pa.array(every[~found]), pa.nulls(n, id_type), pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(logs[~found]),
                ],
                names,
            )

    names = ["row", "code", "doc_id", "n", "n_known", "base", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    said = scratch.keep(slim.mapInArrow(run, f"row long, code long, doc_id {kind}, n long, n_known long, base double, score double"), "said")

    # words that are not among the frequent ones: one row for each time they are said
    light = said.filter("code IS NOT NULL").select("row", "code", "score").join(words.withColumnRenamed("n", "c"), "code", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    in_tree = F.col("score") + float(np.log10(1 - SHARE))
    share = F.when(c == 0, F.lit(float(np.log10(SHARE * new)))).otherwise(F.log10(c * known_share))
    mixed = F.greatest(in_tree, share) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(in_tree - share)))
    rest = light.groupBy("row").agg(
        F.sum(F.log10(c + 0.1) - F.lit(scale)).alias("light_base"), F.sum(F.when(c > 0, 1).otherwise(0)).alias("light_known"),
        F.sum(mixed).alias("light_score"),
    )
    whole = said.filter("code IS NULL").join(rest, "row", "left")
    none = F.lit(0.0)
    return whole.select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("light_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("light_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("light_score", none)).alias("score"),
    )
