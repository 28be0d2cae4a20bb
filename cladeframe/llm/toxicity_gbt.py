"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a learned lexicon, its nearness to words of the second
person, capitals, punctuation and obfuscation.  The lexicon comes from the labelled rows:
for every word, and its first four and six letters, in how many toxic and how many other
texts it stands.  Trees and calibration are fitted by Spark on the labelled rows, on
separate parts of them; the calibration sees scores on a grid, so its size never grows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch

#: Entries of the lexicon; least toxic texts and log-odds of one.
LEXICON, LEAST_TEXTS, LEAST_ODDS = 4096, 5, 1.0
TREES, DEPTH, RATE = 20, 3, 0.3
#: Part of the labelled rows that calibrates, and the steps of its score grid.
CALIBRATION, GRID = 0.25, 1000
#: So many labels are sent to every task, a hash table of some 32 MB.
SENT_LABELS = 1_000_000
#: A lexicon word is near the second person within so many words.
NEAR = 4

# Words of the second person, and what digits and signs stand for in a word.
SECOND = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes tú ti os vosotros".split()
)
SIGNS = str.maketrans("0134578@$!", "oieastbasi")

_EDGES = regex.compile(r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}@$]+$")
_LETTERS = regex.compile(r"[^\p{L}]+")

FEATURES = (
    "lexicon_density", "lexicon_odds", "lexicon_top", "lexicon_count", "lexicon_kinds", "near_second", "second_density",
    "capital_share", "capital_words", "exclaim_rate", "repeat_marks", "obfuscated_rate", "obfuscated_lexicon", "log_words",
)


def keys(word: str) -> list[str]:
    """Lexicon keys of a folded word: itself, closed by a blank, and its first letters."""
    return [f"{word} ", word[:4], word[:6]] if len(word) > 6 else [f"{word} ", word[:4]] if len(word) > 4 else [f"{word} "]


def parts(token: str) -> tuple[str, str, str]:
    """A token without its outer marks, its word, and the word behind digits and signs."""
    core = token if token.isalpha() else _EDGES.sub("", token)
    low = core.lower()
    if core.isalpha():
        return core, low, low
    return core, _LETTERS.sub("", low), _LETTERS.sub("", low.translate(SIGNS))


def lexicon(labelled: DataFrame, scratch: Scratch) -> dict[str, float]:
    """Key -> log-odds of standing in a toxic text, from ``(text, toxic)``; all rows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        known: dict[str, list[str]] = {}

        def out() -> pa.RecordBatch:
            names = list(found)
            columns = [pa.array(names, pa.string())] + [pa.array([found[k][j] for k in names], pa.int64()) for j in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["key", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                said: set[str] = set()
                for token in set((text or "").split()):
                    if token not in known:
                        word = parts(token)[1]
                        known[token] = keys(word) if word else []
                    said.update(known[token])
                for k in said:
                    found[k][toxic] += 1
                found[""][toxic] += 1
            if len(known) > 300_000:
                known.clear()
            if len(found) > 300_000:
                yield out()
                found.clear()
        yield out()

    partial = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "key string, clean long, toxic long")
    counts = scratch.keep(partial.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    total = counts.filter("key = ''").first()
    if total is None or not total["clean"] or not total["toxic"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1.0))
    best = counts.filter(f"key <> '' AND toxic >= {LEAST_TEXTS}").withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    top = best.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "key").limit(LEXICON)
    return {r["key"]: r["odds"] for r in top.select("key", "odds").collect()}


class _Words(dict):
    """Token -> number of its row in ``values``: odds, second person, capitals, obfuscation
    (two columns), letters, upper-case letters."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds, self.values = odds, np.zeros((1024, 7))

    def _odds(self, word: str) -> float:
        return max((self.odds.get(k, 0.0) for k in keys(word)), default=0.0) if word else 0.0

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        if at == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        core, word, hidden = parts(token)
        odds = self._odds(word)
        behind = self._odds(hidden) if hidden != word else odds
        mixed = hidden != word and core[0].isalpha()
        self.values[at] = (
            max(odds, behind), word in SECOND, len(word) > 1 and token.isupper(), mixed, odds == 0.0 and behind > 0,
            len(word), sum(map(str.isupper, token)),
        )
        return at


def _features(text: str, words: _Words) -> list[float]:
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    index = np.fromiter(map(words.__getitem__, tokens), np.int64, n)
    odds, second, capital, mixed, hidden, letters, upper = words.values[index].T
    hit = odds > 0
    you = np.flatnonzero(second)
    near = 0.0
    if len(you) and hit.any():
        places = np.flatnonzero(hit)
        right = np.searchsorted(you, places)
        gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - places), np.abs(you[np.maximum(right - 1, 0)] - places))
        near = float((gap <= NEAR).sum())
    return [
        hit.mean(), odds.sum() / n, odds.max(), math.log1p(hit.sum()), len(np.unique(index[hit])), near, second.mean(),
        upper.sum() / max(1.0, letters.sum()), capital.mean(), (text.count("!") + text.count("?")) / len(text), text.count("!!") + text.count("??"),
        mixed.mean(), hidden.sum(), math.log1p(n),
    ]


def features(docs: DataFrame, odds: dict[str, float], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the dense features of every row; null and empty texts have zeros."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(odds)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                if len(words) > 300_000:
                    words = _Words(odds)
                rows.append(_features(text.as_py() or "", words))
            table = np.array(rows, float).reshape(-1, len(FEATURES))
            columns = [batch.column(k) for k in range(len(keep))] + [pa.array(np.ascontiguousarray(c)) for c in table.T]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *FEATURES])

    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, ", ".join([*kinds, *(f"{f} double" for f in FEATURES)]))


def score(docs: DataFrame, labels: DataFrame, learns: str | None = None) -> DataFrame:
    """``doc_id, score`` for every row; learned from labelled rows where ``learns`` holds.

    ``learns`` is a condition on doc_id.  Of several labels of one id the larger counts,
    null ones do not.  Null and empty texts are scored by their zero features.  With no
    labelled row every score is 0, with one class alone it is that class.  Repeated rows
    and null ids are scored each by itself; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxic")
    said = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if learns is not None:
        said = said.filter(learns)
    said = scratch.keep(said, "labels")
    texts = docs.select("doc_id", "text")
    # few labels go to the texts, many meet them in a shuffle
    near = F.broadcast(said) if said.count() <= SENT_LABELS else said
    odds = lexicon(texts.join(near, "doc_id").select("text", "toxic"), scratch)
    measured = scratch.keep(features(texts, odds, ["doc_id"]), "features")

    rows = measured.join(said, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1000)) < 1000 * CALIBRATION)
    rows = scratch.keep(rows, "labelled")
    sizes = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    if {(False, 0), (False, 1)} - set(sizes):
        toxic = sum(n for (_, label), n in sizes.items() if label == 1)
        return measured.select("doc_id", F.lit(1.0 if toxic and toxic == sum(sizes.values()) else 0.0).alias("score"))
    pack = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    trees = GBTClassifier(
        featuresCol="x", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=11, maxBins=32, subsamplingRate=1.0
    ).fit(pack.transform(rows.filter("NOT part")))

    def cell(df: DataFrame) -> DataFrame:
        p = vector_to_array(F.col("probability"))[1]
        return trees.transform(pack.transform(df)).withColumn("cell", F.round(p * GRID).cast("int"))

    steps = np.arange(GRID + 1)
    values = steps / GRID
    if {(True, 0), (True, 1)} <= set(sizes):
        grid = cell(rows.filter("part")).groupBy(F.col("cell").cast("double").alias("at")).agg(
            F.avg("toxic").alias("label"), F.count("*").cast("double").alias("weight")
        )
        line = IsotonicRegression(featuresCol="at", labelCol="label", weightCol="weight").fit(grid)
        values = np.interp(steps, line.boundaries.toArray(), line.predictions.toArray())
    return cell(measured).select("doc_id", F.get(F.lit(values.tolist()), F.col("cell")).alias("score"))
