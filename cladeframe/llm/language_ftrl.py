"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text (anything but a letter
reads as a space), weighted by TF-IDF and scaled to length 1.  Document frequencies are
counted over all training texts.  The classifier is fitted on a bounded sample, at most
``FIT_ROWS`` rows of each language, by follow-the-regularised-leader with elastic-net
penalties, and its scores are calibrated by a temperature fitted on rows it was not
trained on.  Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 14
SIZE = 1 << BITS
#: Rows of one language that the classifier is fitted on, of which CALIBRATION are held back.
FIT_ROWS, CALIBRATION = 1000, 0.2
#: Most characters of the rows that are fitted on together: it bounds the fitting task.
FIT_CHARS = 64_000_000
#: A text above this share of its language's room is fitted on only after all shorter ones.
LONG = 0.01
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 0.002, 0.001
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    points = [p for p in range(0x110000) if chr(p).isalpha()]
    table[points] = points
    return table


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram stands in the text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[points] * _A
    c ^= c >> np.uint32(15)
    total = np.zeros(SIZE, np.int64)
    shift = np.uint32(32 - BITS)
    h = c * _B
    total += np.bincount(h >> shift, minlength=SIZE)
    for k in (1, 2):
        if len(c) > k:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * _C + c[k:] * _B
            total += np.bincount(h >> shift, minlength=SIZE)
    return total


@dataclass(frozen=True)
class Model:
    """Languages, inverse document frequencies, weights (the last column is the bias), temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def _vector(text: str, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(ngram_counts(text)) * idf
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def frequencies(texts: DataFrame) -> DataFrame:
    """``feature, n``: in how many texts each feature stands; feature -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen += ngram_counts(text.as_py()) > 0
                rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[rows], seen[at]]))], ["feature", "n"]
        )

    partial = texts.filter("text IS NOT NULL").select("text").mapInArrow(run, "feature int, n long")
    return partial.groupBy("feature").agg(F.sum("n").alias("n"))


def _fit(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """FTRL-proximal over sparse examples ``(places, values, class)``, one at a time."""
    z, n = np.zeros((classes, SIZE + 1)), np.zeros((classes, SIZE + 1))

    def weights(at) -> np.ndarray:
        zz, nn = z[:, at], n[:, at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(nn)) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            at, values, label = examples[k]
            w = weights(at)
            scores = w @ values
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * values
            more = g * g
            z[:, at] += g - (np.sqrt(n[:, at] + more) - np.sqrt(n[:, at])) / ALPHA * w
            n[:, at] += more
    return weights(slice(None))


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores that makes held-back labels likeliest, from 1/16 to 16."""

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    return min(np.exp(np.linspace(-np.log(16), np.log(16), 81)), key=loss) if len(labels) else 1.0


def fit(training: DataFrame) -> Model | None:
    """A model from ``(doc_id, text, lang)``; None if no row has text with a letter and lang.

    Document frequencies come from all rows.  The rows to fit on are each language's first
    by a hash of doc_id and text, within the two bounds; they go to one task.  A row that is
    repeated is fitted on once, and very long texts come last, so neither uses up the bounds.
    """
    rows = training.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = tuple(sorted(sizes))
    counted = dict(frequencies(rows).collect())
    total = counted.pop(-1)
    idf = np.full(SIZE, np.log(1 + total))
    for feature, n in counted.items():
        idf[feature] = np.log((1 + total) / (1 + n)) + 0.1

    # a threshold on the hash leaves a little more than is wanted, the window takes the rest
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, (2 * FIT_ROWS + 50) / n))))
    few = rows.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")] * (1 << 30)).distinct()
    room = FIT_CHARS // len(languages)
    long = F.char_length("text") > room * LONG
    first = Window.partitionBy("lang").orderBy(long, "draw", "doc_id", "text")
    sample = few.withColumn("rank", F.row_number().over(first)).withColumn("chars", F.sum(F.char_length("text")).over(first))
    sample = sample.filter((F.col("rank") <= FIT_ROWS) & ((F.col("chars") <= room) | (F.col("rank") == 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                x = _vector(text.as_py(), idf)
                at = np.flatnonzero(x)
                values = np.append(x[at], 1.0)
                examples.append((np.append(at, SIZE), values, languages.index(lang.as_py())))
        held = [e for k, e in enumerate(examples) if k % round(1 / CALIBRATION) == 0] if len(examples) > 20 else []
        used = [e for k, e in enumerate(examples) if k % round(1 / CALIBRATION)] if held else examples
        w = _fit(used, len(languages))
        scores = np.array([w[:, at] @ v for at, v, _ in held]).reshape(-1, len(languages))
        t = _temperature(scores, np.array([c for *_, c in held], int))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([t])], ["w", "t"])

    order = ["draw", "doc_id", "lang", "text"]
    one = sample.select(*order).repartition(1).sortWithinPartitions(*order).mapInArrow(run, "w binary, t double").first()
    w = np.frombuffer(one["w"], np.float32).reshape(len(languages), SIZE + 1)
    return Model(languages, idf, w, one["t"])


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` of every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text
    without a model.  With one learned language every other text has it, with score 1.
    Repeated rows stay, columns besides ``key`` and text are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                if model is None or not text or not _LETTER.search(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                s = (model.weights[:, :SIZE] @ _vector(text, model.idf).astype(np.float32) + model.weights[:, SIZE]) / model.temperature
                p = np.exp(s - s.max())
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best] / p.sum()))
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "lang_pred", "score"])

    slim = docs.select(key, F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
