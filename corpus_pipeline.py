"""A corpus pipeline: language, near copies, benchmark passages, secrets, tokens.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns the documents that go on, or, the last, what was encoded.  ``run`` writes each
stage's result as Parquet to the folder that the cluster shares and reads it back as the
next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import byte_bpe, hamming_dedup, language_ftrl, positional_index, secret_markov
from cladeframe.llm.common import Scratch, documents, id_remainder

#: Below this score a language is rejected.
LEAST_SCORE = 0.5
#: So many row keys are sent to every task, a hash table of some 32 MB.
SENT_KEYS = 1_000_000
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _row() -> Column:
    """A row's key: its id and text, so ids that repeat or are null do not decide for each other."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def _gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``, a written table of ``row``.

    Few keys are sent to the texts, many meet them in a shuffle.
    """
    return docs.join(F.broadcast(gone) if gone.count() <= SENT_KEYS else gone, _row() == gone["row"], "left_anti")


def _without(docs: DataFrame, verdicts: DataFrame, keeps: str, name: str) -> DataFrame:
    """``docs`` without the rows for whose key (``row``) ``verdicts`` does not have ``keeps``."""
    gone = verdicts.filter(f"NOT ({keeps})").select("row").distinct()
    return _gone(docs, Scratch(docs.sparkSession, "gone").keep(gone, name))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some certainty; ``und`` and doubtful ones go.

    The model learns from the rows of ``docs`` whose id's remainder modulo 4 is not 2.  Rows
    that repeat an id or have none are judged each by its own text.  Without any row with a
    lang there is no model to reject by, and every text with a letter stays.
    """
    model = language_ftrl.fit(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_ftrl.identify(docs.select(_row().alias("row"), "text"), model, "row")
    return _without(docs, found, f"lang_pred <> '{language_ftrl.UNKNOWN}' AND score >= {LEAST_SCORE}", "languages")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies; rows without an id come last.

    Rows that repeat an id are grouped each by its own text; of equal rows one stays.  Texts
    without words are copies of nothing.
    """
    scratch = Scratch(spark, "copies")
    found = hamming_dedup.near_duplicates(docs.select(_row().alias("doc_id"), "text"))
    found = scratch.keep(found.withColumnRenamed("doc_id", "row"), "found")
    # of groups with several keys each key once, with its id
    copies = found.filter("row <> component_id").select("row", "component_id").distinct()
    members = scratch.keep(copies.union(copies.select(F.col("component_id").alias("row"), "component_id").distinct()), "members")
    ids = docs.select(_row().alias("row"), "doc_id").distinct().join(members, "row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    left = _gone(docs, scratch.keep(members.join(first, "row", "left_anti").select("row"), "gone"))
    equal = found.filter("n_shingles > 0").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    equal = scratch.keep(equal, "equal")
    if not equal.count():
        return left
    one = left.join(equal, _row() == equal["row"], "left_semi").dropDuplicates(["doc_id", "text"])
    return _gone(left, equal).union(one)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, each row judged by its own text."""
    keyed = docs.select(_row().alias("doc_id"), "text")
    found = positional_index.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.withColumnRenamed("doc_id", "row"), "NOT contaminated", "contaminated")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``<secret>`` in the place of every secret and n_chars of the new text."""
    found = secret_markov.scan(docs, into="_secret_spans")
    clean = found.withColumn("text", secret_markov.redacted(F.col("text"), F.col("_secret_spans")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.char_length("text").cast(kind)
        clean = clean.withColumn("n_chars", F.when(F.size("_secret_spans") > 0, changed).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document that is left."""
    return byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("secret_scan", secrets),
    ("byte_bpe", tokens),
]

#: Fitted models and merges have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
