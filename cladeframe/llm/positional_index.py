"""Benchmark decontamination by a distributed positional inverted index.

The test items are cut into windows of 13 consecutive words (a shorter item is one window).
Counts of the test words over all training texts tell each window's two rarest words.  The
index keeps the training postings of those words alone: word, row, position, and for the
rarest also the words around it.  A window is found by intersecting its two lists, both
moved back by the word's place in the item, starting from the rarest; what is left is
compared word for word.  A window whose two rarest words stand within 12 words of one
another, in any order, is a proximity match.

Everything here is DataFrame code.  The only broadcasts are blocks of index words of at most
``BLOCK_BYTES``; a larger test set takes one scan of the texts for each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import LOWER, UPPER, Scratch

WINDOW = 13
#: Contaminated from this share of hit words on: SHARE * n_hit >= n_words.
SHARE = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Words of a whole text, A-Z folded; null has none.

    ``lower`` may fold more than A-Z only where the text has other than ASCII characters.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """Split a table of distinct terms by hash so that each block is under ``BLOCK_BYTES``."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    return [terms.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == k) for k in range(n)]


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: how often each of ``terms`` stands in all texts; absent terms are left out."""
    said = docs.select(F.explode(words(F.col("text"))).alias("term"))
    counts = [said.join(F.broadcast(block), "term").groupBy("term").agg(F.count("*").alias("n")) for block in _blocks(terms)]
    return reduce(DataFrame.union, counts)


def windows(items: DataFrame) -> DataFrame:
    """``item, item_id, start, window``: every window of every item with a word and an id."""
    cut = items.filter("size(w) > 0 AND item_id IS NOT NULL").withColumn("span", F.least(F.size("w"), F.lit(WINDOW)))
    starts = cut.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("span"))).alias("start"))
    return starts.select("item", "item_id", "start", F.slice("w", F.col("start") + 1, F.col("span")).alias("window"))


def probes(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with places and words of their two rarest terms; ones with an unseen word cannot occur."""
    spread = cut.select("item", "start", F.size("window").alias("span"), F.posexplode("window").alias("place", "term"))
    ranked = spread.join(counts, "term").groupBy("item", "start", "span").agg(
        F.array_sort(F.collect_list(F.struct("n", "term", "place"))).alias("r")  # at most 13 rows
    )
    kept = ranked.filter(F.size("r") == F.col("span")).select(
        "item", "start", F.col("r")[0].alias("one"), F.get("r", F.least(F.lit(1), F.size("r") - 1)).alias("two")
    )
    return cut.join(kept, ["item", "start"]).select(
        "item", "item_id", "start", "window",
        F.col("one.term").alias("term"), F.col("one.place").alias("place"),
        F.col("two.term").alias("term2"), F.col("two.place").alias("place2"),
    )


def postings(docs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The index: ``row, doc_id, pos, term, rarest, around, at`` for the terms asked for.

    One more row for each text, with a null term, has its number of words as ``pos``.
    ``around`` holds up to 12 words on both sides of a rarest term, which stands at ``at``.
    """
    marked = first.select("term", F.lit(True).alias("rarest")).union(second.select("term", F.lit(False).alias("rarest")))
    terms = marked.groupBy("term").agg(F.max("rarest").alias("rarest"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    said = texts.select("row", "doc_id", "w", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "term"))
    low = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
    columns = [
        "row", "doc_id", "pos", "term", "rarest",
        F.when(F.col("rarest"), F.slice("w", low + 1, F.lit(2 * WINDOW - 1))).alias("around"), (F.col("pos") - low).alias("at"),
    ]
    out = []
    for k, block in enumerate(_blocks(terms)):
        found = said.join(F.broadcast(block), "term", "left").filter(
            F.col("rarest").isNotNull() | (F.col("term").isNull() if k == 0 else F.lit(False))
        )
        out.append(found.select(*columns))
    return reduce(DataFrame.union, out)


def matches(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact occurrences ``row, item, item_id, start, pos, span`` and proximity matches ``row, item_id``.

    ``start`` is the window's first word in the item, ``pos`` its first word in the text.
    """
    held = index.filter("term IS NOT NULL")
    one = held.filter("rarest").join(asked, "term").withColumn("from", F.col("pos") - F.col("place"))
    near = one.filter(F.array_contains("around", F.col("term2"))).select("row", "item_id").distinct()
    # the second list, moved back by the place of its word
    pairs = asked.select("item", "start", F.col("term2").alias("term"), "place2")
    two = held.select("row", "pos", "term").join(pairs, "term").select(
        "row", "item", "start", (F.col("pos") - F.col("place2")).alias("from")
    )
    both = one.filter(F.array_contains("around", F.col("term2"))).join(two, ["row", "item", "start", "from"], "left_semi")
    begin = F.col("at") - F.col("place") + 1
    # a start before the text's first word cannot match; slice() takes no start below 1
    same = (begin >= 1) & (F.slice("around", F.greatest(begin, F.lit(1)), F.size("window")) == F.col("window"))
    exact = both.filter(same).select("row", "item", "item_id", "start", F.col("from").alias("pos"), F.size("window").alias("span"))
    return exact, near


def hit_words(exact: DataFrame) -> DataFrame:
    """``row, n_hit``: words inside any occurrence, each counted once.

    Occurrences are taken in order of their first word; each adds what lies beyond the
    furthest end before it.  A window group is one text's distinct starts.
    """
    spans = exact.groupBy("row", "pos").agg(F.max(F.col("pos") + F.col("span")).alias("end"))
    before = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    added = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("pos"), reached))
    return spans.select("row", added.alias("added")).groupBy("row").agg(F.sum("added").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, n_near, contaminated`` for every row of ``docs``.

    ``items`` is the sorted array of item ids, as strings, with an occurring window;
    ``n_near`` counts items with a proximity match.  Null and empty texts have no words and
    are clean.  Items without words or id ask for nothing; repeated items count once by id.
    Rows that repeat a doc_id are judged each by its own text.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "index")
    items = scratch.keep(
        benchmark.select(
            F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"),
            words(F.col("text")).alias("w"),
        ),
        "items",
    )
    cut = scratch.keep(windows(items), "windows")
    vocabulary = cut.select(F.explode("window").alias("term")).distinct()
    counts = scratch.keep(term_counts(docs, scratch.keep(vocabulary, "vocabulary")), "counts")
    asked = scratch.keep(probes(cut, counts), "probes")
    one = scratch.keep(asked.select("term").distinct(), "rarest")
    two = scratch.keep(asked.select(F.col("term2").alias("term")).distinct(), "second")
    index = scratch.keep(postings(docs.select("doc_id", "text"), one, two), "postings")

    exact, near = matches(index, asked)
    exact = scratch.keep(exact, "exact")
    found = exact.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    close = near.groupBy("row").agg(F.count("*").alias("n_near"))
    rows = index.filter("term IS NULL").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    whole = rows.join(hit_words(exact), "row", "left").join(found, "row", "left").join(close, "row", "left")
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return whole.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )
