"""Registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import (
    block_search, byte_bpe, hamming_dedup, label_shards, language_ftrl, link_trust, positional_index, repetition, secret_markov,
    spelling_index, suffix_tree_lm, token_trees, toxicity_gbt,
)
from cladeframe.llm.common import documents, id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


#: Distinct shingles, pairs by shared shingles, and the closure of the links.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (
  SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.r), s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(min(r.r), s.doc_id)) AS kept
FROM sets s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""


@query("op2_near_duplicates", sql=NEAR_SQL)
def _(spark, sf_dir):
    return hamming_dedup.near_duplicates(documents(spark, sf_dir))


#: All windows of all texts against all windows of the items, word for word.
INDEX_SQL = r"""
WITH folded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
asked AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(w)) AS span, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM asked),
said AS (
  SELECT doc_id, s, span, array_to_string(w[s : s + span - 1], ' ') AS x
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM folded, spans WHERE len(w) >= span)),
found AS MATERIALIZED (SELECT doc_id, s, a.span, item_id FROM said JOIN asked a ON a.x = said.x AND a.span = said.span),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
  sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM folded f LEFT JOIN hits h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""


@query("op9_positional_index", sql=INDEX_SQL)
def _(spark, sf_dir):
    found = positional_index.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op5_byte_bpe")
def _(spark, sf_dir):
    return byte_bpe.round_trip(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


@query("op7_secret_markov")
def _(spark, sf_dir):
    found = secret_markov.scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(secret_markov.RULES)),
        F.sha2(secret_markov.shown(F.col("spans"), base_only=True).cast("binary"), 256).alias("base_sha256"),
        secret_markov.shown(F.col("spans")).alias("spans"),
    )


def language_model(docs: DataFrame) -> language_ftrl.Model | None:
    return language_ftrl.fit(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))


@query("op8_language_ftrl")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = language_ftrl.identify(docs, language_model(docs))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_repetition")
def _(spark, sf_dir):
    return repetition.rules(documents(spark, sf_dir))


@query("op4_label_shards")
def _(spark, sf_dir):
    return label_shards.assign(documents(spark, sf_dir))


@query("op10_toxicity_gbt")
def _(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity_gbt.score(documents(spark, sf_dir), labels, "crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_suffix_tree_lm")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # a null id has no remainder: its text is scored, not learned from
    scored = suffix_tree_lm.score(docs, docs.filter(id_remainder(F.col("doc_id"), 10) != 0))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The edits of the counting query: addresses and long numbers are masked.
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+|[0-9]{5,}"


@query("op1_token_trees")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    edited = docs.withColumn("edits", token_trees.masking_edits(F.col("text"), MASKED, "<masked>"))
    return token_trees.recount(edited, RANKS, public_tokenizers.PATTERN)


#: Every document's score for every item, word for word.
SEARCH_SQL = r"""
WITH said AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
held AS (SELECT doc_id, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query("op11_block_search", sql=SEARCH_SQL)
def _(spark, sf_dir):
    return block_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The walk's steps by a recursive query over the flows of both directions.
TRUST_SQL = r"""
WITH RECURSIVE read AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
ruled AS (
  SELECT page_id, host, path, html, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM read),
seeds AS (
  SELECT host, avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0 ELSE 0.0 END) AS allowed,
    avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1.0 ELSE 0.0 END) AS blocked FROM ruled WHERE host <> '' GROUP BY host),
linked AS (
  SELECT host AS a, translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b
  FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''),
    '(?i)\b(?:href|src|action)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s"''<>]+)', 1)) AS b FROM ruled WHERE host <> '')),
hosts AS (SELECT host AS name FROM ruled WHERE host <> '' UNION SELECT b FROM linked),
line AS (
  SELECT DISTINCT array_to_string(l[k:], '.') AS name
  FROM (SELECT string_split(name, '.') AS l, unnest(range(1, greatest(2, len(string_split(name, '.'))))) AS k FROM hosts)),
chain AS (
  SELECT name, regexp_extract(name, '^[^.]*\.(.*)$', 1) AS up FROM line
  WHERE len(string_split(name, '.')) > 2 AND NOT regexp_matches(name, '(^|\.)[0-9]*$') AND NOT contains(name, ':')),
edges AS (
  SELECT a, b, count(*) AS n
  FROM (SELECT a, b FROM linked WHERE a <> b UNION ALL SELECT name, up FROM chain UNION ALL SELECT up, name FROM chain) GROUP BY a, b),
both_ways AS (SELECT a AS src, b AS dst, false AS against, n FROM edges UNION ALL SELECT b, a, true, n FROM edges),
flows AS MATERIALIZED (
  SELECT src, dst, against, CAST(0.85 AS DOUBLE) * n / sum(n) OVER (PARTITION BY src, against) AS share FROM both_ways),
walk(k, host, against, own, every) AS (
  SELECT 0, host, false, CAST(allowed AS DOUBLE), CAST(1 AS DOUBLE) FROM seeds
  UNION ALL SELECT 0, host, true, CAST(blocked AS DOUBLE), CAST(1 AS DOUBLE) FROM seeds
  UNION ALL SELECT any_value(w.k) + 1, f.dst, f.against, sum(w.own * f.share), sum(w.every * f.share)
  FROM walk w JOIN flows f ON f.src = w.host AND f.against = w.against WHERE w.k < 20 GROUP BY f.dst, f.against),
ranks AS (SELECT host, against, sum(own) / sum(every) AS rank FROM walk GROUP BY host, against),
judged AS (
  SELECT host, coalesce(max(rank) FILTER (NOT against), 0) AS trust, coalesce(max(rank) FILTER (against), 0) AS distrust FROM ranks GROUP BY host)
SELECT r.page_id, r.host, r.path, r.rule, CASE
    WHEN r.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow'
    WHEN j.distrust >= 0.4 - 1e-9 AND j.distrust > j.trust + 1e-9 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN judged j USING (host)
"""


@query("op12_link_trust", sql=TRUST_SQL)
def _(spark, sf_dir):
    return link_trust.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


#: Near words by what is left of them without one code point; the checksum byte by byte.
SPELLING_SQL = r"""
WITH RECURSIVE divided(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM divided WHERE k < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM divided WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS (
  SELECT run, n, doc_id, xor(list_reduce(
      list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, steps),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN doc_id IS NOT NULL AND h % 199 = 0
    THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain(word, tip) AS (SELECT word, word FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.tip WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.tip AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN chain c ON c.word = j.word JOIN judged e ON e.word = c.tip AND e.form IS NULL
"""


@query("op13_search_schemes", sql=SPELLING_SQL)
def _(spark, sf_dir):
    return spelling_index.variants(documents(spark, sf_dir))
