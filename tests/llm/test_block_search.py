import math
import random
import re
from collections import Counter

import numpy as np

from cladeframe.llm import block_search as B
from corpus_texts import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    counted = [(doc_id, Counter(fold(text))) for doc_id, text, *_ in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        found = []
        for d, c in counted:
            m = 25 + 75 * c.total() * n_docs // length
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in fold(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(found[:10])]
    return out


def check(make, spark, docs, items):
    table = spark.createDataFrame([(a, b, 1, 2.0) for a, b in items], "item_id long, text string, rank int, score double")
    got = [tuple(r) for r in B.ranked(make(docs), table).select("item_id", "rank", "doc_id", "score").collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(brute(docs, items), key=order)


def texts(rng, n):
    docs = [(k, rng.choice(["", "W", "É"]) + prose(rng, rng.randrange(1, 80), rng.choice([20, 300]))) for k in range(n)]
    items = [(k, prose(rng, rng.randrange(1, 30), 300)) for k in range(12)]
    return docs, items


def test_scores_and_ranks(make, spark, odd_rows):
    docs, items = texts(random.Random(5), 300)
    docs += [(d, t) for d, t in odd_rows] + [(3, "w5 w5"), (2, "w5 w5"), (None, "w5 w5"), (4, "w5 w5"), (4, "w5 w5")]
    items += [(50, None), (51, ""), (52, "..."), (53, "nowhere"), (None, "w5 w9"), (54, "w5 w5 W5 w9"), (3, items[3][1]), (1, "word"), (55, "été 日本語 \x1c")]
    check(make, spark, docs, items)


def test_many_chunks_and_groups_change_nothing(make, spark, monkeypatch):
    monkeypatch.setattr(B, "CELLS", 2000)
    monkeypatch.setattr(B, "TERMS", 40)
    monkeypatch.setattr(B, "BLOCK", 8)
    monkeypatch.setattr(B, "SHORT", 2)
    monkeypatch.setattr(B, "ROWS", 7)
    monkeypatch.setattr(B, "OPENED", 2)
    check(make, spark, *texts(random.Random(6), 200))


def test_empty_tables(make, spark):
    check(make, spark, [], [(1, "a b")])
    check(make, spark, [(1, "a b"), (2, None)], [])
    check(make, spark, [(1, None), (2, "!")], [(1, "a")])


def test_summaries_bound_their_documents_and_blocks_are_left_out():
    rng = np.random.default_rng(1)
    n_docs, n_terms = 2000, 60
    topic = rng.integers(0, 6, n_docs)
    impact = np.where(rng.random((n_docs, n_terms)) < 0.05, rng.integers(1, 500_000, (n_docs, n_terms)), 0).astype(np.int32)
    for k in range(6):  # like documents share ten terms
        impact[topic == k, 10 * k : 10 * k + 10] = rng.integers(1, 900_000, ((topic == k).sum(), 10))
    weight = rng.integers(1, 9000, n_terms)
    of_term, begins, members, summary, summaries = B._blocks(impact, weight)
    for t in range(n_terms):
        docs = np.concatenate([members[begins[b] : begins[b + 1]] for b in range(of_term[t], of_term[t + 1])])
        assert sorted(docs) == np.flatnonzero(impact[:, t]).tolist()
    for b in range(len(begins) - 1):
        if summary[b] >= 0:
            assert (summaries[summary[b]].astype(np.int64) * B.STEP >= impact[members[begins[b] : begins[b + 1]]]).all()
        else:
            assert begins[b + 1] - begins[b] <= B.SHORT
    chunk = B.Chunk.__new__(B.Chunk)
    chunk.of_term, chunk.begins, chunk.members, chunk.summary, chunk.summaries, chunk.dense = of_term, begins, members, summary, summaries, impact
    chunk.most = impact.max(axis=0)
    opened = 0
    for k in range(6):
        places = np.arange(10 * k, 10 * k + 10)
        found, n = chunk.best(places, weight[places], 1)
        scores = impact[:, places].astype(np.int64) @ weight[places]
        assert sorted(s for s, _ in found)[-10:] == np.sort(scores)[-10:].tolist()
        opened += n
    assert opened < 6 * n_docs / 2
