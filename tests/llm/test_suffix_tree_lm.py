import itertools
import math
import random
from collections import Counter

import numpy as np

from cladeframe.llm import suffix_tree_lm as L
from corpus_texts import prose


def base(rows, training):
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for _, t, *_ in training for w in words(t))
    total, z = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    return sorted(((d is None, d or 0, len(words(t)), sum(c[w] > 0 for w in words(t)), total, round(sum(math.log10(c[w] + 0.1) - z for w in words(t)), 6)) for d, t, *_ in rows))


def check(docs, rows, learned, training):
    found = L.score(docs, learned).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert got == base(rows, training)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    return found


def test_base_and_odd_rows(make, odd, odd_rows, none, monkeypatch):
    rng = random.Random(1)
    training = [(k, prose(rng, 80, 300)) for k in range(40)] + [(90, None), (91, ""), (92, "Word WORD")]
    check(odd, odd_rows, make(training), training)
    monkeypatch.setattr(L, "HEAVY", 10)  # nearly all words by the shuffle
    check(odd, odd_rows, make(training), training)
    monkeypatch.setattr(L, "HEAVY", 500_000)
    check(odd, odd_rows, none, [])
    assert L.score(none, make(training)).collect() == []


def test_held_out_texts_score_above_the_base(make):
    rng = random.Random(5)
    parts = ["ba", "lo", "shi", "tru", "ken", "zor"]
    text = lambda: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 6))) for _ in range(60))
    training = [(k, text()) for k in range(300)]
    found = L.score(make([(k, text()) for k in range(40)]), make(training)).collect()
    assert sum(r["score"] > r["base_score"] for r in found) >= 38


def test_token_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    table = np.full(256, L.OTHER, np.int64)
    table[[32, 97, 98]] = [1, 2, 3]
    p = rng.dirichlet(np.ones(L.SYMBOLS) * 0.2, size=3)
    p[:, 4:] = 1e-300
    p /= p.sum(1, keepdims=True)
    child = np.full((3, L.SYMBOLS), -1, np.int32)
    child[0, 2], child[0, 1] = 1, 2
    tree = L.Tree(child, np.log10(p).astype(np.float32), table, 0.0)
    for before in ([], [b"ab"]):
        texts = [before] + [before + [bytes(w)] for k in range(1, 11) for w in itertools.product(b"ab", repeat=k)]
        total = sum(10 ** L.token_scores(tree, [t])[len(before)] for t in texts)
        assert abs(total - 1) < 1e-4
    mixed = [[], [b"a"], [], [b"ab", b"b"]]
    apart = np.concatenate([L.token_scores(tree, [t]) for t in mixed])
    assert np.allclose(L.token_scores(tree, mixed), apart)


def test_contexts_stay_by_divergence(make, spark):
    """After 'q' always 'u': a context that must stay; one that changes nothing must not."""
    rng = random.Random(8)
    training = make([(k, " ".join(rng.choice(["qu", "aa", "ab", "ba"]) for _ in range(100))) for k in range(60)])
    table = L.symbol_table(L.byte_counts(training))
    scratch = L.Scratch(spark, "test")
    counts = scratch.keep(L.corpus_counts(training, table), "counts")
    kept = {(r["depth"], r["context"]) for r in L.contexts(counts.filter("kind = 1").select("code", "n"), scratch).collect()}
    assert (1, int(table[ord("q")])) in kept
    for d, c in kept:  # every suffix is there
        assert d == 0 or (d - 1, c & ((1 << L.BITS * (d - 1)) - 1)) in kept


def test_all_contexts_that_pass_stay_in_parts(make, monkeypatch):
    """A tree larger than the table for small ones loses no context, in one part or in many."""
    rng = random.Random(11)
    training = [(k, prose(rng, 80, 300)) for k in range(60)] + [(90, None), (91, ""), (92, "Word WORD")]
    docs, learned = make(training + [(200, "d\u00e9j\u00e0 vu 77 zqx"), (None, "a b")]), make(training)
    scores = lambda: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["score"]) for r in L.score(docs, learned).collect())
    whole, seen, build_part = scores(), [], L.build_part
    monkeypatch.setattr(L, "build_part", lambda *a: seen.append(a[1:3]) or build_part(*a))
    monkeypatch.setattr(L, "STATES", 5)
    for part, memo, least in ((1 << 21, 1 << 20, 1), (100, 16, 2)):
        monkeypatch.setattr(L, "PART", part)
        monkeypatch.setattr(L, "MEMO", memo)
        seen.clear()
        again = scores()
        assert [r[:4] for r in again] == [r[:4] for r in whole]
        assert np.allclose([r[4] for r in again], [r[4] for r in whole], rtol=1e-5)
        assert (len(seen) == 1) == (least == 1) and len(seen) >= least
        assert seen[0][0] == 0 and seen[-1][1] == 1 << L.BITS * L.SPLIT
