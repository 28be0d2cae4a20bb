import random
import re

from cladeframe.llm import positional_index as I
from corpus_texts import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        w = fold(text)
        hit, found = set(), set()
        for item_id, t in items:
            q = fold(t)
            span = min(13, len(q))
            asked = {tuple(q[k : k + span]) for k in range(len(q) - span + 1)} if q and item_id is not None else set()
            for k in range(len(w) - span + 1):
                if tuple(w[k : k + span]) in asked:
                    hit.update(range(k, k + span))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def check(make, spark, docs, items):
    table = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, term int")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in I.contamination(make(docs), table).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(brute(docs, items), key=order)


def test_passages(make, spark):
    rng = random.Random(2)
    items = [(k, prose(rng, rng.randrange(5, 40), 60)) for k in range(20)]
    items += [(50, "Short one."), (51, "lone"), (52, None), (53, ""), (54, "..."), (None, "w1 w2"), (55, items[3][1]), (3, items[3][1]), (56, "w7 " * 20)]
    docs = [(1, None), (2, ""), (3, "!?"), (4, "lone"), (None, items[0][1])]
    for k in range(10, 60):
        w = prose(rng, rng.randrange(1, 120), 60).split()
        if k % 2:
            q = rng.choice(items[:20])[1].split()
            at, a = rng.randrange(len(w) + 1), rng.randrange(len(q))
            w[at:at] = q[a : a + rng.randrange(1, 40)]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w).replace("w1", "W1")))
    docs += [docs[-1], (7, "w7 " * 5000), (8, "SHORT one lone short ONE"), (9, "É short été one")]
    check(make, spark, docs, items)


def test_empty_tables(make, spark):
    check(make, spark, [], [(1, "a b c")])
    check(make, spark, [(1, "a b c"), (2, None)], [])
    check(make, spark, [], [])


def test_blocks_of_index_words_change_nothing(make, spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BYTES", 200)
    rng = random.Random(4)
    items = [(k, prose(rng, 20, 200)) for k in range(6)]
    check(make, spark, [(k, prose(rng, 30, 200) + " " + items[k % 6][1]) for k in range(12)], items)


def test_proximity(make, spark):
    items = spark.createDataFrame([(1, "rare strange common common common")], "item_id long, text string")
    docs = make([(1, "strange x rare " + "common " * 30), (2, "strange " + "common " * 30 + "rare"), (3, "common " * 9)])
    near = {r["doc_id"]: (r["n_near"], r["n_hit"]) for r in I.contamination(docs, items).collect()}
    assert near == {1: (1, 0), 2: (0, 0), 3: (0, 0)}
