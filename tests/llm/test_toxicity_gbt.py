import random

from cladeframe.llm import toxicity_gbt as G
from corpus_texts import prose

BAD = ["idiot", "scum", "lowlifeish", "trashy"]


def rows(rng, n):
    out = []
    for k in range(n):
        w = prose(rng, rng.randrange(20, 120)).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "", "s", "!"])
        out.append((k, " ".join(w), toxic))
    return out


def labels(spark, pairs):
    return spark.createDataFrame([(d, 1, t, 3) for d, t in pairs], "doc_id long, quality int, toxic int, score int")


def test_held_out_accuracy(make, spark):
    rng = random.Random(2)
    data = rows(rng, 500)
    said = labels(spark, [(d, int(t)) for d, _, t in data] + [(1, None), (None, 1), (10**6, 1)])
    docs = make([(d, t) for d, t, _ in data] + [(600, None), (601, ""), (None, "you idiot"), (0, data[0][1])])
    found = G.score(docs, said, "doc_id % 5 <> 0").collect()
    assert len(found) == 504 and all(0 <= r["score"] <= 1 for r in found)
    score = {r["doc_id"]: r["score"] for r in found}
    held = [(score[d] >= 0.5) == t for d, _, t in data if d % 5 == 0]
    assert sum(held) / len(held) >= 0.97


def test_too_few_labels(make, spark, none):
    docs = make([(k, "a b c") for k in range(6)])
    scores = lambda pairs: {r["score"] for r in G.score(docs, labels(spark, pairs)).collect()}
    assert scores([]) == {0.0}
    assert scores([(k, 0) for k in range(6)]) == {0.0}
    assert scores([(k, 1) for k in range(6)]) == {1.0}
    assert G.score(none, labels(spark, [(1, 1)])).collect() == []


def test_lexicon_finds_words_and_stems(make, spark):
    rng = random.Random(4)
    data = rows(rng, 300)
    table = spark.createDataFrame([(t, int(x)) for _, t, x in data], "text string, toxic int")
    found = G.lexicon(table, G.Scratch(spark, "test"))
    assert {"idiot ", "scum ", "lowl", "lowlif"} <= set(found) and not {"w1 ", "w2 "} & set(found)


def test_features_of_plain_cases():
    words = G._Words({"idiot ": 3.0})
    at = dict(zip(G.FEATURES, G._features("You IDIOT !! 1d1ot x", words)))
    assert at["lexicon_count"] > 0 and at["near_second"] == 2 and at["capital_words"] > 0 and at["repeat_marks"] == 1
    assert G._features("", words) == [0.0] * len(G.FEATURES)
    assert G.parts("1d1ot!")[2] == "idiot" and G.parts("Word,") == ("Word", "word", "word")
