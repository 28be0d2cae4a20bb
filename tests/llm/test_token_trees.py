import random

import public_tokenizers
import pytest

from cladeframe.llm import token_trees as T
from cladeframe.llm.byte_bpe import read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'r", "e", "1", "23", "!", "é", "日", "'", "don't ", "\t", " x", "word "]


@pytest.fixture(scope="module")
def counter():
    return T.Counter(read_ranks(PATH), public_tokenizers.PATTERN)


def test_edits_match_a_full_count(counter):
    rng = random.Random(4)
    for turn in range(600):
        tree = T.TokenTree("".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 900 if turn % 20 == 0 else 40))), counter)
        for _ in range(4):
            a = rng.randrange(len(tree.text) + 1)
            b = a + rng.choice([0, 1, 3, 60])
            new = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 6)))
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            pieces = counter.pattern.findall(want)
            assert tree.text == want
            assert [n for chars, _ in tree.leaves for n in chars] == list(map(len, pieces))
            assert tree.n_tokens == len(counter.encoding.encode_ordinary(want))


def test_an_edit_encodes_its_surroundings_alone(counter):
    tree = T.TokenTree("word and more " * 5000, counter)
    tree.edit(35_000, 35_003, "other")
    assert tree.touched <= 6
    assert tree.n_tokens == len(counter.encoding.encode_ordinary(tree.text))


def test_recount(make, odd_rows, none, counter):
    rows = [(k, t) for k, (_, t) in enumerate(odd_rows)]
    edits = [(k, a, b, r) for k in range(len(rows)) for a, b, r in ((0, 2, "Xy"), (1, 4, "lost"), (50, 60, ""), (10**6, 10**6 + 5, " end"))]
    edits += [(0, None, 3, "x"), (1, 0, 1, None), (999, 0, 1, "no such document")]
    spark = none.sparkSession
    table = spark.createDataFrame(edits, "doc_id long, start long, end long, replacement string")
    found = T.recount(T.attach_edits(make(rows), table), PATH, public_tokenizers.PATTERN, with_text=True).collect()
    assert len(found) == len(rows)
    for r in found:
        text = rows[r["doc_id"]][1] or ""
        want, n = text, len(text)
        chosen, reached = [], 0
        for a, b, x in ((0, 2, "Xy"), (1, 4, "lost"), (50, 60, ""), (10**6, 10**6 + 5, " end")):
            a, b = min(a, n), min(b, n)
            if a >= reached:
                chosen.append((a, b, x))
                reached = max(b, a + (a == b))
        for a, b, x in reversed(chosen):
            want = want[:a] + x + want[b:]
        assert r["edited"] == want
        assert (r["n_tokens"], r["n_tokens_after"]) == tuple(len(counter.encoding.encode_ordinary(t)) for t in (text, want))
    assert T.recount(T.attach_edits(none, table), PATH, public_tokenizers.PATTERN).collect() == []


def test_masking(make):
    docs = make([(1, "mail é a.b@c.example now 1234567 or 123"), (2, None)])
    from cladeframe.llm.queries import MASKED

    edited = docs.withColumn("edits", T.masking_edits(docs.text, MASKED, "<m>"))
    found = {r["doc_id"]: r["edited"] for r in T.recount(edited, PATH, public_tokenizers.PATTERN, with_text=True).collect()}
    assert found == {1: "mail é <m> now <m> or 123", 2: ""}
