import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cladeframe.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_of_odd_rows(odd, odd_rows, plain):
    found = B.round_trip(odd, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text in odd_rows:
        ids = plain.encode_ordinary(text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)


def test_encode_then_decode(odd, odd_rows):
    encoded = B.encode(odd, PATH, public_tokenizers.PATTERN)
    texts = {r["doc_id"]: bytes(r["bytes"]) for r in B.decode(encoded, PATH).collect() if r["doc_id"] is not None}
    assert texts == {d: (t or "").encode() for d, t in odd_rows if d is not None}


def test_empty_table(none):
    assert B.round_trip(none, PATH, public_tokenizers.PATTERN).collect() == []


def test_an_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="vocabulary"):
        B.decode(spark.createDataFrame([(1, [5, 99_999_999])], "doc_id long, ids array<int>"), PATH).collect()


def test_long_pieces_and_ties(plain):
    coder = B.Coder(B.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(8)
    texts = ["a" * 5000, " " * 999 + "x", "ab" * 1000, "the" * 700, "日本" * 300, "".join(rng.choice("abcde") for _ in range(1500))]
    texts += ["".join(rng.choice("ab \n'sé!") for _ in range(200)) for _ in range(60)]
    ids = coder.encode(texts)
    assert [i.tolist() for i in ids] == [plain.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_unbroken_runs_are_put_together_from_stretches(plain):
    coder = B.Coder(B.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(5)
    runs = ["".join(rng.choice(letters) for _ in range(size)) for letters in ("ab", "aaab", "theraniougs", "éa日") for size in (49, 97, 700)]
    runs += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(200_000)), "ab" * 50_000]
    assert [i.tolist() for i in coder.encode(runs)] == [plain.encode_ordinary(t) for t in runs]


def test_pieces_are_learned_in_blocks(plain, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 100)
    coder = B.Coder(B.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(300))
    assert coder.encode([text])[0].tolist() == plain.encode_ordinary(text)
