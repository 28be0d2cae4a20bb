import random

from cladeframe.llm import repetition as R


def longest_repeats(w):
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_repeats_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 40))] for _ in range(rng.randrange(1, 5))]
        for t, found in zip(texts, R.repeats(texts, 2)):
            want = longest_repeats(t)
            assert list(zip(found.starts.tolist(), found.lengths.tolist())) == [(i, n) for i, n in enumerate(want) if n >= 2]
            covered = {p for i, n in enumerate(want) if n >= 2 for p in range(i, i + n)}
            assert found.in_repeats.tolist() == [p in covered for p in range(len(t))]
            keys = {}
            for i in range(len(t) - 1):
                keys.setdefault(tuple(t[i : i + 2]), []).append(i)
            assert found.intervals == sum(len(v) > 1 for v in keys.values())


def base(text):
    text = text or ""
    raw = text.encode()
    w = raw.split()
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = len({p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 3)})
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, repeated, len(w) < 50 or 100 * repeated > 50 * len(w)


def test_base_columns(make, odd_rows):
    rng = random.Random(9)
    rows = [*odd_rows, (20, "a b | c\n" * 30 + "x # y"), (21, "\n".join(rng.choice(["one two", "three *", " "]) for _ in range(200)))]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    found = {r["doc_id"]: tuple(r)[1:7] for r in R.rules(make(rows)).collect()}
    assert found == {k: base(t) for k, t in rows}


def test_verdicts(make, none):
    rng = random.Random(10)
    clean = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    half = clean.split()
    passage = " ".join(half[:60])
    some = " ".join([*half[:150], passage, *half[150:160]])  # 60 of 220 words come twice: 120 of 220
    rows = [(1, clean), (2, some), (3, clean + " " + " ".join(half[:110])), (4, "few words")]
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in R.rules(make(rows)).collect()}
    assert kept == {1: (False, True), 2: (True, False), 3: (False, False), 4: (True, False)}
    assert R.rules(none).collect() == []


def test_spans_have_the_words(make):
    rows = R.spans(make([(1, "p q a b c d e f g x a b c d e f g y"), (2, None)])).collect()
    assert [(r["start"], r["length"], r["words"]) for r in rows][:1] == [(2, 7, "a b c d e f g")]
