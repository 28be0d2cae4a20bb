import random
import re
import zlib
from collections import Counter

from cladeframe.llm import spelling_index as S
from corpus_texts import prose


def near(a, b):
    """Whether one edit turns one word into the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    beside = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {}
    for w, all_near in beside.items():
        best = min(all_near, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(beside[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda x: x[0])


def check(make, docs):
    got = S.variants(make(docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda x: x[0]) == brute(docs)


def words(rng, n, letters="abé", low=6, high=9):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)})


def test_search_finds_what_shares_the_half():
    rng = random.Random(1)
    for letters in ("ab", "abé", "abcdefghij"):
        kept = words(rng, 200, letters)
        asked = [*kept, *words(rng, 30, letters + "z")]
        for left in (True, False):
            got = {(asked[a], kept[b]) for a, b in zip(*S.near_words(kept, asked, left), strict=True)}
            same = lambda w, v, left=left: v.startswith(w[: len(w) // 2]) if left else v.endswith(w[len(w) // 2 :])
            wanted = {(w, v) for w in asked for v in kept if near(w, v) and same(w, v)}
            assert {(w, v) for w, v in got if w != v} == wanted


def corpus(rng, n=60):
    lexicon = words(rng, 120, "abcß", 6, 8)
    spread = [w for k, w in enumerate(lexicon) for _ in range(1 + k % 40)]
    return [(k, rng.choice([" ", ", ", "\n", "7"]).join(rng.choice(spread) for _ in range(150)).replace("ab", rng.choice(["ab", "AB"]))) for k in range(n)]


def test_words_forms_and_roots(make, odd_rows):
    docs = corpus(random.Random(2)) + list(odd_rows) + [(None, "lonely " * 6), (1, "÷×straße ÉTÉÉÉÉ Étéééé " * 9)]
    docs.append((99, "qqqqqq " * 5 + "qqqqqqr " * 25 + "qqqqqqrs " * 130))
    check(make, docs)
    assert any(root != form for _, form, root, *_ in brute(docs) if form)


def test_dropped_letters(make):
    docs = [(k, prose(random.Random(k), 60, 3).replace("w", "wordlike") + " spelling" * 5) for k in range(400)]
    assert len(brute(docs)) > 1
    check(make, docs)


def test_split_halves_change_nothing(make, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 24)
    docs = corpus(random.Random(3))
    check(make, docs)
    monkeypatch.setattr(S, "SENT_HALVES", 0)
    check(make, docs)


def test_no_words(make, none):
    check(make, [])
    check(make, [(1, None), (2, "short words"), (3, "uncommon")])
