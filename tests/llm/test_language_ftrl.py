import random

import pytest

from cladeframe.llm import language_ftrl as L

PARTS = {"en": ["the", "ing", "tion", "wh", "ou"], "de": ["sch", "ung", "ein", "ü", "ß"], "fr": ["eau", "que", "é", "oi", "ment"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for k in range(300):
        lang = rng.choice(sorted(PARTS))
        out.append((k, text(rng, lang, rng.randrange(3, 80)), lang))
    return out


def test_held_out_accuracy_and_calibration(make, rows):
    model = L.fit(make(rows[:200]))
    assert model.languages == ("de", "en", "fr")
    found = {r["doc_id"]: r for r in L.identify(make(rows[200:]), model).collect()}
    right = [found[k]["lang_pred"] == lang for k, _, lang in rows[200:]]
    assert sum(right) >= 98
    scores = [found[k]["score"] for k, *_ in rows[200:]]
    assert all(0 <= s <= 1 for s in scores) and abs(sum(scores) - sum(right)) / len(right) < 0.1


def test_odd_rows(make, odd, odd_rows, rows, none):
    model = L.fit(make([*rows, (900, None, "fr"), (901, "text", None), (None, "the ou", "en"), rows[0], rows[0]]))
    found = L.identify(odd, model).collect()
    assert len(found) == len(odd_rows)
    for r in found:
        texts = [t for d, t in odd_rows if d == r["doc_id"]]
        if all(not any(c.isalpha() for c in t or "") for t in texts):
            assert (r["lang_pred"], r["score"]) == (L.UNKNOWN, 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in model.languages
    assert L.identify(none, model).collect() == []


def test_no_model_and_one_language(make, none):
    assert L.fit(none) is None and L.fit(make([(1, None, "en"), (2, "x", None)])) is None
    assert {r["lang_pred"] for r in L.identify(make([(1, "abc")]), None).collect()} == {L.UNKNOWN}
    alone = L.fit(make([(k, "the ing ou", "en") for k in range(3)]))
    assert [tuple(r)[1:] for r in L.identify(make([(1, "abc")]), alone).collect()] == [("en", 1.0)]


def test_long_and_repeated_rows_do_not_use_up_the_sample(make, rows, monkeypatch):
    monkeypatch.setattr(L, "FIT_CHARS", 60_000)
    # 30 long texts of mixed words bear the label of one language, a third of all rows are one row
    rng = random.Random(9)
    long = [(1000 + k, " ".join(text(rng, x, 700) for x in sorted(PARTS)), "fr") for k in range(30)]
    assert min(len(t) for _, t, _ in long) > 60_000 // 3 * L.LONG
    model = L.fit(make([*rows[:200], *long, *[rows[0]] * 200]))
    found = {r["doc_id"]: r["lang_pred"] for r in L.identify(make(rows[200:]), model).collect()}
    assert sum(found[k] == lang for k, _, lang in rows[200:]) >= 97


def test_frequencies_count_every_text(make, rows):
    counted = dict(L.frequencies(make(rows).repartition(5)).collect())
    assert counted.pop(-1) == len(rows)
    want = sum((L.ngram_counts(t) > 0).astype(int) for _, t, _ in rows)
    assert {k: int(n) for k, n in enumerate(want) if n} == counted
