import random
import re
import string

from pyspark.sql import functions as F

from cladeframe.llm import secret_markov as M

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def found(docs, model=None):
    rows = M.scan(docs, model).collect()
    return [(r["doc_id"], r["text"], [(s["start"], s["kind"], s["end"]) for s in r["spans"]]) for r in rows]


def samples(spark, rng):
    words = ["configuration", "internationalization", "get_user_by_name", "the_quick_brown_fox", "update-all-records", "version_2024_release"]
    ordinary = [(rng.choice(words) + rng.choice(words), False) for _ in range(300)]
    random_ = [("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)), True) for _ in range(300)]
    return spark.createDataFrame(ordinary + random_ + [(None, True), ("x" * 30, None)], "run string, random boolean")


def test_base_spans(make, odd, odd_rows):
    rows = [
        (1, 'é token = "abcdefgh1" then Password:short and PASSWD=\'0123456789\' x'), (2, "secret: token:abcdefgh12 secret: token =longenough1"),
        (3, "AKIA" + "A1" * 6 + "AKIAAKIAAKIAAKIA"), (4, "AKIA1234567 AKIAabcdefghijklmn"), (5, "deadbeef" * 4 + " " + "0" * 31 + "g" + "a" * 32 + "A"),
        (6, "api_key=" + "ab12" * 10 + " APIKEY : x-y_z.w=12"), (7, "token=" + "0123456789abcdef" * 3), (8, "ſecret=abcdefghij token =abcdefghij"),
        (9, "password " * 2000 + "password=12345678"), *[(100 + k, t) for k, (_, t) in enumerate(odd_rows)],
    ]
    for _, text, spans in found(make(rows), M.Model(tuple([0.0] * M.STATES**2))):
        assert spans == plain(text), text


def test_random_runs_are_added_and_ordinary_ones_left(make, spark):
    rng = random.Random(12)
    model = M.train(samples(spark, rng))
    key = "q7Zx2Lp0Vt9Bn4Kd8Ws1Rm6"
    rows = [(1, f"the value {key} stands here"), (2, "see get_user_by_name_version_2024_release now"), (3, "internationalization2024internationalization"),
            (4, f"token={key}"), (5, None), (6, "")]
    spans = {d: s for d, _, s in found(make(rows), model)}
    assert spans == {1: [(10, 3, 10 + len(key))], 2: [], 3: [], 4: [(0, 0, 6 + len(key))], 5: [], 6: []}


def test_the_rest_of_a_run_beside_a_base_span(make, spark):
    model = M.train(samples(spark, random.Random(12)))
    head, tail, access, hexes = "q7Zx2Lp0Vt9Bn4Kd8Ws1", "m6Yc3Hg5Tf0Rj2Qe7XbP", "AKIA" + "B2" * 8, "0123456789abcdef" * 2
    rows = [
        (1, f"é {head}+{access}/{tail} end"), (2, f"see {access} end"), (3, f"{hexes}+{tail}"), (4, f"internationalization/{hexes}/internationalization"),
        (5, f"{head}+{access}/{hexes}Z{tail}"),
    ]
    spans = {d: s for d, _, s in found(make(rows), model)}
    at = 3 + len(head)
    assert spans[1] == [(2, 3, at), (at, 1, at + 20), (at + 20, 3, at + 21 + len(tail))]
    assert spans[2] == [(4, 1, 24)]
    assert spans[3] == [(0, 2, 32), (32, 3, 33 + len(tail))]
    assert spans[4] == [(21, 2, 53)]
    assert [k for _, k, _ in spans[5]] == [3, 1, 2, 3]
    text = M.scan(make(rows), model).select("doc_id", M.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert not [r for r in text if head in r["t"] or tail in r["t"] or access in r["t"]]


def test_scores_match_a_plain_sum(make, spark):
    rng = random.Random(13)
    model = M.train(samples(spark, rng))
    runs = ["abcDEF0123456789+/_-xyz", "a", "zzzzzzzzzzzzzzzzzzzz9"]
    got = spark.createDataFrame([(r,) for r in runs], "run string").select("run", model.score(F.col("run")).alias("s")).collect()
    for r in got:
        state, total = 0, 0.0
        for c in r["run"]:
            now = M.SYMBOLS.index(c) + 1
            total += model.ratios[state * M.STATES + now]
            state = now
        assert abs(total - r["s"]) < 1e-9


def test_redaction(make):
    docs = make([(1, "é token=0123456789abcdef0123456789abcdef0123 end"), (2, None), (3, "clean"), (4, "AKIA" + "B2" * 8)])
    scanned = M.scan(docs, M.Model(tuple([0.0] * M.STATES**2)))
    out = {r["doc_id"]: r["t"] for r in scanned.select("doc_id", M.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "é <secret> end", 2: None, 3: "clean", 4: "<secret>"}


def test_nothing_to_learn_from(none, make):
    assert found(none) == []
    assert [s for *_, s in found(make([(1, None), (2, "plain words only")]))] == [[], []]
    assert "Python" not in M.scan(make([(1, "x")]))._jdf.queryExecution().toString()
