import hashlib
import random

import pytest

import corpus_pipeline as P
from corpus_texts import prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with one case of each kind among clean documents."""
    rng = random.Random(21)
    top = tmp_path_factory.mktemp("tables")
    clean = [(k, prose(rng, 100, 3000), "en") for k in range(60)]
    item = prose(rng, 40, 3000)
    rows = [
        *clean, (100, clean[0][1], "en"), (101, clean[1][1].replace(" w", " w", 1) + " more", "en"), (102, item + " " + prose(rng, 20, 3000), "en"),
        (103, prose(rng, 60, 3000) + ' token = "0123456789abcdef" ' + prose(rng, 30, 3000), "en"), (104, "12345 !!", "en"), (105, None, "en"), (None, "no id", "en"),
    ]
    docs = spark.createDataFrame([(d, t, x, "src", len(t or "")) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), rows


def test_stages_keep_columns_and_decide(spark, folder):
    top, rows = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, top)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {d for d, *_ in rows}
    assert ids - set(seen["language_id"]) == {104, 105}
    assert set(seen["language_id"]) - set(seen["near_dedup"]) == {100, 101}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {102}
    assert set(seen["secret_scan"]) == set(seen["decontamination"])
    changed = {d for d, t in seen["secret_scan"].items() if t != seen["decontamination"][d]}
    assert changed == {103} and "0123456789abcdef" not in seen["secret_scan"][103]


def test_run(spark, folder):
    top, rows = folder
    found = {r["doc_id"]: r["decoded_sha256"] for r in P.run(spark, top).collect()}
    text = {d: t for d, t, _ in rows}
    assert set(found) == {*range(60), 103, None}
    assert all(found[k] == hashlib.sha256(text[k].encode()).hexdigest() for k in range(60))


def test_empty_documents(spark, folder, tmp_path):
    top, _ = folder
    spark.read.parquet(f"{top}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{top}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_rows_of_one_id_and_of_none_are_judged_each(spark, tmp_path):
    """A good row does not rescue a bad one of its id, a null id rescues none, equal rows leave one."""
    rng = random.Random(22)
    item, kept, other = prose(rng, 40, 3000), prose(rng, 100, 3000), prose(rng, 100, 3000)
    rows = [
        *((k, prose(rng, 100, 3000)) for k in range(20)), (30, kept), (30, item), (30, "12345 !!"), (31, other), (31, other), (29, prose(rng, 90, 3000)),
        (None, item), (None, "12345 !!"), (None, kept + " more"), (None, "no id"), (32, kept), (33, other + " more"), (33, prose(rng, 80, 3000)),
    ]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = lambda found: sorted(((d is None, d or 0, t) for d, t in found))
    pairs = lambda df: order((r["doc_id"], r["text"]) for r in df.collect())
    assert pairs(P.languages(spark, docs, str(tmp_path))) == order((d, t) for d, t in rows if t != "12345 !!")
    assert pairs(P.benchmark_passages(spark, docs, str(tmp_path))) == order((d, t) for d, t in rows if t != item)
    # the item stays under its one id, the longer copies and one of the equal rows go
    single = set(rows) - {(None, item), (None, "12345 !!"), (None, kept + " more"), (32, kept), (33, other + " more")}
    assert set(pairs(P.near_copies(spark, docs, str(tmp_path)))) == set(order(single)) and len(single) == len(pairs(P.near_copies(spark, docs, str(tmp_path))))
