import random
import zlib
from collections import Counter, defaultdict

from cladeframe.llm import label_shards as S


def check(docs, rows, shards):
    found = S.assign(docs, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in found:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return found


def test_odd_rows(odd, odd_rows, none):
    check(odd, odd_rows, 40)
    check(odd, odd_rows, 3)
    check(none, [], 40)


def test_groups_stay_together_and_a_large_one_is_split(make, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 50)
    rng = random.Random(2)
    rows = [(k, f"alone {k}") for k in range(300)]
    rows += [(1000 + k, f"group {k // 5}") for k in range(200)]
    rows += [(5000 + k, "a third of all rows") for k in range(250)]
    rng.shuffle(rows)
    docs = make(rows)
    found = check(docs, rows, 10)
    text = {d: t for d, t in rows}
    shards = defaultdict(Counter)
    for r in found:
        shards[text[r["doc_id"]]][r["shard"]] += 1
    cut = sum(len(c) > 1 for t, c in shards.items() if t.startswith("group"))
    assert cut <= 6  # of 40 groups; by a hash alone nearly all would be cut
    large = shards["a third of all rows"]
    assert sum(n for _, n in large.most_common(5)) >= 240  # 250 rows, 75 in a shard


def test_the_result_does_not_depend_on_how_rows_are_dealt(make):
    rows = [(k, f"text {k % 70}") for k in range(200)]
    key = lambda r: tuple(r)
    one = sorted(map(key, S.assign(make(rows).coalesce(1), 7, 2).collect()), key=str)
    other = sorted(map(key, S.assign(make(rows[::-1]).repartition(9), 7, 2).collect()), key=str)
    assert one == other


def test_no_python_in_the_plan(make):
    placed = S.assign(make([(1, "a"), (2, "a"), (3, None)]), 2, 1)
    assert "Python" not in placed._jdf.queryExecution().toString() and "Arrow" not in placed._jdf.queryExecution().toString()


def test_cut_links(spark):
    placed = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "node string, shard int")
    links = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "c"), ("y", "d"), ("z", "d")], "link string, node string")
    assert tuple(S.cut_links(placed, links).first()) == (2, 1, 5, 1)
