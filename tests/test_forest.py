import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import brute
from cladeframe.functions import kernels as K
from cladeframe.functions import residues as R
from cladeframe.operators import profiles as P
from cladeframe.operators import tours as U
from cladeframe.operators import trees as T
from cladeframe.plans import forest as N
from cladeframe.sources import text as S

STATES, BYTES = R.DNA.state_table(), R.DNA.byte_index()


def mutant(rng, seq):
    out = list(seq)
    for _ in range(rng.randrange(1, 6)):
        k, what = rng.randrange(len(out)), rng.random()
        if what < 0.6:
            out[k] = rng.choice("ACGT")
        elif what < 0.8:
            out.insert(k, rng.choice("ACGT"))
        elif len(out) > 5:
            del out[k]
    return "".join(out)


def family(rng, sizes, length=30):
    rows = []
    for t, n in enumerate(sizes):
        base = "".join(rng.choice("ACGT") for _ in range(length))
        rows += [(t, i, f"t{t}n{i}", mutant(rng, base)) for i in range(n)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "tree_id int, i long, name string, seq string")


# ---- a plain loop ---------------------------------------------------------------------------


def local_score(a, b):
    sub = lambda x, y: 3 if x == y else 0
    return brute.free_shift(a, b, sub, lambda c: -5, lambda c: -2, -5, -2, local=True)


def plain_order(dist):
    ids = sorted({i for i, _ in dist})
    if len(ids) == 1:
        return ids
    _, a, b = min((d, i, j) for (i, j), d in dist.items() if i != j)
    order, total = [a, b], {k: dist[a, k] + dist[b, k] for k in ids}
    while len(order) < len(ids):
        best = min((total[k], k) for k in ids if k not in order)[1]
        order.append(best)
        total = {k: total[k] + dist[best, k] for k in ids}
    return order


def plain_distances(seqs):
    own = {i: local_score(s, s) for i, s in seqs.items()}
    return {(i, j): 1 - local_score(seqs[min(i, j)], seqs[max(i, j)]) / ((own[i] + own[j]) / 2) for i in seqs for j in seqs}


def plain_aligned(rows):
    def score(a, b):
        total, last = 0, None
        for x, y in zip(a, b, strict=True):
            if x == y == "-":
                continue
            kind = "a" if x == "-" else "b" if y == "-" else None
            total += (3 if x == y else 0) if kind is None else (-2 if kind == last else -5)
            last = kind
        return total

    return {(i, j): -score(a, b) for i, a in rows.items() for j, b in rows.items()}


def codes(seq):
    return BYTES[np.frombuffer(seq.encode(), np.uint8)]


def open_both(ops, ref, seq):
    a, b, top, low = iter(ref), iter(seq), "", ""
    for o in ops:
        top += "-" if o == "2" else next(a)
        low += "-" if o == "1" else next(b)
    return top, low


def plain_build(seqs, order):
    """Rows by id and edges ``{edge: (u, v)}``, one sequence after the other."""
    rows, edges, node = {order[0]: seqs[order[0]]}, {}, {order[0]: 0}
    if len(order) == 1:
        return rows, edges, node
    a, b = seqs[order[0]], seqs[order[1]]
    one_hot = lambda s: 1 << codes(s).astype(np.int64)
    score, ops = K.trace_pairs(one_hot(a)[:, None], np.zeros((len(a), 1), bool), [one_hot(b)], 3, 0, -5, -3)
    assert score[0] == brute.free_shift(a, b, lambda x, y: 3 * (x == y), lambda c: -5, lambda c: -3, -5, -3)
    rows[order[0]], rows[order[1]] = open_both(ops[0].decode(), a, b)
    edges, node = {0: (0, 1)}, {order[0]: 0, order[1]: 1}
    for k, i in enumerate(order[2:], 2):
        tree = pd.DataFrame([(e, u, v, 1.0) for e, (u, v) in sorted(edges.items())], columns=["edge_id", "u", "v", "len"])
        tips = pd.DataFrame([(node[j], rows[j]) for j in rows], columns=["node_id", "seq"])
        state, _, flag = P.edge_vectors(tree, tips, R.DNA, 0.3)
        query = STATES[codes(seqs[i])]
        scores = [brute.profile_score(s.tolist(), (f == 1).tolist(), query.tolist(), 2, -2, -4, -1) for s, f in zip(state, flag, strict=True)]
        e = int(np.argmax(scores))
        _, ops = K.trace_pairs(state[[e]].T, flag[[e]].T == 1, [query], 2, -2, -4, -1)
        both = {j: open_both(ops[0].decode(), row, seqs[i]) for j, row in rows.items()}
        rows = {j: top for j, (top, _) in both.items()} | {i: both[order[0]][1]}
        at = int(tree["edge_id"][e])
        u, v = edges[at]
        edges |= {at: (u, 2 * k - 2), 2 * k - 3: (2 * k - 2, v), 2 * k - 2: (2 * k - 2, 2 * k - 1)}
        node[i] = 2 * k - 1
    return rows, edges, node


def plain_splits(edges, node):
    tips = {n: i for i, n in node.items()}
    found = set()
    for cut, (_, v) in edges.items():
        side, todo = {v}, [v]
        while todo:
            at = todo.pop()
            for e, ends in edges.items():
                if e != cut and at in ends:
                    other = ends[0] if ends[1] == at else ends[1]
                    if other not in side:
                        side.add(other)
                        todo.append(other)
        below = frozenset(tips[n] for n in side if n in tips)
        found.add(frozenset([below, frozenset(tips.values()) - below]))
    return found


def same(forest, wanted):
    rows, edges = {}, {}
    for r in forest.rows.collect():
        rows.setdefault(r["tree_id"], {})[r["i"]] = (r["seq"], r["node_id"])
    for r in forest.edges.collect():
        edges.setdefault(r["tree_id"], {})[r["edge_id"]] = (r["u"], r["v"])
    for t, (plain_rows, plain_edges, node) in wanted.items():
        assert rows.pop(t) == {i: (s, node[i]) for i, s in plain_rows.items()}
        assert edges.pop(t, {}) == plain_edges
    assert not rows and not edges


def by_tree(rows):
    out = {}
    for t, i, _, s in rows:
        out.setdefault(t, {})[i] = s
    return out


# ---- tests ----------------------------------------------------------------------------------


@pytest.mark.parametrize("cells", [None, 40])
def test_trees_from_nothing(spark, monkeypatch, cells):
    if cells:  # several column blocks and several groups of edges
        monkeypatch.setattr(P, "CELLS_PER_TASK", cells)
        monkeypatch.setattr(N, "SCORE_CELLS", cells)
    rows = family(random.Random(8 if cells else 7), [1, 2, 6])
    forest = N.from_nothing(table(spark, rows), S.flat_matrix(spark))
    same(forest, {t: plain_build(seqs, plain_order(plain_distances(seqs))) for t, seqs in by_tree(rows).items()})


def test_larger_trees_go_on_by_jobs(spark, monkeypatch):
    monkeypatch.setattr(N, "ORDER_IDS", 3)
    monkeypatch.setattr(N, "TREE_CELLS", 400)  # of the six, two steps are taken in a task
    rows = family(random.Random(17), [1, 3, 6])
    forest = N.from_nothing(table(spark, rows), S.flat_matrix(spark))
    same(forest, {t: plain_build(seqs, plain_order(plain_distances(seqs))) for t, seqs in by_tree(rows).items()})


def n_jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_steps_of_small_trees_are_no_jobs(spark):
    def grow(n):
        N.from_nothing(table(spark, family(random.Random(4), [n])), S.flat_matrix(spark)).rows.collect()

    assert n_jobs(spark, "nine tips", lambda: grow(9)) <= n_jobs(spark, "four tips", lambda: grow(4)) + 2


def test_generations_of_small_trees_are_no_jobs(spark, monkeypatch):
    seqs = table(spark, family(random.Random(3), [1, 2, 5, 6], 16)).cache()
    forest = N.from_nothing(seqs, S.flat_matrix(spark))
    forest = N.Forest(forest.rows.cache(), forest.edges.cache())
    for df in (seqs, forest.rows, forest.edges):
        df.count()
    monkeypatch.setattr(N, "from_nothing", lambda *_: forest)
    refined = []
    most = lambda n: lambda: refined.append(N.refine(seqs, S.flat_matrix(spark), most=n))
    assert n_jobs(spark, "eight", most(8)) < n_jobs(spark, "two", most(2)) + 6
    # rounds of any length give what jobs for each generation give
    monkeypatch.setattr(N, "ROUND", 1)
    most(2)()
    refined.append(N._refined_by_jobs(seqs, forest, "dna", 2))
    of = lambda r: [sorted(map(tuple, df.collect())) for df in (r.history, r.ends, r.forest.rows.select(*N.ROW), r.forest.edges.select(*N.EDGE))]
    assert of(refined[1]) == of(refined[2]) == of(refined[3])


def test_refinement_ends_when_splits_repeat(spark):
    rows = family(random.Random(12), [1, 3, 6], 16)
    got = N.refine(table(spark, rows), S.flat_matrix(spark))
    last, ends, n_history = {}, {}, 0
    for t, seqs in by_tree(rows).items():
        built, seen = plain_build(seqs, plain_order(plain_distances(seqs))), []
        for gen in range(100):
            built = plain_build(seqs, plain_order(plain_aligned(built[0])))
            splits = plain_splits(built[1], built[2])
            n_history += 1
            before = [g for g, s in enumerate(seen) if s == splits]
            seen.append(splits)
            if before:
                ends[t] = (gen, before[-1], gen - before[-1])
                break
        last[t] = built
    assert {r["tree_id"]: (r["gen"], r["same_as"], r["period"]) for r in got.ends.collect()} == ends
    assert got.history.count() == n_history
    same(got.forest, last)


def test_refinement_stops_after_the_last_generation(spark):
    got = N.refine(table(spark, family(random.Random(3), [4], 20)), S.flat_matrix(spark), most=1)
    assert got.ends.count() == 0 and got.history.count() == 1 and got.forest.rows.count() == 4


def test_orders(spark):
    rng = np.random.default_rng(6)
    cells, wanted = [], {}
    for t, n in enumerate((1, 2, 5, 8)):
        d = rng.integers(1, 6, (n, n))
        d = d + d.T
        cells += [(t, i, j, int(d[i, j])) for i in range(n) for j in range(n)]
        wanted[t] = plain_order({(i, j): int(d[i, j]) for i in range(n) for j in range(n)})
    found = N.addition_orders(spark.createDataFrame(cells, "tree_id int, i long, j long, dist long")).collect()
    assert sorted((r["tree_id"], r["rank"], r["i"]) for r in found) == sorted((t, k, i) for t, order in wanted.items() for k, i in enumerate(order))


def test_extension_in_file_order(spark):
    rows = family(random.Random(9), [4, 5])
    seqs = table(spark, rows)
    orders = seqs.select("tree_id", F.col("i").cast("int").alias("rank"), "i")
    first = N.build(seqs.filter("i < 3"), orders.filter("i < 3"))
    grown = N.extend(first, seqs.filter("i >= 3"), orders.filter("i >= 3").withColumn("rank", F.col("rank") - 3))
    same(grown, {t: plain_build(s, sorted(s)) for t, s in by_tree(rows).items()})


def test_along_a_target_gives_the_target(spark):
    rng = random.Random(5)
    newick = {}
    rows = family(rng, [3, 7, 9])
    for t in range(3):
        parts = [f"{name}:1" for tree, _, name, _ in rows if tree == t]
        while len(parts) > 3:
            i, j = sorted(rng.sample(range(len(parts)), 2))
            b, a = parts.pop(j), parts.pop(i)
            parts.append(f"({a},{b}):1")
        newick[t] = f"({','.join(parts)});"
    target = T.explode_trees(spark.createDataFrame([(str(t), x) for t, x in newick.items()], "tree_id string, newick string"))
    number = lambda df: df.withColumn("tree_id", F.col("tree_id").cast("int"))
    nodes, edges = number(T.nodes_of(target)), number(T.edges_of(target))
    seqs = table(spark, rows)
    orders = seqs.select("tree_id", ((F.col("i") * 2) % F.count("*").over(Window.partitionBy("tree_id"))).cast("int").alias("rank"), "i")
    got = N.along(seqs, orders, nodes, edges)
    key = lambda df: sorted((r["tree_id"], r["split_key"]) for r in df.collect())
    assert key(U.split_fingerprints(got.nodes(), got.edges)) == key(U.split_fingerprints(nodes, edges))
    found = {(r["tree_id"], r["name"]): r["seq"] for r in got.rows.collect()}
    assert {k: s.replace("-", "") for k, s in found.items()} == {(t, name): s for t, _, name, s in rows}
    assert all(len({len(s) for (t, _), s in found.items() if t == k}) == 1 for k in range(3))
    with pytest.raises(Exception, match="no sequence for tip"):
        N.along(seqs.filter("i > 0"), orders, nodes, edges)


def test_traversal_and_fingerprints(spark):
    rng = random.Random(3)
    texts = []
    for k, n in enumerate([3, 4, 5, 9, 20, 20]):
        parts = [f"n{x}:1" for x in rng.sample(range(n), n)]
        while len(parts) > 3:
            i, j = sorted(rng.sample(range(len(parts)), 2))
            b, a = parts.pop(j), parts.pop(i)
            parts.append(f"({a},{b}):1")
        texts.append((f"t{k}", f"({','.join(parts)});"))
    texts.append(("star", "(a,b,c,d,(e,f,g));"))
    branches = T.explode_trees(spark.createDataFrame(texts, "tree_id string, newick string")).cache()
    nodes, edges = T.nodes_of(branches), T.edges_of(branches)
    turned = edges.withColumn("w", F.when(F.col("edge_id") % 2 == 0, F.col("u")).otherwise(F.col("v"))).select(
        "tree_id", "edge_id", F.col("w").alias("u"), (F.col("u") + F.col("v") - F.col("w")).alias("v")
    )
    got = {(r["tree_id"], r["edge_id"]): tuple(r)[2:] for r in U.traversal(nodes, turned).collect()}
    wanted = {
        (r["tree_id"], r["edge_id"]): (r["parent"], r["node_id"], r["depth"], r["node_id"], r["first_tip"], r["n_tips"])
        for r in branches.filter("edge_id IS NOT NULL").collect()
    }
    assert got == wanted
    keys = {(r["tree_id"], r["edge_id"]): (r["split_key"], r["size"]) for r in U.split_fingerprints(nodes, turned).collect()}
    tips = {(r["tree_id"], r["edge_id"]): (tuple(r["tips"]), r["size"]) for r in T.splits(branches).collect()}
    assert len(set(keys.values())) == len(set(tips.values())) == len({(keys[k], tips[k]) for k in tips})
    assert all(keys[k][1] == tips[k][1] for k in tips)
    ring = spark.createDataFrame([("x", 0, 0, 1), ("x", 1, 1, 2), ("x", 2, 2, 0), ("x", 3, 5, 6)], "tree_id string, edge_id int, u int, v int")
    names = spark.createDataFrame([("x", k, f"n{k}", k > 4) for k in range(7)], "tree_id string, node_id int, name string, is_tip boolean")
    with pytest.raises(Exception, match="not a tree"):
        U.traversal(names, ring).collect()
