"""Operators on DataFrames: both routes of movement, ties, missing profiles, files, orders."""

import math
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from cladeframe.functions import kernels as K
from cladeframe.functions import residues as R
from cladeframe.operators import columns as C
from cladeframe.operators import logodds as G
from cladeframe.operators import pairwise as W
from cladeframe.operators import place as L
from cladeframe.operators import profiles as P
from cladeframe.operators import traces as X
from cladeframe.operators import trees as T
from cladeframe.plans import jobs as J
from cladeframe.plans import registry
from cladeframe.sources import text as S


def test_registry_and_entry():
    import __spark_entry__ as e

    assert set(registry.oracles()) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.oracles()) <= set(e.oracle_sql())


@pytest.fixture(scope="module")
def edges_and_queries(spark):
    rng = np.random.default_rng(7)
    n_col, n_prof = 30, 25
    state, aux = rng.integers(1, 16, (n_prof, n_col)), rng.integers(0, 2, (n_prof, n_col))
    prof = spark.createDataFrame(
        [(int(3 * k), state[k].tolist(), aux[k].tolist(), [0.1] * n_col) for k in range(n_prof)],
        "edge_id int, state array<int>, aux array<int>, gapp array<double>",
    )
    seqs = ["".join(rng.choice(list("ACGT"), rng.integers(1, 25))) for _ in range(40)]
    queries = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)] + [(99, "")], "seq_id long, seq string")
    return prof, queries, state, aux, seqs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_by_one_block_and_by_many(edges_and_queries):
    prof, queries, state, aux, seqs = edges_and_queries
    one, many = L.best_edge(queries, prof), L.best_edge(queries, prof, broadcast_bytes=500)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert sorted(map(str, L.top_edges(queries, prof, 3).collect())) == sorted(map(str, L.top_edges(queries, prof, 3, broadcast_bytes=500).collect()))
    code = {"A": 1, "C": 2, "G": 4, "T": 8}
    found = {r["seq_id"]: (r["edge_id"], r["score"]) for r in one.collect()}
    for k, s in enumerate(seqs):
        scores = [brute.profile_score(state[e], aux[e] == 1, [code[c] for c in s]) for e in range(len(state))]
        best = max(scores)
        assert found[k] == (3 * scores.index(best), best)


def test_traces_by_both_routes_have_the_placement_score(edges_and_queries, monkeypatch):
    prof, queries, *_ = edges_and_queries
    placed = queries.filter("seq <> ''").join(L.best_edge(queries, prof), "seq_id")
    one = L.trace(placed, prof)
    monkeypatch.setattr(L, "SALT_QUERIES", 2)
    many = L.trace(placed, prof, broadcast_bytes=500)
    assert rows(one) == rows(many)
    assert rows(L.checked_traces(one, placed)) == rows(one)
    wrong = placed.withColumn("score", F.col("score") + 1)
    with pytest.raises(Exception, match="trace score differs"):
        L.checked_traces(one, wrong).collect()


def test_checked_traces_need_no_join(edges_and_queries):
    prof, queries, *_ = edges_and_queries
    placed = queries.withColumn("name", F.concat(F.lit("q"), "seq_id")).join(L.best_edge(queries, prof), "seq_id")
    want = X.with_gapped(L.trace(placed, prof), placed).select("seq_id", "edge_id", "score", "ops", "name", "gapped")
    for size in (1 << 20, 500):
        assert rows(L.trace(placed, prof, broadcast_bytes=size, checked=True)) == rows(want)
        with pytest.raises(Exception, match="trace score differs"):
            L.trace(placed.withColumn("score", F.col("score") + 1), prof, broadcast_bytes=size, checked=True).collect()


def test_opened_rows_of_a_batch(spark, monkeypatch):
    texts = [("a", "acA-Gt"), ("b", "C-T"), ("c", "gAcC-"), ("d", "---"), ("e", None)]
    traces = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(texts)], "seq_id long, name string, gapped string")
    gaps = spark.createDataFrame([(0, 2), (1, 1), (3, 2)], "pos int, n int")
    want = {"a": "ACA--GT-", "b": "--C--T--", "c": "-GACC---", "d": "--------", "e": None}
    for held in (1 << 24, 8):
        monkeypatch.setattr(X, "OPENED_BYTES", held)
        assert {r["name"]: r["seq"] for r in X.open_queries(traces, gaps, 3).collect()} == want
    with pytest.raises(Exception, match="longer than its budget"):
        X.open_queries(traces, gaps.filter("pos > 0"), 3).collect()


def test_rows_are_made_from_their_cells(spark):
    cells = "array<struct<col:int,ch:string>>"
    given = [(1, [(0, "A"), (3, "C")]), (2, [(5, "T")]), (3, [(k, "G") for k in range(6)]), (4, [])]
    made = spark.createDataFrame(given, f"k int, m {cells}").select("k", R.row_of_cells(F.col("m"), F.lit(6)).alias("seq"))
    assert dict(map(tuple, made.collect())) == {1: "A--C--", 2: "-----T", 3: "GGGGGG", 4: "------"}
    msa = spark.createDataFrame([("p1.a", "A---"), ("p1.b", "--C-"), ("p2.a", "----")], "name string, seq string").withColumn("input", F.lit(0))
    merged = C.merge_by_prefix(msa, "p", "input")
    assert rows(merged) == rows(spark.createDataFrame([("p1", "A-C-"), ("p2", "----")], "name string, seq string"))
    # no lookup for every column of a row
    assert "try_element_at" not in merged._jdf.queryExecution().analyzed().toString()


def test_a_missing_profile_is_an_error(edges_and_queries):
    prof, queries, *_ = edges_and_queries
    placed = queries.limit(1).withColumn("edge_id", F.lit(4))
    for size in (1 << 20, 500):
        with pytest.raises(Exception, match="no profile for edge"):
            L.trace(placed, prof, broadcast_bytes=size).collect()
    with pytest.raises(ValueError, match="no profiles"):
        L.best_edge(queries, prof.filter("false"))


def test_queries_stay_in_place_on_the_broadcast_route(edges_and_queries, spark, tmp_path):
    prof, queries, *_ = edges_and_queries
    part = L.in_blocks(queries, prof.select("edge_id", "state", "aux"), "edge_id", 10, 1 << 20, L.ProfileSet.of, None, "seq_id long")
    assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()


# ---- log-odds ----------------------------------------------------------------------------


def node_table(spark, match, gap, ids):
    return spark.createDataFrame(
        [(int(i), match[k].tolist(), gap[k].tolist()) for k, i in enumerate(ids)], "node_id int, p array<array<double>>, gap array<double>"
    )


def test_node_ties_do_not_depend_on_blocks(spark):
    """Scores 0.3e-4 apart: only nodes within 1e-4 of the best of all may win."""
    n = 200
    base = np.array([0.97, 0.01, 0.01, 0.01])
    p = np.tile(base, (n, 1, 1))
    p[:, 0, 0] = 0.97 * np.exp(0.3e-4 * np.arange(n) - 0.3e-4 * n)
    table = node_table(spark, p, np.full((n, 1), 0.5), np.arange(n))
    queries = spark.createDataFrame([(1, "A")], "seq_id long, seq string")
    one, many = (G.best_node(queries, table, [0.25] * 4, broadcast_bytes=b).first() for b in (1 << 24, 2000))
    assert tuple(one) == tuple(many)
    assert one["node_id"] == 196


def log_odds_brute(match, residue, gap, query, delta, epsilon):
    """All alignments by the recurrence, cell by cell."""
    n, w = len(query), len(match)
    low, d, e = -math.inf, math.log(delta), math.log(epsilon)
    m = [[0.0] * (w + 1) for _ in range(n + 1)]
    ins = [[0.0] + [low] * w for _ in range(n + 1)]
    skip = [[low] * (w + 1) for _ in range(n + 1)]
    skip[0][1:] = [0.0] * w
    for i in range(1, n + 1):
        for j in range(1, w + 1):
            before = max(m[i - 1][j - 1] + residue[j - 1], ins[i - 1][j - 1] + gap[j - 1], skip[i - 1][j - 1] + gap[j - 1])
            m[i][j] = before + match[j - 1][query[i - 1]]
            ins[i][j] = max(m[i - 1][j] + d, ins[i - 1][j] + e)
        for j in range(1, w + 1):
            skip[i][j] = max(m[i][j - 1] + d, skip[i][j - 1] + e)
    return max(m[n][min(n, w) :])


def rescore(match, residue, gap, query, ops, delta, epsilon):
    """Score of an operation string; its first run of gaps and its last skips are free."""
    body = ops.decode().rstrip("1")
    start = 0 if body[0] == "0" else len(body) - len(body.lstrip(body[0]))
    i, j = (start, 0) if body[0] == "2" else (0, start)
    total, before = 0.0, None
    for c in body[start:]:
        if c == "0":
            weight = max(residue[j], gap[j]) if before is None else residue[j] if before == "0" else gap[j]
            total += weight + match[j][query[i]]
        else:
            total += math.log(epsilon if before == c else delta)
        i, j, before = i + (c != "1"), j + (c != "2"), c
    return total


def test_log_odds_traces():
    rng = np.random.default_rng(3)
    for _ in range(30):
        w = int(rng.integers(3, 20))
        match, residue, gap = rng.normal(0, 2, (w, 4)), rng.normal(0, 1, w), rng.normal(0, 1, w)
        queries = [rng.integers(0, 4, int(rng.integers(1, w + 1))) for _ in range(7)] + [np.empty(0, dtype=np.int64)]
        scores, ops = K.log_odds_traces(match, residue, gap, queries, 0.05, 0.3)
        for q, s, o in zip(queries, scores, ops):
            assert s == pytest.approx(log_odds_brute(match, residue, gap, q.tolist(), 0.05, 0.3))
            assert o.count(b"0") + o.count(b"2") == len(q) and o.count(b"0") + o.count(b"1") == w
            kernel = K.log_odds_scores(match[:, :, None], residue[:, None], gap[:, None], [q], 0.05, 0.3)
            if len(q):
                assert s == pytest.approx(kernel[0, 0])
                if b"0" in o:
                    assert s == pytest.approx(rescore(match, residue, gap, q.tolist(), o, 0.05, 0.3))


def test_log_odds_sum_of_paths_is_above_the_best():
    rng = np.random.default_rng(4)
    match, residue, gap = rng.normal(0, 2, (9, 4, 3)), rng.normal(0, 1, (9, 3)), rng.normal(0, 1, (9, 3))
    queries = [rng.integers(0, 4, 5) for _ in range(4)]
    best = K.log_odds_scores(match, residue, gap, queries, 0.05, 0.3)
    total = K.log_odds_scores(match, residue, gap, queries, 0.05, 0.3, "sum")
    assert (total >= best - 1e-9).all()


def test_node_traces_split_a_popular_node(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = node_table(spark, rng.dirichlet(np.ones(4), (3, 12)), rng.random((3, 12)), [5, 9, 2])
    queries = spark.createDataFrame([(k, "".join(rng.choice(list("ACGT"), 8))) for k in range(30)], "seq_id long, seq string")
    background = [0.25] * 4
    placed = queries.join(G.best_node(queries, table, background), "seq_id")
    one = rows(G.trace_nodes(placed, table, background))
    monkeypatch.setattr(L, "SALT_QUERIES", 3)
    assert rows(G.trace_nodes(placed, table, background)) == one
    assert [(r[0], r[1], pytest.approx(r[2])) for r in one] == [tuple(r) for r in sorted(placed.select("seq_id", "node_id", "score").collect())]
    with pytest.raises(Exception, match="no profile for node"):
        G.trace_nodes(placed.withColumn("node_id", F.lit(77)), table, background).collect()


# ---- orders, cycles, merging, distances ------------------------------------------------------


def test_one_length_is_ranked_over_many_partitions(spark):
    seqs = spark.range(500).select(F.col("id").alias("i"), F.lit("ACGT").alias("seq"))
    assert rows(W.length_order(seqs).select("rank", "i")) == [(k, k) for k in range(500)]


def test_generation_cycle(spark):
    history = [(g, f"{g if g < 3 else 3}-{k}") for g in range(8) for k in range(2)]
    found = rows(T.generation_cycle(spark.createDataFrame(history, "gen int, split_key string")))
    assert found == [(g, g - 1, 1) for g in range(4, 8)]


def test_first_input_wins_outside_the_prefix(spark):
    msa = spark.createDataFrame([("x", "AC", 2), ("x", "GT", 1), ("p1.a", "A-", 1), ("p1.b", "-C", 1)], "name string, seq string, no int")
    assert rows(C.merge_by_prefix(msa, "p", "no")) == [("p1", "AC"), ("x", "GT")]


def test_pairs_of_mixed_and_empty_rows(spark):
    seqs = spark.createDataFrame([(k, "" if k % 3 == 0 else "ACGTACGT"[: k % 7 + 1]) for k in range(20)], "i long, seq string")
    found = W.local_scores(seqs, S.flat_matrix(spark)).collect()
    assert sorted((r["i"], r["j"]) for r in found) == [(i, j) for i in range(20) for j in range(i, 20)]


def test_decimals_of_exact_halves(spark):
    values = [0.53125, 0.40625, 0.00625, 0.53135, 1.0, 0.0]
    table = spark.createDataFrame([(1, k, 0, v) for k, v in enumerate(values)], "i int, j int, score int, dist double")
    assert S.matrix_lines(table).first()["value"] == "1\t" + "\t".join("%.4f" % v for v in values)


def plain_penalty(state, flag, query, gap_open=3, gap_extend=1, mismatch=1, match_flag=3):
    """Rows of the band one after the other; a skip is tried from every column before."""
    band = len(state) - len(query) + 1
    cur = [0] * band
    for i, b in enumerate(query):
        step = lambda d: (0 if state[i + d] & b else mismatch) + (match_flag if flag[i + d] else 0)
        h = [min([cur[d] + step(d)] + ([cur[d + 1] + mismatch] if d + 1 < band else [])) for d in range(band)]
        skip = lambda e, d: sum(0 if flag[i + k] else gap_extend + (gap_open if k == e + 1 else 0) for k in range(e + 1, d + 1))
        cur = [min([h[d]] + [h[e] + skip(e, d) for e in range(d)]) for d in range(band)]
    return min(cur)


def test_cheapest_edge(edges_and_queries):
    prof, queries, state, aux, seqs = edges_and_queries
    code = {"A": 1, "C": 2, "G": 4, "T": 8}
    wanted = {99: (None, None)}
    for k, s in enumerate(seqs):
        costs = [plain_penalty(a.tolist(), (x == 1).tolist(), [code[c] for c in s]) for a, x in zip(state, aux)]
        wanted[k] = (3 * costs.index(min(costs)), min(costs))
    for size in (1 << 20, 500):
        found = L.cheapest_edge(queries, prof, broadcast_bytes=size).collect()
        assert {r["seq_id"]: (r["edge_id"], r["penalty"]) for r in found} == wanted
    long = queries.sparkSession.createDataFrame([(1, "A" * 30), (2, None)], "seq_id long, seq string")
    assert [r["penalty"] for r in L.cheapest_edge(long, prof).collect()] == [None, None]


def test_samples(spark):
    seqs = spark.range(2000).select(F.col("id").alias("seq_id"), F.lit("ACGT").alias("seq"), F.when(F.col("id") < 100, 50.0).otherwise(1.0).alias("weight"))
    for draw in (lambda seed: W.uniform_sample(seqs, 50, seed), lambda seed: W.weighted_sample(seqs, 50, seed)):
        ids = [r["seq_id"] for r in draw(3).collect()]
        assert len(ids) == len(set(ids)) == 50 and set(ids) <= set(range(2000))
        assert sorted(ids) == sorted(r["seq_id"] for r in draw(3).collect()) != sorted(r["seq_id"] for r in draw(4).collect())
    assert W.uniform_sample(seqs, 5000, 1).count() == 2000
    heavy = sum(r["seq_id"] < 100 for seed in range(6) for r in W.weighted_sample(seqs, 50, seed).collect())
    assert 150 < heavy < 280  # 72 % of the weight is theirs
    assert W.weighted_sample(seqs.withColumn("weight", F.lit(0.0)), 5, 1).count() == 0
    n = W.bernoulli_sample(seqs, 0.1, 5).count()
    assert 120 < n < 290 and W.bernoulli_sample(seqs, 0.0, 5).count() == 0 and W.bernoulli_sample(seqs, 1.0, 5).count() == 2000


def test_matching_sequences_reach_the_share(spark):
    primers = spark.createDataFrame([(0, "CTTGGTCATTTAGAGGAAGT"), (1, "CGATGAAGAACGCAG")], "primer_id int, seq string")
    one, two = (r["seq"] for r in primers.orderBy("primer_id").collect())
    body = "ACGTTGCA" * 5
    close = one[:10] + ("A" if one[10] != "A" else "C") + one[11:]  # a mismatch costs 8 of 100
    texts = [one + body + two, body + close + two, body + one, one[:12] + body + two, ""]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    assert {r["seq_id"] for r in W.primer_matches(seqs, primers).collect()} == {0, 1}
    assert {r["seq_id"] for r in W.sample_matching(seqs, primers, 5, 1).collect()} == {0, 1}
    assert W.sample_matching(seqs, primers, 1, 1).count() == 1
    with pytest.raises(ValueError, match="no sequence"):
        W.sample_matching(seqs.filter("seq_id > 1"), primers, 1, 1)


# ---- whole job and files -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def small_tree(spark):
    tree = spark.createDataFrame([("t", "((a:1,b:1):1,(c:1,d:1):1,e:1);")], "tree_id string, newick string")
    branches = T.explode_trees(tree)
    return T.nodes_of(branches).drop("tree_id"), T.edges_of(branches).drop("tree_id")


ROWS = {"a": "ACGT-ACGTAC", "b": "ACGTTACGTAC", "c": "AAGT-ACCTAC", "d": "AAGTTACCTGC", "e": "ACGT-TCGTAA"}


def test_place_job(spark, small_tree):
    nodes, edges = small_tree
    msa = spark.createDataFrame(list(ROWS.items()), "name string, seq string")
    queries = spark.createDataFrame([(1, "q1", "ACGTACGTAC"), (2, "q2", "AAGTTTACCTGC"), (3, "q3", "GTAC")], "seq_id long, name string, seq string")
    job = J.place_job(msa, nodes, edges, queries)
    aligned = {(r["kind"], r["name"]): r["seq"] for r in job.aligned.collect()}
    assert len({len(s) for s in aligned.values()}) == 1 and len(aligned) == 8
    assert {n: s.replace("-", "") for (k, n), s in aligned.items() if k == "qs"} == {r["name"]: r["seq"] for r in queries.collect()}
    assert {n: s.replace("-", "") for (k, n), s in aligned.items() if k == "ref"} == {n: s.replace("-", "") for n, s in ROWS.items()}
    limited = J.place_job(msa, nodes, edges, queries, spark.createDataFrame([("q3", 6, 10)], "name string, start int, end int"))
    ops = {r["seq_id"]: r["ops"] for r in limited.traces.collect()}
    assert ops[3].startswith("1" * 6)


def test_place_job_of_amino_acids(spark, small_tree):
    # N is a residue and no gap, U is nothing; B and Z stand for two amino acids each
    nodes, edges = small_tree
    rows = {"a": "NNMK-WNBR", "b": "NNMKLWNZR", "c": "NDMK-WNDR", "d": "NDMKLWNER", "e": "NNNN-NNNN"}
    msa = spark.createDataFrame(list(rows.items()), "name string, seq string")
    queries = spark.createDataFrame([(1, "q1", "nnmkwndr"), (2, "q2", "NNMKULWNDR")], "seq_id long, name string, seq string")
    job = J.place_job(msa, nodes, edges, queries, alpha=R.AA)
    aligned = {r["name"]: r["seq"] for r in job.aligned.collect()}
    assert {n: s.replace("-", "") for n, s in aligned.items()} == {
        **{n: s.replace("-", "") for n, s in rows.items()}, "q1": "NNMKWNDR", "q2": "NNMKLWNDR",
    }
    profiles = P.edge_profiles(msa, nodes, edges, alpha=R.AA).collect()
    state = lambda seq: [int(R.AA.state_table()[R.AA.byte_index()[ord(c)]]) for c in seq]
    want = {
        k: max(brute.profile_score(r["state"], r["aux"], state(q)) for r in profiles) for k, q in ((1, "NNMKWNDR"), (2, "NNMKLWNDR"))
    }
    assert {int(r["name"][1:]): r["score"] for r in job.placed.collect()} == want
    own = spark.createDataFrame([(1, "q1", aligned["q1"])], "seq_id long, name string, seq string")
    assert X.placement_quality(own, job.traces, R.AA).first()["share"] == 1.0


def test_insertion_in_order_and_guided(spark, small_tree):
    from cladeframe.plans import insertion as N

    nodes, edges = small_tree
    msa = spark.createDataFrame(list(ROWS.items()), "name string, seq string")
    first = N.start(msa, nodes, edges)
    grown = N.insert_in_order(first, spark.createDataFrame([(1, "y", "AAGTTTACCTGC"), (0, "x", "ACGTTACGTAC")], "rank int, name string, seq string"))
    found = dict(rows(grown.msa))
    assert set(found) == set("abcdexy") and len({len(s) for s in found.values()}) == 1
    assert found["x"].replace("-", "") == "ACGTTACGTAC" and found["y"].replace("-", "") == "AAGTTTACCTGC"
    assert {n: found[n].replace("-", "") for n in ROWS} == {n: s.replace("-", "") for n, s in ROWS.items()}
    degree = {}
    for r in grown.edges.collect():
        for end in (r["u"], r["v"]):
            degree[end] = degree.get(end, 0) + 1
    tips = {r["node_id"] for r in grown.nodes.filter("is_tip").collect()}
    assert len(tips) == 7 and grown.edges.count() == 2 * 7 - 3
    assert all(n == (1 if k in tips else 3) for k, n in degree.items())
    branches = T.explode_trees(spark.createDataFrame([("t", "((a:1,b:1):1,(c:1,d:1):1,e:1);")], "tree_id string, newick string"))
    beside = N.insert_guided(first, "z", "ACGTACGTAC", ["c", "d"], branches)
    edge = T.locate_edges(T.splits(branches), spark.createDataFrame([("t", 0, ["c", "d"])], "tree_id string, want_id int, tips array<string>"), branches).first()["edge_id"]
    old = edges.filter(f"edge_id = {edge}").first()
    z = beside.nodes.filter("name = 'z'").first()["node_id"]
    around = {r["v"] if r["u"] == z - 1 else r["u"] for r in beside.edges.collect() if z - 1 in (r["u"], r["v"])}
    assert around == {old["u"], old["v"], z}
    with pytest.raises(Exception, match="no branch"):
        N.insert_guided(first, "z", "ACGT", ["a", "c"], branches)


def test_files_round_trip(spark, tmp_path):
    msa = spark.createDataFrame(list(ROWS.items()), "name string, seq string")
    S.write_phylip(msa, f"{tmp_path}/phy")
    assert rows(S.read_phylip(spark, f"{tmp_path}/phy")) == sorted(ROWS.items())
    S.write_fasta(msa.repartition(3), f"{tmp_path}/fa")
    assert rows(S.read_fasta(spark, f"{tmp_path}/fa")) == sorted(ROWS.items())
    S.write_fasta(msa, f"{tmp_path}/degapped", drop_gaps=True)
    assert rows(S.read_fasta(spark, f"{tmp_path}/degapped")) == sorted((n, s.replace("-", "")) for n, s in ROWS.items())
    (tmp_path / "crlf.fa").write_bytes(b">s1  x\r\nAC\r\nGT\r\n>s2\r\nTT\r\n")
    assert rows(S.read_fasta(spark, f"{tmp_path}/crlf.fa")) == [("s1_x", "ACGT"), ("s2", "TT")]
    (tmp_path / "wrong.phy").write_text("3 4\na ACGT\nb AC-T\n")
    with pytest.raises(Exception, match="does not fit"):
        S.read_phylip(spark, f"{tmp_path}/wrong.phy")


def test_hits_partitions_and_matrices(spark, tmp_path):
    (tmp_path / "hits").mkdir()
    line = "q{} r1 97.5 10 1 0 1 10 5 14 1e-5 {}\n"
    (tmp_path / "hits" / "a.txt").write_text("".join(line.format(k, 20 + k) for k in range(5)))
    (tmp_path / "hits" / "b.txt").write_text("".join(line.format(k, 20 + k) for k in range(5, 9)))
    hits = S.read_blast(spark, f"{tmp_path}/hits")
    assert rows(hits.select("line_no", "qs_name", "qs_start", "ref_end")) == [(k, f"q{k}", 0, 13) for k in range(9)]
    (tmp_path / "bad.txt").write_text("q1 r1 97.5\n")
    with pytest.raises(Exception, match="bad hit line"):
        S.read_blast(spark, f"{tmp_path}/bad.txt").collect()
    (tmp_path / "parts.txt").write_text("DNA, g1 = 1-4\r\nDNA, g2 = 5-11\n")
    assert rows(S.read_partitions(spark, f"{tmp_path}/parts.txt").select("gene_name", "start", "end")) == [("g1", 0, 3), ("g2", 4, 10)]
    (tmp_path / "matrix.txt").write_text("# scores\n  A C\nA 3 -1\nC -1 4\n")
    assert rows(S.read_matrix(spark, f"{tmp_path}/matrix.txt")) == [("A", "A", 3), ("A", "C", -1), ("C", "A", -1), ("C", "C", 4)]


def test_probabilities_lines_and_tables(spark, tmp_path):
    blob = b"".join(struct.pack("<ii8d", k, 2, *([0.25 * (k + 1)] * 8)) for k in range(3)) + struct.pack("<i", -1)
    (tmp_path / "anc.bin").write_bytes(blob)
    found = rows(S.read_anc_probs(spark, f"{tmp_path}/anc.bin").select("node_label", "col", F.element_at("p", 1)))
    assert found == [(k, c, 0.25 * (k + 1)) for k in range(3) for c in range(2)]
    (tmp_path / "raw.txt").write_text("ACGT\nAC-T\n")
    assert rows(S.read_raw_lines(spark, f"{tmp_path}/raw.txt")) == [("0", "ACGT"), ("1", "AC-T")]
    (tmp_path / "uneven.txt").write_text("ACGT\nAC\n")
    with pytest.raises(Exception, match="line lengths"):
        S.read_raw_lines(spark, f"{tmp_path}/uneven.txt")
    table = spark.createDataFrame([(i, j, 3 * i + j, (i + j) / 8) for i in range(2) for j in range(2)], "i int, j int, score int, dist double")
    S.write_matrix(table, f"{tmp_path}/dist")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/dist").collect()] == ["2", "0\t0.0000\t0.1250", "1\t0.1250\t0.2500"]
    S.write_matrix(table, f"{tmp_path}/score", "score")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/score").collect()] == ["0\t0\t1", "1\t3\t4"]


def test_stream_of_files(spark, edges_and_queries, tmp_path):
    from cladeframe.streaming.placement import place_stream

    prof, queries, *_ = edges_and_queries
    fresh = queries.filter("seq <> ''")
    fresh.filter("seq_id < 10").write.parquet(f"{tmp_path}/in/a")
    arriving = spark.readStream.schema(queries.schema).parquet(f"{tmp_path}/in/*")
    run = lambda: place_stream(arriving, prof, f"{tmp_path}/out", f"{tmp_path}/log", once=True).awaitTermination()
    run()
    fresh.filter("seq_id >= 10").write.parquet(f"{tmp_path}/in/b")
    run()
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("seq_id", "edge_id", "score")) == rows(L.best_edge(fresh, prof))


def test_distinct_traces(spark):
    table = spark.createDataFrame([(1, "00", 5, 3), (1, "00", 2, 3), (1, "01", 4, 2)], "seq_id long, ops string, edge_id int, score int")
    assert rows(X.distinct_traces(table).select("seq_id", "ops", "edge_id")) == [(1, "00", 2), (1, "01", 4)]


def plain_rescore(state, flag, query, ops):
    """A walk over the operations; the first and the last run of skips or insertions are free."""
    runs = []
    for o in ops:
        if runs and runs[-1][0] == o:
            runs[-1][1] += 1
        else:
            runs.append([o, 1])
    col = res = total = 0
    for at, (o, n) in enumerate(runs):
        for k in range(n):
            paid = o == "0" or 0 < at < len(runs) - 1
            if o == "0":
                total += (2 if state[col] & query[res] else 0) - (3 if flag[col] else 0)
            elif paid:
                total -= 0 if o == "1" and flag[col] else 1 if k else 3
            col, res = col + (o != "2"), res + (o != "1")
    return total


def test_traces_are_scored_again_from_their_operations(spark):
    rng = np.random.default_rng(31)
    state, flag = rng.integers(1, 15, (4, 12)), rng.integers(0, 2, (4, 12))
    prof = spark.createDataFrame([(k, state[k].tolist(), flag[k].tolist()) for k in range(4)], "edge_id int, state array<int>, aux array<int>")
    code = {"A": 1, "C": 2, "G": 4, "T": 8}
    queries, traces, want = [], [], {}
    for k in range(200):
        # any order of steps over all columns, also runs beside runs and none of residues
        ops = list("0" * 12)
        for at in rng.choice(12, rng.integers(0, 8), replace=False):
            ops[at] = "1"
        for _ in range(rng.integers(0, 5)):
            ops.insert(int(rng.integers(0, len(ops) + 1)), "2")
        ops = "".join(ops)
        seq = "".join(rng.choice(list("ACGT"), ops.count("0") + ops.count("2")))
        queries.append((k, seq))
        traces.append((k, k % 4, ops))
        want[k] = plain_rescore(state[k % 4], flag[k % 4], [code[c] for c in seq], ops)
    queries += [(900, ""), (901, None)]
    traces += [(900, 0, "1" * 12), (901, 0, "1" * 12)]
    table = spark.createDataFrame(traces, "seq_id long, edge_id int, ops string")
    asked = spark.createDataFrame(queries, "seq_id long, seq string")
    got = {r["seq_id"]: r["score"] for r in L.rescored(table, asked, prof).collect()}
    assert got == want | {900: None, 901: None}
    assert L.rescored(table.limit(0), asked, prof).count() == 0


def test_scores_of_operations_are_those_of_the_placement(edges_and_queries):
    prof, queries, *_ = edges_and_queries
    placed = L.best_edge(queries, prof).join(queries, "seq_id")
    traces = L.trace(placed, prof)
    again = L.rescored(traces.drop("score"), queries, prof)
    assert rows(again.select("seq_id", "score")) == rows(traces.select("seq_id", "score"))
    # one residue more before the last column is another score or no trace at all
    spoilt = traces.filter("ops LIKE '%00%'").withColumn("ops", F.regexp_replace("ops", "00", "0210"))
    worse = {r["seq_id"]: r["score"] for r in L.rescored(spoilt.drop("score"), queries, prof).collect()}
    best = {r["seq_id"]: r["score"] for r in traces.collect()}
    assert worse and any(worse[k] != best[k] for k in worse)
    bounds = placed.withColumn("start", F.when(F.col("seq_id") % 3 > 0, (F.col("seq_id") % 7).cast("int"))).withColumn("end", F.col("start") + 15)
    limited = L.trace(bounds.drop("score", "edge_id").join(L.best_edge(bounds.drop("edge_id", "score"), prof), "seq_id"), prof)
    limited = limited.join(bounds.select("seq_id", "start", "end"), "seq_id")
    again = L.rescored(limited.drop("score"), queries, prof)
    assert rows(again.select("seq_id", "score")) == rows(limited.select("seq_id", "score"))


def test_candidates(edges_and_queries):
    prof, queries, *_ = edges_and_queries
    asked = queries.filter("seq <> ''")
    found = J.candidates(asked, prof, 4)
    top = L.top_edges(asked, prof, 4)
    assert rows(found.scored.select("seq_id", "edge_id", "score", "rank")) == rows(top.select("seq_id", "edge_id", "score", "rank"))
    least = {}
    for r in found.scored.collect():
        least[r["seq_id"], r["ops"]] = min(least.get((r["seq_id"], r["ops"]), (10**9, 0)), (r["edge_id"], r["score"]))
    assert {(r["seq_id"], r["ops"]): (r["edge_id"], r["score"]) for r in found.report.collect()} == least


def test_dtw_of_equal_series_is_made_once(spark, monkeypatch):
    kinds = [[1.0, 5.0, 2.0], [4.0], [3.0, 3.0, 0.0, 7.0]]
    rows = [(k * 7 % 13, kinds[k % 3]) for k in range(13)]
    asked, cells = [], W._cells
    monkeypatch.setattr(W, "_cells", lambda left, right, *rest: asked.append([d.count() for d in (left, right) if d is not None]) or cells(left, right, *rest))
    table = lambda rows: spark.createDataFrame(rows, "key long, v array<double>")
    got = sorted(tuple(r) for r in W.dtw_distances(table([*rows, (99, [])]), block=4).collect())
    assert got == sorted((i, j, brute.dtw(x, y)) for i, x in rows for j, y in rows if i <= j)
    other = [(1, [1.0, 5.0]), (2, [2.0])]  # a set without copies
    got = sorted(tuple(r) for r in W.dtw_distances(table(rows), table(other), block=4).collect())
    assert got == sorted((i, j, brute.dtw(x, y)) for i, x in rows for j, y in other)
    assert asked == [[3], [3, 2]]


def test_placed_ends_are_traced_in_one_sweep(edges_and_queries, monkeypatch):
    prof, queries, *_ = edges_and_queries
    named = queries.withColumn("name", F.concat(F.lit("q"), "seq_id"))
    for asked in (named, named.withColumn("start", (F.col("seq_id") % 3).cast("int")).withColumn("end", F.col("start") + 9)):
        ends = asked.drop("end_row").join(L.best_edge(asked, prof, ends=True), "seq_id")
        assert rows(ends.select("seq_id", "edge_id", "score")) == rows(L.best_edge(asked, prof))
        assert rows(L.trace(ends, prof, checked=True)) == rows(L.trace(ends.drop("end_row"), prof, checked=True))
    batch = {c: [r[c] for r in ends.filter("seq <> ''").collect()] for c in ends.columns}
    profiles = L.ProfileSet.of(prof.select("edge_id", "state", "aux").toArrow())
    swept, real = [], K._Pairs.sweep
    monkeypatch.setattr(K._Pairs, "sweep", lambda self, keep=True: swept.append(keep) or real(self, keep))
    L._trace_rows(batch, profiles, L.R.DNA, L.Scores())
    assert swept and all(swept)
    with pytest.raises(ValueError, match="trace score differs"):
        L._trace_rows({**batch, "score": [s + 1 for s in batch["score"]]}, profiles, L.R.DNA, L.Scores())


def test_dtw_pairs_of_copies_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(W, "CLASS_IDS", 4)
    monkeypatch.setattr(W, "PAIRS_PER_BATCH", 16)
    rows = [(k, [1.0, 5.0] if k < 30 else [float(k), 2.0, 0.5]) for k in range(40)]
    got = W.dtw_distances(spark.createDataFrame(rows, "key long, v array<double>"), block=64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, j, brute.dtw(x, y)) for i, x in rows for j, y in rows if i <= j)


def test_longest_insertions_of_traces(spark):
    rng = np.random.default_rng(4)
    ops = ["".join(rng.choice(list("0122"), k)) for k in (0, 1, 5, 30, 30, 60)] + ["2", "22", "1", "0022", None]
    wanted = {}
    for s in ops:
        pos = n = 0
        for o in (s or "") + "0":
            if o != "2":
                if n:
                    wanted[pos] = max(wanted.get(pos, 0), n)
                pos, n = pos + 1, -1
            n += 1
    got = X.insert_budget(spark.createDataFrame([(s,) for s in ops], "ops string"))
    assert got.dtypes == [("pos", "int"), ("n", "int")] and {r["pos"]: r["n"] for r in got.collect()} == wanted


def test_gapped_text_of_long_runs_of_skips(spark):
    # a pattern for the tail took the square of each run
    ops = "0" + "1" * 200_000 + "2" + "1" * 200_000 + "0" + "1" * 7
    began = time.time()
    row = spark.createDataFrame([(ops, "ACG"), ("11", "")], "ops string, seq string").select(X.gapped(F.col("ops"), F.col("seq")).alias("g")).collect()
    assert row[0]["g"] == "A" + "-" * 200_000 + "c" + "-" * 200_000 + "G" + "-" * 7 and row[1]["g"] == "--"
    assert time.time() - began < 15
