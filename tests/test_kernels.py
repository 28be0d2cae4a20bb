import tracemalloc

import numpy as np
import pytest

import brute
from cladeframe.functions import kernels as K


def rand_case(rng, n_col, n_prof, n_q, max_len):
    state = rng.integers(1, 16, (n_col, n_prof))
    flag = rng.random((n_col, n_prof)) < 0.3
    queries = [rng.integers(1, 15, rng.integers(1, max_len + 1)) for _ in range(n_q)]
    return state, flag, queries


@pytest.mark.parametrize("scheme", [(2, -3, -3, -1), (1, -2, -2, -2), (3, 0, -5, -1)])
def test_profile_scores_match_brute_force(scheme):
    rng = np.random.default_rng(1)
    for _ in range(25):
        state, flag, queries = rand_case(rng, int(rng.integers(1, 14)), 5, 7, 12)
        got = K.profile_scores(state, flag, np.arange(16), queries, *scheme)
        for b, q in enumerate(queries):
            for e in range(5):
                assert got[b, e] == brute.profile_score(state[:, e], flag[:, e], q, *scheme)


def test_golden_free_shift():
    state = np.array([2, 4, 1, 5, 8, 4, 4, 2, 4, 1, 8, 1, 1, 2, 2])[:, None]
    flag = (np.arange(15) == 3)[:, None]
    q = [np.array([4, 2, 1, 8, 2])]
    assert K.profile_scores(state, flag, np.arange(16), q, 2, -3, -3, -1)[0, 0] == 5
    score, ops = K.trace_pairs(state, flag, q, 2, -3, -3, -1)
    assert score[0] == 5
    assert ops[0].decode()[::-1] == "111000100111111"


def test_trace_score_equals_kernel_score():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = 6
        state, flag, queries = rand_case(rng, int(rng.integers(1, 15)), n, n, 14)
        scores, ops = K.trace_pairs(state, flag, queries, 2, -3, -3, -1)
        for k in range(n):
            text = ops[k].decode()
            want = brute.profile_score(state[:, k], flag[:, k], queries[k])
            assert scores[k] == want
            total, a, b = brute.trace_score(state[:, k], flag[:, k], queries[k], text)
            assert (a, b) == (state.shape[0], queries[k].size)
            if "0" in text:
                assert total <= want


def test_empty_query_is_lowest_and_all_skip():
    state, flag = np.ones((4, 1), dtype=int), np.zeros((4, 1), dtype=bool)
    got = K.profile_scores(state, flag, np.arange(16), [np.array([], dtype=int)], 2, -3, -3, -1)
    assert got[0, 0] == np.iinfo(np.int32).min
    assert K.trace_pairs(state, flag, [np.array([], dtype=int)], 2, -3, -3, -1)[1] == [b"1111"]


@pytest.mark.parametrize("local,soft", [(True, False), (False, False), (False, True)])
def test_matrix_scores_match_brute_force(local, soft):
    rng = np.random.default_rng(3)
    matrix = np.where(np.eye(4, dtype=bool), 5, -3)
    for _ in range(25):
        profs = [rng.integers(0, 4, rng.integers(1, 12)) for _ in range(4)]
        queries = [rng.integers(0, 4, rng.integers(1, 12)) for _ in range(5)]
        got = K.matrix_scores(profs, queries, matrix, -5, -2, local, soft)
        for b, q in enumerate(queries):
            for e, p in enumerate(profs):
                if soft:  # the soft start sits on the other axis of the plain recurrence
                    want = brute.free_shift(
                        list(q), list(p), lambda c, r: matrix[c, r], lambda c: -5, lambda c: -2, -5, -2, up_start=0
                    )
                else:
                    want = brute.free_shift(
                        list(p), list(q), lambda c, r: matrix[c, r], lambda c: -5, lambda c: -2, -5, -2, local=local
                    )
                assert got[b, e] == want


def test_local_goldens():
    code = {c: k for k, c in enumerate("ACGT")}
    seqs = [np.array([code[c] for c in s]) for s in ("ACGTACGT", "ACGTTACGT", "GGGG")]
    got = K.matrix_scores(seqs, seqs, np.eye(4, dtype=int) * 3, -5, -2, True)
    assert got.tolist() == [[24, 19, 3], [19, 27, 3], [3, 3, 12]]


def test_large_scores_use_wide_integers():
    q = [np.zeros(300, dtype=int)]
    got = K.matrix_scores([np.zeros(300, dtype=int)], q, np.full((1, 1), 300), -5, -2, True)
    assert got[0, 0] == 90000


def test_opening_cheaper_than_extending_is_refused():
    with pytest.raises(ValueError):
        K.matrix_scores([np.zeros(3, dtype=int)], [np.zeros(3, dtype=int)], np.eye(1, dtype=int), -1, -2, True)


def test_dtw():
    assert K.dtw_distances([np.array([1, 2, 3, 4, 5])], [np.array([1, 2, 4])])[0, 0] == 2
    rng = np.random.default_rng(4)
    xs = [rng.integers(0, 20, rng.integers(1, 9)) for _ in range(6)]
    got = K.dtw_distances(xs, xs[::-1])
    for i, x in enumerate(xs):
        for j, y in enumerate(xs[::-1]):
            assert got[i, j] == brute.dtw(x, y)
    d, path = K.dtw_path(np.array([1, 2, 3, 4, 5]), np.array([1, 2, 4]))
    assert d == 2 and path[0] == (0, 0) and path[-1] == (4, 2)


@pytest.mark.parametrize("piece", [8, 1024])
def test_traces_from_given_ends(monkeypatch, piece):
    monkeypatch.setattr(K, "PIECE", piece)
    rng = np.random.default_rng(8)
    symbol_states = np.array([1, 2, 4, 8])
    for n_col in (1, 3, 7):
        state, flag = rng.integers(1, 16, (n_col, 5)), rng.random((n_col, 5)) < 0.3
        queries = [rng.integers(0, 4, int(n)) for n in (1, 2, 9, 90, 300)]
        ends = np.zeros((5, 5), np.int64)
        scores = K.profile_scores(state, flag, symbol_states, queries, 2, -3, -3, -1, ends)
        for e in range(5):
            own = [x[:, [e] * 5] for x in (state, flag)]
            bits = [symbol_states[q] for q in queries]
            want = K.trace_pairs(*own, bits, 2, -3, -3, -1)
            got = K.trace_pairs(*own, bits, 2, -3, -3, -1, ends[:, e])
            assert got[1] == want[1] and got[0].tolist() == want[0].tolist() == scores[:, e].tolist()
    with pytest.raises(ValueError, match="outside"):
        K.trace_pairs(*own, bits, 2, -3, -3, -1, np.full(5, 300))


@pytest.mark.parametrize("draw", [lambda r, n: r.integers(0, 90_000, n).astype(float), lambda r, n: r.normal(size=n), lambda r, n: r.integers(0, 10**12, n).astype(float)])
@pytest.mark.parametrize("lanes", [1, 7, 1536])
def test_dtw_of_many_pairs(monkeypatch, draw, lanes):
    monkeypatch.setattr(K, "DTW_LANES", lanes)
    rng = np.random.default_rng(lanes)
    xs, ys = ([draw(rng, int(rng.integers(1, 8))) for _ in range(n)] for n in (9, 11))
    got = K.dtw_distances(xs, ys)
    assert [[brute.dtw(x, y) for y in ys] for x in xs] == got.tolist()


def test_dtw_memory_does_not_grow_with_pairs_times_samples():
    rng = np.random.default_rng(2)
    xs = [rng.integers(0, 90_000, 30).astype(float) for _ in range(400)]
    tracemalloc.start()
    got = K.dtw_distances(xs, xs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all cells of two rows of the table took 80 MB
    assert peak < 16 << 20 and (got == got.T).all() and not got.diagonal().any()


def test_long_queries_are_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    state, flag = rng.integers(1, 16, (12, 3)), rng.random((12, 3)) < 0.2
    queries = [rng.integers(0, 15, n) for n in (0, 3, 700, 1500)]
    scored = lambda: K.profile_scores(state, flag, np.arange(16), queries, 2, -3, -3, -1)
    whole = scored()
    back = K.overlap(12, 24, -14, -1)
    monkeypatch.setattr(K, "PIECE", 1)
    assert len(K.cuts(1500, back)) > 5 and K.cuts(1500, back)[-1][1] == 1500
    assert (scored() == whole).all()
    # values of such a profile fit a byte
    assert K._offset_type(-10, 200)[0] == np.int8


def test_edges_that_cannot_win_are_not_scored(monkeypatch):
    from cladeframe.functions import residues as R
    from cladeframe.operators import place as L

    rng = np.random.default_rng(6)
    state = rng.integers(1, 16, (30, 20))
    flag = np.arange(30)[:, None] >= np.repeat([30, 4], 10)
    prof = L.ProfileSet(np.arange(20), state, flag)
    batch = {"seq_id": [0, 1, 2], "seq": ["ACGTRYKMACGTACGT" * 9, "", "GATTACA" * 20]}
    met = []
    real = K.profile_scores
    monkeypatch.setattr(K, "profile_scores", lambda s, *a: met.append(s.shape[1]) or real(s, *a))
    monkeypatch.setattr(L, "EDGES_PER_ROUND", 20)
    every = L._score_rows(batch, prof, R.DNA, L.Scores(), 1)
    monkeypatch.setattr(L, "EDGES_PER_ROUND", 5)
    met.clear()
    assert L._score_rows(batch, prof, R.DNA, L.Scores(), 1).equals(every)
    assert sum(met) <= 10


def test_traces_of_long_queries_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    state, flag = rng.integers(1, 16, (9, 6)), rng.random((9, 6)) < 0.3
    queries = [rng.choice([1, 2, 4, 8], n) for n in (0, 4, 90, 200, 500, 900)]
    scores, ops = K.trace_pairs(state, flag, queries, 2, -3, -3, -1)
    swept = []
    real = K._Pairs.sweep
    monkeypatch.setattr(K._Pairs, "sweep", lambda self, keep=True: swept.append((keep, self.lens.max())) or real(self, keep))
    monkeypatch.setattr(K, "PIECE", 1)
    again, same = K.trace_pairs(state, flag, queries, 2, -3, -3, -1)
    assert (scores == again).all() and ops == same
    # rows are kept only for the residues that a path can cross
    assert max(n for keep, n in swept if keep) < 60 and max(n for _, n in swept) < 500


def test_one_long_query_does_not_widen_the_others():
    sizes = [50_000, *[20] * 3000]
    filled = [sum(sizes[x] for x in queue) for queue in K._queues(sizes, 500)]
    assert filled[0] == 50_000 and max(filled[1:]) <= 12_100 and sum(filled) == sum(sizes)
    # before, every query of a batch was padded to the longest one
    rng = np.random.default_rng(8)
    queries = [rng.integers(0, 4, n) for n in sizes]
    peak = []
    pad = K._pad
    K._pad = lambda rows, width, fill: peak.append(len(rows) * width) or pad(rows, width, fill)
    try:
        K.matrix_scores([rng.integers(0, 4, 20)], queries, np.eye(4, dtype=int) * 8 - 3, -5, -2, False, True)
    finally:
        K._pad = pad
    assert max(peak) <= 4 * sum(sizes)
