import random

from cladeframe.llm import hamming_dedup as H
from corpus_texts import prose


def brute(rows):
    """Groups by exact shingle sets over all pairs."""
    sets = {}
    for k, (_, text, *_) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    groups = {}
    for k in sets:
        if rows[k][0] is not None:
            groups.setdefault(find(k), []).append(rows[k][0])
    return [(r[0], len(sets[k]), None if r[0] is None else min(groups[find(k)])) for k, r in enumerate(rows)]


def got(docs):
    return [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in H.near_duplicates(docs).collect()]


def same(found, rows):
    want = [(*x, x[0] is None or x[0] == x[2]) for x in brute(rows)]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(found, key=order) == sorted(want, key=order)


def test_odd_rows(odd, odd_rows):
    same(got(odd), odd_rows)


def test_empty_table(none):
    assert got(none) == []


def test_chains_copies_and_families(make):
    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randrange(30, 200))) for k in range(40)]
    base = prose(rng, 150).split()
    for k in range(100, 160):  # a family whose members are near the base and not always near each other
        w = base[:]
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    chain = prose(rng, 100).split()
    for k in range(200, 212):  # each a step from the last
        chain[rng.randrange(100)] = f"y{k}"
        rows.append((k, " ".join(chain)))
    shared = prose(rng, 60)
    rows += [(300 + k, f"{prose(rng, 60)} {shared}") for k in range(30)]  # one passage, no near copies
    rows += [(400 + k, rows[0][1]) for k in range(25)]  # copies
    rng.shuffle(rows)
    same(got(make(rows)), rows)


def test_every_pair_under_the_distance_shares_a_key():
    rng = random.Random(5)
    limit = H.CHUNKS * (H.ERRORS + 1) - 1
    for _ in range(300):
        a = [rng.randrange(256) for _ in range(H.CHUNKS * H.WIDTH)]
        b = a[:]
        for k in rng.sample(range(len(a)), limit):
            b[k] = (b[k] + rng.randrange(1, 256)) % 256
        apart = [sum(x != y for x, y in zip(a[c : c + H.WIDTH], b[c : c + H.WIDTH])) for c in range(0, len(a), H.WIDTH)]
        assert min(apart) <= H.ERRORS


def test_parity_bound_never_drops_a_link():
    rng = random.Random(6)
    for n in (4, 50, 400, 3000):
        for _ in range(20):
            common = [rng.getrandbits(64) for _ in range(n)]
            extra = int(n / 3)  # a Jaccard of 0.75 or a little more
            cut = rng.randrange(extra + 1)
            a, b = common + [rng.getrandbits(64) for _ in range(cut)], common + [rng.getrandbits(64) for _ in range(extra - cut)]
            pa, pb = (int.from_bytes(H.parity(H.np.array(sorted(s), H.np.uint64)).tobytes(), "little") for s in (a, b))
            most = (len(a) + len(b)) / 7
            expected = H.PARITY / 2 * (1 - H.np.exp(-2 * most / H.PARITY)) + 5.5 * H.PARITY**0.5 / 2
            assert (pa ^ pb).bit_count() <= min(most + 1e-6, expected)
