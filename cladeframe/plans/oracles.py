"""Equivalent SQL for the registered queries, for an independent engine.

Each statement is put together from named CTEs over the driver's tables.  The dynamic
programs are recursive CTEs with one step per residue and a window per row.
"""

from __future__ import annotations

import re

# The residue fold used by every adapter.
FOLD = ("abcdefghijklmnopqrstuvwxyzUN?.", "ABCDEFGHIJKLM-OPQRSTTVWXYZT---")
FOLD4 = ("abcdefghijklmnopqrstuvwxyzU", "ABCDEFGHIJKLMNOPQRSTTVWXYZT")
SINGLES = "ACMGRSVTWYHKDB"
AA = "ARNDCQEGHILKMFPSTWYV"
#: Amino acids that stand for A, C, G, T, N and U of the month alignment.
AA_REFERENCE = "AEBSZN"


def norm(x: str) -> str:
    return f"translate({x}, '{FOLD[0]}', '{FOLD[1]}')"


def single(x: str) -> str:
    return f"regexp_replace({norm(x)}, '[^{SINGLES}]', '', 'g')"


def acgt(x: str) -> str:
    return f"regexp_replace(translate({x}, '{FOLD4[0]}', '{FOLD4[1]}'), '[^ACGT]', '', 'g')"


def letters(x: str) -> str:
    return f"string_split({x}, '')"


def length_of(v: str) -> str:
    """Branch length above a heap node; nodes 2 and 3 share one branch."""
    own = lambda k: f"(0.05 + 0.01 * ({k} % 7))"
    return f"(CASE WHEN {v} IN (2, 3) THEN {own(2)} + {own(3)} ELSE {own(v)} END)"


def long_of(source: str, seq: str = "seq", extra: str = "name") -> str:
    return (
        f"SELECT {extra}, col, substr({seq}, CAST(col + 1 AS INTEGER), 1) AS ch "
        f"FROM (SELECT *, unnest(range(0, length({seq}))) AS col FROM {source})"
    )


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def variant(suffix: str, *changed: str) -> None:
    """Copies, with a suffix, of all CTEs that read one of ``changed``, reading the suffixed ones."""
    renamed = set(changed)
    for name, (needs, _) in list(CTES.items()):
        if renamed & set(needs) and name + suffix not in CTES:
            renamed.add(name)
    words = re.compile(rf"\b({'|'.join(sorted(renamed))})\b")
    for name in [n for n in CTES if n in renamed and n not in changed]:
        needs, sql = CTES[name]
        CTES[name + suffix] = ([n + suffix if n in renamed else n for n in needs], words.sub(rf"\1{suffix}", sql))


def statement(final: str, *needs: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    body = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {body}\n{final}" if order else final


cte("cal", [], "SELECT min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders")
cte(
    "monthly", ["cal"],
    "SELECT c_nationkey AS k, (year(o_orderdate) - (SELECT y0 FROM cal)) * 12 + month(o_orderdate) - 1 AS col, "
    "count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
)
cte(
    "counts", ["monthly"],
    "SELECT n_name AS name, col, n FROM monthly JOIN nation ON k = n_nationkey UNION ALL "
    "SELECT replace(r_name, ' ', '_'), col, sum(n) FROM monthly JOIN nation ON k = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)


def rows_from(counts: str) -> str:
    return (
        "SELECT g.name, string_agg(substr('-ACGTNU', CAST(1 + coalesce(n, 0) % 7 AS INTEGER), 1), '' ORDER BY g.col) AS seq "
        f"FROM (SELECT name, unnest(range(0, (y1 - y0 + 1) * 12)) AS col FROM (SELECT DISTINCT name FROM {counts}), cal) g "
        f"LEFT JOIN {counts} c ON c.name = g.name AND c.col = g.col GROUP BY 1"
    )


cte("msa", ["counts", "cal"], rows_from("counts"))
cte("tips", [], "SELECT CAST(n_nationkey + (SELECT count(*) FROM nation) AS INTEGER) AS node_id, n_name AS name FROM nation")
cte("msa_long", ["msa"], long_of("msa"))
cte("ref_long", ["msa", "tips"], long_of(f"(SELECT name, {norm('seq')} AS seq FROM msa WHERE name IN (SELECT name FROM tips))"))
cte(
    "ref_cols", ["ref_long"],
    "SELECT name, ch, col AS old, dense_rank() OVER (ORDER BY col) - 1 AS col FROM ref_long "
    "WHERE col IN (SELECT col FROM ref_long GROUP BY col HAVING bool_or(ch <> '-'))",
)
cte("gapfreq", ["ref_cols"], "SELECT count(*) FILTER (ch = '-') / CAST(count(*) AS DOUBLE) AS f FROM ref_cols")
cte(
    "vectors", [],
    "SELECT 'v' || vec_id AS name, array_to_string(list_transform(embedding, lambda x: CASE WHEN x < -0.1 THEN 'A' "
    "WHEN x < -0.05 THEN '-' WHEN x < 0 THEN 'C' WHEN x < 0.05 THEN 'G' WHEN x < 0.1 THEN 'n' ELSE 'T' END), '') AS seq FROM embeddings",
)
cte("vectors_long", ["vectors"], long_of("vectors"))
cte(
    "owner", ["cal"],
    "SELECT o_custkey, (year(o_orderdate) - (SELECT y0 FROM cal)) * 12 + month(o_orderdate) - 1 AS col, "
    "min(o_orderpriority) AS pri, count(*) AS m FROM orders GROUP BY 1, 2",
)
cte("owner_counts", ["owner"], "SELECT 'motu_cluster_' || o_custkey || '.' || substr(pri, 1, 1) AS name, col, (m - 1) % 4 + 1 AS n FROM owner")
cte("gene_rows", ["owner_counts", "cal"], rows_from("owner_counts"))
cte(
    "genes", ["cal"],
    "SELECT 2 * (y - y0) + h AS ord, 'h' || y || '_' || h AS gene_name, (y - y0) * 12 + 6 * h AS \"start\", (y - y0) * 12 + 6 * h + 5 AS \"end\" "
    "FROM (SELECT unnest(range(y0, y1 + 1)) AS y, y0, y1 FROM cal), (SELECT unnest([0, 1]) AS h) "
    "UNION ALL SELECT 2 * (y1 - y0 + 1) + y - y0, 'y' || y, (y - y0) * 12, (y - y0) * 12 + 11 "
    "FROM (SELECT unnest(range(y0, y1 + 1)) AS y, y0, y1 FROM cal)",
)
cte(
    "hits", [],
    "SELECT 'o' || l_orderkey AS qs_name, n_name AS ref_name, CAST(l_partkey % 8 AS INTEGER) AS ref_start, "
    "CAST(l_partkey % 8 + CAST(l_quantity AS INTEGER) % 8 AS INTEGER) AS ref_end, l_extendedprice AS bit_score, "
    "l_linenumber * 1000000 + l_partkey AS line_no FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
)
cte(
    "best_hits", ["hits"],
    "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY qs_name ORDER BY bit_score DESC, line_no, "
    "ref_name DESC, ref_start DESC, ref_end DESC) AS r FROM hits) WHERE r = 1",
)
cte(
    "hit_cols", ["best_hits", "msa_long"],
    "SELECT h.*, CAST(a.col AS INTEGER) AS col_start, CAST(b.col AS INTEGER) AS col_end FROM best_hits h "
    f"JOIN (SELECT name, col, row_number() OVER (PARTITION BY name ORDER BY col) - 1 AS k FROM msa_long WHERE {norm('ch')} <> '-') a "
    "ON a.name = ref_name AND a.k = ref_start "
    f"JOIN (SELECT name, col, row_number() OVER (PARTITION BY name ORDER BY col) - 1 AS k FROM msa_long WHERE {norm('ch')} <> '-') b "
    "ON b.name = ref_name AND b.k = ref_end",
)
cte(
    "series", [],
    "SELECT key, day, row_number() OVER (PARTITION BY key ORDER BY day) AS t, cents FROM (SELECT user_id AS key, CAST(ts AS DATE) AS day, "
    "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS cents FROM events GROUP BY 1, 2)",
)
cte(
    "season", ["monthly"],
    "SELECT tree_id, mon, coalesce(n, 0) AS n FROM (SELECT tree_id, unnest(range(0, 12)) AS mon FROM (SELECT DISTINCT n_name AS tree_id FROM monthly "
    "JOIN nation ON k = n_nationkey UNION SELECT DISTINCT r_name FROM monthly JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey)) "
    "LEFT JOIN (SELECT n_name AS tree_id, col % 12 AS mon, sum(n) AS n FROM monthly JOIN nation ON k = n_nationkey GROUP BY 1, 2 "
    "UNION ALL SELECT r_name, col % 12, sum(n) FROM monthly JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) USING (tree_id, mon)",
)
cte(
    "season_rank", ["season"],
    "SELECT tree_id, 'm' || lpad(CAST(mon AS VARCHAR), 2, '0') AS name, row_number() OVER (PARTITION BY tree_id ORDER BY n, mon) - 1 AS r FROM season",
)
# a caterpillar over 12 tips: inner branch k (0..8) holds the tips of rank 0..9-k
cte(
    "season_sets", ["season_rank"],
    "SELECT tree_id, CAST(k AS INTEGER) AS edge_id, list_sort(list(name) FILTER (r <= 9 - k)) AS below, list_sort(list(name)) AS everything "
    "FROM season_rank, (SELECT unnest(range(0, 9)) AS k) GROUP BY 1, 2 UNION ALL "
    "SELECT a.tree_id, CAST(9 + r AS INTEGER), [name], everything FROM season_rank a JOIN "
    "(SELECT tree_id, list_sort(list(name)) AS everything FROM season_rank GROUP BY 1) USING (tree_id)",
)
cte(
    "season_splits", ["season_sets"],
    "SELECT tree_id, edge_id, CASE WHEN 2 * len(below) > len(everything) OR (2 * len(below) = len(everything) AND NOT list_contains(below, everything[1])) "
    "THEN list_filter(everything, lambda x: NOT list_contains(below, x)) ELSE below END AS tips FROM season_sets",
)
cte("tree_pairs", [], "SELECT n_name AS t1, r_name AS t2 FROM nation JOIN region ON n_regionkey = r_regionkey")
cte("items", [], "SELECT item_id AS seq_id, 'b' || item_id AS name, text AS seq FROM benchmark")

# ---- edge profiles of the nation tree ---------------------------------------------------
cte("rate", ["gapfreq"], f"SELECT v, exp(-{length_of('v')}) AS x, f FROM (SELECT unnest(range(2, 50)) AS v), gapfreq")


def combine(a: str, b: str, pa: str, pb: str) -> str:
    """Select list joining vectors a and b through the branches of rate rows pa and pb."""
    def part(v: str, p: str, row: int) -> str:
        if row == 0:
            return f"((1 - {p}.f + {p}.f * {p}.x) * {v}.l0 + ({p}.f * (1 - {p}.x)) * {v}.l1)"
        return f"(((1 - {p}.f) * (1 - {p}.x)) * {v}.l0 + ({p}.f + (1 - {p}.f) * {p}.x) * {v}.l1)"

    l0, l1 = f"{part(a, pa, 0)} * {part(b, pb, 0)}", f"{part(a, pa, 1)} * {part(b, pb, 1)}"
    state = f"CASE WHEN {a}.st & {b}.st <> 0 THEN {a}.st & {b}.st ELSE {a}.st | {b}.st END"
    return f"{state} AS st, {l0} / greatest({l0}, {l1}) AS l0, {l1} / greatest({l0}, {l1}) AS l1"


cte(
    "tip_vals", ["ref_cols", "tips"],
    f"SELECT node_id AS v, col, strpos('{SINGLES}-', ch) AS st, CASE WHEN ch = '-' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS l0, "
    "CASE WHEN ch = '-' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l1 FROM ref_cols JOIN tips USING (name)",
)
_previous = "tip_vals"
for _level, (_lo, _hi) in enumerate([(16, 24), (8, 15), (4, 7), (2, 3)]):
    cte(
        f"up{_level}", [_previous, "rate"],
        f"SELECT v, col, st, l0, l1 FROM {_previous} UNION ALL SELECT a.v // 2, a.col, {combine('a', 'b', 'pa', 'pb')} "
        f"FROM {_previous} a JOIN {_previous} b ON b.v = a.v + 1 AND b.col = a.col JOIN rate pa ON pa.v = a.v JOIN rate pb ON pb.v = b.v "
        f"WHERE a.v % 2 = 0 AND a.v // 2 BETWEEN {_lo} AND {_hi}",
    )
    _previous = f"up{_level}"
cte("down0", ["up3"], "SELECT 5 - v AS v, col, st, l0, l1 FROM up3 WHERE v IN (2, 3)")
_previous = "down0"
for _level, (_lo, _hi) in enumerate([(4, 7), (8, 15), (16, 31), (32, 49)], start=1):
    cte(
        f"down{_level}", [_previous, "up3", "rate"],
        f"SELECT v, col, st, l0, l1 FROM {_previous} UNION ALL SELECT s.c, d.col, {combine('d', 'u', 'pa', 'pb')} "
        f"FROM (SELECT unnest(range({_lo}, {_hi + 1})) AS c) s JOIN {_previous} d ON d.v = s.c // 2 "
        f"JOIN up3 u ON u.v = (CASE WHEN s.c % 2 = 0 THEN s.c + 1 ELSE s.c - 1 END) AND u.col = d.col "
        f"JOIN rate pa ON pa.v = d.v JOIN rate pb ON pb.v = u.v",
    )
    _previous = f"down{_level}"
cte(
    "edge_vals", ["up3", "down4", "rate"],
    f"SELECT v, col, {combine('a', 'b', 'p', 'p')} FROM (SELECT v, col, st, l0, l1 FROM up3 WHERE v >= 3) a JOIN "
    "(SELECT v AS v2, col AS col2, st, l0, l1 FROM down4) b ON a.v = b.v2 AND a.col = b.col2 JOIN (SELECT v AS v3, x, f FROM rate) p ON p.v3 = a.v",
)
cte(
    "prof", ["edge_vals", "gapfreq"],
    "SELECT CAST(v - 3 AS INTEGER) AS edge_id, CAST(col AS INTEGER) AS col, CAST(st AS INTEGER) AS state, CASE WHEN l0 < l1 THEN 1 ELSE 0 END AS aux, "
    "l0 * (1 - f) / (l0 * (1 - f) + l1 * f) AS gapp FROM edge_vals, gapfreq",
)

# ---- free-shift scores of the items against all edges ------------------------------------
cte("item_res", ["items"], f"SELECT seq_id, {single('seq')} AS s FROM items")
cte(
    "item_sym", ["item_res"],
    f"SELECT seq_id, i, length(s) AS n, strpos('{SINGLES}', substr(s, CAST(i AS INTEGER), 1)) AS b FROM "
    "(SELECT seq_id, s, unnest(range(1, length(s) + 1)) AS i FROM item_res)",
)
cte(
    "cost", ["prof"],
    "SELECT edge_id, col, state, aux, o, sum(e) OVER (PARTITION BY edge_id ORDER BY col) AS ce, max(col) OVER () AS lastcol FROM "
    "(SELECT *, CASE WHEN aux = 1 THEN 0 ELSE -3 END AS o, CASE WHEN aux = 1 THEN 0 ELSE -1 END AS e FROM prof)",
)
def free_shift(start: str, dp: str) -> str:
    """Recursive steps of the free-shift scores: one residue a step, ``start`` gives (seq_id, cost row)s."""
    return (
        f"SELECT seq_id, edge_id, col, 0 AS i, 0 AS n, state, aux, o, ce, lastcol, 0 AS s, -1000000 AS up FROM {start} "
        "UNION ALL SELECT seq_id, edge_id, col, i, n, state, aux, o, ce, lastcol, greatest(h, ce + max(lh + o - ce) OVER w) AS s, up FROM ("
        "SELECT *, coalesce(lag(h) OVER (PARTITION BY seq_id, edge_id ORDER BY col), 0) AS lh FROM ("
        "SELECT *, greatest(diag + (CASE WHEN state & b <> 0 THEN 2 ELSE 0 END) + (CASE WHEN aux = 1 THEN -3 ELSE 0 END), up) AS h FROM ("
        "SELECT d.seq_id, d.edge_id, d.col, q.i, q.n, d.state, d.aux, d.o, d.ce, d.lastcol, q.b, greatest(d.up - 1, d.s - 3) AS up, "
        "coalesce(lag(d.s) OVER (PARTITION BY d.seq_id, d.edge_id ORDER BY d.col), 0) AS diag "
        f"FROM {dp} d JOIN item_sym q ON q.seq_id = d.seq_id AND q.i = d.i + 1))) "
        "WINDOW w AS (PARTITION BY seq_id, edge_id ORDER BY col ROWS UNBOUNDED PRECEDING)"
    )


def best_of(dp: str) -> str:
    return f"SELECT seq_id, edge_id, CAST(max(s) AS INTEGER) AS score FROM {dp} WHERE i > 0 AND (col = lastcol OR i = n) GROUP BY 1, 2"


cte("dp", ["item_sym", "cost"], free_shift("cost, (SELECT DISTINCT seq_id FROM item_sym)", "dp"))
cte("edge_scores", ["dp"], best_of("dp"))
# the columns of an item: its gene's, as far as the reduced reference reaches, or all
cte(
    "item_bounds", ["items", "hit_cols", "genes", "cost"],
    'SELECT seq_id, CAST(CASE WHEN g."start" <= w THEN g."start" END AS INTEGER) AS "start", '
    'CAST(CASE WHEN g."start" <= w THEN least(g."end", w) END AS INTEGER) AS "end", w FROM items '
    "CROSS JOIN (SELECT max(lastcol) AS w FROM cost) LEFT JOIN hit_cols ON qs_name = 'o' || seq_id "
    'LEFT JOIN genes g ON g.ord = (SELECT min(ord) FROM genes p WHERE col_start >= p."start" AND col_end <= p."end")',
)
cte(
    "bound_dp", ["item_sym", "cost", "item_bounds"],
    free_shift(
        '(SELECT seq_id, edge_id, col, state, aux, o, ce, coalesce("end", w) AS lastcol FROM cost JOIN item_bounds '
        'ON col BETWEEN coalesce("start", 0) AND coalesce("end", w) WHERE seq_id IN (SELECT seq_id FROM item_sym))', "bound_dp",
    ),
)
cte("bound_scores", ["bound_dp"], best_of("bound_dp"))

# ---- the same for amino acids: other reference letters, tip states and residues -------------
cte(
    "ref_cols_aa", ["msa", "tips"],
    "SELECT name, ch, dense_rank() OVER (ORDER BY col) - 1 AS col FROM (SELECT *, bool_or(ch <> '-') OVER (PARTITION BY col) AS covered FROM ("
    + long_of(f"(SELECT name, translate(seq, 'ACGTNU', '{AA_REFERENCE}') AS seq FROM msa WHERE name IN (SELECT name FROM tips))")
    + ")) WHERE covered",
)
cte(
    "tip_vals_aa", ["ref_cols_aa", "tips"],
    f"SELECT node_id AS v, col, CASE ch WHEN '-' THEN 1048575 WHEN 'B' THEN 12 WHEN 'Z' THEN 96 ELSE 1 << (strpos('{AA}', ch) - 1) END AS st, "
    "CASE WHEN ch = '-' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS l0, CASE WHEN ch = '-' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l1 "
    "FROM ref_cols_aa JOIN tips USING (name)",
)
cte(
    "item_sym_aa", ["items"],
    f"SELECT seq_id, i, length(s) AS n, 1 << (strpos('{AA}', substr(s, CAST(i AS INTEGER), 1)) - 1) AS b FROM (SELECT seq_id, s, unnest(range(1, length(s) + 1)) AS i "
    f"FROM (SELECT seq_id, regexp_replace(translate(seq, '{FOLD4[0][:26]}', '{FOLD4[0][:26].upper()}'), '[^{AA}]', '', 'g') AS s FROM items))",
)
variant("_aa", "ref_cols", "tip_vals", "item_sym")
