"""Every registered query: a Spark job over whole tables and, where SQL can say it, its oracle.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``oracles()`` gives the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions import gapmodel as M
from cladeframe.functions import residues as R
from cladeframe.operators import bounds as B
from cladeframe.operators import columns as C
from cladeframe.operators import logodds as G
from cladeframe.operators import pairwise as W
from cladeframe.operators import place as L
from cladeframe.operators import profiles as P
from cladeframe.operators import tours as U
from cladeframe.operators import traces as X
from cladeframe.operators import trees as T
from cladeframe.plans import forest as N
from cladeframe.plans import jobs as J
from cladeframe.plans import oracles as O
from cladeframe.session import cut_lineage, shared_folder
from cladeframe.sources import tables as D
from cladeframe.sources import text as S
from cladeframe.streaming import placement as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STATEMENTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, *needs: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            _STATEMENTS[name] = (sql, needs)
        return fn

    return register


def oracles() -> dict[str, str]:
    """Name -> SQL.  Built when asked for: a statement may use tables named further down."""
    return {name: O.statement(sql, *needs) for name, (sql, needs) in _STATEMENTS.items()}


def six(c: F.Column | str) -> F.Column:
    return F.round(c, 6)


# ---- shared inputs --------------------------------------------------------------------


def _msa(spark: SparkSession, sf: str) -> DataFrame:
    """The month alignment is a few rows out of whole tables; it is read several times."""
    return cut_lineage(D.alignment(spark, sf))


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = D.heap_tree(spark, sf)
    return cut_lineage(nodes), cut_lineage(edges)


def _refs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _tree(spark, sf)
    return cut_lineage(C.drop_gap_columns(_msa(spark, sf), nodes.filter("is_tip"))), nodes, edges


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    refs, nodes, edges = _refs(spark, sf)
    return cut_lineage(P.edge_profiles(refs, nodes, edges))


def _branches(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(T.explode_trees(D.season_trees(spark, sf)))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("t1"), F.col("r_name").alias("t2")
    )


def _gene_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Operation strings read off the gene rows: gap = skip, A/G = column, C/T = insertion.

    Each is padded with skips to the alignment width.
    """
    rows = D.gene_rows(spark, sf)
    ops = F.translate("seq", "-ACGT", "10202")
    used = F.length(F.regexp_replace(ops, "2", ""))
    padded = F.concat(ops, F.repeat(F.lit("1"), F.length("seq") - used))
    return rows.select(
        F.xxhash64("name").alias("seq_id"), "name", F.regexp_replace("seq", "-", "").alias("seq"),
        F.col("seq").alias("row"), padded.alias("ops"), F.length("seq").alias("width"),
    )


TRACES = "gene_traces"
O.cte(
    TRACES, ["gene_rows"],
    "SELECT name, replace(seq, '-', '') AS seq, seq AS row, length(seq) AS width, translate(seq, '-ACGT', '10202') || "
    "repeat('1', length(seq) - length(replace(translate(seq, '-ACGT', '10202'), '2', ''))) AS ops FROM gene_rows",
)
O.cte(
    "steps", [TRACES],
    "SELECT name, seq, row, width, i, o, count(*) FILTER (o <> '2') OVER (PARTITION BY name ORDER BY i) AS cols, "
    "count(*) FILTER (o <> '1') OVER (PARTITION BY name ORDER BY i) AS res FROM "
    "(SELECT name, seq, row, width, i, substr(ops, CAST(i AS INTEGER), 1) AS o FROM (SELECT *, unnest(range(1, length(ops) + 1)) AS i FROM gene_traces))",
)
O.cte(
    "budget", ["steps"],
    "SELECT pos, max(n) AS n FROM (SELECT name, cols AS pos, count(*) AS n FROM steps WHERE o = '2' GROUP BY 1, 2) GROUP BY 1",
)

# ---- sources and sinks ------------------------------------------------------------------


@query("fasta_records", sql="SELECT 'd' || doc_id AS name, length(regexp_replace(text, '\\s+', '', 'g')) AS n, "
       "md5(regexp_replace(text, '\\s+', '', 'g')) AS digest FROM documents")
def _(spark, sf):
    records = S.fasta_records(S.fasta_lines(D.texts(spark, sf)))
    return records.select("name", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query("fasta_degapped", "gene_rows",
       sql="SELECT '>' || name || chr(10) || regexp_replace(seq, '[-Nn]', '', 'g') AS value FROM gene_rows")
def _(spark, sf):
    return S.fasta_lines(D.gene_rows(spark, sf).withColumn("seq", R.degap(F.col("seq"))))


@query("phylip_lines", "msa",
       sql="SELECT rpad(name, CAST((SELECT max(length(name)) FROM msa) + 1 AS INTEGER), ' ') || seq AS value FROM msa "
       "UNION ALL SELECT count(*) || ' ' || max(length(seq)) FROM msa")
def _(spark, sf):
    return S.phylip_lines(_msa(spark, sf)).select("value")


@query("tabular_hits",
       sql="SELECT 'o' || l_orderkey AS qs_name, 's' || l_suppkey AS ref_name, l_linenumber AS \"len\", "
       "CAST(l_quantity AS INTEGER) - 1 AS qs_end, CAST(l_partkey AS INTEGER) - 1 AS ref_start, "
       "round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 2) AS bit_score FROM lineitem")
def _(spark, sf):
    li = D.table(spark, sf, "lineitem")
    whole = lambda c: F.col(c).cast("long").cast("string")
    lines = li.select(
        F.col("l_linenumber").cast("long").alias("line_no"),
        F.concat_ws("\t", F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("s"), "l_suppkey"), F.lit("99.5"),
                    whole("l_linenumber"), F.lit("0"), F.lit("0"), F.lit("1"), whole("l_quantity"), whole("l_partkey"),
                    whole("l_partkey"), F.lit("1e-10"), F.col("l_extendedprice").cast("string")).alias("value"),
    )
    return S.parse_hits(lines).select(
        "qs_name", "ref_name", "len", "qs_end", "ref_start", F.round(F.col("bit_score").cast("double"), 2).alias("bit_score")
    )


@query("partition_file", "genes",
       sql="SELECT 'DNA' AS model, gene_name, CAST(\"start\" AS INTEGER) AS \"start\", CAST(\"end\" AS INTEGER) AS \"end\", "
       "CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER) AS ord FROM genes")
def _(spark, sf):
    line = F.concat("model", F.lit(", "), "gene_name", F.lit(" = "), F.col("start") + 1, F.lit("-"), F.col("end") + 1)
    lines = D.genes(spark, sf).select("ord", line.alias("l"))
    whole = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "l"))), lambda x: x["l"]), "\n").alias("value"))
    return S.parse_partitions(whole)


@query("newick_text", "season_rank",
       sql="SELECT tree_id, '((((((((((' || string_agg(CASE WHEN r = 0 THEN name || ':1' WHEN r <= 9 THEN ',' || name || ':1):0.5' "
       "ELSE ',' || name || ':1' END, '' ORDER BY r) || ');' AS newick FROM season_rank GROUP BY 1")
def _(spark, sf):
    b = _branches(spark, sf)
    return T.newick_from_edges(T.nodes_of(b), T.edges_of(b))


@query("distance_lines", "pair_norm",
       sql="SELECT i, i || chr(9) || string_agg(printf('%.4f', dist), chr(9) ORDER BY j) AS value FROM pair_norm GROUP BY i")
def _(spark, sf):
    return S.matrix_lines(W.normalize_distance(W.mirror(_item_scores(spark, sf))))


@query("placement_report", "edge_scores", "items",
       sql="SELECT name || ' ' || lpad(CAST(edge_id AS VARCHAR), 4, '0') || ' ' || lpad(CAST(score AS VARCHAR), 5, '0') AS value FROM "
       "(SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, edge_id) AS r FROM edge_scores) JOIN items USING (seq_id) WHERE r = 1")
def _(spark, sf):
    return S.placement_report(_placed_items(spark, sf))


# ---- scalar functions -------------------------------------------------------------------


@query("normalized_names",
       sql="SELECT doc_id, length(regexp_replace(text, '\\s+', '_', 'g')) AS n, md5(regexp_replace(text, '\\s+', '_', 'g')) AS digest FROM documents")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", R.normalize_name(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("residue_encodings", sql=f"""
SELECT doc_id, md5({O.norm('text')}) AS normalized, md5(q) AS residues,
 md5(translate(regexp_replace(regexp_replace(text, '[^-Nn]', '0', 'g'), '[-Nn]', '1', 'g'), '', '')) AS mask,
 length({O.norm('text')}) - length(replace({O.norm('text')}, '-', '')) AS n_gap,
 CAST(coalesce(list_sum(list_transform(string_split(q, ''), lambda c: strpos('{O.SINGLES}', c))), 0) AS BIGINT) AS state_sum,
 CAST(length(q) AS BIGINT) AS n FROM (SELECT *, {O.single('text')} AS q FROM documents)""")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text", R.query_residues(F.col("text")).alias("q"))
    states = R.encode_pstate(F.col("q"))
    total = F.aggregate(states, F.lit(0).cast("long"), lambda a, s: a + F.greatest(s, F.lit(0)))
    return d.select(
        "doc_id", F.md5(R.normalize_seq(F.col("text"))).alias("normalized"), F.md5("q").alias("residues"),
        F.md5(R.gap_mask(F.col("text"))).alias("mask"), R.gap_count(F.col("text")).cast("long").alias("n_gap"),
        total.alias("state_sum"), F.length("q").cast("long").alias("n"),
    )


@query("state_round_trip", sql=f"SELECT doc_id, md5({O.single('text')}) AS via_state, md5({O.single('text')}) AS via_index FROM documents")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", R.query_residues(F.col("text")).alias("q"))
    some = F.length("q") > 0
    back = lambda f, g: F.md5(F.when(some, g(f(F.col("q")))).otherwise(F.lit("")))
    return d.select("doc_id", back(R.encode_pstate, R.decode_pstate).alias("via_state"), back(R.encode_cstate, R.decode_cstate).alias("via_index"))


@query("amino_states", sql=f"""
SELECT doc_id, CAST(length(q) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(string_split(q, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (strpos('{O.AA}', c) - 1) END)), 0) AS BIGINT) AS state_sum
FROM (SELECT doc_id, regexp_replace(translate(text, '{R.LOWER}', '{R.UPPER}'), '[^{O.AA}]', '', 'g') AS q FROM documents)""")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", R.query_residues(F.col("text"), R.AA).alias("q"))
    states = F.when(F.length("q") > 0, R.encode_pstate(F.col("q"), R.AA)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(states, F.lit(0).cast("long"), lambda a, s: a + s)
    return d.select("doc_id", F.length("q").cast("long").alias("n"), total.alias("state_sum"))


@query("residue_predicates", "msa_long", sql=f"""
SELECT name, count(*) FILTER ({O.norm('ch')} = '-') AS n_gap, count(*) FILTER (strpos('{O.SINGLES}', {O.norm('ch')}) > 0) AS n_single,
 count(*) FILTER (strpos('_{O.SINGLES}-', ch) > 0) AS n_known FROM msa_long GROUP BY 1""")
def _(spark, sf):
    ch = F.col("ch")
    return C.to_long(_msa(spark, sf)).groupBy("name").agg(
        F.count_if(R.is_gap(ch)).alias("n_gap"), F.count_if(R.is_single(ch)).alias("n_single"), F.count_if(R.is_known(ch)).alias("n_known")
    )


@query("nongap_maps", "msa_long", sql=f"SELECT name, string_agg(CAST(col AS VARCHAR), ',' ORDER BY col) AS cols FROM msa_long WHERE {O.norm('ch')} <> '-' GROUP BY 1")
def _(spark, sf):
    return _msa(spark, sf).select("name", F.array_join(R.nongap_map(F.col("seq")).cast("array<string>"), ",").alias("cols"))


@query("mapped_states", sql="""
SELECT doc_id, CAST(length(q) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(string_split(q, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE strpos('ACGT', c) - 1 END)), 0) AS BIGINT) AS total
FROM (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', '', 'g') AS q FROM documents)""")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", R.map_states(F.col("text"), "ACGT").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("trace_positions", "steps",
       sql="SELECT name, string_agg(CAST(CASE WHEN o = '0' THEN cols - 1 ELSE cols END AS VARCHAR), ',' ORDER BY i) AS cols FROM steps WHERE o <> '1' GROUP BY 1")
def _(spark, sf):
    return _gene_traces(spark, sf).select("name", F.array_join(X.position_map(F.col("ops")).cast("array<string>"), ",").alias("cols"))


@query("realized_traces", "steps",
       sql="SELECT name, string_agg(CASE WHEN o = '1' THEN '-' ELSE substr(seq, CAST(res AS INTEGER), 1) END, '' ORDER BY i) FILTER (o <> '2') AS aligned, "
       "string_agg(CASE WHEN o = '1' THEN '-' WHEN o = '0' THEN substr(seq, CAST(res AS INTEGER), 1) ELSE lower(substr(seq, CAST(res AS INTEGER), 1)) END, '' ORDER BY i) AS gapped, "
       "string_agg(CASE WHEN o = '2' THEN '-' ELSE substr(row, CAST(cols AS INTEGER), 1) END, '' ORDER BY i) AS ref_side FROM steps GROUP BY 1")
def _(spark, sf):
    t = _gene_traces(spark, sf)
    ref_side, _ = X.realize_two_sided(F.col("ops"), F.col("row"), F.col("seq"))
    return t.select("name", X.realize(F.col("ops"), F.col("seq")).alias("aligned"), X.gapped(F.col("ops"), F.col("seq")).alias("gapped"), ref_side.alias("ref_side"))


@query("cut_gene", "msa", "genes",
       sql="SELECT name, substr(seq, CAST(\"start\" + 1 AS INTEGER), CAST(\"end\" - \"start\" + 1 AS INTEGER)) AS seq FROM msa, genes WHERE gene_name = 'y1997'")
def _(spark, sf):
    return C.cut_partition(_msa(spark, sf), D.genes(spark, sf), "y1997")


@query("cut_all_genes", "gene_rows", "genes",
       sql="SELECT gene_name, name, substr(seq, CAST(\"start\" + 1 AS INTEGER), CAST(\"end\" - \"start\" + 1 AS INTEGER)) AS seq FROM gene_rows, genes")
def _(spark, sf):
    return C.cut_all_partitions(D.gene_rows(spark, sf), D.genes(spark, sf))


@query("gap_transitions", "gapfreq", sql=f"""
SELECT CAST(v - 3 AS INTEGER) AS edge_id, round(1 - f + f * x, 6) AS p00, round(f * (1 - x), 6) AS p01, round((1 - f) * (1 - x), 6) AS p10, round(f + (1 - f) * x, 6) AS p11
FROM (SELECT v, f, exp(-{O.length_of('v')}) AS x FROM (SELECT unnest(range(3, 50)) AS v), gapfreq)""")
def _(spark, sf):
    refs, _, edges = _refs(spark, sf)
    f = C.gap_frequency(refs).select("gap_freq").scalar()
    p = edges.withColumn("f", f).select("edge_id", M.gap_transition(F.col("f"), F.col("len")).alias("p"))
    return p.select("edge_id", *[six(f"p.{c}").alias(c) for c in ("p00", "p01", "p10", "p11")])


O.cte(
    "anc", ["ref_cols", "tips"],
    "SELECT label, col, count(*) FILTER (ch = 'A') AS a, count(*) FILTER (ch = 'C') AS c, count(*) FILTER (ch = 'G') AS g, count(*) FILTER (ch = 'T') AS t "
    "FROM (SELECT col, ch, unnest(list_transform(range(1, CAST(floor(log2(node_id)) AS BIGINT)), lambda k: node_id >> k)) AS label FROM ref_cols JOIN tips USING (name)) GROUP BY 1, 2",
)
O.cte("anc_p", ["anc"], "SELECT CAST(label AS INTEGER) AS node_label, CAST(col AS INTEGER) AS col, b, (n + 1.0::DOUBLE) / (a + c + g + t + 4.0::DOUBLE) AS p FROM "
      "(SELECT *, unnest([0, 1, 2, 3]) AS b, unnest([a, c, g, t]) AS n FROM anc)")
O.cte("bg", ["ref_cols"], "SELECT strpos('ACGT', ch) - 1 AS b, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS q FROM ref_cols WHERE ch IN ('A', 'C', 'G', 'T') GROUP BY ch")


@query("log_odds", "anc_p", "bg",
       sql="SELECT node_label, col, b, round(greatest(-100.0, ln(p / q)), 6) AS lo, round(p / q, 6) AS odds, round(greatest(-100.0, ln(p / 0.25)), 6) AS vs_flat, "
       "round(greatest(-100.0, ln((1 - p) / 0.75)), 6) AS vs_rest FROM anc_p JOIN bg USING (b)")
def _(spark, sf):
    refs, nodes, _ = _refs(spark, sf)
    anc = D.heap_anc_probs(refs, nodes).select("node_label", "col", F.posexplode("p").alias("b", "p"))
    bg = C.base_frequencies(refs).select((F.instr(F.lit("ACGT"), F.col("base")) - 1).alias("b"), F.col("freq").alias("q"))
    pair = M.paired_log_odds(F.col("p"), F.lit(0.25))
    return anc.join(F.broadcast(bg), "b").select(
        "node_label", "col", "b", six(M.log_odds(F.col("p"), F.col("q"))).alias("lo"), six(M.odds(F.col("p"), F.col("q"))).alias("odds"),
        six(pair["gap"]).alias("vs_flat"), six(pair["residue"]).alias("vs_rest"),
    )


@query("gap_posteriors", "vectors_long",
       sql="SELECT CAST(col AS INTEGER) AS col, round(r * (1 - f) / (r * (1 - f) + g * f), 6) AS residue, round(g * f / (r * (1 - f) + g * f), 6) AS gap FROM "
       "(SELECT col, count(*) FILTER (ch <> '-') / CAST(count(*) AS DOUBLE) AS r, count(*) FILTER (ch = '-') / CAST(count(*) AS DOUBLE) AS g FROM vectors_long GROUP BY 1), "
       "(SELECT count(*) FILTER (ch = '-') / CAST(count(*) AS DOUBLE) AS f FROM vectors_long)")
def _(spark, sf):
    v = D.vectors(spark, sf)
    f = C.gap_frequency(v, normalized=False).select("gap_freq").scalar()
    s = C.column_stats(v).withColumn("f", f)
    r, g = F.col("n_nongap") / F.col("n_rows"), F.col("n_gap") / F.col("n_rows")
    return s.select("col", six(M.gap_posterior(r, g, F.col("f"))).alias("residue"), six(M.gap_ancestral_prob(r, g, F.col("f"))).alias("gap"))


@query("alignment_agreement", "vectors", sql=f"""
SELECT name, round(count(*) FILTER (sa = sb) / CAST(count(*) AS DOUBLE), 6) AS agreement, round(count(*) FILTER (ga = gb) / CAST(count(*) AS DOUBLE), 6) AS strict FROM (
 SELECT name, i, {O.norm('a')} AS sa, {O.norm('b')} AS sb, count(*) FILTER (a = '-') OVER w AS ga, count(*) FILTER (b = '-') OVER w AS gb FROM (
  SELECT name, i, substr(seq, CAST(i AS INTEGER), 1) AS a, substr(reverse(seq), CAST(i AS INTEGER), 1) AS b FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM vectors))
 WINDOW w AS (PARTITION BY name ORDER BY i)) GROUP BY 1""")
def _(spark, sf):
    v = D.vectors(spark, sf)
    got = C.alignment_agreement(v, v.select("name", F.reverse("seq").alias("seq")))
    return got.select("name", six("agreement").alias("agreement"), six("strict").alias("strict"))


# ---- filters ------------------------------------------------------------------------------


@query("bad_characters", sql=f"""
SELECT ch, CAST(sum(n) AS BIGINT) AS n_chars, count(*) AS n_seqs FROM (SELECT doc_id, ch, count(*) AS n FROM (
 SELECT doc_id, unnest(string_split(regexp_replace({O.norm('text')}, '[_{O.SINGLES}-]', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    return C.bad_characters(D.texts(spark, sf))


@query("reference_rows", "ref_cols", sql="SELECT name, string_agg(ch, '' ORDER BY col) AS seq FROM ref_cols GROUP BY 1")
def _(spark, sf):
    return _refs(spark, sf)[0]


@query("query_covered_columns", "msa_long", "tips", sql="""
SELECT name, string_agg(ch, '' ORDER BY col) AS seq FROM msa_long WHERE col IN (SELECT col FROM msa_long WHERE name NOT IN (SELECT name FROM tips) GROUP BY 1
 HAVING bool_or(ch NOT IN ('-', '?', 'N', 'n'))) GROUP BY 1""")
def _(spark, sf):
    return C.covered_by_queries(_msa(spark, sf), _tree(spark, sf)[0].filter("is_tip"))


@query("well_filled_columns", "gene_rows", "vectors_long", sql="""
SELECT name, string_agg(ch, '' ORDER BY col) AS seq FROM vectors_long WHERE col IN (SELECT col FROM vectors_long GROUP BY 1
 HAVING count(*) FILTER (ch <> '-') >= floor(count(*) / 2)) GROUP BY 1""")
def _(spark, sf):
    return C.well_filled(D.vectors(spark, sf))


@query("chopped_overhangs", "gene_rows", sql="""
SELECT name, s AS seq, s <> seq AS chopped FROM (SELECT name, seq, repeat('-', lo) || substr(seq, lo + 1, 24) || repeat('-', length(seq) - 24 - lo) AS s
 FROM (SELECT name, seq, CAST(CAST(regexp_extract(name, '_([0-9]+)\\.', 1) AS INTEGER) % 40 AS INTEGER) AS lo FROM gene_rows))""")
def _(spark, sf):
    rows = D.gene_rows(spark, sf).withColumn("start", F.regexp_extract("name", r"_([0-9]+)\.", 1).cast("int") % 40)
    return X.chop_overhang(rows.withColumn("end", F.col("start") + 23)).select("name", "seq", "chopped")


@query("overhang_report", "gene_rows", sql="""
SELECT name, CAST((SELECT count(*) FROM gene_rows WHERE length(replace(substr(seq, 49), '-', '')) > 0) AS BIGINT) AS n_total FROM gene_rows
WHERE length(replace(substr(seq, 49), '-', '')) > 0 ORDER BY name LIMIT 20""")
def _(spark, sf):
    rows = D.gene_rows(spark, sf).withColumn("start", F.lit(0)).withColumn("end", F.lit(47))
    return X.overhang_report(X.chop_overhang(rows))


# ---- joins ------------------------------------------------------------------------------


@query("tree_rows", "msa", "tips", sql="SELECT name, seq FROM msa WHERE name IN (SELECT name FROM tips)")
def _(spark, sf):
    return C.tree_rows(_msa(spark, sf), _tree(spark, sf)[0].filter("is_tip"))


@query("extra_rows", "msa", "tips", sql="SELECT name, seq FROM msa WHERE name NOT IN (SELECT name FROM tips)")
def _(spark, sf):
    return C.extra_rows(_msa(spark, sf), _tree(spark, sf)[0].filter("is_tip"))


@query("missing_tips", sql="""
SELECT 'c' || c_custkey AS name FROM customer WHERE c_custkey NOT IN
 (SELECT o_custkey FROM orders WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders))""")
def _(spark, sf):
    tips = D.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    orders = D.table(spark, sf, "orders")
    early = orders.filter(F.year("o_orderdate") == orders.agg(F.min(F.year("o_orderdate"))).scalar())
    return C.missing_tips(early.select(F.concat(F.lit("c"), "o_custkey").alias("name")), tips)


@query("all_queries", "msa", "tips",
       sql="SELECT name, md5(seq) AS digest FROM (SELECT 'd' || doc_id AS name, text AS seq FROM documents UNION ALL SELECT name, seq FROM msa WHERE name NOT IN (SELECT name FROM tips))")
def _(spark, sf):
    q = C.all_queries(D.texts(spark, sf), _msa(spark, sf), _tree(spark, sf)[0].filter("is_tip"))
    return q.select("name", F.md5("seq").alias("digest"))


@query("best_hits", "best_hits", sql="SELECT qs_name, ref_name, ref_start, ref_end, bit_score FROM best_hits")
def _(spark, sf):
    return B.best_hits(D.hits(spark, sf)).select("qs_name", "ref_name", "ref_start", "ref_end", "bit_score")


@query("hit_columns", "hit_cols", sql="SELECT qs_name, ref_name, col_start, col_end FROM hit_cols")
def _(spark, sf):
    return B.hit_columns(B.best_hits(D.hits(spark, sf)), _msa(spark, sf)).select("qs_name", "ref_name", "col_start", "col_end")


@query("query_bounds", "hit_cols", "genes", sql="""
SELECT 'o' || o_orderkey AS name, gene_name, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end" FROM orders
LEFT JOIN hit_cols ON qs_name = 'o' || o_orderkey LEFT JOIN genes g ON g.ord = (SELECT min(ord) FROM genes p WHERE col_start >= p."start" AND col_end <= p."end")""")
def _(spark, sf):
    q = D.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("name"))
    return B.query_bounds(q, D.hits(spark, sf), _msa(spark, sf), D.genes(spark, sf), missing="full")


def _item_scores(spark: SparkSession, sf: str) -> DataFrame:
    items = D.items(spark, sf).select(F.col("seq_id").alias("i"), "seq")
    return cut_lineage(W.local_scores(items, S.flat_matrix(spark)))


O.cte("acgt", ["items"], "SELECT seq_id, upper(regexp_replace(seq, '[^ACGTacgt]', '', 'g')) AS s FROM items")
O.cte("acgt_long", ["acgt"], "SELECT seq_id, i, substr(s, CAST(i AS INTEGER), 1) AS b FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM acgt)")
O.cte(
    "local_dp", ["acgt_long"],
    "SELECT a.seq_id AS a, p.seq_id AS p, p.i AS col, p.b AS c, 0 AS i, 0 AS s, -1000000 AS up FROM (SELECT DISTINCT seq_id FROM acgt_long) a, acgt_long p WHERE a.seq_id <= p.seq_id "
    "UNION ALL SELECT a, p, col, c, i, greatest(h, max(lh - 5 + 2 * (col - 1)) OVER (PARTITION BY a, p ORDER BY col ROWS UNBOUNDED PRECEDING) - 2 * (col - 1)) AS s, up FROM ("
    "SELECT *, coalesce(lag(h) OVER (PARTITION BY a, p ORDER BY col), 0) AS lh FROM (SELECT *, greatest(diag + CASE WHEN b = c THEN 3 ELSE 0 END, up, 0) AS h FROM ("
    "SELECT d.a, d.p, d.col, d.c, q.i, q.b, greatest(d.up - 2, d.s - 5) AS up, coalesce(lag(d.s) OVER (PARTITION BY d.a, d.p ORDER BY d.col), 0) AS diag "
    "FROM local_dp d JOIN acgt_long q ON q.seq_id = d.a AND q.i = d.i + 1)))",
)
O.cte("pair_half", ["local_dp"], "SELECT a AS i, p AS j, CAST(max(s) AS INTEGER) AS score FROM local_dp GROUP BY 1, 2")
O.cte("pair_all", ["pair_half"], "SELECT i, j, score FROM pair_half UNION ALL SELECT j, i, score FROM pair_half WHERE i <> j")
O.cte("pair_norm", ["pair_all"], "SELECT x.i, x.j, x.score, 1 - x.score / ((a.score + b.score) / 2.0::DOUBLE) AS dist FROM pair_all x "
      "JOIN pair_half a ON a.i = x.i AND a.j = x.i JOIN pair_half b ON b.i = x.j AND b.j = x.j")


@query("local_scores", "pair_half", sql="SELECT i, j, score FROM pair_half")
def _(spark, sf):
    return _item_scores(spark, sf)


O.cte("nation_long", [], "SELECT j, i, substr(s, CAST(i AS INTEGER), 1) AS b FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM "
      "(SELECT CAST(n_nationkey AS BIGINT) AS j, upper(regexp_replace(n_name, '[^ACGTacgt]', '', 'g')) AS s FROM nation))")
O.cte(
    "cross_dp", ["acgt_long", "nation_long"],
    "SELECT a.seq_id AS a, p.j AS p, p.i AS col, p.b AS c, 0 AS i, 0 AS s, -1000000 AS up FROM (SELECT DISTINCT seq_id FROM acgt_long) a, nation_long p "
    + O.CTES["local_dp"][1][O.CTES["local_dp"][1].index("UNION ALL"):].replace("local_dp", "cross_dp"),
)


@query("cross_scores", "cross_dp", "items", sql="""
SELECT seq_id AS i, CAST(n_nationkey AS BIGINT) AS j, CAST(coalesce(score, 0) AS INTEGER) AS score FROM items CROSS JOIN nation
LEFT JOIN (SELECT a, p, max(s) AS score FROM cross_dp GROUP BY 1, 2) ON a = seq_id AND p = n_nationkey""")
def _(spark, sf):
    nations = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_name").alias("seq"))
    return W.local_scores(D.items(spark, sf).select(F.col("seq_id").alias("i"), "seq"), S.flat_matrix(spark), nations)


@query("mean_distances", "pair_norm", sql="SELECT i, j, score, round(dist, 6) AS dist FROM pair_norm")
def _(spark, sf):
    d = W.normalize_distance(W.mirror(_item_scores(spark, sf)))
    return d.select("i", "j", "score", six("dist").alias("dist"))


@query("minmax_distances", "pair_half", sql="SELECT i, j, round(1 - (score - lo) / CAST(hi - lo AS DOUBLE), 6) AS dist FROM pair_half, (SELECT min(score) AS lo, max(score) AS hi FROM pair_half)")
def _(spark, sf):
    return W.normalize_distance(_item_scores(spark, sf), "minmax").select("i", "j", six("dist").alias("dist"))


@query("closest_pair", "pair_norm", sql="SELECT i, j, round(dist, 6) AS dist FROM pair_norm WHERE i <> j ORDER BY dist, i, j LIMIT 1")
def _(spark, sf):
    d = W.normalize_distance(_item_scores(spark, sf))
    return W.closest_pair(d).select("i", "j", six("dist").alias("dist"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq_id"), F.col("text").alias("seq"))


O.cte("primers", [], "SELECT unnest([0, 1]) AS primer_id, unnest(['" + "', '".join(S.BUILTIN_PRIMERS) + "']) AS p")
O.cte("primer_long", ["primers"], "SELECT primer_id, i, length(p) AS n, substr(p, CAST(i AS INTEGER), 1) AS b FROM (SELECT *, unnest(range(1, length(p) + 1)) AS i FROM primers)")
O.cte("turn_long", [], "SELECT conv_id * 1000 + turn AS seq_id, col, length(text) AS w, upper(substr(text, CAST(col AS INTEGER), 1)) AS c FROM "
      "(SELECT *, unnest(range(1, length(text) + 1)) AS col FROM conversations)")
O.cte(
    "primer_dp", ["primer_long", "turn_long"],
    "SELECT seq_id, primer_id, col, w, c, 0 AS i, 0 AS n, 0 AS s, 0 AS up FROM turn_long, primers "
    "UNION ALL SELECT seq_id, primer_id, col, w, c, i, n, greatest(h, max(lh - 5 + 2 * (col - 1)) OVER (PARTITION BY seq_id, primer_id ORDER BY col ROWS UNBOUNDED PRECEDING) - 2 * (col - 1)) AS s, up FROM ("
    "SELECT *, coalesce(lag(h) OVER (PARTITION BY seq_id, primer_id ORDER BY col), 0) AS lh FROM (SELECT *, greatest(diag + CASE WHEN b = c THEN 5 ELSE -3 END, up) AS h FROM ("
    "SELECT d.seq_id, d.primer_id, d.col, d.w, d.c, q.i, q.n, q.b, greatest(d.up - 2, d.s - 5) AS up, coalesce(lag(d.s) OVER (PARTITION BY d.seq_id, d.primer_id ORDER BY d.col), 0) AS diag "
    "FROM primer_dp d JOIN primer_long q ON q.primer_id = d.primer_id AND q.i = d.i + 1)))",
)
O.cte("primer_best", ["primer_dp"], "SELECT seq_id, primer_id, CAST(max(s) AS INTEGER) AS score, max(n) * 5 AS best FROM primer_dp WHERE i > 0 AND (i = n OR col = w) GROUP BY 1, 2")


@query("primer_scores", "primer_best", sql="SELECT seq_id, primer_id, score, round(score / CAST(best AS DOUBLE), 6) AS share FROM primer_best")
def _(spark, sf):
    return W.primer_scores(_turns(spark, sf), S.builtin_primers(spark)).select("seq_id", "primer_id", "score", six("share").alias("share"))


@query("primer_matches", "primer_best", sql="SELECT seq_id FROM primer_best GROUP BY 1 HAVING bool_and(score / CAST(best AS DOUBLE) >= 0.0)")
def _(spark, sf):
    return W.primer_matches(_turns(spark, sf), S.builtin_primers(spark), share=0.0).select("seq_id")


@query("primer_weights", "primer_best", sql="SELECT seq_id, CAST(1000 + sum(floor(score / CAST(best AS DOUBLE) * 1000 * 10)) AS BIGINT) AS weight FROM primer_best GROUP BY 1")
def _(spark, sf):
    return W.primer_weights(_turns(spark, sf), S.builtin_primers(spark))


@query("document_primer_weights")
def _(spark, sf):
    return W.primer_weights(D.texts(spark, sf), S.builtin_primers(spark))


@query("transferred_lengths", "season_splits", sql="SELECT tree_id, edge_id, CASE WHEN len(tips) = 1 THEN 3.0 ELSE 1.5 END::DOUBLE AS \"len\" FROM season_splits")
def _(spark, sf):
    b = _branches(spark, sf)
    # a donor with other branch numbers and lengths
    donor = b.withColumn("edge_id", F.col("edge_id") + 100).withColumn("len", F.col("len") * 3)
    return T.transfer_lengths(b.drop("len"), donor)


@query("node_profiles", "anc_p", sql="SELECT node_label AS node_id, round(sum(p * (col + 1) * (b + 1)), 4) AS weighted FROM anc_p WHERE node_label > 2 GROUP BY 1")
def _(spark, sf):
    pr = _node_profiles(spark, sf)
    cells = pr.select("node_id", F.posexplode("p").alias("col", "q")).select("node_id", "col", F.posexplode("q").alias("b", "p"))
    return cells.groupBy("node_id").agg(F.round(F.sum(F.col("p") * (F.col("col") + 1) * (F.col("b") + 1)), 4).alias("weighted"))


@query("located_edges", "season_splits", sql="SELECT tree_id, CAST(edge_id AS VARCHAR) AS want_id, edge_id FROM season_splits")
def _(spark, sf):
    b = _branches(spark, sf)
    sp = cut_lineage(T.splits(b))
    # every other branch is asked for by the far side of its split
    months = F.array(*(F.lit(f"m{k:02d}") for k in range(12)))
    side = F.when(F.col("edge_id") % 2 == 0, F.array_except(months, F.col("tips"))).otherwise(F.col("tips"))
    wanted = sp.select("tree_id", F.col("edge_id").cast("string").alias("want_id"), side.alias("tips"))
    return T.locate_edges(sp, wanted, b)


@query("aligned_scores", "msa_long", sql="""
SELECT i, j, CAST(sum(CASE WHEN k = 'm' THEN 3 WHEN k = 'n' THEN 0 WHEN k = prev THEN -2 ELSE -5 END) AS INTEGER) AS score FROM (
 SELECT i, j, col, k, lag(k) OVER (PARTITION BY i, j ORDER BY col) AS prev FROM (
  SELECT a.name AS i, b.name AS j, a.col, CASE WHEN a.ch = '-' THEN 'x' WHEN b.ch = '-' THEN 'y' WHEN a.ch = b.ch THEN 'm' ELSE 'n' END AS k
  FROM msa_long a JOIN msa_long b ON a.col = b.col AND a.name <= b.name WHERE NOT (a.ch = '-' AND b.ch = '-'))) GROUP BY 1, 2""")
def _(spark, sf):
    return W.aligned_scores(_msa(spark, sf))


O.cte("dtw_size", ["series"], "SELECT key, max(t) AS n FROM series GROUP BY 1")
O.cte(
    "dtw_dp", ["series", "dtw_size"],
    "SELECT a.key AS i, b.key AS j, b.t AS col, b.cents AS y, 0 AS t, 1e15::DOUBLE AS d FROM dtw_size a JOIN series b ON a.key <= b.key "
    "UNION ALL SELECT i, j, col, y, t, cum + min(m - (cum - cost)) OVER (PARTITION BY i, j ORDER BY col ROWS UNBOUNDED PRECEDING) AS d FROM ("
    "SELECT i, j, col, y, t, cost, sum(cost) OVER (PARTITION BY i, j ORDER BY col ROWS UNBOUNDED PRECEDING) AS cum, least(d, coalesce(pd, CASE WHEN t = 1 THEN 0 ELSE 1e15::DOUBLE END)) AS m FROM ("
    "SELECT d.i, d.j, d.col, d.y, x.t, d.d, abs(x.cents - d.y) AS cost, lag(d.d) OVER (PARTITION BY d.i, d.j ORDER BY d.col) AS pd FROM dtw_dp d JOIN series x ON x.key = d.i AND x.t = d.t + 1))",
)


@query("dtw_distances", "dtw_dp", "dtw_size", sql="SELECT d.i, d.j, d.d AS dist FROM dtw_dp d JOIN dtw_size a ON a.key = d.i AND a.n = d.t JOIN dtw_size b ON b.key = d.j AND b.n = d.col")
def _(spark, sf):
    return W.dtw_distances(D.series(spark, sf))


# ---- placement ----------------------------------------------------------------------------


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return L.clean_queries(D.items(spark, sf))


def _placed_items(spark: SparkSession, sf: str) -> DataFrame:
    q = _items(spark, sf)
    return L.best_edge(q, _profiles(spark, sf)).join(q.select("seq_id", "name"), "seq_id")


@query("edge_profiles", "prof", sql="SELECT edge_id, col, state, aux, round(gapp, 6) AS gapp FROM prof")
def _(spark, sf):
    return P.profiles_long(_profiles(spark, sf)).select("edge_id", "col", "state", "aux", six("gapp").alias("gapp"))


@query("best_edge", "edge_scores",
       sql="SELECT seq_id, edge_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, edge_id) AS r FROM edge_scores) WHERE r = 1")
def _(spark, sf):
    return L.best_edge(_items(spark, sf), _profiles(spark, sf))


def _amino_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of the nation tree over the month alignment, its letters changed into amino acids."""
    nodes, edges = _tree(spark, sf)
    msa = _msa(spark, sf).withColumn("seq", F.translate("seq", "ACGTNU", O.AA_REFERENCE))
    refs = cut_lineage(C.drop_gap_columns(msa, nodes.filter("is_tip"), R.AA))
    return cut_lineage(P.edge_profiles(refs, nodes, edges, alpha=R.AA))


@query("amino_profiles", "prof_aa", sql="SELECT edge_id, col, state, aux, round(gapp, 6) AS gapp FROM prof_aa")
def _(spark, sf):
    return P.profiles_long(_amino_profiles(spark, sf)).select("edge_id", "col", "state", "aux", six("gapp").alias("gapp"))


@query("amino_edges", "edge_scores_aa",
       sql="SELECT seq_id, edge_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, edge_id) AS r FROM edge_scores_aa) WHERE r = 1")
def _(spark, sf):
    return L.best_edge(L.clean_queries(D.items(spark, sf), R.AA), _amino_profiles(spark, sf), alpha=R.AA)


@query("top_edges", "edge_scores",
       sql="SELECT * FROM (SELECT seq_id, edge_id, score, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, edge_id) AS INTEGER) AS rank FROM edge_scores) WHERE rank <= 5")
def _(spark, sf):
    return L.top_edges(_items(spark, sf), _profiles(spark, sf), 5)


@query("candidate_scores", "edge_scores",
       sql="SELECT * FROM (SELECT seq_id, edge_id, score, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, edge_id) AS INTEGER) AS rank FROM edge_scores) WHERE rank <= 5")
def _(spark, sf):
    """The candidates' traces, scored again from their operations alone: both sides agree only if every trace is a best one."""
    items, profiles = _items(spark, sf), _profiles(spark, sf)
    return J.candidates(items, profiles, 5).scored.select("seq_id", "edge_id", "score", "rank")


@query("candidate_report")
def _(spark, sf):
    """Tied traces have no order that SQL could follow; the tests hold the report against plain code."""
    items = _items(spark, sf)
    report = J.candidates(items, _profiles(spark, sf), 5).report.join(items.select("seq_id", "seq"), "seq_id")
    return S.candidate_report(report.withColumn("aligned", X.realize(F.col("ops"), F.col("seq"))))


@query("bounded_placement", "bound_scores", "item_bounds", sql="""
SELECT seq_id, edge_id, score, "start", "end" FROM (
 SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, edge_id) AS r FROM bound_scores) JOIN item_bounds USING (seq_id) WHERE r = 1""")
def _(spark, sf):
    """Hits give the columns, the columns limit the placement, and the traces are scored again from their operations."""
    hits = D.hits(spark, sf).withColumn("qs_name", F.regexp_replace("qs_name", "^o", "b"))
    items, profiles = D.items(spark, sf), _profiles(spark, sf)
    found = B.query_bounds(items.select("name"), hits, _msa(spark, sf), D.genes(spark, sf), missing="full")
    last = L.profile_shape(profiles)[1] - 1
    reached = F.col("start") <= last
    bounds = found.select("name", F.when(reached, F.col("start")).alias("start"), F.when(reached, F.least("end", F.lit(last))).alias("end"))
    bounds = cut_lineage(bounds)
    job = J.place_job(_msa(spark, sf), *_tree(spark, sf), items, bounds)
    traced = job.traces.join(items.select("seq_id", "name"), "seq_id").join(bounds, "name", "left").drop("score")
    return L.rescored(traced, _items(spark, sf), profiles).select("seq_id", "edge_id", "score", "start", "end")


O.cte(
    "pen_prof", ["prof"],
    "SELECT edge_id, c, state, aux = 1 AS f, sum(CASE WHEN aux = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY edge_id ORDER BY c) AS carry "
    "FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY col) - 1 AS c FROM prof)",
)
O.cte("pen_seq", [], f"SELECT DISTINCT {O.acgt('p_name')} AS s FROM part")
O.cte(
    "pen_dp", ["pen_prof", "pen_seq"],
    "SELECT s, edge_id, d, 0 AS i, 0 AS cost FROM (SELECT s, edge_id, unnest(range(0, w - length(s) + 1)) AS d "
    "FROM pen_seq, (SELECT edge_id, count(*) AS w FROM pen_prof GROUP BY 1) WHERE length(s) > 0 AND length(s) < w) "
    "UNION ALL SELECT s, edge_id, d, i, least(h, min(run) OVER (PARTITION BY s, edge_id ORDER BY d ROWS UNBOUNDED PRECEDING) + carry) AS cost "
    "FROM (SELECT *, lag(h) OVER (PARTITION BY s, edge_id ORDER BY d) + CASE WHEN f THEN 0 ELSE 4 END - carry AS run "
    "FROM (SELECT x.s, x.edge_id, x.d, x.i + 1 AS i, p.f, p.carry, least(x.cost + "
    "CASE WHEN p.state & (1 << (strpos('ACGT', substr(x.s, x.i + 1, 1)) - 1)::INTEGER) = 0 THEN 1 ELSE 0 END + CASE WHEN p.f THEN 3 ELSE 0 END, "
    "coalesce(lead(x.cost) OVER (PARTITION BY x.s, x.edge_id ORDER BY x.d) + 1, 1000000)) AS h "
    "FROM pen_dp x JOIN pen_prof p ON p.edge_id = x.edge_id AND p.c = x.i + x.d WHERE x.i < length(x.s)))",
)


@query("cheapest_edge", "pen_dp", sql=f"""
SELECT p_partkey AS seq_id, edge_id, CAST(penalty AS INTEGER) AS penalty
FROM part LEFT JOIN (SELECT s, arg_min(edge_id, (cost, edge_id)) AS edge_id, min(cost) AS penalty FROM pen_dp WHERE i = length(s) GROUP BY s) b
 ON b.s = {O.acgt('p_name')}""")
def _(spark, sf):
    names = D.table(spark, sf, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("seq"))
    return L.cheapest_edge(L.clean_queries(names, "dna4"), _profiles(spark, sf))


@query("work_cells", "ref_cols", sql=f"""
SELECT count(*) AS n_queries, CAST(sum(length({O.single('text')})) AS BIGINT) AS n_residues, CAST(47 AS BIGINT) AS n_edges, max(w) AS n_cols,
 CAST(sum(length({O.single('text')})) * 47 * max(w) AS BIGINT) AS cells FROM documents, (SELECT count(DISTINCT col) AS w FROM ref_cols)""")
def _(spark, sf):
    return L.work_cells(L.clean_queries(D.texts(spark, sf)), _profiles(spark, sf))


@query("document_placement")
def _(spark, sf):
    return L.best_edge(L.clean_queries(D.texts(spark, sf)), _profiles(spark, sf))


@query("traced_scores", "edge_scores",
       sql="SELECT seq_id, edge_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, edge_id) AS r FROM edge_scores) WHERE r = 1")
def _(spark, sf):
    return J.place_job(_msa(spark, sf), *_tree(spark, sf), D.items(spark, sf)).traces.select("seq_id", "edge_id", "score")


@query("document_alignment",
       sql=f"SELECT name, length(s) AS n, md5(s) AS digest FROM (SELECT 'd' || doc_id AS name, {O.single('text')} AS s FROM documents)")
def _(spark, sf):
    aligned = J.place_job(_msa(spark, sf), *_tree(spark, sf), D.texts(spark, sf)).aligned.filter("kind = 'qs'")
    residues = F.regexp_replace("seq", "-+", "")
    return aligned.select("name", F.length(residues).cast("long").alias("n"), F.md5(residues).alias("digest"))


@query("stream_placement", "edge_scores",
       sql="SELECT seq_id, edge_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, edge_id) AS r FROM edge_scores) WHERE r = 1")
def _(spark, sf):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # the rows arrive as files of a folder
    _items(spark, sf).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("seq_id long, name string, seq string").parquet(f"{folder}/in")
    streaming.place_stream(arriving, _profiles(spark, sf), f"{folder}/out", f"{folder}/log", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("seq_id", "edge_id", "score")


O.cte("greedy", ["pair_all"], """SELECT 1 AS k, [i, j] AS used FROM (SELECT i, j FROM pair_all WHERE i <> j ORDER BY score DESC, i, j LIMIT 1) UNION ALL
SELECT k + 1, list_append(used, j) FROM (SELECT g.k, g.used, p.j, row_number() OVER (ORDER BY sum(p.score) DESC, p.j) AS r FROM greedy g
 JOIN pair_all p ON list_contains(g.used, p.i) AND NOT list_contains(g.used, p.j) GROUP BY g.k, g.used, p.j) WHERE r = 1""")


@query("addition_order", "greedy", sql="""SELECT CAST(r - 1 AS INTEGER) AS rank, i FROM
 (SELECT unnest(used) AS i, unnest(range(1, len(used) + 1)) AS r FROM (SELECT arg_max(used, k) AS used FROM greedy))""")
def _(spark, sf):
    closer = W.mirror(_item_scores(spark, sf)).select(F.lit(0).alias("tree_id"), "i", "j", (-F.col("score")).cast("long").alias("dist"))
    return N.addition_orders(cut_lineage(closer)).select("rank", "i")


#: The benchmark texts are dealt to so many trees.
TREES = 8


def _families(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf).filter("seq <> ''")
    return items.select((F.col("seq_id") % TREES).cast("int").alias("tree_id"), F.col("seq_id").alias("i"), "name", "seq")


O.cte("tree_pairs_all", ["pair_all"], f"SELECT CAST(i % {TREES} AS INTEGER) AS t, i, j, score FROM pair_all WHERE i % {TREES} = j % {TREES}")
O.cte("tree_greedy", ["tree_pairs_all"], """SELECT t, 1 AS k, [i, j] AS used
FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, i, j) AS r FROM tree_pairs_all WHERE i <> j) WHERE r = 1
UNION ALL SELECT t, k + 1, list_append(used, j)
FROM (SELECT g.t, g.k, g.used, p.j, row_number() OVER (PARTITION BY g.t ORDER BY sum(p.score) DESC, p.j) AS r
 FROM tree_greedy g JOIN tree_pairs_all p ON p.t = g.t AND list_contains(g.used, p.i) AND NOT list_contains(g.used, p.j)
 GROUP BY g.t, g.k, g.used, p.j) WHERE r = 1""")


@query("tree_orders", "tree_greedy", sql="""SELECT t AS tree_id, CAST(r - 1 AS INTEGER) AS rank, i FROM
 (SELECT t, unnest(used) AS i, unnest(range(1, len(used) + 1)) AS r FROM (SELECT t, arg_max(used, k) AS used FROM tree_greedy GROUP BY t))""")
def _(spark, sf):
    texts = D.items(spark, sf).select((F.col("seq_id") % TREES).cast("int").alias("tree_id"), F.col("seq_id").alias("i"), "seq")
    scores = W.mirror(W.local_scores(texts, S.flat_matrix(spark), within="tree_id"))
    return N.addition_orders(cut_lineage(scores.select("tree_id", "i", "j", (-F.col("score")).cast("long").alias("dist"))))


@query("grown_trees")
def _(spark, sf):
    """Rows and splits cannot be said in SQL; the tests hold them against a plain loop."""
    return N.from_nothing(_families(spark, sf), S.flat_matrix(spark)).rows


@query("refined_trees")
def _(spark, sf):
    return N.refine(_families(spark, sf), S.flat_matrix(spark)).ends


@query("extended_trees")
def _(spark, sf):
    """Every tree's first half of texts in id order, then the others added in id order."""
    seqs = _families(spark, sf)
    rank = (F.row_number().over(Window.partitionBy("tree_id").orderBy("i")) - 1).alias("rank")
    orders = cut_lineage(seqs.select("tree_id", rank, "i", F.ceil(F.count("*").over(Window.partitionBy("tree_id")) / 2).cast("int").alias("half")))
    first, later = orders.filter("rank < greatest(half, 2)"), orders.filter("rank >= greatest(half, 2)")
    forest = N.build(seqs, first.select("tree_id", "rank", "i"))
    return N.extend(forest, seqs, later.select("tree_id", (F.col("rank") - F.greatest("half", F.lit(2))).alias("rank"), "i")).rows


def _node_profiles(spark: SparkSession, sf: str) -> DataFrame:
    refs, nodes, edges = _refs(spark, sf)
    gaps = G.node_gap_probs(refs, nodes, edges, 2)
    return cut_lineage(G.node_profiles(D.heap_anc_probs(refs, nodes), nodes, gaps))


O.cte("node_gap", ["up3", "gapfreq"], "SELECT v, col, l1 * f / (l0 * (1 - f) + l1 * f) AS gap FROM up3, gapfreq WHERE v BETWEEN 3 AND 24")
O.cte("item4", ["items"], f"SELECT seq_id, i, length(s) AS n, strpos('ACGT', substr(s, CAST(i AS INTEGER), 1)) - 1 AS b FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM (SELECT seq_id, {O.acgt('seq')} AS s FROM items))")
O.cte(
    "node_lo", ["anc_p", "bg", "node_gap"],
    "SELECT x.v, anc_p.col + 1 AS col, list(greatest(-100.0, ln(p / q)) ORDER BY b) AS lo, max(greatest(-100.0, ln((1 - gap) / (1 - 0.715)))) AS ng, max(greatest(-100.0, ln(gap / 0.715))) AS g "
    "FROM anc_p JOIN bg USING (b) JOIN node_gap x ON x.v = node_label AND x.col = anc_p.col GROUP BY 1, 2",
)
O.cte(
    "lo_dp", ["item4", "node_lo"],
    "SELECT seq_id, v, col, lo, ng, g, 0 AS i, 0 AS n, 0.0::DOUBLE AS m, CASE WHEN col = 0 THEN -1e30 ELSE 0 END::DOUBLE AS d, CASE WHEN col = 0 THEN 0 ELSE -1e30 END::DOUBLE AS x "
    "FROM (SELECT v, col, lo, ng, g FROM node_lo UNION ALL SELECT DISTINCT v, 0, [0.0, 0, 0, 0]::DOUBLE[], 0::DOUBLE, 0::DOUBLE FROM node_lo), (SELECT DISTINCT seq_id FROM item4) "
    "UNION ALL SELECT seq_id, v, col, lo, ng, g, i, n, m, CASE WHEN col = 0 THEN -1e30 ELSE max(lm + ln(1e-4) - col * ln(1e-3)) OVER (PARTITION BY seq_id, v ORDER BY col ROWS UNBOUNDED PRECEDING) + col * ln(1e-3) END AS d, x FROM ("
    "SELECT *, coalesce(lag(m) OVER (PARTITION BY seq_id, v ORDER BY col), -1e30) AS lm FROM ("
    "SELECT seq_id, v, col, lo, ng, g, i, n, CASE WHEN col = 0 THEN 0 ELSE greatest(pm + ng, pd + g, px + g) + lo[b + 1] END AS m, x FROM ("
    "SELECT t.seq_id, t.v, t.col, t.lo, t.ng, t.g, q.i, q.n, q.b, lag(t.m) OVER u AS pm, lag(t.d) OVER u AS pd, lag(t.x) OVER u AS px, "
    "CASE WHEN t.col = 0 THEN 0 ELSE greatest(t.m + ln(1e-4), t.x + ln(1e-3)) END AS x FROM lo_dp t JOIN item4 q ON q.seq_id = t.seq_id AND q.i = t.i + 1 "
    "WINDOW u AS (PARTITION BY t.seq_id, t.v ORDER BY t.col))))",
)
O.cte("node_scores", ["lo_dp"], "SELECT seq_id, v, max(m) AS score FROM lo_dp WHERE i > 0 AND i = n AND col >= least(n, (SELECT max(col) FROM node_lo)) GROUP BY 1, 2")


@query("best_node", "node_scores",
       sql="SELECT seq_id, CAST(min(v) FILTER (score > best - 1e-4) AS INTEGER) AS node_id, round(max(best), 5) AS score FROM "
       "(SELECT *, max(score) OVER (PARTITION BY seq_id) AS best FROM node_scores) GROUP BY 1")
def _(spark, sf):
    refs = _refs(spark, sf)[0]
    q = G.clean_queries(D.items(spark, sf))
    placed = G.best_node(q, _node_profiles(spark, sf), G.background_frequencies(refs))
    return placed.select("seq_id", "node_id", F.round("score", 5).alias("score"))


@query("traced_nodes", "node_scores",
       sql="SELECT seq_id, CAST(min(v) FILTER (score > best - 1e-4) AS INTEGER) AS node_id FROM "
       "(SELECT *, max(score) OVER (PARTITION BY seq_id) AS best FROM node_scores) GROUP BY 1")
def _(spark, sf):
    refs, nodes, edges = _refs(spark, sf)
    job = J.node_job(_msa(spark, sf), nodes, edges, D.heap_anc_probs(refs, nodes), 2, D.items(spark, sf))
    return job.traces.select("seq_id", "node_id")


# ---- aggregations ---------------------------------------------------------------------------


@query("column_coverage", "vectors_long", sql="SELECT CAST(col AS INTEGER) AS col, bool_or(ch <> '-') AS covered FROM vectors_long GROUP BY 1")
def _(spark, sf):
    return C.column_coverage(D.vectors(spark, sf))


@query("column_stats", "vectors_long", sql="SELECT CAST(col AS INTEGER) AS col, count(*) AS n_rows, count(*) FILTER (ch <> '-') AS n_nongap, count(*) FILTER (ch = '-') AS n_gap FROM vectors_long GROUP BY 1")
def _(spark, sf):
    return C.column_stats(D.vectors(spark, sf))


@query("column_gap_frequency", "vectors_long", sql="SELECT CAST(col AS INTEGER) AS col, round((count(*) FILTER (ch IN ('-', 'n')) + 1) / CAST(count(*) + 2 AS DOUBLE), 6) AS gap_freq FROM vectors_long GROUP BY 1")
def _(spark, sf):
    return C.column_gap_frequency(D.vectors(spark, sf)).select("col", six("gap_freq").alias("gap_freq"))


@query("gap_frequency", "gene_rows", sql="SELECT CAST(sum(length(seq) - length(replace(seq, '-', ''))) AS BIGINT) AS n_gap, CAST(sum(length(seq)) AS BIGINT) AS n_total, "
       "round(sum(length(seq) - length(replace(seq, '-', ''))) / CAST(sum(length(seq)) AS DOUBLE), 6) AS gap_freq FROM gene_rows")
def _(spark, sf):
    return C.gap_frequency(D.gene_rows(spark, sf)).withColumn("gap_freq", six("gap_freq"))


@query("base_frequencies", sql=f"""
SELECT base, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS freq FROM (SELECT base, CAST(sum(length(q) - length(replace(q, base, ''))) AS BIGINT) AS n
 FROM (SELECT {O.norm('text')} AS q FROM documents), (SELECT unnest(['A', 'C', 'G', 'T']) AS base) GROUP BY 1)""")
def _(spark, sf):
    return C.base_frequencies(D.texts(spark, sf)).withColumn("freq", six("freq"))


@query("insert_budget", "budget", sql="SELECT CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n FROM budget")
def _(spark, sf):
    return X.insert_budget(_gene_traces(spark, sf))


@query("output_width", "budget", "cal", sql="SELECT CAST((y1 - y0 + 1) * 12 AS BIGINT) AS n_cols, CAST(coalesce((SELECT sum(n) FROM budget), 0) AS BIGINT) AS n_inserted, "
       "CAST((y1 - y0 + 1) * 12 + coalesce((SELECT sum(n) FROM budget), 0) AS BIGINT) AS width FROM cal")
def _(spark, sf):
    t = cut_lineage(_gene_traces(spark, sf))
    return X.output_width(X.insert_budget(t), t.first()["width"])


@query("merged_rows", "owner", "cal", sql="""
SELECT 'motu_cluster_' || g.o_custkey AS name, string_agg(CASE WHEN m IS NULL THEN '-' ELSE substr('ACGT', CAST((m - 1) % 4 + 1 AS INTEGER), 1) END, '' ORDER BY g.col) AS seq
FROM (SELECT o_custkey, unnest(range(0, (y1 - y0 + 1) * 12)) AS col FROM (SELECT DISTINCT o_custkey FROM owner), cal) g LEFT JOIN owner o ON o.o_custkey = g.o_custkey AND o.col = g.col GROUP BY 1""")
def _(spark, sf):
    return C.merge_by_prefix(D.gene_rows(spark, sf).withColumn("input", F.lit(0)), "motu_cluster_", "input")


@query("first_input_rows", "gene_rows",
       sql="SELECT 'other_' || split_part(substr(name, 14), '.', 1) AS name, arg_min(seq, name) AS seq FROM gene_rows GROUP BY 1")
def _(spark, sf):
    rows = D.gene_rows(spark, sf).withColumn("input", F.col("name"))
    renamed = F.concat(F.lit("other_"), F.substring_index(F.expr("substring(name, 14)"), ".", 1))
    return C.merge_by_prefix(rows.withColumn("name", renamed), "motu_cluster_", "input")


@query("placement_quality", "steps", sql="""
SELECT name, round(count(*) FILTER (home = got) / CAST(count(*) AS DOUBLE), 6) AS share FROM (
 SELECT s.name, s.res, CASE WHEN o = '0' THEN cols - 1 ELSE cols END AS got, h.home FROM steps s JOIN (
  SELECT name, row_number() OVER (PARTITION BY name ORDER BY i) AS res, i - 1 AS home FROM (SELECT name, i, substr(row, CAST(i AS INTEGER), 1) AS c FROM (SELECT name, row, unnest(range(1, length(row) + 1)) AS i FROM gene_traces)) WHERE c <> '-') h
 ON h.name = s.name AND h.res = s.res WHERE o <> '1') GROUP BY 1""")
def _(spark, sf):
    t = _gene_traces(spark, sf)
    q = X.placement_quality(t.select("seq_id", "name", F.col("row").alias("seq")), t.select("seq_id", "ops"))
    return q.select("name", six("share").alias("share"))


@query("alignment_summary", "msa", sql="SELECT count(*) AS n_rows, CAST(max(length(name)) AS INTEGER) AS max_name_len, CAST(min(length(seq)) AS INTEGER) AS min_len, CAST(max(length(seq)) AS INTEGER) AS max_len, min(length(seq)) = max(length(seq)) AS uniform FROM msa")
def _(spark, sf):
    return C.alignment_summary(_msa(spark, sf))


@query("splits", "season_splits", sql="SELECT tree_id, edge_id, CAST(len(tips) AS INTEGER) AS size, array_to_string(tips, ',') AS tips, sha256(array_to_string(tips, ',')) AS split_key FROM season_splits")
def _(spark, sf):
    return T.splits(_branches(spark, sf)).select("tree_id", "edge_id", "size", F.array_join("tips", ",").alias("tips"), "split_key")


@query("node_heights", "season_rank", sql="""
SELECT tree_id, CAST(k AS INTEGER) AS node_id, CAST(CASE WHEN k <= 9 THEN 10 - k ELSE 0 END AS INTEGER) AS height, CAST(CASE WHEN k <= 9 THEN k WHEN k = 10 THEN 10 WHEN k >= 20 THEN 1 ELSE 21 - k END AS INTEGER) AS depth
FROM (SELECT DISTINCT tree_id, unnest(range(0, 22)) AS k FROM season_rank)""")
def _(spark, sf):
    return _branches(spark, sf).select("tree_id", "node_id", "height", "depth")


@query("table_traversal", "season_rank", sql="""
SELECT tree_id, CAST(k AS INTEGER) AS node_id, CAST(k AS INTEGER) AS preorder,
 CAST(CASE WHEN k <= 9 THEN k WHEN k = 10 THEN 10 WHEN k >= 20 THEN 1 ELSE 21 - k END AS INTEGER) AS depth
FROM (SELECT DISTINCT tree_id, unnest(range(1, 22)) AS k FROM season_rank)""")
def _(spark, sf):
    b = _branches(spark, sf)
    return U.traversal(T.nodes_of(b), T.edges_of(b)).select("tree_id", "node_id", "preorder", "depth")


# ---- windows, orders, sets --------------------------------------------------------------------


@query("output_columns", "budget", "cal", sql="SELECT CAST(pos AS INTEGER) AS pos, CAST(pos + sum(coalesce(n, 0)) OVER (ORDER BY pos) AS BIGINT) AS out_col FROM (SELECT unnest(range(0, (y1 - y0 + 1) * 12)) AS pos FROM cal) LEFT JOIN budget USING (pos)")
def _(spark, sf):
    t = cut_lineage(_gene_traces(spark, sf))
    return X.output_columns(X.insert_budget(t), t.first()["width"])


@query("opened_rows", "steps", "budget", "cal", sql="""
SELECT name, string_agg(CASE WHEN pos = 0 THEN repeat('-', n - length(ins)) || ins ELSE ins || repeat('-', n - length(ins)) END || ch, '' ORDER BY pos) AS seq FROM (
 SELECT g.name, g.pos, CAST(coalesce(b.n, 0) AS INTEGER) AS n, coalesce(i.ins, '') AS ins, coalesce(c.ch, '') AS ch
 FROM (SELECT name, unnest(range(0, width + 1)) AS pos FROM gene_traces) g LEFT JOIN budget b ON b.pos = g.pos
 LEFT JOIN (SELECT name, cols AS pos, string_agg(substr(seq, CAST(res AS INTEGER), 1), '' ORDER BY i) AS ins FROM steps WHERE o = '2' GROUP BY 1, 2) i ON i.name = g.name AND i.pos = g.pos
 LEFT JOIN (SELECT name, cols - 1 AS pos, CASE WHEN o = '1' THEN '-' ELSE substr(seq, CAST(res AS INTEGER), 1) END AS ch FROM steps WHERE o <> '2') c ON c.name = g.name AND c.pos = g.pos) GROUP BY 1""")
def _(spark, sf):
    t = cut_lineage(_gene_traces(spark, sf))
    gapped = t.withColumn("gapped", X.gapped(F.col("ops"), F.col("seq")))
    return X.open_queries(gapped, X.insert_budget(t), t.first()["width"]).select("name", "seq")


@query("opened_references", "msa_long", "tips", "budget", "cal", sql=f"""
SELECT name, string_agg(repeat('-', CAST(coalesce(n, 0) AS INTEGER)) || {O.norm('ch')}, '' ORDER BY col) || repeat('-', CAST(coalesce((SELECT n FROM budget, cal WHERE pos = (y1 - y0 + 1) * 12), 0) AS INTEGER)) AS seq
FROM msa_long LEFT JOIN budget ON pos = col WHERE name IN (SELECT name FROM tips) GROUP BY 1""")
def _(spark, sf):
    t = cut_lineage(_gene_traces(spark, sf))
    rows = C.tree_rows(_msa(spark, sf), _tree(spark, sf)[0].filter("is_tip"))
    return X.open_reference(rows, X.insert_budget(t), t.first()["width"])


@query("length_order", sql="SELECT doc_id AS i, CAST(length(text) AS INTEGER) AS length, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS rank FROM documents")
def _(spark, sf):
    return W.length_order(D.texts(spark, sf).select(F.col("seq_id").alias("i"), "seq"))


@query("tip_order", "season_rank", sql="SELECT tree_id, name, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY name) - 1 AS INTEGER) AS serial FROM season_rank")
def _(spark, sf):
    return T.tip_order(_branches(spark, sf))


@query("bernoulli_sample")
def _(spark, sf):
    return W.bernoulli_sample(D.texts(spark, sf), 0.1, 7)


@query("uniform_sample")
def _(spark, sf):
    return W.uniform_sample(D.texts(spark, sf), 10, 7)


@query("weighted_sample")
def _(spark, sf):
    return W.weighted_sample(W.primer_weights(_turns(spark, sf), S.builtin_primers(spark)), 10, 7)


@query("tip_sets_equal", "season_sets", "tree_pairs", sql="SELECT t1, t2, a.everything = b.everything AS equal FROM tree_pairs JOIN (SELECT DISTINCT tree_id, everything FROM season_sets) a ON a.tree_id = t1 JOIN (SELECT DISTINCT tree_id, everything FROM season_sets) b ON b.tree_id = t2")
def _(spark, sf):
    return T.tip_sets_equal(_branches(spark, sf), _pairs(spark, sf))


O.cte("tree_dist", ["season_splits", "tree_pairs"], "SELECT t1, t2, count(a.tips) AS n_shared, count(*) AS n_splits FROM tree_pairs JOIN season_splits b ON b.tree_id = t2 LEFT JOIN season_splits a ON a.tree_id = t1 AND a.tips = b.tips GROUP BY 1, 2")


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    b = _branches(spark, sf)
    return U.split_fingerprints(T.nodes_of(b), T.edges_of(b))


@query("tree_distance", "tree_dist", sql="SELECT t1, t2, n_shared, n_splits, round(1 - n_shared / CAST(n_splits AS DOUBLE), 6) AS dist FROM tree_dist")
def _(spark, sf):
    d = T.tree_distance(_fingerprints(spark, sf), _pairs(spark, sf))
    return d.withColumn("dist", six("dist"))


@query("split_sets_equal", "tree_dist", sql="SELECT t1, t2, n_shared = n_splits AS contained FROM tree_dist")
def _(spark, sf):
    return T.split_sets_equal(cut_lineage(_fingerprints(spark, sf)), _pairs(spark, sf))


@query("without_clones", "season_splits", "season_sets", sql="""
SELECT tree_id, edge_id, array_to_string(CASE WHEN 2 * len(b) > len(e) OR (2 * len(b) = len(e) AND NOT list_contains(b, e[1])) THEN list_filter(e, lambda x: NOT list_contains(b, x)) ELSE b END, ',') AS tips
FROM (SELECT s.tree_id, s.edge_id, list_filter(s.tips, lambda x: x NOT IN ('m00', 'm07')) AS b, list_filter(everything, lambda x: x NOT IN ('m00', 'm07')) AS e FROM season_splits s JOIN season_sets USING (tree_id, edge_id))""")
def _(spark, sf):
    sp = cut_lineage(T.splits(_branches(spark, sf)))
    return T.drop_cloned_tips(sp, ["m00", "m07"]).select("tree_id", "edge_id", F.array_join("tips", ",").alias("tips"))


O.cte("g", ["season_splits"], "SELECT gen, h FROM (SELECT tree_id, list_sort(list(array_to_string(tips, ','))) AS h FROM season_splits GROUP BY 1) JOIN "
      "(SELECT n_name AS tree_id, CAST(n_nationkey AS BIGINT) AS gen FROM nation UNION ALL SELECT n_name, n_nationkey + 25 FROM nation) USING (tree_id)")


@query("generation_cycle", "g", sql="""
SELECT gen, max(prior) AS same_as, gen - max(prior) AS period FROM (SELECT a.gen, b.gen AS prior FROM g a JOIN g b ON a.h = b.h AND b.gen < a.gen) GROUP BY 1""")
def _(spark, sf):
    nation = D.table(spark, sf, "nation").select(F.col("n_name").alias("tree_id"), F.col("n_nationkey").cast("long").alias("gen"))
    sp = T.splits(_branches(spark, sf)).select("tree_id", "split_key")
    twice = nation.unionByName(nation.withColumn("gen", F.col("gen") + 25))
    return T.generation_cycle(sp.join(twice, "tree_id").select("gen", "split_key"))

