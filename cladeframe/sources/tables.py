"""Adapters: the star-schema tables seen as sequences, alignments, trees and hits.

Each adapter reads whole tables.  Rows that become one sequence are aggregated to a
fixed calendar first (months of the order years, days of the event log), so the
string or array built per key is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import residues as R

# The residue written for a count modulo seven, and gene names' prefix.
COUNT_SYMBOLS = "-ACGTNU"
GENE_MODEL = "DNA"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as raw query sequences."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq_id"), F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("seq")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as raw query sequences."""
    d = table(spark, sf_dir, "benchmark")
    return d.select(
        F.col("item_id").alias("seq_id"), F.concat(F.lit("b"), "item_id").alias("name"), F.col("text").alias("seq")
    )


def _first_year(orders: DataFrame) -> Column:
    return orders.agg(F.min(F.year("o_orderdate"))).scalar()


def _width(orders: DataFrame) -> Column:
    """Months from the first January to the last December."""
    return orders.agg(
        ((F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate")) + 1) * 12)
    ).scalar()


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    col = (F.year("o_orderdate") - F.col("_y0")) * 12 + F.month("o_orderdate") - 1
    per_customer = (
        orders.withColumn("_y0", _first_year(orders)).groupBy("o_custkey", col.alias("col")).agg(F.count("*").alias("n"))
    )
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "col")
        .agg(F.sum("n").alias("n"))
    )


def _rows(counts: DataFrame, width: Column) -> DataFrame:
    # a month without orders has the residue of zero, which is the gap
    symbol = F.substr(F.lit(COUNT_SYMBOLS), (F.col("n") % 7 + 1).cast("int"), F.lit(1))
    cells = F.array_sort(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), symbol.alias("ch"))))
    return counts.groupBy("name").agg(cells.alias("m")).withColumn("_w", width).select(
        "name", R.row_of_cells(F.col("m"), F.col("_w").cast("int")).alias("seq")
    )


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msa(name, seq)``: one row per nation and one per region, one column per month.

    A residue encodes the month's order count; the months of the last year without
    orders are all-gap columns.
    """
    monthly = _monthly(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    width = _width(table(spark, sf_dir, "orders"))
    named = monthly.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    by_region = (
        named.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(R.normalize_name(F.col("r_name")).alias("name"), "col")
        .agg(F.sum("n").alias("n"))
    )
    counts = named.select(F.col("n_name").alias("name"), "col", "n").unionByName(by_region)
    return _rows(counts, width)


def heap_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Balanced tree over the nations: ``(nodes, edges)`` of one tree.

    Heap numbering over n tips: inner nodes 2..n-1, tip of nation k is n + k, the parent
    of v is v // 2, and the root is suppressed by joining nodes 2 and 3.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n = nation.agg(F.count("*").alias("n"))
    ids = n.select(F.explode(F.sequence(F.lit(2), (2 * F.col("n") - 1).cast("int"))).alias("node_id"))
    tips = nation.withColumn("_n", n.scalar()).select(
        (F.col("n_nationkey") + F.col("_n")).cast("int").alias("node_id"), F.col("n_name").alias("name")
    )
    nodes = ids.join(tips, "node_id", "left").select(
        F.lit("nations").alias("tree_id"),
        "node_id",
        "name",
        F.col("name").isNotNull().alias("is_tip"),
        F.col("node_id").cast("string").alias("label"),
    )
    length = lambda v: F.lit(0.05) + F.lit(0.01) * (v % 7)
    edges = ids.filter("node_id > 2").select(
        F.lit("nations").alias("tree_id"),
        (F.col("node_id") - 3).cast("int").alias("edge_id"),
        F.when(F.col("node_id") == 3, 2).otherwise(F.floor(F.col("node_id") / 2)).cast("int").alias("u"),
        F.col("node_id").alias("v"),
        F.when(F.col("node_id") == 3, length(F.lit(2)) + length(F.lit(3)))
        .otherwise(length(F.col("node_id")))
        .alias("len"),
    )
    return nodes, edges


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as tabular hits of orders against nations (0-based positions)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    start = (F.col("l_partkey") % 8).cast("int")
    return (
        li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("o"), "l_orderkey").alias("qs_name"),
            F.col("n_name").alias("ref_name"),
            start.alias("ref_start"),
            (start + F.col("l_quantity").cast("int") % 8).alias("ref_end"),
            F.col("l_extendedprice").alias("bit_score"),
            (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("line_no"),
        )
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of the alignment: half years, then whole years (file order ``ord``)."""
    orders = table(spark, sf_dir, "orders")
    years = orders.agg(
        F.min(F.year("o_orderdate")).alias("y0"), F.max(F.year("o_orderdate")).alias("y1")
    ).select(F.explode(F.sequence("y0", "y1")).alias("y"), "y0", "y1")
    base = (F.col("y") - F.col("y0")) * 12
    half = lambda h: F.struct(
        (2 * (F.col("y") - F.col("y0")) + h).alias("ord"),
        F.concat(F.lit("h"), F.col("y"), F.lit("_"), F.lit(h)).alias("gene_name"),
        (base + 6 * h).alias("start"),
        (base + 6 * h + 5).alias("end"),
    )
    whole = F.struct(
        (2 * (F.col("y1") - F.col("y0") + 1) + F.col("y") - F.col("y0")).alias("ord"),
        F.concat(F.lit("y"), F.col("y")).alias("gene_name"),
        base.alias("start"),
        (base + 11).alias("end"),
    )
    return years.select(F.explode(F.array(half(0), half(1), whole)).alias("p")).select(
        F.col("p.ord").alias("ord"),
        F.lit(GENE_MODEL).alias("model"),
        F.col("p.gene_name").alias("gene_name"),
        F.col("p.start").alias("start"),
        F.col("p.end").alias("end"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of ``events.value`` per user, in whole cents: ``(key, v)``.

    The array holds one entry per day with events, so it is bounded by the calendar.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    daily = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    )
    days = F.array_sort(F.collect_list(F.struct("day", "cents")))
    return daily.groupBy(F.col("user_id").alias("key")).agg(
        F.transform(days, lambda d: d["cents"].cast("double")).alias("v")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a wide alignment: each component quantised to a residue."""
    emb = table(spark, sf_dir, "embeddings")
    symbol = lambda x: (
        F.when(x < -0.1, "A").when(x < -0.05, "-").when(x < 0, "C").when(x < 0.05, "G").when(x < 0.1, "n").otherwise("T")
    )
    return emb.select(
        F.concat(F.lit("v"), "vec_id").alias("name"),
        F.array_join(F.transform("embedding", lambda x: symbol(x)), "").alias("seq"),
    )


def gene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that cover disjoint columns: one per (customer, priority) over the months.

    A month belongs to the lowest order priority of the customer in that month, so the
    rows of one customer never overlap.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    col = (F.year("o_orderdate") - F.col("_y0")) * 12 + F.month("o_orderdate") - 1
    owner = (
        orders.withColumn("_y0", _first_year(orders))
        .groupBy("o_custkey", col.alias("col"))
        .agg(F.min("o_orderpriority").alias("pri"), F.count("*").alias("n"))
    )
    counts = owner.select(
        F.concat(F.lit("motu_cluster_"), "o_custkey", F.lit("."), F.substr("pri", F.lit(1), F.lit(1))).alias("name"),
        "col",
        ((F.col("n") - 1) % 4 + 1).alias("n"),
    )
    return _rows(counts, _width(orders))


def season_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One caterpillar tree per nation and per region over the twelve calendar months.

    ``(tree_id, newick)``: months are attached from the quietest to the busiest.
    """
    monthly = _monthly(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    named = monthly.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")
    )
    season = named.groupBy("n_name", "r_name", (F.col("col") % 12).alias("mon")).agg(F.sum("n").alias("n"))
    both = season.select(F.col("n_name").alias("tree_id"), "mon", "n").unionByName(
        season.select(F.col("r_name").alias("tree_id"), "mon", "n")
    )
    months = F.map_from_entries(F.collect_list(F.struct("mon", "n")))
    rank = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(11)),
            lambda k: F.struct(
                F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0)).alias("n"), k.alias("mon")
            ),
        )
    )
    totals = both.groupBy("tree_id", "mon").agg(F.sum("n").alias("n")).groupBy("tree_id").agg(months.alias("m"))
    order = totals.select("tree_id", F.transform(rank, lambda r: r["mon"]).alias("mons"))
    name = lambda k: F.concat(F.lit("m"), F.lpad(k.cast("string"), 2, "0"), F.lit(":1.0"))
    inner = F.aggregate(
        F.slice("mons", 2, 9),
        name(F.get(F.col("mons"), 0)),
        lambda acc, k: F.concat(F.lit("("), acc, F.lit(","), name(k), F.lit("):0.5")),
    )
    return order.select(
        "tree_id",
        F.concat(F.lit("("), inner, F.lit(","), name(F.get(F.col("mons"), 10)), F.lit(","), name(F.get(F.col("mons"), 11)), F.lit(");")).alias("newick"),
    )


def heap_anc_probs(msa: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_label, col, p)``: smoothed base shares of the tips below each inner heap node.

    Stands in for externally estimated ancestral probabilities.
    """
    tips = nodes.filter("is_tip").select("name", "node_id")
    cells = msa.join(tips, "name").select(
        "node_id", F.posexplode(R.chars(R.normalize_seq(F.col("seq")))).alias("col", "ch")
    )
    halvings = F.sequence(F.lit(1), F.floor(F.log2(F.col("node_id"))).cast("int") - 1)
    above = F.transform(halvings, lambda k: F.floor(F.col("node_id") / F.pow(F.lit(2.0), k)).cast("int"))
    counts = (
        cells.withColumn("node_label", F.explode(above))
        .groupBy("node_label", "col")
        .agg(*[F.count_if(F.col("ch") == b).alias(b) for b in "ACGT"])
    )
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T") + 4.0
    return counts.select("node_label", "col", F.array(*[(F.col(b) + 1.0) / total for b in "ACGT"]).alias("p"))
