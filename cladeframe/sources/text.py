"""Readers and writers of sequence, alignment, hit, partition and matrix files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cladeframe.functions import residues as R
from cladeframe.operators.columns import AlignmentError, alignment_summary

# The two built-in primers and the columns of tabular hits.
BUILTIN_PRIMERS = ["CTTGGTCATTTAGAGGAAGT", "CGATGAAGAACGCAG"]
HIT_COLUMNS = [
    ("qs_name", "string"), ("ref_name", "string"), ("ident", "float"), ("len", "int"),
    ("mismatch", "int"), ("gap_open", "int"), ("qs_start", "int"), ("qs_end", "int"),
    ("ref_start", "int"), ("ref_end", "int"), ("evalue", "string"), ("bit_score", "float"),
]


def fasta_records(lines: DataFrame) -> DataFrame:
    """``(name, seq)`` from text records split at line-initial ``>``; batch or streaming."""
    rec = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(rec, "^([^\n]*)", 1)
    return (
        lines.filter(F.trim("value") != "")
        .select(
            R.normalize_name(F.rtrim(F.regexp_replace(head, "\r$", ""))).alias("name"),
            F.regexp_replace(F.substr(rec, F.length(head) + 1), r"\s+", "").alias("seq"),
        )
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files as ``(name, seq)``; one record per row, files stay splittable."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path))


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """The same as a streaming source over a folder."""
    return fasta_records(
        spark.readStream.schema("value string").format("text").option("lineSep", "\n>").load(path)
    )


_PHYLIP_HEADER = r"^\s*(\d+)\s+(\d+)\s*$"


def read_phylip(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """PHYLIP alignment as ``(name, seq)``; ``check`` compares rows with the header."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.filter(~F.col("value").rlike(_PHYLIP_HEADER)).select(
        F.regexp_extract("value", r"^\s*(\S+)", 1).alias("name"),
        F.regexp_replace(F.regexp_extract("value", r"^\s*\S+\s+(.*)$", 1), r"\s+", "").alias("seq"),
    )
    if check:
        head = lines.filter(F.col("value").rlike(_PHYLIP_HEADER)).agg(
            F.count("*").alias("k"),
            F.max(F.regexp_extract("value", _PHYLIP_HEADER, 1).cast("long")).alias("n"),
            F.max(F.regexp_extract("value", _PHYLIP_HEADER, 2).cast("long")).alias("w"),
        ).first()
        got = alignment_summary(rows).first()
        if head["k"] != 1 or got["n_rows"] != head["n"] or not (got["min_len"] == got["max_len"] == head["w"]):
            raise AlignmentError(f"header {head['n']} x {head['w']} does not fit {got.asDict()} in {path}")
    return rows


def _positions(df: DataFrame) -> DataFrame:
    """Add the file block a row came from and its order inside the scan task."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, value)`` in file order, without moving the lines through one task.

    Counts per file block are summed up first; that frame has one row per scan block.
    """
    rows = _positions(lines)
    blocks = rows.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select("_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_off"))
    return rows.join(offsets, ["_file", "_block"]).select(
        (F.col("_off") + F.col("_row") - F.col("_first")).alias("line_no"), "value"
    )


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hit files, numbered in file order."""
    return parse_hits(number_lines(spark.read.text(path)))


def parse_hits(lines: DataFrame) -> DataFrame:
    """Hits from ``(line_no, value)``; positions become 0-based, a malformed line is an error."""
    parts = lines.filter(F.trim("value") != "").withColumn("f", F.split(F.trim("value"), r"\s+"))
    bad = F.raise_error(F.concat(F.lit("bad hit line: "), F.col("value")))
    cols: list[Column] = []
    for k, (name, kind) in enumerate(HIT_COLUMNS):
        raw = F.get(F.col("f"), F.lit(k))
        value = raw if kind == "string" else raw.try_cast(kind)
        value = F.when(value.isNull(), bad.cast(kind)).otherwise(value)
        cols.append((value - 1 if name.endswith(("_start", "_end")) else value).alias(name))
    return parts.select(*cols, "line_no")


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """``MODEL, gene = a-b`` lines as 0-based inclusive ranges in file order.

    A partition file names column ranges of one alignment, so it is read whole.
    """
    return parse_partitions(spark.read.text(path, wholetext=True))


def parse_partitions(texts: DataFrame) -> DataFrame:
    """Partitions from whole files ``(value)``; a malformed line is an error."""
    lines = texts.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    pattern = r"^([^,]*),\s*(\S+)\s.*?=\s*(\d+)\s*-\s*(\d+)"
    bad = F.raise_error(F.concat(F.lit("bad partition line: "), F.col("line")))
    part = lambda k: F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, k)).otherwise(
        bad.cast("string")
    )
    return lines.filter(F.trim("line") != "").select(
        "ord",
        part(1).alias("model"),
        part(2).alias("gene_name"),
        (part(3).cast("int") - 1).alias("start"),
        (part(4).cast("int") - 1).alias("end"),
    )


def flat_matrix(spark: SparkSession, match: int = 3, mismatch: int = 0, symbols: str = "ACGT") -> DataFrame:
    """``(a, b, score)`` with one score on the diagonal and one elsewhere."""
    a = spark.range(1).select(F.explode(F.split(F.lit(symbols), "")).alias("a"))
    return a.select("a", F.explode(F.split(F.lit(symbols), "")).alias("b")).select(
        "a", "b", F.when(F.col("a") == F.col("b"), match).otherwise(mismatch).alias("score")
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Square text matrix: a line of symbols, then one line per symbol; ``#`` starts a comment."""
    lines = (
        spark.read.text(path, wholetext=True)
        .select(F.filter(F.split("value", "\r?\n"), lambda x: ~x.rlike(r"^\s*(#.*)?$")).alias("l"))
    )
    fields = lambda x: F.split(F.trim(x), r"\s+")
    rows = lines.select(
        fields(F.get("l", F.lit(0))).alias("syms"), F.explode(F.slice("l", F.lit(2), F.size("l") - 1)).alias("line")
    ).select("syms", fields(F.col("line")).alias("f"))
    return rows.select(
        F.get("f", F.lit(0)).alias("a"), F.posexplode("syms").alias("k", "b"), "f"
    ).select("a", "b", F.get("f", F.col("k") + 1).cast("int").alias("score"))


def builtin_primers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(BUILTIN_PRIMERS)), "primer_id int, seq string")


def read_anc_probs(spark: SparkSession, path: str) -> DataFrame:
    """Binary per-node probabilities as ``(node_label, col, p)``.

    Records are int32 counter, int32 width, width x 4 doubles; counter -1 ends a file.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                pos = 0
                while pos + 4 <= len(blob):
                    (label,) = struct.unpack_from("<i", blob, pos)
                    if label == -1:
                        break
                    (width,) = struct.unpack_from("<i", blob, pos + 4)
                    p = np.frombuffer(blob, "<f8", width * 4, pos + 8).reshape(width, 4)
                    pos += 8 + width * 32
                    yield pd.DataFrame({"node_label": label, "col": np.arange(width), "p": list(p)})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(records, "node_label int, col int, p array<double>")


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """One equal-length sequence per line; the name is the line number."""
    lines = number_lines(spark.read.text(path))
    rows = lines.select("line_no", F.trim(F.regexp_replace("value", r"\s+$", "")).alias("seq"))
    same = rows.agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi")).first()
    if same["lo"] != same["hi"]:
        raise AlignmentError(f"different line lengths: {same['lo']} to {same['hi']}")
    return rows.select(F.col("line_no").cast("string").alias("name"), "seq")


# ---- sinks ---------------------------------------------------------------------------


def phylip_lines(msa: DataFrame, order: str | None = None) -> DataFrame:
    """``(ord, value)``: header line, then names padded to the longest plus one."""
    head = alignment_summary(msa).select(
        F.struct("n_rows", "max_len", "max_name_len", "uniform").alias("h")
    ).scalar()
    key = F.struct(F.lit(1).alias("part"), (F.col(order) if order else F.col("name")).cast("string").alias("k"))
    if order:
        key = F.struct(F.lit(1).alias("part"), F.lpad(F.col(order).cast("string"), 20, "0").alias("k"))
    bad = F.raise_error(F.lit("rows of different length"))
    rows = msa.withColumn("_h", head).select(
        key.alias("ord"),
        F.when(~F.col("_h.uniform"), bad.cast("string"))
        .otherwise(F.concat(F.expr("rpad(name, _h.max_name_len + 1, ' ')"), F.col("seq")))
        .alias("value"),
    )
    top = msa.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("w")).select(
        F.struct(F.lit(0).alias("part"), F.lit("").alias("k")).alias("ord"),
        F.concat_ws(" ", "n", "w").alias("value"),
    )
    return top.unionByName(rows)


def write_phylip(msa: DataFrame, path: str, order: str | None = None) -> None:
    phylip_lines(msa, order).orderBy("ord").select("value").write.text(path)


def fasta_lines(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def write_fasta(seqs: DataFrame, path: str, drop_gaps: bool = False) -> None:
    """One record per row; ``drop_gaps`` removes gaps and N (alignment to FASTA)."""
    out = seqs.withColumn("seq", R.degap(F.col("seq"))) if drop_gaps else seqs
    fasta_lines(out).write.text(path)


@F.pandas_udf(StringType())
def _four_decimals(x: pd.Series) -> pd.Series:
    """Four decimals of the exact binary value, halves to even; Java's formats round halves up."""
    return x.map(lambda v: "%.4f" % v, na_action="ignore")


def matrix_lines(scores: DataFrame, kind: str = "distance") -> DataFrame:
    """``(i, value)``: one text line per row of a square matrix ``(i, j, score, dist)``.

    ``distance`` prints four decimals, ``score`` the raw numbers, ``hits`` one
    ``j score`` pair per line.  A line holds a whole row by definition of the format.
    """
    if kind == "hits":
        return scores.select("i", F.concat_ws(" ", "i", "j", "score").alias("value"))
    shown = _four_decimals(F.col("dist")) if kind == "distance" else F.col("score").cast("string")
    cells = F.array_sort(F.collect_list(F.struct("j", shown.alias("v"))))
    return scores.groupBy("i").agg(
        F.concat(F.col("i"), F.lit("\t"), F.array_join(F.transform(cells, lambda c: c["v"]), "\t")).alias("value")
    )


def write_matrix(scores: DataFrame, path: str, kind: str = "distance") -> None:
    lines = matrix_lines(scores, kind)
    if kind == "distance":
        n = scores.agg(F.countDistinct("i").cast("string").alias("value")).select(
            F.lit(None).cast(lines.schema["i"].dataType).alias("i"), "value"
        )
        lines = n.unionByName(lines)
    lines.orderBy(F.col("i").asc_nulls_first()).select("value").write.text(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.parquet(path)


def placement_report(placed: DataFrame) -> DataFrame:
    """``name edge score`` lines with zero-padded numbers."""
    pad = lambda c, w: F.lpad(c.cast("string"), F.greatest(F.lit(w), F.length(c.cast("string"))), F.lit("0"))
    return placed.select(F.concat_ws(" ", "name", pad(F.col("edge_id"), 4), pad(F.col("score"), 5)).alias("value"))


def candidate_report(candidates: DataFrame) -> DataFrame:
    """``seq edge score<TAB>aligned`` lines of the candidate alignments."""
    return candidates.select(
        F.concat(F.concat_ws(" ", "seq_id", "edge_id", "score"), F.lit("\t"), F.col("aligned")).alias("value")
    )
