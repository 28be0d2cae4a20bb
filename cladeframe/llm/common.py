"""What several operators share: reading, the contracts' sample rule, scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def largest(df: DataFrame, value: str, limit: int) -> DataFrame:
    """Rows with the greatest positive ``value``, at most ``limit``, without sorting them.

    Rows are counted by steps of 2 % of the value, some thousand counts at most; the cut is the
    lowest step down to which there are not too many, so equal values stay or go together.
    """
    step = F.floor(F.log(F.col(value)) * 50)
    counts = sorted(df.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])
    total, cut = 0, None
    for row in counts:
        total += row["n"]
        if total > limit:
            break
        cut = row["step"]
    return df.filter(step >= cut) if cut is not None else df.filter("false")


class Scratch:
    """Parquet tables in the folder that the cluster shares; they outlive lost executors.

    The folder is ``spark.checkpoint.dir``.  Where it is unset, a local master gets a
    temporary folder; any other master is an error, as machines would not see the files.
    """

    def __init__(self, spark: SparkSession, label: str):
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="cladeframe-")
        self.spark, self.root = spark, f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: a cut in the lineage."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
