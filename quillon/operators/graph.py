"""Connected components by joins: large-star and small-star steps in turn, each round in a checkpoint, until nothing changes."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, a local session (tests on one machine) takes a new one; on a cluster that is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b); label is the least node of its component. Rounds grow with the logarithm of the size."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        turned = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        links = e.unionByName(turned) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        met = links.join(least, "a")
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    now, mark = checkpoint(edges.select("a", "b").filter("a <> b").distinct()), None
    while True:
        now = checkpoint(star(star(now, True), False))
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
