"""A join whose hot keys are cut into parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key on the left side of a join that one task meets with the other side's.
CHUNK = 2000


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left and right with equal keys, the other columns as x_a and x_b. A key with many rows on the left is cut into parts, each of which meets
    the right side's rows in a task of its own; no row that is joined is kept or sent."""
    spark = left.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    hot = F.broadcast(left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")).filter("parts > 1"))  # at most one row for CHUNK rows
    named = lambda d, s: d.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c not in on])
    a = named(left, "a")
    a = a.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64(*[c for c in a.columns if c not in on]), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    b = named(right, "b").join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    keys = [*on, "part"]
    return a.repartition(n, *keys).join(b.repartition(n, *keys), keys)
