"""Operator 6: shards by a k-d tree over metadata.

Starting from one node with all documents, each node above the target bytes is split at the byte-weighted median of its widest metadata
dimension (its range over the whole table's), level by level, all nodes of a level in the same jobs. Medians are exact:
the range is cut into bins, bytes are summed by node and bin, and the bin that holds the median is cut again, until one
value is left; what is shuffled is at most some thousand rows a node and task (more bins where nodes are few, so that passes are fewer). The texts are read once,
for their sizes.

Dimensions: integers as they are; values of any other type (whole strings, fractions, dates) by their dense rank among the table's distinct values, which a
distributed sort of these gives. Results: null is the lowest value of its dimension. A null text weighs 0 bytes. Rows equal to the median go left, so a tie
isn't torn apart; if the median is the largest value, rows below it go left. A node whose rows have the same values in all dimensions (such as repeated rows) can't be
split and stays, even over the target. Extra columns don't matter; an empty table gives an empty table.

Depth isn't limited: of two levels on one dimension, one leaves at most half of the bytes in each part or makes the dimension constant, so the levels are at most twice
the logarithm of total over target, and two for each dimension. Numbers of shards hold 62 levels; beyond, Spark's arithmetic raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, small_enough

TARGET_BYTES = 128 << 20
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")
#: Bins of a node's range: BINS at least, ALL_BINS over all nodes of a level, and a range isn't cut into more than MOST_BINS.
BINS, ALL_BINS, MOST_BINS = 1024, 1 << 20, 1 << 12
#: Nodes of a level, or distinct values, up to this number (some 100 bytes each) are sent to every executor; more are joined by shuffle.
BROADCAST_NODES = 50_000
#: Parts into which the rows of one value are dealt where values are joined by shuffle.
SALTS = 32


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for b in batches:
        at = np.arange(k, k + b.num_rows)
        k += b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at)], names=["value", "part", "place"])


def dense_ranks(values: DataFrame) -> DataFrame:
    """(value, rank) of the distinct values that aren't null of a one-column table: sorted by range partitions, no value or row gathered in one place."""
    kind = values.schema[0].dataType
    ordered = values.toDF("value").filter("value is not null").distinct()
    ordered = ordered.repartitionByRange("value").sortWithinPartitions("value")
    placed = checkpoint(ordered.mapInArrow(_numbered, T.StructType([T.StructField("value", kind), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])))
    sizes = placed.groupBy("part").count()  # a row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return placed.join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("place")).alias("rank"))


def _coded(df: DataFrame, dimensions: tuple[str, ...], at: str) -> DataFrame:
    """df with the codes of its dimensions, an array of bigint that isn't null and has no nulls."""
    whole = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(f"`{d}`")).alias(f"{n}{k}") for k, d in enumerate(dimensions) if isinstance(df.schema[d].dataType, T.IntegralType) for f, n in ((F.min, "low"), (F.count, "have"))]).head()
    codes: list[Column] = []
    for k, d in enumerate(dimensions):
        value = F.col(f"`{d}`")
        if isinstance(df.schema[d].dataType, T.IntegralType):
            low = whole[f"low{k}"]
            if low is None or whole[f"have{k}"] == whole["n"] or low > -(2**63):  # else nothing is under the least: ranks
                codes.append(F.coalesce(value.cast("bigint"), F.lit((low if low is not None else 0) - (whole[f"have{k}"] < whole["n"])).cast("bigint")))
                continue
        rank, name, salt = fresh(df, f"rank{k}", f"value{k}", "salt")
        ranks = dense_ranks(df.select(value)).select(F.col("value").alias(name), F.col("rank").alias(rank))
        if small_enough(ranks, BROADCAST_NODES):
            df = df.join(F.broadcast(ranks), value == F.col(name), "left").drop(name)
        else:  # a value may hold a third of all rows
            dealt = ranks.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            df = df.withColumn(salt, F.monotonically_increasing_id() % SALTS).join(dealt.withColumnRenamed(salt, "_" + salt), (F.col(f"`{d}`") == F.col(name)) & (F.col(salt) == F.col("_" + salt)), "left").drop(name, salt, "_" + salt)
        codes.append(F.coalesce(F.col(rank), F.lit(-1)).cast("bigint"))
    return df.withColumn(at, F.array(*codes) if codes else F.array().cast("array<bigint>"))


def _meet(rows: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    return rows.join(F.broadcast(nodes) if small_enough(nodes, BROADCAST_NODES) else nodes, "node", how)


def _medians(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, dim, at, top): the weighted median of each node's dimension. nodes: node, dim, low, high, bytes."""
    top = nodes.select("node", F.col("high").alias("top"))
    now = nodes.select("node", "dim", "low", "high", (F.col("bytes") / 2).alias("want"), F.lit(0).cast("bigint").alias("below"))
    bins_each = min(MOST_BINS, max(BINS, ALL_BINS // max(1, nodes.count())))
    while True:
        width = F.expr(f"high div {bins_each} - low div {bins_each} + 1")  # never overflows; all of these divisions keep the order
        bins = (
            _meet(rows.select("node", "bytes", "at"), now, "inner")
            .withColumn("v", F.get("at", F.col("dim")))
            .filter(F.col("v").between(F.col("low"), F.col("high")))
            .withColumn("wide", width)
            .withColumn("bin", F.expr("v div wide - low div wide"))
            .groupBy("node", "dim", "want", "below", "bin")
            .agg(F.sum("bytes").alias("b"), F.min("v").alias("bin_low"), F.max("v").alias("bin_high"))
        )
        order = Window.partitionBy("node").orderBy("bin")
        upto = bins.withColumn("upto", F.col("below") + F.sum("b").over(order))
        reached = upto.filter(F.col("upto") >= F.col("want")).withColumn("k", F.row_number().over(order)).filter("k = 1")
        now = checkpoint(reached.select("node", "dim", F.col("bin_low").alias("low"), F.col("bin_high").alias("high"), "want", (F.col("upto") - F.col("b")).alias("below")))
        if now.filter("low < high").isEmpty():
            return now.join(top, "node").select("node", "dim", F.col("low").alias("split"), "top")


def kd_shards(df: DataFrame, target_bytes: int = TARGET_BYTES, dimensions: tuple[str, ...] = DIMENSIONS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard) for each row; shard is the leaf's number in heap order (a node's children are twice it and one more)."""
    at, weight, name = fresh(df, "at", "weight", "name")
    plain = df.select(F.col(doc_id).alias(name), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias(weight), *[F.col(f"`{d}`") for d in dict.fromkeys(dimensions)])
    if any(not isinstance(df.schema[d].dataType, T.IntegralType) for d in dimensions):
        plain = checkpoint(plain)  # the texts are read once
    rows = checkpoint(_coded(plain, dimensions, at).select(F.col(name).alias("doc_id"), F.col(weight).alias("bytes"), F.col(at).alias("at"), F.lit(1).cast("bigint").alias("node")))
    each = [f(F.get("at", F.lit(k))).alias(f"{n}{k}") for k in range(len(dimensions)) for f, n in ((F.min, "low"), (F.max, "high"))]
    whole = rows.agg(*each).head()
    spans = [max(1.0, float((whole[f"high{k}"] or 0) - (whole[f"low{k}"] or 0))) for k in range(len(dimensions))]
    while True:
        stats = rows.groupBy("node").agg(F.sum("bytes").alias("bytes"), *each)
        sides = F.array(
            *[
                F.struct(((F.col(f"high{k}").cast("double") - F.col(f"low{k}").cast("double")) / spans[k]).alias("share"), F.lit(-k).alias("first"), F.lit(k).alias("dim"), F.col(f"low{k}").alias("low"), F.col(f"high{k}").alias("high"))
                for k in range(len(dimensions))
            ]
        )
        nodes = checkpoint(stats.filter(F.col("bytes") > target_bytes).select("node", "bytes", F.array_max(sides).alias("side")).filter("side.low < side.high").select("node", "bytes", "side.dim", "side.low", "side.high"))
        if nodes.isEmpty():
            break
        splits = _medians(rows, nodes)
        value = F.get("at", F.col("dim"))
        right = F.when(F.col("split") < F.col("top"), value > F.col("split")).otherwise(value >= F.col("split"))
        moved = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("bigint"))
        rows = checkpoint(_meet(rows, splits, "left").select("doc_id", "bytes", "at", moved.alias("node")))
    return rows.select("doc_id", F.col("bytes").alias("n_bytes"), F.col("node").alias("shard"))
