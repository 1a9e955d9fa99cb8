"""The corpus pipeline: documents in, token ids out. Each stage's rows are written as Parquet and read again as the next one's.

Counted as part of the subpackage llm. Near copies are compared after boilerplate lines are gone (a large group of copies keeps one copy of its lines), mixing weights are measured on what
is kept, and only that is encoded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common, line_dedup, mixing, near_dedup, quality, sentencepiece_codec

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs, copies_once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(docs.select("doc_id", "lang", "source", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_quality),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Near copies are found by sketches, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what stands between them goes to the shared folder that the cluster names."""
    common.shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
