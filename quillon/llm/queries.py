"""The operators of this subpackage as queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, line_dedup, lm_score, mixing, near_dedup, quality, sentencepiece_codec, sharding, suffix_dedup, topk

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, work: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: work(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="item_id")


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": _over("documents", lambda d: sentencepiece_codec.encode_decode(d.select("doc_id", "text"))),
    "op2_chat_format": _over("conversations", chat.format_chats),
    "op3_line_dedup": _over("documents", line_dedup.line_dedup),
    "op4_suffix_dedup": _over("documents", suffix_dedup.repeated_passages),
    "op5_exact_topk": _over("embeddings", topk.every_hundredth),
    "op6_kd_shards": _over("documents", sharding.kd_shards),
    "op7_quality_rules": _over("documents", quality.quality_filter),
    "op8_lm_scores": _over("documents", lm_score.document_scores),
    "op8_lm_scores_benchmark": _lm,
    "op9_mixing": _over("documents", mixing.mix),
    "op10_near_dedup": _over("documents", near_dedup.groups),
}

SQL: dict[str, str] = {
    "op2_chat_format": chat.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_exact_topk": topk.SQL,
    "op7_quality_rules": quality.SQL,
    "op9_mixing": mixing.SQL,
}
