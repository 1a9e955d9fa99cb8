"""Queries that run as streams over all that is there, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..streaming import burns
from .monitoring import STATES_SQL, outcomes
from .registry import query


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(f"WITH RECURSIVE {STATES_SQL} SELECT event_id, state FROM ST")
def stream_burn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the state machine with keyed state; the same rows as the batch form."""
    return burns.run_once(burns.burn_stream(outcomes(_stream(spark, sf_dir))), _folder(spark)).select("event_id", "state")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: windows that the watermark has closed."""
    return burns.run_once(burns.windowed_counts(_stream(spark, sf_dir)), _folder(spark))


@query("SELECT event_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: each event once."""
    return burns.run_once(burns.first_seen(_stream(spark, sf_dir)).select("event_id", "event_type"), _folder(spark))


@query("SELECT user_id, count(*)::BIGINT AS n, max(ts) AS latest FROM events GROUP BY user_id")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: micro-batches merged into a table; each batch's totals have a folder of their own, written again if the batch is."""
    folder = _folder(spark)

    def merge(session: SparkSession, rows: DataFrame, n: int) -> None:
        rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{folder}/table/batch={n}")

    burns.incremental_ingest(_stream(spark, sf_dir), folder, merge)
    return spark.read.parquet(f"{folder}/table").groupBy("user_id").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
