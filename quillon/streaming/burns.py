"""Structured Streaming forms of the monitors (ST1, ST2, ST10, ST11) and of event-time windows.

Keyed state lives in the state store; sources are any streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import LEAST_RATE, LEAST_SAMPLES, RATE_WINDOW, RUN

OUT = "key bigint, event_id bigint, verdict string, state string"
STATE = "outcomes string, codes string, state string"


def _verdict(outcomes: str, codes: list[str]) -> str | None:
    last = codes[-RUN:]
    if outcomes[-1] == "0" and codes[-1] == "407":
        return "permanent"
    if len(last) == RUN and all(c in ("403", "429") for c in last) and "1" not in outcomes[-RUN:]:
        return "blocked"
    if len(last) == RUN and all(c == "TIMEOUT" for c in last) and "1" not in outcomes[-RUN:]:
        return "timeouts"
    if len(outcomes) >= LEAST_SAMPLES and outcomes.count("1") / len(outcomes) < LEAST_RATE:
        return "rate"
    return None


def burn_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """ST1: events (key, ts, event_id, ok, code) to (key, event_id, verdict, state), one row an event. State: the last 20 outcomes and 3 codes of a key. Within a micro-batch a key's events are taken in order of time."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        outcomes, joined, state = store.get if store.exists else ("", "", "healthy")
        codes = joined.split(",") if joined else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, ok, code in zip(rows["event_id"].tolist(), rows["ok"].tolist(), rows["code"].tolist(), strict=True):
            outcomes = (outcomes + ("1" if ok else "0"))[-RATE_WINDOW:]
            codes = [*codes, code][-RUN:]
            verdict = _verdict(outcomes, codes)
            if state == "cooldown":
                state = "healthy" if ok else "cooldown"
            elif state != "burned":
                state = "burned" if verdict == "permanent" else "cooldown" if verdict else "healthy"
            out.append((k[0], event, verdict, state))
        store.update((outcomes, ",".join(codes), state))
        yield pd.DataFrame(out, columns=["key", "event_id", "verdict", "state"])

    return events.groupBy(key).applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Extension: counts by event-time window and type; what comes later than the watermark is dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """ST10: each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Read all that is there now, write it as Parquet with a checkpoint in the folder, and read it again. Called again, it goes on where it ended."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def incremental_ingest(stream: DataFrame, folder: str, merge: Callable[[SparkSession, DataFrame, int], None]) -> None:
    """ST11, ST12: each micro-batch is merged by `merge(spark, rows, batch number)`, which must give the same result when a batch is repeated."""
    query = stream.writeStream.foreachBatch(lambda rows, n: merge(rows.sparkSession, rows, n)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
