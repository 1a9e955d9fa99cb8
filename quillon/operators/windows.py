"""Windows over events, and ranks over whole tables (W3-W10, ST1-ST5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import checkpoint

STATUS_WINDOW, RATE_WINDOW, LEAST_SAMPLES, LEAST_RATE, RUN = 10, 20, 5, 0.5, 3


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """A rank over all rows, 1 first, without putting them into one partition: rows are range-partitioned and sorted, counted by partition, and
    numbered from the sum of the counts before. Order must be unique. What is broadcast is a number per partition."""
    ranged = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + local).drop("_p", "_before")


def burn_verdicts(df: DataFrame, key: str, order: list[str], success: Column, code: Column) -> DataFrame:
    """Df and verdict after each event: 'permanent' (407), 'blocked' (three 403 or 429 in a row), 'timeouts' (three in a row), 'rate' (under
    half of the last 20, from five on) or null; rate_20 is the share of successes. code: text, 'TIMEOUT' for none."""
    w = Window.partitionBy(key).orderBy(*order)
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    ok = success.cast("int")
    blocked = (code.isin("403", "429") & ~success).cast("int")
    late = ((code == "TIMEOUT") & ~success).cast("int")
    full = F.count(F.lit(1)).over(last(RUN)) == RUN
    rate = F.avg(ok).over(last(RATE_WINDOW))
    verdict = (
        F.when((code == "407") & ~success, "permanent").when(full & (F.min(blocked).over(last(RUN)) == 1), "blocked").when(full & (F.min(late).over(last(RUN)) == 1), "timeouts")
        .when((F.count(F.lit(1)).over(last(RATE_WINDOW)) >= LEAST_SAMPLES) & (rate < LEAST_RATE), "rate")
    )
    return df.withColumn("rate_20", rate).withColumn("verdict", verdict)


def sorted_scan(df: DataFrame, key: str, order: list[str], columns: tuple[str, ...], kinds: str, step: Callable[[object, tuple], tuple[object, tuple]]) -> DataFrame:
    """df and more columns (kinds: their DDL) from a fold over each key's rows in order: step(state, values of columns) -> (state, values of the new ones); state starts as None.

    One shuffle by key and a sort; the rows then stream through, so that a key may be larger than memory.
    """
    added = T.StructType.fromDDL(kinds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for frame in frames:
            out = []
            for k, *values in zip(frame[key].tolist(), *[frame[c].tolist() for c in columns], strict=True):
                if k != now:
                    now, state = k, None
                state, made = step(state, tuple(values))
                out.append(made)
            for i, f in enumerate(added.fields):
                frame[f.name] = [x[i] for x in out]
            yield frame

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, T.StructType([*df.schema.fields, *added.fields]))


def burn_states(df: DataFrame, key: str, order: list[str], success: Column, code: Column) -> DataFrame:
    """ST1 as a batch: df, rate_20, verdict, and state after each event: healthy, cooldown (till the next success) or burned (for good).

    A verdict counts only in a healthy state, which depends on all events before, so the verdicts are folded in order.
    """
    judged = burn_verdicts(df, key, order, success, code).withColumn("_ok", success)
    return sorted_scan(judged, key, order, ("verdict", "_ok"), "state string", _next_state).drop("_ok")


def _next_state(state: str | None, row: tuple) -> tuple[str, tuple[str]]:
    verdict, ok = row
    if state == "cooldown":
        state = "healthy" if ok else "cooldown"
    elif state != "burned":
        state = "burned" if verdict == "permanent" else "cooldown" if isinstance(verdict, str) else "healthy"
    return state, (state,)


def count_within(df: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """W5, ST4: events of the key in the window up to each event, and whether they reach the limit."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("retired", F.col("in_window") >= limit)


def islands(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values: run number and position within it."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return runs.withColumn("run_pos", F.row_number().over(Window.partitionBy(key, "run").orderBy(*order))).drop("_new")


def high_water(df: DataFrame, key: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """W7, ST5: highest value so far, and whether the threshold is crossed upwards here (armed again once the value is under it)."""
    w = Window.partitionBy(key).orderBy(*order)
    above = F.col(value) >= threshold
    return df.withColumn("high_water", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("fires", above & ~F.coalesce(F.lag(value).over(w) >= threshold, F.lit(False)))


def rotations(df: DataFrame, key: str, order: list[str], at: str, most: int, max_age_s: float) -> DataFrame:
    """ST3: a session of the key ends after `most` events or when its first event is max_age_s old; session number of each event, and why its session began.

    A fold over the key's events in order, as a session's start depends on where the one before ended.
    """

    def step(state: tuple[int, int, int] | None, row: tuple) -> tuple[tuple[int, int, int], tuple[int, int, str]]:
        session, n, since = state or (0, 0, 0)
        why = "first" if state is None else "max-events" if n >= most else "max-age" if row[0] - since >= max_age_s * 1e6 else ""
        new = (session + 1, 1, row[0]) if why else (session, n + 1, since)
        return new, (new[0], new[1], why)

    return sorted_scan(df.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))), key, order, ("_us",), "session int, n int, why string", step).drop("_us")


def round_robin(df: DataFrame, order: list[str], members: int, sticky: int = 1) -> DataFrame:
    """A member in turn for each row, the same one for `sticky` rows."""
    return global_rank(df, *order, name="_rank").withColumn("member", (F.floor((F.col("_rank") - 1) / sticky) % members).cast("int")).drop("_rank")
