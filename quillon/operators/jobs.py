"""Job queues and logs (P13-P18, W9, A20-A22, A24, A30, A31, ST7-ST9, T8, T10, SK17, SK18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import half_up

MOST_PRIORITY, NORMAL, TYPES = 2**31 - 1, 5, ("search", "detail-batch", "enrich")
WEEK_MS = 7 * 24 * 3600 * 1000


def priority(raw: Column) -> Column:
    """A whole number from 0 to 2^31-1; 5 for none, for no number and for a negative one."""
    n = raw.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")) | (n < 0), NORMAL).otherwise(F.least(F.floor(n), F.lit(MOST_PRIORITY))).cast("bigint")


def errors(kind: Column, query: Column, location: Column, most: Column, ids: Column, business: Column, prio: Column, attempts: Column, delay: Column) -> Column:
    """Array of what is wrong with a request, empty for a good one; an unknown type is the only error of its row."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    out = lambda c, low, high: c.isNotNull() & (c.try_cast("double").isNull() | ~c.try_cast("double").between(low, high))
    broken = lambda c: c.try_cast("double") != F.floor(c.try_cast("double"))
    search, batch = kind == "search", kind == "detail-batch"
    found = F.array(
        F.when(search & blank(query), "query"), F.when(search & blank(location), "location"), F.when(search & (out(most, 1, 100_000) | F.coalesce(broken(most), F.lit(False))), "max_results"),
        F.when(batch & (ids.isNull() | (F.size(ids) == 0)), "no_ids"), F.when(batch & (F.size(ids) > 500), "too_many_ids"), F.when(batch & F.exists(F.coalesce(ids, F.array().cast("array<string>")), blank), "empty_id"),
        F.when((kind == "enrich") & blank(business), "business"), F.when(out(prio, 0, float("inf")), "priority"), F.when(out(attempts, 1, 50) | F.coalesce(broken(attempts), F.lit(False)), "attempts"), F.when(out(delay, 0, WEEK_MS), "delay"),
    )
    return F.when(F.coalesce(kind.isin(*TYPES), F.lit(False)), F.array_compact(found)).otherwise(F.array(F.lit("type")))


def task(kind: Column, query: Column, location: Column, most: Column, business: Column) -> Column:
    """The task of a request."""
    return F.named_struct(
        F.lit("type"), F.concat(F.when(kind == "detail-batch", "detail").otherwise(kind), F.lit("-task")), F.lit("query"), F.when(kind == "search", query), F.lit("location"), F.when(kind == "search", location),
        F.lit("max_results"), F.when((kind == "search") & (most.try_cast("int") > 0), most.try_cast("int")), F.lit("business"), F.when(kind == "enrich", business),
    )


def job_states(events: DataFrame, now: Column) -> DataFrame:
    """ST7, ST8: latest state of each job. events: job, at, seq, event ('add', 'start', 'done', 'fail'), attempts, delay_until, priority.

    A failed job waits again until it has failed `attempts` times, then it is a dead letter ('failed'); a delayed one waits once its time has come.
    """
    g = events.groupBy("job").agg(
        F.max_by("event", F.struct("at", "seq")).alias("last"), F.count_if(F.col("event") == "fail").alias("fails"), F.max("attempts").alias("attempts"), F.max("delay_until").alias("delay_until"), F.max("priority").alias("priority"), F.min("at").alias("added"),
    )
    state = (
        F.when(F.col("last") == "done", "completed").when(F.col("last") == "start", "active").when((F.col("last") == "fail") & (F.col("fails") >= F.coalesce("attempts", F.lit(1))), "failed").when((F.col("last") == "add") & (F.col("delay_until") > now), "delayed").otherwise("waiting")
    )
    return g.select("job", state.alias("state"), F.col("fails").cast("int").alias("attempts_made"), "priority", "added")


def queue_order(states: DataFrame) -> DataFrame:
    """Waiting jobs with their place: lowest priority number first, then oldest, then by job."""
    from .windows import global_rank

    waiting = states.filter("state = 'waiting'").select("job", "priority", "added")
    return global_rank(waiting, "priority", "added", "job", name="place")


def state_counts(states: DataFrame) -> DataFrame:
    """Jobs by state, in one row."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("waiting", "active", "completed", "failed", "delayed")])


def dead_letters(states: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """ST9, T8: a page of the dead letters, oldest first."""
    return states.filter("state = 'failed'").orderBy("added", "job").offset(offset).limit(limit)


def dead_letter_count(states: DataFrame) -> DataFrame:
    """ST9: how many there are; one row."""
    return states.agg(F.count_if(F.col("state") == "failed").alias("dead_letters"))


def retried(states: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """ST9: the states after dead letters (those of ids, a column job; all, if None) wait again, with no attempt made. Other jobs of ids stay as they are."""
    chosen = states.withColumn("_hit", F.lit(True)) if ids is None else states.join(ids.select("job").distinct().withColumn("_hit", F.lit(True)), "job", "left")
    again = (F.col("state") == "failed") & F.coalesce("_hit", F.lit(False))
    return chosen.withColumn("attempts_made", F.when(again, 0).otherwise(F.col("attempts_made"))).withColumn("state", F.when(again, "waiting").otherwise(F.col("state"))).drop("_hit")


def without_dead_letters(states: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """ST9: the states without dead letters (those of ids; all, if None)."""
    if ids is None:
        return states.filter("state <> 'failed'")
    return states.join(ids.select("job", F.lit("failed").alias("state")).distinct(), ["job", "state"], "left_anti").select(*states.columns)


def cost_summary(log: DataFrame) -> DataFrame:
    """Log: provider, cost, ms, success. One row a provider and one ('*') for all, by grouping sets in one pass."""
    d = log.select(F.coalesce("provider", F.lit("unknown")).alias("provider"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("ms", F.lit(0)).alias("ms"), F.coalesce("success", F.lit(True)).alias("success"))
    g = d.rollup("provider").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("succeeded"), half_up(F.sum("cost"), 6).alias("cost"), half_up(F.avg("ms")).cast("bigint").alias("avg_ms"))
    return g.select(F.coalesce("provider", F.lit("*")).alias("provider"), "n", "succeeded", half_up(F.col("succeeded") * 100.0 / F.col("n"), 1).alias("success_rate"), "cost", "avg_ms")


def batch_totals(batches: DataFrame) -> DataFrame:
    """Worker, ok, ms, error: attempts, successes, rate, times and failures by worker, with the commonest error (ties by name)."""
    by_error = batches.filter("not ok").groupBy("worker", "error").agg(F.count(F.lit(1)).alias("c")).groupBy("worker").agg(F.min(F.struct((-F.col("c")).alias("o"), "error")).alias("e")).select("worker", F.col("e.error").alias("top_error"))
    g = batches.groupBy("worker").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("succeeded"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), half_up(F.avg("ms"), 2).alias("avg_ms"))
    return g.join(by_error, "worker", "left").select("worker", "attempted", "succeeded", half_up(F.col("succeeded") * 100.0 / F.col("attempted"), 1).alias("rate"), "min_ms", "max_ms", "avg_ms", "top_error")


def least_busy(workers: DataFrame) -> DataFrame:
    """The worker with the fewest tasks, ties by id."""
    return workers.orderBy("attempted", "worker").limit(1)


def missing_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with at least one empty field, and which."""
    lost = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields]))
    return df.select(key, lost.alias("missing")).filter(F.size("missing") > 0)


def fill_missing(df: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Only empty fields are filled."""
    other = found.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    met = df.join(other, key, "left")
    return met.select(*[F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in df.columns])


LEVELS = ("debug", "info", "warn", "error")


def at_level(log: DataFrame, least: str) -> DataFrame:
    """SK17: log rows of a level and above."""
    order = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return log.filter(order >= LEVELS.index(least) + 1)


def latest_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
