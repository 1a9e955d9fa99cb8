"""Queries of job queues, costs and worker totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs
from ..sources.listings import listings
from .registry import query


@query("""
SELECT k, CASE k % 6 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 2147483647 WHEN 4 THEN 2 ELSE 5 END::BIGINT AS priority,
 CASE k % 5 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'query' ELSE 'max_results' END WHEN 1 THEN 'no_ids' WHEN 2 THEN 'business|attempts' WHEN 3 THEN 'type' ELSE '' END AS errors, CASE k % 5 WHEN 0 THEN 'search-task' WHEN 1 THEN 'detail-task' WHEN 2 THEN 'enrich-task' WHEN 3 THEN 'other-task' ELSE 'enrich-task' END AS task FROM L
""")
def job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests checked, their priority and task."""
    k = F.col("k")
    raw = F.element_at(F.array(*[F.lit(x) for x in ("7.9", "-1", "x", "1e12", "2", None)]), (k % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("search", "detail-batch", "enrich", "other", "enrich")]), (k % 5 + 1).cast("int"))
    text, none = F.when(k % 2 == 1, "plumber"), F.lit(None).cast("string")
    ids = F.array().cast("array<string>")
    most, business, attempts = F.when(k % 2 == 1, "0"), F.when(k % 5 == 4, "b1"), F.when(k % 5 == 2, "1.5")
    wrong = jobs.errors(kind, text, F.lit("here"), most, ids, business, none, attempts, none)
    return listings(spark, sf_dir).select("k", jobs.priority(raw).alias("priority"), F.array_join(wrong, "|").alias("errors"), jobs.task(kind, text, F.lit("here"), most, business)["type"].alias("task"))


#: orders as jobs: an 'add' each, and what its key says came of it
_JOBS_SQL = """J AS (SELECT o_orderkey AS job, CAST(o_orderkey % 4 AS BIGINT) AS priority, o_orderdate AS added, 1 + (o_orderkey // 3) % 2 AS attempts, o_orderkey % 3 AS fails, o_orderkey % 7 AS f FROM orders),
S AS (SELECT job, CASE WHEN f = 0 THEN 'completed' WHEN f = 1 THEN 'active' WHEN f IN (2, 3) AND fails > 0 THEN CASE WHEN fails >= attempts THEN 'failed' ELSE 'waiting' END WHEN f = 4 AND fails = 0 THEN 'delayed' ELSE 'waiting' END AS state, CASE WHEN f IN (2, 3) THEN fails ELSE 0 END::INT AS attempts_made, priority, added FROM J)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    at, f = F.col("o_orderdate"), F.col("o_orderkey") % 7
    base = [k.alias("job"), (1 + F.floor(k / 3) % 2).alias("attempts"), F.when((f == 4) & (k % 3 == 0), F.expr("timestamp '2100-01-01 00:00:00'")).alias("delay_until"), (k % 4).alias("priority")]
    event = lambda when, name, later: F.when(when, F.struct((at + F.make_dt_interval(F.lit(0), F.lit(later))).alias("at"), F.lit(later).alias("seq"), F.lit(name).alias("event")))
    failing = f.isin(2, 3)
    rows = F.array_compact(F.array(event(F.lit(True), "add", 0), event(failing & (k % 3 >= 1), "fail", 1), event(failing & (k % 3 >= 2), "fail", 2), event(f.isin(0, 1), "start", 3), event(f == 0, "done", 4)))
    events = o.select(*base, F.explode(rows).alias("e")).select("job", "attempts", "delay_until", "priority", "e.*")
    return jobs.job_states(events, F.expr("timestamp '2050-01-01 00:00:00'"))


@query(f"WITH {_JOBS_SQL} SELECT job, CASE WHEN state = 'failed' AND attempts_made < 1 THEN 'waiting' ELSE state END AS state, attempts_made FROM S")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7, ST8: states of jobs from their events."""
    return _states(spark, sf_dir).select("job", "state", "attempts_made")


@query(f"WITH {_JOBS_SQL} SELECT {', '.join(f'''count(*) FILTER (WHERE state = '{s}')::BIGINT AS {s}''' for s in ('waiting', 'active', 'completed', 'failed', 'delayed'))} FROM S")
def job_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by state."""
    return jobs.state_counts(_states(spark, sf_dir))


@query(f"WITH {_JOBS_SQL} SELECT job, priority, row_number() OVER (ORDER BY priority, added, job)::BIGINT AS place FROM S WHERE state = 'waiting'")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the queue."""
    return jobs.queue_order(_states(spark, sf_dir)).select("job", "priority", "place")


@query(f"WITH {_JOBS_SQL} SELECT job, attempts_made FROM S WHERE state = 'failed' ORDER BY added, job LIMIT 20 OFFSET 5")
def dead_letter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9, T8: a page of dead letters (paging is the feature)."""
    return jobs.dead_letters(_states(spark, sf_dir), 20, 5).select("job", "attempts_made")


@query(f"""WITH {_JOBS_SQL}, A AS (SELECT job, CASE WHEN state = 'failed' AND job % 2 = 0 THEN 'waiting' ELSE state END AS state, CASE WHEN state = 'failed' AND job % 2 = 0 THEN 0 ELSE attempts_made END AS attempts_made FROM S)
SELECT job, state, attempts_made FROM A WHERE NOT (state = 'failed' AND job % 3 = 0)""")
def dead_letter_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: dead letters of even jobs tried again, of every third one that is left removed."""
    s = _states(spark, sf_dir).select("job", "state", "attempts_made")
    return jobs.without_dead_letters(jobs.retried(s, s.filter("job % 2 = 0")), s.filter("job % 3 = 0"))


@query(f"WITH {_JOBS_SQL} SELECT count(*) FILTER (WHERE state = 'failed')::BIGINT AS dead_letters FROM S")
def dead_letter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: how many dead letters there are."""
    return jobs.dead_letter_count(_states(spark, sf_dir))


_EVENT_LOG = "E AS (SELECT CASE WHEN user_id % 9 = 0 THEN 'unknown' ELSE 'p' || CAST(user_id % 9 AS VARCHAR) END AS provider, value AS cost, CAST(floor(value * 10) AS BIGINT) AS ms, event_type <> 'error' AS ok FROM events)"
_COST = "count(*)::BIGINT AS n, count(*) FILTER (WHERE ok)::BIGINT AS succeeded, floor(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS success_rate, floor(sum(cost) * 1e6 + 0.5) / 1e6 AS cost, floor(avg(ms) + 0.5)::BIGINT AS avg_ms FROM E"


def _rounded(d: DataFrame, c: str = "cost") -> DataFrame:
    return d.withColumn(c, F.floor(F.col(c) * 100 + 0.5) / 100)


@query(f"WITH {_EVENT_LOG}, X AS (SELECT provider, {_COST} GROUP BY provider UNION ALL SELECT '*', {_COST}) SELECT provider, n, succeeded, success_rate, floor(cost * 100 + 0.5) / 100 AS cost, avg_ms FROM X")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by provider and in all."""
    u = F.col("user_id") % 9
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(u != 0, F.concat(F.lit("p"), u.cast("string"))).alias("provider"), F.col("value").alias("cost"), F.floor(F.col("value") * 10).alias("ms"), (F.col("event_type") != "error").alias("success"))
    return _rounded(jobs.cost_summary(log))


_WORK = "W AS (SELECT user_id % 7 AS worker, event_type <> 'error' AS ok, CAST(floor(value * 10) AS BIGINT) AS ms, CASE WHEN event_id % 3 = 0 THEN 'TIMEOUT' ELSE 'HTTP' END AS error FROM events)"


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).alias("worker"), (F.col("event_type") != "error").alias("ok"), F.floor(F.col("value") * 10).alias("ms"), F.when(F.col("event_id") % 3 == 0, "TIMEOUT").otherwise("HTTP").alias("error"))


@query(f"""WITH {_WORK}, X AS (SELECT worker, error, count(*) AS c FROM W WHERE NOT ok GROUP BY ALL), T AS (SELECT worker, first(error ORDER BY c DESC, error) AS top_error FROM X GROUP BY worker)
SELECT worker, count(*)::BIGINT AS attempted, count(*) FILTER (WHERE ok)::BIGINT AS succeeded, floor(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS rate, min(ms) AS min_ms, max(ms) AS max_ms, floor(avg(ms) * 100 + 0.5) / 100 AS avg_ms, any_value(top_error) AS top_error FROM W LEFT JOIN T USING (worker) GROUP BY worker""")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by worker."""
    return jobs.batch_totals(_work(spark, sf_dir))


@query(f"WITH {_WORK}, A AS (SELECT worker, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad FROM W GROUP BY worker) SELECT sum(n)::BIGINT AS attempted, sum(bad)::BIGINT AS errors, count(*) FILTER (WHERE bad * 100 < n * 20)::BIGINT AS active, (SELECT worker FROM A ORDER BY n, worker LIMIT 1) AS least_busy FROM A")
def pool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pool, and the least busy worker."""
    t = jobs.batch_totals(_work(spark, sf_dir))
    bad = F.col("attempted") - F.col("succeeded")
    whole = t.agg(F.sum("attempted").alias("attempted"), F.sum(bad).alias("errors"), F.count_if(bad * 100 < F.col("attempted") * 20).alias("active"))
    return whole.crossJoin(F.broadcast(jobs.least_busy(t).select(F.col("worker").alias("least_busy"))))  # one row each


@query("SELECT o_custkey AS run, sum(floor(abs(o_totalprice) + 0.5)::BIGINT)::BIGINT AS rows_out, count(*)::BIGINT AS runs, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS failed FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY GROUP BY o_custkey")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent runs rolled up. The bound is a one-row subquery, so that the filter stays a filter of the scan."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    last = o.agg(F.max("o_orderdate").alias("last"))
    recent = o.crossJoin(F.broadcast(last)).filter(F.col("o_orderdate") >= F.col("last") - F.expr("interval 365 day"))  # last: one row
    whole = F.floor(F.abs("o_totalprice") + 0.5).cast("bigint")
    return recent.groupBy(F.col("o_custkey").alias("run")).agg(F.sum(whole).alias("rows_out"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@query("SELECT place_id, array_to_string(list_filter([CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN website IS NULL THEN 'website' END, CASE WHEN rating IS NULL THEN 'rating' END], lambda x: x IS NOT NULL), '|') AS missing FROM L WHERE phone IS NULL OR website IS NULL OR rating IS NULL")
def discovery_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with empty fields, and which."""
    d = listings(spark, sf_dir).select("place_id", "phone", "website", "rating")
    return jobs.missing_fields(d, "place_id", ["phone", "website", "rating"]).withColumn("missing", F.array_join("missing", "|"))


@query("SELECT place_id, coalesce(phone, CASE WHEN k % 2 = 0 THEN 'found ' || place_id END) AS phone, coalesce(website, CASE WHEN k % 2 = 0 THEN 'http://f.example.com' END) AS website FROM L")
def discovery_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields filled from what was found."""
    d = listings(spark, sf_dir)
    found = d.filter("k % 2 = 0").select("place_id", F.concat(F.lit("found "), "place_id").alias("phone"), F.lit("http://f.example.com").alias("website"))
    return jobs.fill_missing(d.select("place_id", "phone", "website"), found, "place_id", ["phone", "website"])


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'debug' END AS level FROM events WHERE event_type IN ('error', 'click')")
def log_at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK17: log rows from 'warn' on."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return jobs.at_level(e.select("event_id", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warn").otherwise("debug").alias("level")), "warn")
