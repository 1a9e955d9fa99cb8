"""Queries of windows over event streams (W3-W7, W10, ST1-ST5) and, as extensions, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import half_up
from ..operators import windows
from .registry import query

#: failures are made three times as frequent as errors, so that all verdicts occur
EVENTS_SQL = f"EV AS (SELECT event_id, user_id, ts, value, ok, CASE WHEN ok THEN '200' WHEN event_id % 61 = 0 THEN '407' WHEN user_id % 4 = 0 THEN '403' WHEN user_id % 4 = 1 THEN 'TIMEOUT' WHEN event_id % 4 < 2 THEN '429' ELSE '500' END AS code FROM (SELECT *, event_type NOT IN ('error', 'view') AS ok FROM events))"
_PREC = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"
VERDICT_SQL = f"""{EVENTS_SQL}, VD AS (SELECT *, avg(ok::INT) OVER ({_PREC.format(n=19)}) AS rate, CASE WHEN code = '407' THEN 'permanent' WHEN count(*) OVER ({_PREC.format(n=2)}) = 3 AND min((code IN ('403', '429'))::INT) OVER ({_PREC.format(n=2)}) = 1 THEN 'blocked'
  WHEN count(*) OVER ({_PREC.format(n=2)}) = 3 AND min((code = 'TIMEOUT')::INT) OVER ({_PREC.format(n=2)}) = 1 THEN 'timeouts' WHEN count(*) OVER ({_PREC.format(n=19)}) >= 5 AND avg(ok::INT) OVER ({_PREC.format(n=19)}) < 0.5 THEN 'rate' END AS verdict, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM EV)"""


def outcomes(df: DataFrame) -> DataFrame:
    """Events as outcomes of requests: ok and code."""
    ok, u, e = ~F.col("event_type").isin("error", "view"), F.col("user_id"), F.col("event_id")
    code = F.when(ok, "200").when(e % 61 == 0, "407").when(u % 4 == 0, "403").when(u % 4 == 1, "TIMEOUT").when(e % 4 < 2, "429").otherwise("500")
    return df.select("event_id", "user_id", "ts", "value", ok.alias("ok"), code.alias("code"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query(f"WITH {VERDICT_SQL} SELECT event_id, floor(rate * 1e6 + 0.5) / 1e6 AS rate_20, verdict FROM VD")
def burn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict after each event, from its last 3 and 20."""
    d = windows.burn_verdicts(outcomes(_events(spark, sf_dir)), "user_id", ["ts", "event_id"], F.col("ok"), F.col("code"))
    return d.select("event_id", half_up(F.col("rate_20"), 6).alias("rate_20"), "verdict")


STATES_SQL = f"""{VERDICT_SQL}, ST AS (SELECT user_id, rn, event_id, CASE WHEN verdict = 'permanent' THEN 'burned' WHEN verdict IS NOT NULL THEN 'cooldown' ELSE 'healthy' END AS state FROM VD WHERE rn = 1
  UNION ALL SELECT v.user_id, v.rn, v.event_id, CASE WHEN s.state = 'burned' THEN 'burned' WHEN s.state = 'cooldown' THEN CASE WHEN v.ok THEN 'healthy' ELSE 'cooldown' END WHEN verdict = 'permanent' THEN 'burned' WHEN verdict IS NOT NULL THEN 'cooldown' ELSE 'healthy' END FROM ST s JOIN VD v ON v.user_id = s.user_id AND v.rn = s.rn + 1)"""


@query(f"WITH RECURSIVE {STATES_SQL} SELECT event_id, state FROM ST")
def burn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 as a batch: healthy, cooldown or burned after each event."""
    return windows.burn_states(outcomes(_events(spark, sf_dir)), "user_id", ["ts", "event_id"], F.col("ok"), F.col("code")).select("event_id", "state")


@query(f"WITH RECURSIVE {STATES_SQL}, Z AS (SELECT user_id, state, rn, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS back FROM ST), Y AS (SELECT Z.user_id, Z.state, VD.ts FROM Z JOIN VD ON VD.user_id = Z.user_id AND VD.rn = Z.rn WHERE back = 1) SELECT user_id, state, state = 'healthy' OR (state = 'cooldown' AND TIMESTAMP '2024-01-31 00:00:00' - ts >= INTERVAL 10 MINUTE) AS reusable FROM Y")
def burn_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: last state by key, and whether the key can be used again ten minutes after its last event."""
    d = windows.burn_states(outcomes(_events(spark, sf_dir)), "user_id", ["ts", "event_id"], F.col("ok"), F.col("code"))
    last = d.groupBy("user_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))
    rested = F.expr("timestamp '2024-01-31 00:00:00'") - F.col("ts") >= F.expr("interval 10 minutes")
    return last.select("user_id", "state", ((F.col("state") == "healthy") | ((F.col("state") == "cooldown") & rested)).alias("reusable"))


@query("SELECT event_id, n::BIGINT AS in_window, n >= 3 AS retired FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')")
def crash_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, ST4: errors of the key within six hours."""
    return windows.count_within(_events(spark, sf_dir).filter("event_type = 'error'"), "user_id", "ts", 6 * 3600, 3).select("event_id", "in_window", "retired")


@query("""
WITH a AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT event_id, run::BIGINT AS run, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::INT AS run_pos FROM b
""")
def stall_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types."""
    return windows.islands(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("event_id", "run", "run_pos")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS high_water, value >= 40 AND NOT coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 40, false) AS fires FROM events")
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, ST5: running maximum and upward crossings of a threshold."""
    return windows.high_water(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", 40.0).select("event_id", "high_water", "fires")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, 1 AS session, 1 AS n, us AS since, 'first' AS why FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN n >= 5 OR e.us - since >= 172800000000 THEN session + 1 ELSE session END, CASE WHEN n >= 5 OR e.us - since >= 172800000000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 5 OR e.us - since >= 172800000000 THEN e.us ELSE since END, CASE WHEN n >= 5 THEN 'max-events' WHEN e.us - since >= 172800000000 THEN 'max-age' ELSE '' END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT event_id, session, n, why FROM f
""")
def session_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: sessions of at most five events and two days."""
    return windows.rotations(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "ts", 5, 2 * 86400).select("event_id", "session", "n", "why")


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 3 % 7)::INT AS member FROM events")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven members in turn, three events each."""
    return windows.round_robin(_events(spark, sf_dir), ["ts", "event_id"], 7, 3).select("event_id", "member")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows."""
    g = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT start, count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: windows of an hour, every half hour."""
    return _events(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""
WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM b GROUP BY user_id, s
""")
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions with a gap of six hours."""
    g = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_id, prev_id FROM (SELECT a.event_id, max(b.event_id) AS prev_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.ts < a.ts WHERE a.event_type = 'error' GROUP BY a.event_id)")
def last_click_before_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: an as-of join by one sort of both sides: the last click before each error of the same user (ids ascend with time)."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    e = _events(spark, sf_dir).filter("event_type in ('error', 'click')")
    met = e.withColumn("prev_id", F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(w))
    return met.filter("event_type = 'error' and prev_id is not null").select("event_id", "prev_id")
