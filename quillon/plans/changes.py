"""Queries of change capture and incremental decisions (C1-C18, J1-J3, SC6-SC12, SK7-SK11, A1, A2, A23-A25, T1, U1-U3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes
from ..sources.listings import listings
from .registry import query

_STATUS_SQL = "CASE status_text WHEN 'Permanently closed' THEN 'permanently_closed' WHEN 'Temporarily closed' THEN 'temporarily_closed' ELSE 'open' END"
#: a batch (now) over an earlier state (old): new ids, unchanged rows, and changes of each tracked field
STATES_SQL = f"""NW AS (SELECT place_id, k, name, rating, reviews_count, category, address, phone, website, {_STATUS_SQL} AS business_status, lat AS latitude, lng AS longitude, last_list, last_detail, bal FROM L WHERE k % 29 <> 0),
OD AS (SELECT place_id, k, name, CASE WHEN k % 10 = 0 THEN rating - 0.5 ELSE rating END AS rating, CASE WHEN k % 5 = 1 THEN old_reviews ELSE reviews_count END AS reviews_count, category, address, CASE WHEN k % 14 = 3 THEN NULL ELSE phone END AS phone, CASE WHEN k % 16 = 5 THEN 'http://old.example.com' WHEN website IS NULL THEN '' ELSE website END AS website,
  CASE WHEN k % 18 = 7 THEN 'open' ELSE {_STATUS_SQL} END AS business_status, lat AS latitude, lng AS longitude, last_list, last_detail, bal FROM L WHERE k % 11 <> 0)"""
_TXT = lambda c: f"nullif(CAST({c} AS VARCHAR), '')"
_HASH = lambda columns: "sha256(" + " || chr(1) || ".join(f"'{c}=' || coalesce(" + (f"CAST(CAST({c} AS DECIMAL(10,7)) AS VARCHAR)" if c in ("latitude", "longitude") else _TXT(c)) + ", 'null')" for c in columns) + ")"
_HAVE = ("place_id", "name", "rating", "reviews_count", "category", "address", "phone", "website", "business_status", "latitude", "longitude")
_HAVE_LISTED = _HAVE[1:9]
ACTED_SQL = f"{STATES_SQL}, OH AS (SELECT place_id, CASE WHEN k % 50 = 4 THEN NULL ELSE {_HASH(_HAVE)} END AS h FROM OD), AC AS (SELECT NW.*, {_HASH(_HAVE)} AS row_hash, CASE WHEN OH.place_id IS NULL THEN 'inserted' WHEN h = {_HASH(_HAVE)} THEN 'unchanged' ELSE 'updated' END AS action FROM NW LEFT JOIN OH ON OH.place_id = NW.place_id)".replace("'place_id=' || coalesce(nullif(CAST(place_id", "'place_id=' || coalesce(nullif(CAST(place_id")
ACTED_SQL = ACTED_SQL.replace("SELECT NW.*, sha256('place_id=' || coalesce(nullif(CAST(place_id", "SELECT NW.*, sha256('place_id=' || coalesce(nullif(CAST(NW.place_id").replace("WHEN h = sha256('place_id=' || coalesce(nullif(CAST(place_id", "WHEN h = sha256('place_id=' || coalesce(nullif(CAST(NW.place_id")


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) states of the listings."""
    d, k = listings(spark, sf_dir), F.col("k")
    status = F.when(F.col("status_text") == "Permanently closed", "permanently_closed").when(F.col("status_text") == "Temporarily closed", "temporarily_closed").otherwise("open")
    tail = [F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), "last_list", "last_detail", "bal"]
    new = d.filter("k % 29 <> 0").select("place_id", "k", "name", "rating", "reviews_count", "category", "address", "phone", "website", status.alias("business_status"), *tail)
    old = d.filter("k % 11 <> 0").select(
        "place_id", "k", "name", F.when(k % 10 == 0, F.col("rating") - 0.5).otherwise(F.col("rating")).alias("rating"), F.when(k % 5 == 1, F.col("old_reviews")).otherwise(F.col("reviews_count")).alias("reviews_count"), "category", "address",
        F.when(k % 14 != 3, F.col("phone")).alias("phone"), F.when(k % 16 == 5, "http://old.example.com").otherwise(F.coalesce("website", F.lit(""))).alias("website"), F.when(k % 18 == 7, "open").otherwise(status).alias("business_status"), *tail,
    )
    return old, new


def _acted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = states(spark, sf_dir)
    known = old.select("place_id", F.when(F.col("k") % 50 != 4, changes.row_hash(old)).alias("row_hash"))
    return old, changes.actions(known, new)


@query(f"WITH {STATES_SQL} SELECT place_id, {_HASH(_HAVE)} AS row_hash, {_HASH(_HAVE_LISTED)} AS change_hash FROM NW")
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of whole rows and of the list's fields."""
    new = states(spark, sf_dir)[1]
    return new.select("place_id", changes.row_hash(new).alias("row_hash"), changes.row_hash(new, changes.LISTED).alias("change_hash"))


@query(f"WITH {ACTED_SQL} SELECT place_id, row_hash, action FROM AC")
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted, updated or unchanged; a row that was never hashed is updated."""
    return _acted(spark, sf_dir)[1].select("place_id", "row_hash", "action")


_T = [("rating", "CAST({x} AS VARCHAR)", 1), ("reviews_count", "CAST({x} AS VARCHAR)", 1), ("business_status", "{x}", 0), ("phone", "nullif({x}, '')", 0), ("website", "nullif({x}, '')", 0)]
CHANGES_SQL = f"{ACTED_SQL}, FC AS (" + " UNION ALL ".join(
    f"SELECT NW.place_id, '{f}' AS field, {t.format(x='OD.' + f)} AS old_value, {t.format(x='NW.' + f)} AS new_value, " + (f"CASE WHEN OD.{f} IS NULL THEN NW.{f}::DOUBLE ELSE floor((NW.{f}::DOUBLE - OD.{f}::DOUBLE) * 10 + 0.5) / 10 END" if num else ("TRY_CAST(CASE WHEN " + t.format(x="OD." + f) + " IS NULL THEN trim(NW." + f + ") END AS DOUBLE)"))
    + f" AS delta FROM OD JOIN NW USING (place_id) WHERE {t.format(x='OD.' + f)} IS DISTINCT FROM {t.format(x='NW.' + f)}" for f, t, num in _T
) + ")"


@query(f"WITH {CHANGES_SQL} SELECT * FROM FC")
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6-C9, SK11: changes in long form."""
    return changes.field_changes(*states(spark, sf_dir))


@query(f"WITH {CHANGES_SQL} SELECT {', '.join(f'''count(*) FILTER (WHERE field = '{f}')::BIGINT AS {f}''' for f in changes.TRACKED)}, count(*)::BIGINT AS total FROM FC")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: changes by field."""
    return changes.change_summary(changes.field_changes(*states(spark, sf_dir)))


@query(f"WITH {ACTED_SQL} SELECT action, count(*)::BIGINT AS n FROM AC GROUP BY action")
def upsert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: rows by action."""
    return _acted(spark, sf_dir)[1].groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ACTED_SQL} SELECT place_id, rating, reviews_count, business_status, phone, website FROM OD WHERE place_id IN (SELECT place_id FROM AC WHERE action = 'updated')")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK10: old values of updated rows."""
    return changes.snapshots(*_acted(spark, sf_dir))


@query(f"""WITH {ACTED_SQL} SELECT coalesce(NW.place_id, OD.place_id) AS place_id, coalesce(AC.action, 'kept') AS action, CASE WHEN AC.action IN ('inserted', 'updated') THEN NW.rating ELSE OD.rating END AS rating, CASE WHEN AC.action IN ('inserted', 'updated') THEN NW.phone ELSE OD.phone END AS phone,
  CASE WHEN AC.action IN ('inserted', 'updated') THEN NW.website ELSE OD.website END AS website, CASE WHEN AC.action IN ('inserted', 'updated') THEN NW.reviews_count ELSE OD.reviews_count END AS reviews_count FROM OD FULL JOIN NW ON OD.place_id = NW.place_id LEFT JOIN AC ON AC.place_id = NW.place_id""")
def merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK7-SK9, C10, C11: the state after the batch."""
    return changes.merged(*_acted(spark, sf_dir)).select("place_id", "action", "rating", "phone", "website", "reviews_count")


_NOW = "TIMESTAMP '2024-06-01 00:00:00'"
DECISIONS_SQL = f"""{STATES_SQL}, DE AS (SELECT NW.place_id, OD.place_id IS NOT NULL AS known, CASE WHEN NW.k % 7 = 0 THEN NULL ELSE {_NOW} - to_hours((NW.k % 60)::BIGINT) END AS seen, CASE WHEN NW.k % 9 = 0 THEN NULL ELSE {_NOW} - to_hours((NW.k % 400)::BIGINT) END AS detailed, {_HASH(_HAVE_LISTED).replace("CAST(", "CAST(NW.")} = {_HASH(_HAVE_LISTED).replace("CAST(", "CAST(OD.")} AS same,
  NW.reviews_count::DOUBLE AS nr, OD.reviews_count::DOUBLE AS orr FROM NW LEFT JOIN OD ON OD.place_id = NW.place_id),
DF AS (SELECT *, greatest(0, epoch_us({_NOW}) - epoch_us(seen)) / 86400000000.0::DOUBLE AS la, greatest(0, epoch_us({_NOW}) - epoch_us(detailed)) / 86400000000.0::DOUBLE AS da, CASE WHEN orr = 0 THEN CASE WHEN nr > 0 THEN 1000.0 WHEN nr IS NOT NULL THEN 0.0 ELSE NULL END ELSE (nr - orr) / abs(orr) * 100 END AS jump FROM DE),
DC AS (SELECT place_id, CASE WHEN NOT known THEN 'new' WHEN la IS NULL OR la > 1 THEN 'stale' WHEN same THEN 'fresh_unchanged' ELSE 'fresh_changed' END AS list_action, CASE WHEN NOT known OR da IS NULL THEN 'no_cache' WHEN jump > 10 THEN 'forced_refresh' WHEN da > 7 THEN 'cache_miss' ELSE 'cache_hit' END AS detail_action FROM DF)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = states(spark, sf_dir)
    now = F.expr(_NOW)
    ago = lambda gap, n: F.when(F.col("k") % gap != 0, now - F.make_dt_interval(F.lit(0), (F.col("k") % n).cast("int")))
    o = old.select("place_id", changes.row_hash(old, changes.LISTED).alias("oh"), F.col("reviews_count").alias("orr"), F.lit(True).alias("known"))
    met = new.select("place_id", "k", "reviews_count", changes.row_hash(new, changes.LISTED).alias("nh")).join(o, "place_id", "left")
    known = F.coalesce("known", F.lit(False))
    fresh = changes.list_freshness(known, changes.age_days(ago(7, 60), now))
    detail = changes.detail_decision(known, changes.age_days(ago(9, 400), now), changes.review_jump(F.col("orr"), F.col("reviews_count")))
    return met.select("place_id", changes.list_action(fresh, F.col("nh").eqNullSafe(F.col("oh"))).alias("list_action"), detail.alias("detail_action"))


@query(f"WITH {DECISIONS_SQL} SELECT * FROM DC")
def incremental_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each listing and its details."""
    return _decided(spark, sf_dir)


@query(f"""WITH {DECISIONS_SQL} SELECT {', '.join(f'''count(*) FILTER (WHERE {c} = '{v}')::BIGINT AS {n}''' for c, v, n in (('list_action', 'new', 'list_new'), ('list_action', 'fresh_unchanged', 'list_skipped'), ('list_action', 'stale', 'list_stale'), ('list_action', 'fresh_changed', 'list_changed'), ('detail_action', 'cache_hit', 'detail_hits'), ('detail_action', 'cache_miss', 'detail_misses'), ('detail_action', 'forced_refresh', 'detail_forced'), ('detail_action', 'no_cache', 'detail_no_cache')))},
  (count(*) FILTER (WHERE list_action = 'fresh_unchanged') + 3 * count(*) FILTER (WHERE detail_action = 'cache_hit'))::BIGINT AS requests_saved, (4 * count(*) FILTER (WHERE detail_action = 'cache_hit'))::BIGINT AS seconds_saved FROM DC""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions counted, and what they save."""
    return changes.cache_stats(_decided(spark, sf_dir))


@query(f"SELECT category AS query, count(*)::BIGINT AS n, max(last_list) AS newest, coalesce(greatest(0, epoch_us({_NOW}) - epoch_us(max(last_list))) / 86400000000.0::DOUBLE <= 1, false) AS skip FROM L GROUP BY category")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8: which queries were run lately."""
    d = listings(spark, sf_dir).withColumn("query", F.col("category"))
    return changes.preflight(d, F.expr(_NOW))


@query("SELECT place_id, name, phone, rating FROM L WHERE place_id IN (SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') FROM orders WHERE o_orderstatus = 'P')")
def lookup_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6, SC9: listings by a set of ids."""
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'P'").select(F.concat(F.lit("P"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("place_id"))
    return listings(spark, sf_dir).select("place_id", "name", "phone", "rating").join(wanted, "place_id", "left_semi")


#: orders as a log of changes
_LOG_SQL = "SELECT o_orderkey AS id, o_custkey AS business, CASE o_orderkey % 5 WHEN 0 THEN 'rating' WHEN 1 THEN 'reviews_count' WHEN 2 THEN 'business_status' WHEN 3 THEN 'phone' ELSE 'website' END AS field, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS old_value, CAST(o_orderkey % 70 AS VARCHAR) AS new_value, CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderkey % 70 - o_orderkey % 50 AS DOUBLE) / 2 END AS delta, o_orderdate AS detected_at FROM orders"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    field = F.element_at(F.array(*[F.lit(f) for f in changes.TRACKED]), (k % 5 + 1).cast("int"))
    return o.select(k.alias("id"), F.col("o_custkey").alias("business"), field.alias("field"), F.when(k % 6 != 0, (k % 50).cast("string")).alias("old_value"), (k % 70).cast("string").alias("new_value"), F.when(k % 5 < 2, (k % 70 - k % 50).cast("double") / 2).alias("delta"), F.col("o_orderdate").alias("detected_at"))


@query(f"SELECT id, field, detected_at FROM ({_LOG_SQL}) WHERE business = 7 ORDER BY detected_at DESC, id DESC LIMIT 100")
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10, T1: the latest changes of a listing (a top-k report)."""
    return change_log(spark, sf_dir).filter("business = 7").orderBy(F.desc("detected_at"), F.desc("id")).limit(100).select("id", "field", "detected_at")


@query(f"SELECT business, count(*)::BIGINT AS changes, max(detected_at) AS latest FROM ({_LOG_SQL}) GROUP BY business")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11: changes kept by listing."""
    return change_log(spark, sf_dir).groupBy("business").agg(F.count(F.lit(1)).alias("changes"), F.max("detected_at").alias("latest"))


@query(f"""SELECT id, strftime(detected_at, '%Y-%m-%d %H:%M') || '  ' || CASE field WHEN 'reviews_count' THEN 'reviews' WHEN 'business_status' THEN 'status' ELSE field END || ' ' || coalesce(old_value, '(none)') || ' → ' || new_value
  || CASE WHEN delta IS NULL THEN '' ELSE ' (Δ ' || CASE WHEN delta > 0 THEN '+' ELSE '' END || CASE WHEN delta = floor(delta) THEN CAST(delta::BIGINT AS VARCHAR) ELSE CAST(delta AS VARCHAR) END || ')' END AS line FROM ({_LOG_SQL})""")
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: lines of a timeline."""
    c = F.col
    return change_log(spark, sf_dir).select("id", changes.timeline_line(c("detected_at"), c("field"), c("old_value"), c("new_value"), c("delta")).alias("line"))


@query(f"SELECT field, count(*)::BIGINT AS n FROM ({_LOG_SQL}) WHERE detected_at > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY GROUP BY field")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by field since 30 days before the last."""
    log = change_log(spark, sf_dir)
    last = log.agg(F.max("detected_at").alias("last"))
    return log.crossJoin(F.broadcast(last)).filter(F.col("detected_at") > F.col("last") - F.expr("interval 30 day")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))  # last: one row


@query(f"SELECT business, id, prev, value - prev AS step FROM (SELECT business, id, CAST(new_value AS BIGINT) AS value, lag(CAST(new_value AS BIGINT)) OVER (PARTITION BY business ORDER BY detected_at, id) AS prev FROM ({_LOG_SQL})) WHERE prev IS NOT NULL")
def history_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to the value before."""
    value = F.col("new_value").cast("bigint")
    prev = F.lag(value).over(Window.partitionBy("business").orderBy("detected_at", "id"))
    return change_log(spark, sf_dir).select("business", "id", value.alias("v"), prev.alias("prev")).filter("prev is not null").select("business", "id", "prev", (F.col("v") - F.col("prev")).alias("step"))


@query("""
WITH S AS (SELECT 0 AS origin, k AS seq, CASE WHEN k % 3 = 0 THEN place_id ELSE '' END AS place_id, name, address FROM L WHERE k % 2 = 0 UNION ALL SELECT 1, k, CASE WHEN k % 3 = 0 THEN place_id ELSE '' END, CASE WHEN k % 8 = 0 THEN NULL ELSE name END, CASE WHEN k % 8 = 0 THEN NULL ELSE address END FROM L),
K AS (SELECT *, CASE WHEN place_id <> '' THEN 'pid:' || place_id WHEN coalesce(name, '') || coalesce(address, '') <> '' THEN 'h:' || sha1(coalesce(name, '') || '|' || coalesce(address, '') || '||')[1:16] END AS key FROM S)
SELECT key, origin, seq FROM K QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY origin, seq) = 1
""")
def checkpoint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and fresh rows, each key once; rows without a key all stay."""
    d, k = listings(spark, sf_dir), F.col("k")
    own = F.when(k % 3 == 0, F.col("place_id")).otherwise("")
    none = F.lit(None).cast("string")
    keyed = lambda x: x.withColumn("key", changes.dedup_key(F.col("pid"), F.col("name"), F.col("address"), none, none)).select("key", "seq")
    saved = d.filter("k % 2 = 0").select(own.alias("pid"), "name", "address", k.alias("seq"))
    fresh = d.select(own.alias("pid"), F.when(k % 8 != 0, F.col("name")).alias("name"), F.when(k % 8 != 0, F.col("address")).alias("address"), k.alias("seq"))
    return changes.union_first_seen(keyed(saved), keyed(fresh)).select("key", "origin", "seq")


_RUN_SQL = "SELECT k AS id, place_id, CASE WHEN k % 3 = 0 THEN 'plumber' ELSE 'cafe' END AS query, 'City ' || (k % 4) AS location FROM L"


@query(f"SELECT * FROM ({_RUN_SQL}) WHERE query = 'cafe' AND location = 'City 2'")
def run_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7: the stored listings of a search."""
    k = F.col("k")
    return changes.for_run(listings(spark, sf_dir).select(k.alias("id"), "place_id", F.when(k % 3 == 0, "plumber").otherwise("cafe").alias("query"), F.concat(F.lit("City "), (k % 4).cast("string")).alias("location")), "cafe", "City 2")


@query("SELECT o_orderkey AS id, floor((epoch(TIMESTAMP '1998-12-01 12:00:00') - epoch(v::TIMESTAMP)) / 86400)::BIGINT AS age_days, coalesce(floor((epoch(TIMESTAMP '1998-12-01 12:00:00') - epoch(v::TIMESTAMP)) / 86400) > 365, true) AS stale FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS v FROM orders)")
def rule_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of rule sets (orders stand for them), and which are stale."""
    verified, now = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).cast("timestamp"), F.lit("1998-12-01 12:00:00").cast("timestamp")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), changes.rule_age_days(verified, now).alias("age_days"), changes.is_stale(verified, now, 365).alias("stale"))
