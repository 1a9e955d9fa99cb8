"""Data-quality aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core, parsers
from ..sources.listings import listings
from .registry import query

CORE_FIELDS = ("name", "rating", "reviews_count", "address")
FIELDS = (*CORE_FIELDS, "price_level", "category", "phone", "website", "plus_code", "open_now", "business_status", "is_sponsored")
CORE_LIMIT, OTHER_LIMIT, LEAST_SAMPLE = 50.0, 30.0, 10


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the fields of a whole card."""
    k, status = F.col("k"), F.col("status_text")
    return listings(spark, sf_dir).select(
        "*", F.when(k % 4 != 0, F.expr("repeat('$', cast(k % 4 as int))")).alias("price_level"), F.when(k % 5 == 0, F.concat(F.lit("849V+"), k.cast("string"))).otherwise("").alias("plus_code"),
        F.when(status == "Open now", True).when(k % 3 == 0, False).alias("open_now"), F.when(status != "Open now", F.lower(status)).alias("business_status"), (k % 50 == 0).alias("is_sponsored"),
    )


_PROFILES = """(SELECT *, CASE WHEN k % 4 <> 0 THEN repeat('$', (k % 4)::INT) END AS price_level, CASE WHEN k % 5 = 0 THEN '849V+' || k ELSE '' END AS plus_code,
  CASE WHEN status_text = 'Open now' THEN true WHEN k % 3 = 0 THEN false END AS open_now, CASE WHEN status_text <> 'Open now' THEN lower(status_text) END AS business_status, k % 50 = 0 AS is_sponsored FROM L)"""


def fill_rates(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A3: filled, total and rate (one decimal) by field; warns under 80. One pass, then an unpivot of one row."""
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(core.filled(F.col(f))).alias(f) for f in fields])
    long = row.unpivot("total", list(fields), "field", "filled")
    rate = F.when(F.col("total") > 0, core.half_up(F.col("filled") * 100.0 / F.col("total"), 1)).otherwise(0.0)
    return long.select("field", "filled", "total", rate.alias("rate"), (rate < 80).alias("warn"))


def fill_health(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A4: fields under their limit, if the sample is large enough; A33 aborts when a core field is among them."""
    rates = fill_rates(df, fields)
    is_core = F.col("field").isin(*CORE_FIELDS)
    bad = (F.col("total") >= LEAST_SAMPLE) & (F.col("rate") < F.when(is_core, CORE_LIMIT).otherwise(OTHER_LIMIT))
    return rates.select("field", "rate", is_core.alias("is_core"), F.when(bad & is_core, "abort").when(bad, "degraded").otherwise("ok").alias("health"))


def abort_if_unhealthy(df: DataFrame) -> None:
    """Raise if a core field fails; reads one row per field."""
    bad = [r["field"] for r in fill_health(df).filter("health = 'abort'").collect()]
    if bad:
        raise ValueError(f"core fields hardly filled: {', '.join(sorted(bad))}")


_RATES = "SELECT field, filled, total, floor(filled * 100.0 / total * 10 + 0.5) / 10 AS rate FROM (SELECT field, count(v) FILTER (WHERE v <> '')::BIGINT AS filled, count(*)::BIGINT AS total FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS v FROM {_PROFILES}" for f in ("name", "rating", "reviews_count", "address", "price_level", "category", "phone", "website", "plus_code", "open_now", "business_status", "is_sponsored")) + ") GROUP BY field)"


@query(f"SELECT *, rate < 80 AS warn FROM ({_RATES}) WHERE EXISTS (SELECT 1 FROM L )", "fill_rates")
def _fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_rates(profiles(spark, sf_dir))


@query(f"SELECT field, rate, field IN ('name', 'rating', 'reviews_count', 'address') AS is_core, CASE WHEN total >= 10 AND field IN ('name', 'rating', 'reviews_count', 'address') AND rate < 50 THEN 'abort' WHEN total >= 10 AND field NOT IN ('name', 'rating', 'reviews_count', 'address') AND rate < 30 THEN 'degraded' ELSE 'ok' END AS health FROM ({_RATES}) WHERE EXISTS (SELECT 1 FROM L )", "fill_health")
def _fill_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_health(profiles(spark, sf_dir))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, core.half_up(part * 100.0 / whole, 1)).otherwise(0.0)


@query("""
WITH n AS (SELECT *, regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]', '', 'g'), '(co|inc|llc|ltd|the)$', '') AS plain FROM L),
d AS (SELECT coalesce(sum(c - 1), 0)::BIGINT AS dup FROM (SELECT count(*) AS c FROM n WHERE plain <> '' OR coalesce(phone, '') <> '' GROUP BY plain, coalesce(trim(phone), ''))),
p AS (SELECT *, list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM L),
f AS (SELECT *, trim(address) <> '' AS has, len(parts) + regexp_matches(address, '(?i)\\b[a-z0-9]{3,10}\\s*[a-z0-9]{0,6}\\b')::INT + regexp_matches(address, '(?i)\\b\\d+\\s+[a-z]')::INT >= 3 AS is_full FROM p)
SELECT count(*)::BIGINT AS total, count(DISTINCT nullif(regexp_replace(trim(phone), '[0-9]', '9', 'g'), ''))::BIGINT AS phone_formats, count(*) FILTER (WHERE has)::BIGINT AS with_address, count(*) FILTER (WHERE has AND is_full)::BIGINT AS full_address,
       count(*) FILTER (WHERE has AND NOT is_full)::BIGINT AS partial_address, floor(count(*) FILTER (WHERE has AND is_full) * 100.0 / count(*) * 10 + 0.5) / 10 AS full_pct, (SELECT dup FROM d) AS duplicates, floor((SELECT dup FROM d) * 100.0 / count(*) * 10 + 0.5) / 10 AS duplicate_pct,
       floor(count(*) FILTER (WHERE regexp_matches(website, '(?i)^https?://')) * 100.0 / count(*) * 10 + 0.5) / 10 AS website_pct FROM f
""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone formats, address completeness, exact duplicates, share with a website; one row."""
    rows = listings(spark, sf_dir)
    plain, phone = parsers.plain_name(F.col("name")), F.coalesce(F.trim("phone"), F.lit(""))
    repeats = rows.select(plain.alias("plain"), phone.alias("phone")).filter((F.col("plain") != "") | (F.col("phone") != "")).groupBy("plain", "phone").agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("dup"))
    has, full = F.trim("address") != "", parsers.address_is_full(F.col("address"))
    whole = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(core.text_or_null(parsers.format_signature(F.col("phone")))).alias("phone_formats"),
        F.count_if(has).alias("with_address"),
        F.count_if(has & full).alias("full_address"),
        F.count_if(has & ~full).alias("partial_address"),
        F.count_if(F.col("website").rlike("(?i)^https?://")).alias("n_web"),
    )
    joined = whole.crossJoin(F.broadcast(repeats))  # one row each
    pct = lambda part, name: _pct(F.col(part), F.col("total")).alias(name)
    return joined.select("total", "phone_formats", "with_address", "full_address", "partial_address", pct("full_address", "full_pct"), F.col("dup").alias("duplicates"), pct("dup", "duplicate_pct"), pct("n_web", "website_pct"))


@query("""
SELECT coalesce(liveness, 'unknown') AS liveness, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN k % 5 = 0 THEN 'redirected' WHEN st IS NULL THEN 'error' WHEN st BETWEEN 200 AND 399 THEN 'live' WHEN st BETWEEN 400 AND 599 THEN 'dead' ELSE 'error' END AS liveness
  FROM (SELECT k, CASE k % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 600 END AS st FROM L WHERE website IS NOT NULL)) GROUP BY 1
""")
def website_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liveness of given status codes (a redirect comes before the code)."""
    from ..operators.web import liveness

    k = F.col("k")
    code = F.when(k % 4 == 0, 200).when(k % 4 == 1, 404).when(k % 4 == 2, 600)
    rows = listings(spark, sf_dir).filter("website is not null")
    return rows.groupBy(liveness(code, k % 5 == 0).alias("liveness")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE status_text = 'Open now')::BIGINT AS open, count(*) FILTER (WHERE status_text = 'Permanently closed')::BIGINT AS closed, floor(avg(rating) * 100 + 0.5) / 100 AS avg_rating, sum(reviews_count)::BIGINT AS reviews,
       'listings=' || CAST(count(*) AS VARCHAR) || ' rated=' || CAST(count(rating) AS VARCHAR) AS line FROM L
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's summary, and its line of text."""
    return listings(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status_text") == "Open now").alias("open"), F.count_if(F.col("status_text") == "Permanently closed").alias("closed"), core.half_up(F.avg("rating"), 2).alias("avg_rating"),
        F.sum("reviews_count").alias("reviews"), F.concat(F.lit("listings="), F.count(F.lit(1)).cast("string"), F.lit(" rated="), F.count("rating").cast("string")).alias("line"),
    )
