"""Queries of the card and detail parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core, parsers
from ..sources.listings import listings
from .registry import query

_TRACK = parsers.TRACKING


def clean_url_sql(u: str) -> str:
    rest = f"regexp_replace({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"
    head = f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    # without look-ahead: a parameter with its &, then one at the end
    cut = f"regexp_replace(regexp_replace({rest}, '([?&])(?:(?:{_TRACK})(?:=[^&#]*)?&)+', '\\1', 'g'), '[?&](?:{_TRACK})(?:=[^&#]*)?(#|$)', '\\1')"
    cut = f"regexp_replace({cut}, '[?&](#|$)', '\\1')"
    return f"(CASE WHEN {u} = '' THEN NULL WHEN {head} = '' THEN {u} ELSE lower({head}) || CASE WHEN {cut} = '/' THEN '' ELSE {cut} END END)"


@query("""
SELECT place_id, CASE WHEN v BETWEEN 0 AND 5 THEN v END AS rating, rc AS reviews, nullif(regexp_extract(price, '(\\${1,4})', 1), '') AS price_level
FROM (SELECT place_id, TRY_CAST(nullif(regexp_extract(raw, '([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS v,
        TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace(cnt, '[(),]', '', 'g'), '(?i)reviews?', ''), '([0-9]+)', 1), '') AS BIGINT) AS rc, price
      FROM (SELECT place_id, 'Rated ' || CAST(CASE WHEN k % 7 = 0 THEN rating + 2 ELSE rating END AS VARCHAR) || ' stars' AS raw,
              '(' || CAST(reviews_count // 1000 AS VARCHAR) || ',' || lpad(CAST(reviews_count % 1000 AS VARCHAR), 3, '0') || ') Reviews' AS cnt,
              'Cheap ' || repeat('$', CAST(k % 6 AS INTEGER)) || ' food' AS price FROM L))
""")
def parse_card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating, review count, price level from decorated text."""
    raw = listings(spark, sf_dir).select(
        "place_id",
        F.concat(F.lit("Rated "), F.when(F.col("k") % 7 == 0, F.col("rating") + 2).otherwise(F.col("rating")).cast("string"), F.lit(" stars")).alias("raw"),
        F.concat(F.lit("("), F.floor(F.col("reviews_count") / 1000).cast("string"), F.lit(","), F.lpad((F.col("reviews_count") % 1000).cast("string"), 3, "0"), F.lit(") Reviews")).alias("cnt"),
        F.concat(F.lit("Cheap "), F.repeat(F.lit("$"), (F.col("k") % 6).cast("int")), F.lit(" food")).alias("price"),
    )
    return raw.select("place_id", parsers.rating(F.col("raw")).alias("rating"), parsers.reviews_count(F.col("cnt")).alias("reviews"), parsers.price_level(F.col("price")).alias("price_level"))


@query("""
SELECT k, coalesce(url_decode(nullif(regexp_extract(u, '[?&]place_id=([^&]+)', 1), '')), nullif(regexp_extract(u, '(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)', 1), ''), nullif(regexp_extract(u, '(ChIJ[A-Za-z0-9_-]{10,})', 1), '')) AS parsed_id,
       nullif(regexp_extract(p, '([2-9CFGHJMPQRVWX0]{4,8}\\+[2-9CFGHJMPQRVWX0]{2,3})', 1), '') AS plus_code
FROM (SELECT k, CASE k % 4 WHEN 0 THEN 'https://m.example/?q=1&place_id=ab%20c' || CAST(k AS VARCHAR) WHEN 1 THEN 'https://m.example/data=0x1a2b:0x' || CAST(k AS VARCHAR) WHEN 2 THEN 'x/ChIJabcdefghij' || CAST(k AS VARCHAR) ELSE 'none' END AS u,
             CASE WHEN k % 3 = 0 THEN '87G8' || CAST(2 + k % 8 AS VARCHAR) || 'CFG+2X, Town' ELSE 'no code' END AS p FROM L)
""")
def parse_place_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place id from URLs, plus code."""
    k, kk = F.col("k") % 4, F.col("k").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://m.example/?q=1&place_id=ab%20c"), kk)).when(k == 1, F.concat(F.lit("https://m.example/data=0x1a2b:0x"), kk)).when(k == 2, F.concat(F.lit("x/ChIJabcdefghij"), kk)).otherwise("none")
    plus = F.when(F.col("k") % 3 == 0, F.concat(F.lit("87G8"), (2 + F.col("k") % 8).cast("string"), F.lit("CFG+2X, Town"))).otherwise("no code")
    return listings(spark, sf_dir).select("k", parsers.place_id(url).alias("parsed_id"), parsers.plus_code(plus).alias("plus_code"))


@query("""
SELECT o_orderkey, CASE WHEN low LIKE '%open now%' OR (low LIKE 'open%' AND low NOT LIKE 'opens%' AND low NOT LIKE '%hours%') THEN true WHEN low LIKE '%closed%' OR low LIKE 'opens%' THEN false END AS open_now,
       CASE WHEN low LIKE '%permanently closed%' THEN 'permanently_closed' WHEN low LIKE '%temporarily closed%' THEN 'temporarily_closed' ELSE 'open' END AS business_status,
       regexp_matches(o_orderpriority, '(?i)urgent|^5-low$') AS sponsored
FROM (SELECT *, lower(CASE o_orderstatus WHEN 'F' THEN 'Permanently closed' WHEN 'P' THEN 'Opens 3 PM' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Open - Closes 10 PM' WHEN o_orderkey % 3 = 1 THEN 'Temporarily closed' ELSE 'See hours' END END) AS low FROM orders)
""")
def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open now, business status, sponsored mark."""
    k = F.col("o_orderkey") % 3
    card = F.when(F.col("o_orderstatus") == "F", "Permanently closed").when(F.col("o_orderstatus") == "P", "Opens 3 PM").otherwise(F.when(k == 0, "Open - Closes 10 PM").when(k == 1, "Temporarily closed").otherwise("See hours"))
    mark = F.when(F.col("o_orderpriority").rlike("(?i)urgent|^5-low$"), "Sponsored").otherwise("plain")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", parsers.open_now(card).alias("open_now"), parsers.business_status(card).alias("business_status"), parsers.sponsored(mark, F.lit(None).cast("string")).alias("sponsored"))


@query("""
SELECT status, count(*) AS n, count(*) FILTER (WHERE status <> 'open') AS n_closed FROM (
  SELECT CASE WHEN lower(status_text) LIKE '%permanently closed%' THEN 'permanently_closed' WHEN lower(status_text) LIKE '%temporarily closed%' THEN 'temporarily_closed' ELSE 'open' END AS status FROM L) GROUP BY status
""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by status."""
    status = parsers.business_status(F.col("status_text"))
    return listings(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(status != "open").alias("n_closed"))


@query(f"""
SELECT page_id, {clean_url_sql('url')} AS clean, CASE WHEN url LIKE '%instagram.com%' THEN 'instagram' WHEN url LIKE '%x.com%' THEN 'twitter' ELSE 'other' END AS platform,
       CASE WHEN page_id % 2 = 0 THEN 'https://maps.example/rel/' || CAST(page_id AS VARCHAR) ELSE 'https://cdn.example/' || CAST(page_id AS VARCHAR) END AS absolute FROM pages
""")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tracking parameters off, relative URLs made absolute, social platform."""
    pid = F.col("page_id").cast("string")
    relative = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/rel/"), pid)).otherwise(F.concat(F.lit("//cdn.example/"), pid))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", parsers.clean_website(F.col("url")).alias("clean"), parsers.social_platform(F.col("url")).alias("platform"), parsers.absolute_url(relative, "https://maps.example").alias("absolute"))


@query("""
SELECT place_id, nullif(trim(regexp_replace(phone, '^(?i:tel:)', '')), '') AS cleaned, regexp_replace(trim(phone), '[0-9]', '9', 'g') AS signature FROM L
""")
def clean_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phone without its scheme; its digit pattern."""
    return listings(spark, sf_dir).select("place_id", parsers.clean_phone(F.col("phone")).alias("cleaned"), parsers.format_signature(F.col("phone")).alias("signature"))


@query("""
SELECT event_id, CASE dow WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' ELSE 'Saturday' END AS day, hour::INTEGER AS hour,
       CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 4 WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS level
FROM (SELECT event_id, event_type, dayofweek(ts) AS dow, hour(ts) AS hour FROM events)
""")
def parse_busy_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weekday alias, busy level and hour from labels made of event times."""
    day = F.concat(F.lower(F.date_format("ts", "E")), F.lit("."))
    level = F.create_map(*[F.lit(x) for x in ("click", "Usually busy", "view", "Usually very busy", "error", "Currently not too busy", "signup", "Usually not busy", "purchase", "quiet")])[F.col("event_type")]
    label = F.concat(level, F.lit(" at "), F.date_format("ts", "h a"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", parsers.normal_day(day).alias("day"), parsers.hour_of_label(label).alias("hour"), parsers.busy_level(label).alias("level"))


@query("""
SELECT place_id, CASE WHEN k % 5 = 0 THEN NULL ELSE 'Monday: 9-' || CAST(k % 12 AS VARCHAR) || CASE WHEN k % 5 = 1 THEN '' ELSE '; Fete: 10-2' END END AS hours,
       CASE WHEN k % 3 = 0 THEN NULL ELSE 'Friday 15/4 1/0' END AS busy FROM L
""")
def parse_hours_and_popular_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested opening hours and popular times, flattened for comparison (SK2)."""
    k = F.col("k")
    rows = F.array(
        F.struct(F.lit("mon.").alias("day"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" 9-"), (k % 12).cast("string"))).alias("text")),
        F.struct(F.lit("Fete").alias("day"), F.when(k % 5 > 1, "10-2").alias("text")),
    )
    bars = F.array(F.struct(F.lit(None).cast("int").alias("hour"), F.lit("3 PM very busy").alias("label")), F.struct(F.lit(None).cast("int").alias("hour"), F.lit("?").alias("label")))
    entries = F.array(F.struct(F.lit("FRI").alias("day"), F.when(k % 3 == 0, F.slice(bars, 1, 0)).otherwise(bars).alias("bars")))
    busy = F.transform(parsers.popular_times(entries), lambda d: F.concat_ws(" ", d["day"], F.transform(d["busy"], lambda b: F.concat(b["hour"].cast("string"), F.lit("/"), b["level"].cast("string")))))
    hours = F.transform(parsers.hours_table(rows), lambda r: F.concat(r["day"], F.lit(": "), r["hours"]))
    return listings(spark, sf_dir).select("place_id", F.when(hours.isNotNull(), F.array_join(hours, "; ")).alias("hours"), F.when(busy.isNotNull(), F.array_join(busy, "|")).alias("busy"))


@query("""
SELECT conv_id, turn, nullif(trim(role), '') AS author, CASE WHEN turn <= 5 THEN turn::DOUBLE END AS rating, nullif(trim(text, ' '), '') AS review_text FROM conversations
""")
def parse_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with trimmed fields and a rating in range."""
    made = parsers.review(F.concat(F.col("role"), F.lit(" ")), F.concat(F.col("turn").cast("string"), F.lit(" stars")), F.concat(F.lit(" "), F.col("text")), F.lit(None).cast("string"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", made.alias("r")).filter("r is not null").select("conv_id", "turn", F.col("r.author").alias("author"), F.col("r.rating").alias("rating"), F.col("r.text").alias("review_text"))


@query("""
SELECT place_id, 'facebook:https://fb.com/p' || CAST(k % 3 AS VARCHAR) || CASE WHEN k % 3 = 1 THEN '' ELSE '|facebook:https://fb.com/p1' END || '|instagram:https://instagram.com/a' AS socials FROM L
""")
def social_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct social profiles in the order of first sight."""
    page = lambda n: F.concat(F.lit("https://fb.com/p"), n.cast("string"))
    urls = F.array(page(F.col("k") % 3), page(F.lit(1)), F.lit(""), F.lit("https://instagram.com/a?utm_source=x"), F.lit("https://Instagram.com/a"))
    flat = F.transform(parsers.social_profiles(urls), lambda s: F.concat(s["platform"], F.lit(":"), s["url"]))
    return listings(spark, sf_dir).select("place_id", F.array_join(flat, "|").alias("socials"))


@query("""
SELECT place_id, CASE WHEN k % 2 = 0 THEN 'L' || CAST(k AS VARCHAR) ELSE 'D' || CAST(k AS VARCHAR) END AS phone, 'D' || CAST(k AS VARCHAR) AS hours, CASE WHEN k % 3 = 0 THEN 'C' ELSE 'B' END AS menu, k % 3 = 0 AS from_cache FROM L
""")
def merge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List values win for phone, details for the rest, cached values where there are some."""
    k = F.col("k").cast("string")
    base = listings(spark, sf_dir).select("place_id", "k", F.when(F.col("k") % 2 == 0, F.concat(F.lit("L"), k)).alias("list_phone"), F.lit("B").alias("menu"))
    detail = base.select("place_id", F.concat(F.lit("D"), k).alias("detail"), F.when(F.col("k") % 3 == 0, "C").alias("cached"))
    return base.join(detail, "place_id").select("place_id", F.coalesce("list_phone", "detail").alias("phone"), F.col("detail").alias("hours"), F.coalesce("cached", "menu").alias("menu"), F.col("cached").isNotNull().alias("from_cache"))


@query("""
SELECT k, least(1000.0 * pow(2, k % 12), 300000.0) AS wait_ms, TRY_CAST(CASE k % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'x' WHEN 2 THEN '7' ELSE NULL END AS DOUBLE) AS num,
       CAST(trunc(TRY_CAST(CASE k % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'x' WHEN 2 THEN '7' ELSE NULL END AS DOUBLE)) AS BIGINT) AS whole,
       CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS flag FROM L
""")
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P8, SC5, F22: lenient numbers, integers, booleans; capped exponential waits."""
    k = F.col("k") % 4
    raw = F.when(k == 0, "12.5").when(k == 1, "x").when(k == 2, "7")
    flag = F.when(k == 0, " Yes").when(k == 1, "0").when(k == 2, "maybe").otherwise("ON")
    return listings(spark, sf_dir).select("k", parsers.backoff_ms(F.col("k") % 12, 1000, 300000).alias("wait_ms"), core.to_number(raw).alias("num"), core.to_int(raw).alias("whole"), core.to_bool(flag).alias("flag"))
