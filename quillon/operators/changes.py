"""Change data capture and incremental decisions (C1-C18, J1-J3, SK7-SK11, U1-U3, A1, A2, A23, SC6-SC8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import half_up, ladder

TRACKED = ("rating", "reviews_count", "business_status", "phone", "website")
#: C4: what a list shows of a row; C3 adds its key, its details and its place. When it was seen and what was derived from it isn't hashed.
LISTED = ("name", "rating", "reviews_count", "price_level", "category", "address", "phone", "website", "maps_url", "plus_code", "open_now", "business_status", "is_sponsored", "query", "location")
DETAILS = ("reservation_url", "menu_url", "detail_scraped", "latitude", "longitude", "full_hours", "popular_times", "top_reviews", "photos", "social_profiles")
HASHED = ("place_id", *LISTED, *DETAILS)
LIST_DAYS, DETAIL_DAYS, REVIEW_JUMP = 1, 7, 10.0


def canonical(df: DataFrame, name: str) -> Column:
    """A column as text; '' is null, nested values are JSON with sorted map keys, coordinates have seven decimals."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col))))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(col)
    if name in ("latitude", "longitude"):
        return col.cast("decimal(10,7)").cast("string")
    text = col.cast("string")
    return F.when(text != "", text)


def row_hash(df: DataFrame, columns: tuple[str, ...] = HASHED) -> Column:
    """SHA-256 over name=value of the columns that df has, in order."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(canonical(df, c), F.lit("null"))) for c in columns if c in df.columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def first_of_key(df: DataFrame, key: str = "place_id", order: str = "seq") -> DataFrame:
    """A batch's first row of each key (a repeated key counts once)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def actions(existing: DataFrame, incoming: DataFrame, columns: tuple[str, ...] = HASHED) -> DataFrame:
    """Incoming and row_hash, action. One join on the key; existing has place_id and row_hash, null when never hashed (then updated)."""
    hashed = incoming.withColumn("row_hash", row_hash(incoming, columns))
    old = existing.select("place_id", F.col("row_hash").alias("_old"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("row_hash")), "unchanged").otherwise("updated")
    return hashed.join(old, "place_id", "left").withColumn("action", action).drop("_old", "_there")


def number(x: Column) -> Column:
    value = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def delta(old: Column, new: Column) -> Column:
    """New less old to one decimal; the new value where there was none; null if either isn't a number."""
    o, n = number(old), number(new)
    empty = old.isNull() | (old.cast("string") == "")
    return F.when(empty, n).otherwise(half_up(n - o, 1))


def field_changes(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """C6, C9, SK11: a row (place_id, field, old_value, new_value, delta) for each tracked field that differs; null and '' are equal."""
    met = old.select("place_id", *[F.col(f).alias(f"o_{f}") for f in fields]).join(new.select("place_id", *[F.col(f).alias(f"n_{f}") for f in fields]), "place_id")
    text = lambda c: F.when(c.cast("string") != "", c.cast("string"))
    rows = [
        F.when(~text(F.col(f"o_{f}")).eqNullSafe(text(F.col(f"n_{f}"))), F.struct(F.lit(f).alias("field"), text(F.col(f"o_{f}")).alias("old_value"), text(F.col(f"n_{f}")).alias("new_value"), delta(F.col(f"o_{f}"), F.col(f"n_{f}")).alias("delta")))
        for f in fields
    ]
    return met.select("place_id", F.inline(F.array_compact(F.array(*rows))))


def change_summary(changes: DataFrame, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """A1: changes by field, zero for fields without any, in one row, with the total."""
    return changes.agg(*[F.count_if(F.col("field") == f).alias(f) for f in fields], F.count_if(F.col("field").isin(*fields)).alias("total"))


def snapshots(old: DataFrame, acted: DataFrame, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """SK10: the old tracked values of the rows to be updated."""
    return old.join(acted.filter("action = 'updated'").select("place_id"), "place_id", "left_semi").select("place_id", *fields)


def merged(old: DataFrame, acted: DataFrame, kept_if_null: tuple[str, ...] = ("last_detail",)) -> DataFrame:
    """SK7-SK9: the state after the batch: inserted and updated rows as they came, unchanged ones with newer times only, others as they were."""
    columns = [c for c in old.columns if c != "place_id"]
    o, n = old.select("place_id", F.struct(*columns).alias("o")), acted.select("place_id", F.col("action"), F.struct(*columns).alias("n"))
    met = o.join(n, "place_id", "full_outer")
    times = ("last_list", *kept_if_null)

    def value(c: str) -> Column:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        take = F.coalesce(now, was) if c in times else now
        return F.when(F.col("action").isNull(), was).when((F.col("action") == "unchanged") & F.lit(c not in times), was).otherwise(take).alias(c)

    return met.select("place_id", *[value(c) for c in columns], F.coalesce("action", F.lit("kept")).alias("action"))


def age_days(at: Column, now: Column) -> Column:
    """Days, at least 0; null without a time."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000.0)


def list_freshness(there: Column, age: Column, days: float = LIST_DAYS) -> Column:
    return ladder([(~there, "new"), (age.isNull(), "stale"), (age <= days, "fresh")], "stale")


def list_action(freshness: Column, same: Column) -> Column:
    """C16."""
    return F.when(freshness != "fresh", freshness).when(same, "fresh_unchanged").otherwise("fresh_changed")


def review_jump(old: Column, new: Column) -> Column:
    """C14: change in percent; from nothing to something is 1000."""
    o, n = number(old), number(new)
    return F.when(o == 0, F.when(n > 0, 1000.0).otherwise(0.0)).otherwise((n - o) / F.abs(o) * 100)


def detail_decision(there: Column, age: Column, jump: Column, days: float = DETAIL_DAYS, limit: float = REVIEW_JUMP, no_cache: bool = False) -> Column:
    """no_cache, forced_refresh (before the age is looked at), cache_miss or cache_hit."""
    return ladder([(F.lit(no_cache) | ~there | age.isNull(), "no_cache"), (jump > limit, "forced_refresh"), (age > days, "cache_miss")], "cache_hit")


def cache_stats(df: DataFrame) -> DataFrame:
    """Counts of list actions and detail decisions, and what was saved: a request a fresh row, three requests and four seconds a hit."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    hits, skipped = is_("detail_action", "cache_hit"), is_("list_action", "fresh_unchanged")
    return df.agg(
        is_("list_action", "new").alias("list_new"), skipped.alias("list_skipped"), is_("list_action", "stale").alias("list_stale"), is_("list_action", "fresh_changed").alias("list_changed"), hits.alias("detail_hits"),
        is_("detail_action", "cache_miss").alias("detail_misses"), is_("detail_action", "forced_refresh").alias("detail_forced"), is_("detail_action", "no_cache").alias("detail_no_cache"), (skipped + hits * 3).alias("requests_saved"), (hits * 4).alias("seconds_saved"),
    )


def preflight(df: DataFrame, now: Column, days: float = LIST_DAYS) -> DataFrame:
    """SC8: by query: rows, newest list time, and whether the run can be skipped."""
    g = df.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("last_list").alias("newest"))
    return g.select("query", "n", "newest", F.coalesce(age_days(F.col("newest"), now) <= days, F.lit(False)).alias("skip"))


def dedup_key(place_id: Column, *parts: Column) -> Column:
    """The id, else a hash of name, address, phone and address on the web, else null (never a duplicate)."""
    text = [F.coalesce(p, F.lit("")) for p in parts]
    body = F.concat_ws("|", *text)
    return F.when(place_id != "", F.concat(F.lit("pid:"), place_id)).when(F.regexp_replace(body, r"\|", "") != "", F.concat(F.lit("h:"), F.substring(F.sha1(body), 1, 16)))


def union_first_seen(*frames: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Rows of all frames, of each key the one of the first frame, then of the least order; rows without a key all stay."""
    rows = None
    for k, frame in enumerate(frames):
        one = frame.withColumn("_source", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy(key).orderBy("_source", order)
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return keyed.unionByName(rows.filter(F.col(key).isNull())).withColumnRenamed("_source", "origin")


def timeline_line(at: Column, field: Column, old: Column, new: Column, change: Column) -> Column:
    """C17: time, label, old and new value, change with its sign."""
    label = F.when(field == "reviews_count", "reviews").when(field == "business_status", "status").otherwise(field)
    shown = F.when(change == F.floor(change), F.floor(change).cast("string")).otherwise(change.cast("string"))
    tail = F.when(change.isNull(), "").otherwise(F.concat(F.lit(" (Δ "), F.when(change > 0, "+").otherwise(""), shown, F.lit(")")))
    value = lambda x: F.coalesce(x, F.lit("(none)"))
    return F.concat(F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("----")), F.lit("  "), label, F.lit(" "), value(old), F.lit(" → "), value(new), tail)


def for_run(df: DataFrame, query: str, location: str, order: str = "id") -> DataFrame:
    """SC7: the stored rows of a search, by id."""
    return df.filter((F.col("query") == query) & (F.col("location") == location)).orderBy(order)


def rule_age_days(verified: Column, now: Column) -> Column:
    """Whole days since a set of rules was verified; null if it never was."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(verified)) / 86400).cast("bigint")


def is_stale(verified: Column, now: Column, most_days: int = 30) -> Column:
    """Older than most_days; one that never was verified is stale."""
    return F.coalesce(rule_age_days(verified, now) > most_days, F.lit(True))
