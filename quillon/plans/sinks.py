"""Queries of sinks and sources (SK1-SK6, SK14, SC1, SC3, SC12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources import files
from ..sources.listings import listings
from .registry import query

_COLUMNS = ("place_id", "name", "rating", "reviews_count", "address", "website", "full_hours", "social_profiles", "photos", "top_reviews")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("k"), F.col("k").cast("string")
    hours = F.array(F.struct(F.lit("Monday").alias("day"), F.concat(F.lit("9-"), n).alias("hours")), F.struct(F.lit("").alias("day"), F.lit("x").alias("hours")), F.struct(F.lit("Friday").alias("day"), F.lit(None).cast("string").alias("hours")))
    social = F.array(F.struct(F.lit(None).cast("string").alias("platform"), F.lit("http://x,y").alias("url")), F.struct(F.lit("facebook").alias("platform"), F.lit("").alias("url")))
    name = F.when(k % 3 == 0, F.concat(F.col("name"), F.lit(' "The, Best"'))).otherwise(F.col("name"))
    return listings(spark, sf_dir).select("place_id", name.alias("name"), "rating", "reviews_count", "address", "website", hours.alias("full_hours"), social.alias("social_profiles"), F.array(F.lit("a"), F.lit(""), F.lit("b")).alias("photos"), F.array().cast("array<string>").alias("top_reviews"), "k")


_Q = lambda x: f"CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


@query(f"""SELECT array_to_string([place_id, {_Q('nm')}, coalesce(CAST(rating AS VARCHAR), ''), coalesce(CAST(reviews_count AS VARCHAR), ''), {_Q("coalesce(address, '')")}, {_Q("coalesce(website, '')")}, 'Monday: 9-' || CAST(k AS VARCHAR) || '; Friday:', '"other:http://x,y"', 'a|b', ''], ',') AS line
FROM (SELECT *, coalesce(CASE WHEN k % 3 = 0 THEN name || ' "The, Best"' ELSE name END, '') AS nm FROM L )""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1-SK4: lines of a CSV file."""
    return files.csv_lines(_nested(spark, sf_dir), _COLUMNS)


@query("SELECT place_id, nm AS name, rating, reviews_count FROM (SELECT *, CASE WHEN k % 3 = 0 THEN name || ' \"The, Best\"' ELSE name END AS nm FROM L )")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK4, SK5, SC3: what was written as CSV, read again."""
    import uuid

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(_nested(spark, sf_dir), path, _COLUMNS)
    got = spark.read.schema(", ".join(f"c{i} string" for i in range(len(_COLUMNS)))).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)
    c = F.col
    body = got.filter(~c("c0").rlike("^﻿?Place ID$"))
    return body.select(c("c0").alias("place_id"), c("c1").alias("name"), c("c2").try_cast("double").alias("rating"), c("c3").try_cast("bigint").alias("reviews_count"))


@query("SELECT place_id, name, rating FROM L")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC2, SK5, SC13, SK16: written as JSON and behind a pointer, read again."""
    import uuid

    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    files.write_json(listings(spark, sf_dir).select("place_id", "name", "rating"), path, {"kind": "listings"})
    back = spark.read.schema(files.LISTING).json(f"{path}/businesses").select("place_id", "name", "rating")
    files.replace_folder(back, f"{path}/table")
    return files.read_current(spark, f"{path}/table")


@query("SELECT o_orderkey, regexp_replace(o_orderpriority, '[^a-zA-Z0-9_-]+', '_', 'g')[1:40] || '_' || CASE WHEN o_orderkey % 2 = 0 THEN 'run' ELSE 'New_York' END || '_' || strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') AS name FROM orders")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK6: names of outputs."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", files.base_name(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 1, "New York"), F.col("o_orderdate")).alias("name"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k, 'Monday' AS day FROM events")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12: JSON text to nested columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = files.parse_nested(F.lit('[{"day": "Monday", "hours": "9-5"}]'), "full_hours")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get(hours, F.lit(0))["day"].alias("day"))


@query("SELECT (SELECT max(o_orderkey) FROM orders) + 1 AS id, count(*)::BIGINT AS extracted, count(*) FILTER (WHERE rating IS NULL)::BIGINT AS failed, 0 AS exit_code FROM L")
def run_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK14: a run's row, with the next id."""
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").agg((F.max("o_orderkey") + 1).alias("id"))
    made = listings(spark, sf_dir).agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("rating").isNull()).alias("failed"))
    return runs.crossJoin(F.broadcast(made)).select("id", "extracted", "failed", F.lit(0).alias("exit_code"))  # one row each
