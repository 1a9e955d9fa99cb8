"""SK19: the tables of the store, made by an ordered list of statements that can be run again."""

from __future__ import annotations

from pyspark.sql import SparkSession

LISTING_COLUMNS = """place_id STRING, name STRING, rating DOUBLE, reviews_count BIGINT, price_level STRING, category STRING, address STRING, phone STRING, website STRING, maps_url STRING, plus_code STRING,
 open_now BOOLEAN, business_status STRING, is_sponsored BOOLEAN, scraped_at TIMESTAMP, query STRING, location STRING, reservation_url STRING, menu_url STRING, detail_scraped BOOLEAN, latitude DOUBLE, longitude DOUBLE,
 full_hours MAP<STRING, STRING>, popular_times MAP<STRING, ARRAY<INT>>, top_reviews ARRAY<STRUCT<author: STRING, rating: DOUBLE, text: STRING>>, photos ARRAY<STRING>, social_profiles MAP<STRING, STRING>, row_hash STRING"""

#: In order; a statement is never changed once it is here, new ones come after it.
STATEMENTS = (
    f"CREATE TABLE IF NOT EXISTS {{schema}}.businesses ({LISTING_COLUMNS}) USING parquet",
    f"CREATE TABLE IF NOT EXISTS {{schema}}.snapshots (run_id BIGINT, taken_at TIMESTAMP, {LISTING_COLUMNS}) USING parquet PARTITIONED BY (run_id)",
    "CREATE TABLE IF NOT EXISTS {schema}.field_changes (place_id STRING, run_id BIGINT, field STRING, old_value STRING, new_value STRING, delta DOUBLE, detected_at TIMESTAMP) USING parquet",
    "CREATE TABLE IF NOT EXISTS {schema}.runs (run_id BIGINT, query STRING, location STRING, started_at TIMESTAMP, finished_at TIMESTAMP, inserted BIGINT, updated BIGINT, unchanged BIGINT) USING parquet",
    "CREATE TABLE IF NOT EXISTS {schema}.duplicates (primary_id STRING, duplicate_id STRING, similarity DOUBLE, run_id BIGINT) USING parquet",
)


def migrate(spark: SparkSession, schema: str = "listings_store", statements: tuple[str, ...] = STATEMENTS) -> list[str]:
    """Run all statements in order; tables that are there already stay as they are. Returns the names of the schema's tables."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for statement in statements:
        spark.sql(statement.format(schema=schema))
    return sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary)
