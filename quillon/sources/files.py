"""Sources and sinks (SC1-SC5, SC12, SC13, SK1-SK6, SK16-SK18): listings as JSON, jobs as CSV, results as CSV and JSON."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import to_bool, to_int

#: columns of a listing and their types
FIELDS = {
    **dict.fromkeys("place_id name price_level category address phone website maps_url plus_code business_status scraped_at query location reservation_url menu_url".split(), "string"),
    **dict.fromkeys("rating latitude longitude".split(), "double"),
    **dict.fromkeys("open_now is_sponsored detail_scraped".split(), "boolean"),
    "reviews_count": "bigint",
    "full_hours": "array<struct<day:string,hours:string>>",
    "popular_times": "array<struct<day:string,busy:array<struct<hour:int,level:int,label:string>>>>",
    "top_reviews": "array<struct<author:string,rating:double,text:string,date:string>>",
    "photos": "array<string>",
    "social_profiles": "array<struct<platform:string,url:string>>",
}
LISTING = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
CSV_COLUMNS = tuple(
    "name rating reviews_count price_level category address phone website maps_url place_id plus_code open_now business_status is_sponsored scraped_at query location full_hours popular_times top_reviews photos reservation_url menu_url social_profiles detail_scraped".split()
)


def read_listings(spark: SparkSession, *paths: str) -> DataFrame:
    """SC1, SC2: JSON files, each an array of listings or an object with them in `businesses`. Never inferred; what doesn't fit is null."""
    wrapped = f"{LISTING}, businesses array<struct<{', '.join(f'{n}:{t}' for n, t in FIELDS.items())}>>"
    raw = spark.read.schema(wrapped).option("multiLine", True).option("mode", "PERMISSIVE").json(list(paths))
    flat = raw.filter("businesses is null").drop("businesses").filter(F.coalesce(*[F.col(c).cast("string") for c in ("place_id", "name", "address", "phone", "website")]).isNotNull())
    return flat.unionByName(raw.filter("businesses is not null").select(F.inline("businesses")))


def read_job_csv(spark: SparkSession, path: str) -> DataFrame:
    """SC3-SC5: query, location, max_results, deep_scrape, priority from a CSV of jobs; '#' begins a comment, names of columns in any case; a row with fewer than two fields keeps an error."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    first = lines.limit(1).head()
    if first is None:
        return spark.createDataFrame([], "query string, location string, max_results bigint, deep_scrape boolean, priority bigint, error string")
    header = [h.strip().strip('"').lower().replace("_", "") for h in first["value"].split(",")]
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    body = lines.filter(F.col("value") != first["value"])
    got = body.select("value", F.from_csv("value", schema, {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))

    def at(name: str) -> Column:
        return F.trim(F.col(f"r.c{header.index(name)}")) if name in header else F.lit(None).cast("string")

    few = F.when(F.coalesce(F.trim(F.col("r.c1")) if len(header) > 1 else F.lit(None), F.lit("")) == "", "fewer than two fields")
    return got.select(at("query").alias("query"), at("location").alias("location"), to_int(at("maxresults")).alias("max_results"), to_bool(at("deepscrape")).alias("deep_scrape"), to_int(at("priority")).alias("priority"), few.alias("error"))


def cell(df: DataFrame, name: str) -> Column:
    """SK1, SK2: a column as the text of a CSV cell."""
    kind, c = df.schema[name].dataType, F.col(name)
    if name == "social_profiles":
        text = F.array_join(F.transform(F.filter(c, lambda p: p["url"] != ""), lambda p: F.concat(F.coalesce(p["platform"], F.lit("other")), F.lit(":"), p["url"])), "|")
    elif name == "full_hours":
        text = F.array_join(F.transform(F.filter(c, lambda h: h["day"] != ""), lambda h: F.trim(F.concat(h["day"], F.lit(": "), F.coalesce(h["hours"], F.lit(""))))), "; ")
    elif name in ("top_reviews", "popular_times"):
        text = F.when(F.size(c) > 0, F.to_json(c))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        text = F.array_join(F.filter(c, lambda x: x != ""), "|")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def escaped(text: Column) -> Column:
    """SK3: quoted where it holds a comma, quote or line end."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """SK4: one column `line`; columns that df lacks are empty."""
    cells = [escaped(cell(df, c)) if c in df.columns else F.lit("") for c in columns]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def title(name: str) -> str:
    return " ".join({"id": "ID", "url": "URL"}.get(w, w.capitalize()) for w in name.split("_"))


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    """SK4, SK5: CRLF line ends; each file of the folder begins with a byte order mark and the header, so that each can be opened by itself."""
    head = "﻿" + ",".join(title(c) for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if not begun and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
                begun = True
            yield batch

    csv_lines(df, columns).mapInArrow(run, "line string").write.option("lineSep", "\r\n").text(path)


def write_json(df: DataFrame, path: str, summary: dict[str, object]) -> None:
    """SK5: listings as JSON lines, and the summary in a folder beside them."""
    df.write.json(f"{path}/businesses")
    df.sparkSession.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").write.text(f"{path}/summary")


def base_name(query: Column, location: Column, at: Column) -> Column:
    """SK6: query_location_time, each part in at most 40 safe characters."""
    safe = lambda c: F.substring(F.regexp_replace(F.coalesce(F.when(c != "", c), F.lit("run")), "[^a-zA-Z0-9_-]+", "_"), 1, 40)
    return F.concat_ws("_", safe(query), safe(location), F.date_format(at, "yyyy-MM-dd_HH-mm-ss"))


def parse_nested(text: Column, column: str) -> Column:
    """SC12: JSON text to the listing column's nested type."""
    return F.from_json(text, FIELDS[column])


def replace_folder(df: DataFrame, path: str) -> str:
    """SK15, SK16: write beside the path, then make a pointer to it the last step; readers follow the pointer. Returns the data's folder."""
    spark = df.sparkSession
    data = f"{path}/data-{uuid.uuid4().hex}"
    df.write.parquet(data)
    spark.createDataFrame([(data,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return data


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """SC13: what the pointer names; None if there is none (or it is broken)."""
    try:
        rows = spark.read.text(f"{path}/current").head(1)
    except Exception as error:  # no such folder
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return spark.read.parquet(rows[0]["value"]) if rows and re.search(r"/data-[0-9a-f]{32}$", rows[0]["value"]) else None


def append_events(events: DataFrame, path: str) -> None:
    """SK18: events (costs, burns) as JSON lines, a further file each time; nothing that is there is read or changed. The order of events is that of their own time."""
    events.write.mode("append").option("ignoreNullFields", "false").json(path)


def stream_events(events: DataFrame, path: str, checkpoints: str):
    """SK18 for a stream of events: each once, by the sink's own log. Returns the running query."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoints).outputMode("append").start()
