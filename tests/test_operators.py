"""Boundary values of the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions import core
from quillon.operators import addresses, changes, chains, dedup, phones, scores, sentiment, web, windows
from quillon.operators.graph import components
from quillon.sources import files


def one(spark: SparkSession, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head())


def test_rounding_and_bands(spark: SparkSession) -> None:
    assert one(spark, core.half_up(F.lit(-2.5)), core.half_up(F.lit(2.25), 1), core.clamp(F.lit(120.0))) == (-2.0, 2.3, 100.0)
    assert one(spark, *[scores.grade(F.lit(x)) for x in (85, 70, 55, 40, 39)]) == tuple("ABCDF")
    assert one(spark, *[scores.band(F.lit(x)) for x in (80, 60, 40, 20, 19)]) == ("very_high", "high", "medium", "low", "very_low")
    assert one(spark, *[sentiment.label(F.lit(x)) for x in (0.5, 0.1, 0.0, -0.1, -0.5)]) == ("very_positive", "positive", "neutral", "negative", "very_negative")


def test_phones(spark: SparkSession) -> None:
    rows = [("(212) 555-0123",), ("+44 20 7946 0958 ext. 12",), ("800-555-0100",), ("123",), ("",), (None,), ("١٢١٢٥٥٥٠١٢٣",)]
    got = [(r["phone_e164"], r["phone_type"], r["phone_extension"]) for r in phones.with_phones(spark.createDataFrame(rows, "phone string")).collect()]
    assert got == [("+12125550123", "landline", None), ("+442079460958", "unknown", "12"), ("+18005550100", "toll_free", None), (None, "invalid", None), (None, None, None), (None, None, None), ("+12125550123", "landline", None)]


def test_names_and_chains(spark: SparkSession) -> None:
    assert one(spark, dedup.plain_name(F.lit("The Joe's-Diner Grill, LLC")), dedup.plain_name(F.lit(None).cast("string"))) == ("joes", "")
    assert one(spark, chains.chain(F.lit("Wal-Mart #3"))["chain_id"], chains.chain(F.lit("Targeted"))["chain_id"], chains.chain(F.lit("Micky D's x"))["confidence"]) == ("walmart", None, 0.9)


def test_countries_and_hosts(spark: SparkSession) -> None:
    assert one(spark, *[addresses.country_code(F.lit(x)) for x in ("U.S.A.", "deu", "de", "Nowhere", "")]) == ("US", "DE", "DE", None, None)
    assert one(spark, *[web.host(F.lit(x)) for x in ("WWW.A.com:80/x", "http://u@b.org./", "localhost")]) == ("a.com", "b.org", None)
    assert one(spark, *[web.liveness(F.lit(c).cast("int"), F.lit(False)) for c in (399, 400, 599, 600, None)]) == ("live", "dead", "dead", "error", "error")


def test_changes(spark: SparkSession) -> None:
    assert one(spark, changes.delta(F.lit("100"), F.lit("150")), changes.delta(F.lit(4.5), F.lit(4.3)), changes.delta(F.lit(""), F.lit("3")), changes.delta(F.lit("x"), F.lit("3"))) == (50.0, -0.2, 3.0, None)
    assert one(spark, changes.review_jump(F.lit(0), F.lit(1)), changes.review_jump(F.lit(0), F.lit(0)), changes.review_jump(F.lit(100), F.lit(110))) == (1000.0, 0.0, 10.0)
    yes, age = F.lit(True), lambda x: F.lit(x)
    assert one(spark, changes.detail_decision(yes, age(9.0), F.lit(10.1)), changes.detail_decision(yes, age(7.0), F.lit(10.0)), changes.detail_decision(yes, age(7.1), F.lit(0.0))) == ("forced_refresh", "cache_hit", "cache_miss")


def test_components_and_ranks(spark: SparkSession) -> None:
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a bigint, b bigint")
    assert {(r["node"], r["label"]) for r in components(edges).collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}
    assert [r["rank"] for r in windows.global_rank(spark.range(50).repartition(7), "id").orderBy("id").collect()] == list(range(1, 51))


def test_jobs_csv(spark: SparkSession, tmp_path) -> None:
    (tmp_path / "jobs.csv").write_text('# jobs\nQuery, Location,maxResults,deepScrape\n"plumber, fast",Leeds,20,yes\n\nlone\n"say ""hi""",York,x,\n')
    got = {r["query"]: r for r in files.read_job_csv(spark, str(tmp_path / "jobs.csv")).collect()}
    assert got["plumber, fast"]["max_results"] == 20 and got["plumber, fast"]["deep_scrape"] is True and got["lone"]["error"] and got['say "hi"']["max_results"] is None


def test_listings_json(spark: SparkSession, tmp_path) -> None:
    (tmp_path / "a.json").write_text('[{"place_id": "1", "rating": 4.5}, {"place_id": "2", "full_hours": [{"day": "Monday", "hours": "9"}]}]')
    (tmp_path / "b.json").write_text('{"businesses": [{"place_id": "3"}]}')
    assert {r["place_id"] for r in files.read_listings(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).collect()} == {"1", "2", "3"}


def test_every_hashed_column_counts(spark: SparkSession) -> None:
    """Any column of the 26 changes the row's hash, any of the 15 the list's; nested ones too, whatever the order of a map's keys."""
    from quillon.operators import changes
    from quillon.sources.schema import LISTING_COLUMNS

    assert len(changes.HASHED) == 26 and len(changes.LISTED) == 15
    columns = [c for c in LISTING_COLUMNS.replace("\n", " ").split(", ") if c]
    base = spark.sql("SELECT 'p' place_id, 'n' name, 4.5D rating, 3L reviews_count, '$' price_level, 'c' category, 'a' address, '1' phone, 'w' website, 'm' maps_url, 'x' plus_code, true open_now, 'open' business_status, false is_sponsored, timestamp '2024-01-01 00:00:00' scraped_at, 'q' query, 'l' location, 'r' reservation_url, 'u' menu_url, true detail_scraped, 1.5D latitude, 2.5D longitude, map('mon', '9', 'tue', '8') full_hours, map('mon', array(1, 2)) popular_times, array(named_struct('author', 'z', 'rating', 5.0D, 'text', 't')) top_reviews, array('p1') photos, map('f', 'g') social_profiles")
    assert columns and set(changes.HASHED) < set(base.columns)
    edits = {c: F.lit(None).cast(base.schema[c].dataType) for c in changes.HASHED} | {"full_hours": F.create_map(F.lit("mon"), F.lit("9"), F.lit("tue"), F.lit("7")), "photos": F.array(F.lit("p2"))}
    rows = base.select(changes.row_hash(base).alias("h"), changes.row_hash(base, changes.LISTED).alias("l"), F.lit("").alias("c"))
    for c, value in edits.items():
        other = base.withColumn(c, value)
        rows = rows.unionByName(other.select(changes.row_hash(other).alias("h"), changes.row_hash(other, changes.LISTED).alias("l"), F.lit(c).alias("c")))
    got = {r["c"]: (r["h"], r["l"]) for r in rows.collect()}
    assert len({h for h, _ in got.values()}) == 27 and {c for c, (_, x) in got.items() if x != got[""][1]} == set(changes.LISTED)
    same = base.withColumn("scraped_at", F.current_timestamp()).withColumn("full_hours", F.create_map(F.lit("tue"), F.lit("8"), F.lit("mon"), F.lit("9")))
    assert same.select(changes.row_hash(same)).head()[0] == got[""][0]


def test_rule_ages(spark: SparkSession) -> None:
    from quillon.operators import changes

    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    at = lambda t: F.lit(t).cast("timestamp")
    assert one(spark, *[changes.is_stale(at(t), now, 30) for t in ("2024-01-31 12:00:00", "2024-01-30 12:00:00", None)]) == (False, True, True)


def test_migration_and_event_log(spark: SparkSession, tmp_path) -> None:
    from quillon.sources import files, schema

    names = schema.migrate(spark, "store_test")
    assert names == ["businesses", "duplicates", "field_changes", "runs", "snapshots"]
    spark.sql("INSERT INTO store_test.duplicates VALUES ('a', 'b', 0.9, 1)")
    assert schema.migrate(spark, "store_test") == names and spark.table("store_test.duplicates").count() == 1
    spark.sql("DROP SCHEMA store_test CASCADE")
    for n in (1, 2):
        files.append_events(spark.createDataFrame([(n, None), (n, 0.5)], "id int, cost double"), f"{tmp_path}/log")
    assert spark.read.schema("id int, cost double").json(f"{tmp_path}/log").groupBy("id").count().count() == 2


def test_dead_letters(spark: SparkSession) -> None:
    from quillon.operators import jobs

    s = spark.createDataFrame([(1, "failed", 3), (2, "failed", 1), (3, "active", 0)], "job int, state string, attempts_made int")
    ids = spark.createDataFrame([(1,), (1,), (3,)], "job int")
    rows = lambda d: sorted(tuple(r) for r in d.select("job", "state", "attempts_made").collect())
    assert rows(jobs.retried(s, ids)) == [(1, "waiting", 0), (2, "failed", 1), (3, "active", 0)] and rows(jobs.retried(s)) == [(1, "waiting", 0), (2, "waiting", 0), (3, "active", 0)]
    assert rows(jobs.without_dead_letters(s, ids)) == [(2, "failed", 1), (3, "active", 0)] and rows(jobs.without_dead_letters(s)) == [(3, "active", 0)]
    assert jobs.dead_letter_count(s).head()[0] == 2


def test_neighbours_over_the_antimeridian_and_far_chains(spark: SparkSession) -> None:
    from quillon.operators import geo

    d = spark.createDataFrame([("a", "x", 0.0, 179.999, None), ("b", "x", 0.0, -179.999, "c1"), ("c", "y", 60.0, 10.0, "c1"), ("d", "y", None, None, None)], "id string, category string, lat double, lng double, chain_id string")
    got = {r["id"]: r for r in geo.geo_metrics(d).collect()}
    assert got["a"]["nearest_id"] == "b" and got["a"]["within_500m"] == 1 and 200 < got["a"]["nearest_chain_m"] < 250
    assert got["c"]["nearest_chain_m"] is None and got["c"]["nearest_m"] > 10**7 and got["d"]["nearest_id"] is None  # another place of the same chain doesn't count
