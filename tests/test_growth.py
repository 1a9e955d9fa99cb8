"""What findings on larger tables asked for: work that is spread, done once, and grows with the rows."""

from __future__ import annotations

import math
import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.operators import chains, dedup, geo, phones
from quillon.operators.graph import components
from quillon.sources.listings import listings

SMALL = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_listings_are_spread_before_they_are_worked_on(spark: SparkSession) -> None:
    assert optimized(listings(spark, SMALL)).startswith("RepartitionByExpression [k")


def test_a_name_is_normalised_once_for_all_brands(spark: SparkSession) -> None:
    from quillon.plans.catalogue import QUERIES

    plan = optimized(QUERIES["chain_detect"](spark, SMALL))
    assert plan.count("regexp_replace(") == 3
    found = spark.createDataFrame([("Wal-Mart #3",), ("Seven Eleven",), ("Targeted",), (None,)], "name string").select(chains.chain(F.col("name")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in found] == [("walmart", "Walmart", 1.0), ("7eleven", "7-Eleven", 1.0), (None, None, None), (None, None, None)]


def test_pairs_from_a_score_on_are_all_pairs_of_that_score(spark: SparkSession) -> None:
    r = random.Random(4)
    names = ["Joe Diner", "Joe Diners", "aaa", "aaaa", "The aa", "zz", "", None, "Joe's Tyres Inc", "abcabc abc", "bcabca abca", "x" * 5]
    rows = []
    for i in range(160):
        phone = r.choice([None, "", "12345", "1 23 45", "212 555 0001", "+1 212-555-0001", "abc"])
        valid = "+12125550001" if phone and "212" in phone and r.random() < 0.7 else None
        lat, lng = r.choice([(None, None), (10.0, 20.0), (10.0004, 20.0), (10.0009, 20.0), (10.0, 179.9999), (10.0, -179.9999)])
        rows.append((f"p{i:03}", r.choice(names), valid, phone, r.choice(["US", "DE", None]), lat, lng))
    d = spark.createDataFrame(rows, "place_id string, name string, phone_e164 string, phone string, address_country string, lat double, lng double")
    take = lambda x: sorted(tuple(p) for p in x.collect())
    every = take(dedup.scored_pairs(d))
    traits = {x["id"]: x for x in dedup.traits(d).collect()}
    shared = {(a, b) for a in traits for b in traits if a < b and any(traits[a][c] is not None and traits[a][c] == traits[b][c] for c in ("np", "ph", "gc"))}
    assert len(every) == len(shared) and {p[:2] for p in every} == shared
    left, right = (spark.createDataFrame([(x[0], x[2], x[3]) for x in rows], "id string, e string, p string").select(F.col("id").alias(f"id{s}"), F.col("e").alias(f"e{s}"), F.col("p").alias(f"p{s}")) for s in (1, 2))
    alike = {(x["id1"], x["id2"]) for x in left.crossJoin(right).filter(phones.phones_match(F.col("e1"), F.col("e2"), F.col("p1"), F.col("p2"))).collect()}
    assert all((p[3] == 1.0) == (p[:2] in alike) for p in every)
    for least in (0.3, 0.5, 0.6, 0.75, 0.85, 1.0):
        assert take(dedup.scored_pairs(d, least=least)) == [p for p in every if p[5] >= least], least
    for least in (0.5, 0.85):
        linked = {tuple(x) for x in components(dedup.links(dedup.traits(d), least)).collect()}
        assert linked == {tuple(x) for x in components(spark.createDataFrame([p[:2] for p in every if p[5] >= least], "a string, b string")).collect()}


def test_a_hot_block_makes_no_pairs_that_cannot_be_duplicates(spark: SparkSession) -> None:
    """20,000 listings of one block are 200 million pairs; of these, 20 can be duplicates."""
    i = F.col("id")
    d = spark.range(20_000).select(F.format_string("p%05d", i).alias("place_id"), F.lit("Star Shoes").alias("name"), F.concat(F.lit("+1212"), F.lpad((2_000_000 + i % 19_980).cast("string"), 7, "0")).alias("phone_e164"), F.lit("US").alias("address_country"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng")).withColumn("phone", F.col("phone_e164"))
    assert dedup.links(dedup.traits(d), 0.85).count() == 20


def test_places_with_many_rows_meet_once(spark: SparkSession) -> None:
    """J6 by brute force where rows share places, chains and categories, some over the antimeridian."""
    r = random.Random(7)
    spots = [(10 + r.randrange(40) * 0.002, r.choice([20.0, 179.99, -179.99]) + r.randrange(8) * 0.001) for _ in range(30)]
    rows = [(f"p{i:03}", r.choice(["a", "b", None, ""]), *r.choice(spots), r.choice([None, None, "x", "y"])) for i in range(150)] + [("q", "a", None, None, "x"), ("r", "a", -50.0, 3.0, None)]
    d = spark.createDataFrame(rows, "id string, category string, lat double, lng double, chain_id string")
    away = lambda s, t: 2 * 6371000 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(t[2] - s[2]) / 2) ** 2 + math.cos(math.radians(s[2])) * math.cos(math.radians(t[2])) * math.sin(math.radians(t[3] - s[3]) / 2) ** 2)))
    got = {x["id"]: x for x in geo.geo_metrics(d).collect()}
    assert len(got) == len(rows)
    for s in rows:
        met = [] if s[2] is None else [(away(s, t), t[0], t) for t in rows if t[2] is not None and t[0] != s[0]]
        x, foreign = got[s[0]], [m for m, _, t in met if t[4] is not None and t[4] != s[4]]
        assert (x["within_500m"], x["within_1km"], x["within_5km"]) == tuple(sum(m <= far for m, _, _ in met) for far in (500, 1000, 5000))
        assert x["same_category_1km"] == sum(m <= 1000 and bool(s[1]) and t[1] == s[1] for m, _, t in met)
        assert x["nearest_id"] == (min(met)[1] if met else None) and (x["nearest_m"] is None if not met else abs(x["nearest_m"] - min(met)[0]) < 0.01)
        assert (x["nearest_chain_m"] is None) == (not foreign) and (not foreign or abs(x["nearest_chain_m"] - min(foreign)) < 0.01)


def test_rows_of_one_place_are_not_compared_with_each_other(spark: SparkSession) -> None:
    """60,000 rows at two places are 3.6 billion pairs of rows, and four of places."""
    i = F.col("id")
    d = spark.range(60_000).select(F.format_string("p%05d", i).alias("id"), F.lit("cafe").alias("category"), (10 + (i % 2) * 0.001).alias("lat"), F.lit(20.0).alias("lng"), F.lit(None).cast("string").alias("chain_id"))
    row = geo.geo_metrics(d).groupBy("within_500m", "same_category_1km", "nearest_m").agg(F.count(F.lit(1)), F.count_if(F.col("nearest_id").isin("p00000", "p00001", "p00002", "p00003"))).collect()
    assert [tuple(x) for x in row] == [(59_999, 59_999, 0.0, 60_000, 60_000)]
