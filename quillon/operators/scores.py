"""Lead score and confidence (F150-F163, T4, T5, T7, A17, A18, P11, P12).

Input columns, null where an earlier phase didn't run: name, phone, phone_e164, phone_type, phone_valid, address, address_street, address_city,
address_state, address_country, lat, lng, geocode_confidence, website, website_liveness, category, rating, reviews_count, spam_score, spam_level,
is_spam, phone_reused, chain_id, sophistication, reviews_read, consistency, max_similarity, is_primary, isolation, area_type, coord_source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bands, clamp, half_up, settled

SIGNALS = ("legitimacy", "reputation", "data_quality", "digital_maturity", "establishment", "uniqueness", "geo")
LABELS = ("Legitimacy", "Reputation", "Data quality", "Digital maturity", "Establishment", "Uniqueness", "Geo context")
#: weights in the order of SIGNALS, and what to offer
PROFILES = {
    "default": ((0.25, 0.25, 0.20, 0.10, 0.10, 0.05, 0.05), "general outreach"),
    "web-agency": ((0.20, 0.15, 0.20, 0.10, 0.15, 0.10, 0.10), "website redesign / web presence"),
    "reputation-mgmt": ((0.20, 0.35, 0.15, 0.05, 0.15, 0.05, 0.05), "reputation management services"),
    "seo-agency": ((0.15, 0.15, 0.20, 0.20, 0.10, 0.10, 0.10), "SEO optimization"),
}
NEUTRAL, CAP, CAP_FROM = 50.0, 34, 65


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def _there(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string") != "", F.lit(False))


def signals() -> dict[str, Column]:
    """F150-F156: each signal, 0 to 100."""
    c, n = F.col, F.coalesce(F.col("reviews_count"), F.lit(0))
    legit = 100 - c("spam_score") - F.when(c("spam_level") == "critical", 20).when(c("spam_level") == "high", 10).otherwise(0) - 15 * _flag(c("chain_id").isNotNull())
    fame = bands(c("rating"), [(4.5, 100.0), (4.0, 80.0), (3.5, 60.0), (3.0, 40.0)], 20.0) + bands(n, [(100, 10.0), (50, 5.0)], 0.0) - 15 * _flag(c("consistency").isin("mismatch", "severe_mismatch"))
    has_phone = _there("phone_e164") | _there("phone")
    valid = F.coalesce(c("phone_valid"), F.lit(False))
    parts = [
        15 * _flag(has_phone), F.when(valid, 10.0).when(has_phone & (c("phone_type") == "invalid"), -20.0).otherwise(0.0), 15 * _flag(_there("address_street") & (_there("address_city") | _there("address_state") | _there("address_country"))),
        10 * _flag(c("lat").isNotNull() & c("lng").isNotNull()), 10 * _flag(_there("website")), 10 * _flag(n > 0), 5 * _flag(_there("category")), 5 * _flag(c("consistency").isNotNull()),
    ]
    mature = F.coalesce(c("sophistication").cast("double"), F.when(_there("website"), 30.0).otherwise(20.0)) + F.when(c("website_liveness") == "live", 20).when(c("website_liveness") == "dead", -10).when(c("website_liveness") == "redirected", 10).otherwise(0)
    own = (1 - clamp(F.coalesce(c("max_similarity"), F.lit(0.0)), 0.0, 1.0)) * 100 - 20 * _flag(~c("is_primary")) - 20 * _flag(c("phone_reused"))
    place = F.when(c("isolation") == "isolated", 100.0).when(c("isolation") == "sparse", 80.0).when(c("isolation") == "dense", 40.0).otherwise(60.0)
    place = place + F.when(c("area_type") == "rural", 10).when(c("area_type") == "urban", -5).otherwise(0) - 15 * _flag(c("coord_source") == "none")
    out = {
        "legitimacy": F.when(c("spam_score").isNull(), NEUTRAL).otherwise(clamp(legit)),
        "reputation": F.when(c("rating").isNull(), NEUTRAL).otherwise(clamp(fame)),
        "data_quality": clamp(reduce(lambda a, b: a + b, parts)),
        "digital_maturity": clamp(mature),
        "establishment": bands(n, [(200, 100.0), (100, 80.0), (50, 60.0), (20, 40.0), (5, 20.0)], 10.0),
        "uniqueness": F.when(c("is_primary").isNull(), NEUTRAL).otherwise(clamp(own)),
        "geo": F.when(c("coord_source").isNull(), NEUTRAL).otherwise(clamp(place)),
    }
    return {k: half_up(v.cast("double"), 1) for k, v in out.items()}


def grade(score: Column) -> Column:
    return bands(score, [(85, "A"), (70, "B"), (55, "C"), (40, "D")], "F")


def tier(score: Column, capped: Column) -> Column:
    return F.when(capped, "disqualify").otherwise(bands(score, [(85, "priority"), (70, "qualified"), (55, "nurture"), (40, "monitor")], "disqualify"))


def with_lead_score(df: DataFrame, profile: str = "web-agency") -> DataFrame:
    """F157-F160: df and the seven signals, lead_score, lead_grade, lead_tier, spam_capped, weakest, strengths, risks, recommendation. An unknown profile is the web agency's."""
    name = profile if profile in PROFILES else "web-agency"
    weights, angle = PROFILES[name]
    d = df.select("*", settled(*[value.alias(key) for key, value in signals().items()]))
    whole = reduce(lambda a, b: a + b, [half_up(F.col(k) * w, 1) for k, w in zip(SIGNALS, weights, strict=True)])
    d = d.withColumn("_sum", whole).withColumn("spam_capped", F.coalesce(F.col("is_spam") & (F.col("spam_score") >= CAP_FROM) & (F.col("_sum") > CAP), F.lit(False)))
    d = d.withColumn("lead_score", clamp(F.when(F.col("spam_capped"), float(CAP)).otherwise(half_up(half_up(F.col("_sum"), 6)))).cast("int"))
    d = d.withColumn("lead_grade", grade(F.col("lead_score"))).withColumn("lead_tier", tier(F.col("lead_score"), F.col("spam_capped")))
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.col(k).alias("score"), half_up(F.abs(F.col(k) - 50) * w, 6).alias("pull"), F.lit(i).alias("i")) for i, (k, label, w) in enumerate(zip(SIGNALS, LABELS, weights, strict=True))])
    d = d.withColumn("_rows", rows)

    def top(test: object) -> Column:
        ranked = F.array_sort(F.transform(F.filter("_rows", test), lambda r: F.struct((-r["pull"]).alias("o"), r["i"].alias("i"), r["key"].alias("key"))))
        return F.array_join(F.transform(F.slice(ranked, 1, 3), lambda r: r["key"]), "|")

    d = d.withColumn("weakest", F.array_min(F.transform("_rows", lambda r: F.struct(r["score"].alias("s"), r["i"].alias("i"), r["label"].alias("label"))))["label"])
    who, pitch = F.coalesce(F.concat(F.lit(" "), F.when(F.col("name") != "", F.col("name"))), F.lit("")), f"{angle} ({name})."
    say = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    advice = (
        F.when(F.col("spam_capped"), say("Disqualify", who, ": likely spam.")).when(F.col("lead_tier") == "disqualify", say("Disqualify", who, ": weakest is ", F.col("weakest"), ".")).when(F.col("lead_tier") == "priority", say("Priority", who, ": ", pitch))
        .when(F.col("lead_tier") == "qualified", say("Qualified", who, ": work on ", F.col("weakest"), ", ", pitch)).when(F.col("lead_tier") == "nurture", say("Nurture", who, ": weakest is ", F.col("weakest"), ", ", pitch))
        .otherwise(say("Monitor", who, ": weakest is ", F.col("weakest"), ", ", pitch))
    )
    d = d.withColumn("strengths", top(lambda r: r["score"] >= 70)).withColumn("risks", top(lambda r: r["score"] < 45)).withColumn("recommendation", advice)
    return d.drop("_sum", "_rows")


def band(score: Column) -> Column:
    return bands(score, [(80, "very_high"), (60, "high"), (40, "medium"), (20, "low")], "very_low")


#: code, points, test; in the order that breaks ties
def factors() -> list[tuple[str, int, Column]]:
    c = F.col
    text = lambda n: F.coalesce(F.trim(c(n)) != "", F.lit(False))
    placed = c("lat").isNotNull() & c("lng").isNotNull()
    valid = F.coalesce(c("phone_valid"), F.lit(False)) | text("phone_e164")
    n, read = F.coalesce(c("reviews_count"), F.lit(0)), F.coalesce(c("reviews_read"), F.lit(0))
    return [
        ("MISSING_PHONE", -10, ~text("phone")),
        ("HAS_PHONE", 8, text("phone")),
        ("HAS_VALID_PHONE", 5, text("phone") & valid),
        ("INVALID_PHONE", -12, text("phone") & ~valid & (c("phone_type") == "invalid")),
        ("MISSING_ADDRESS", -8, ~text("address")),
        ("MISSING_GEOCODE", -10, ~placed),
        ("HAS_GEOCODE", 6, placed),
        ("HIGH_GEOCODE_CONFIDENCE", 4, placed & (c("geocode_confidence") >= 0.9)),
        ("MISSING_WEBSITE", -8, ~text("website")),
        ("HAS_WEBSITE", 6, text("website")),
        ("HAS_LIVE_WEBSITE", 4, text("website") & (c("website_liveness") == "live")),
        ("HAS_REVIEWS", 5, n > 0),
        ("HIGH_REVIEW_VOLUME", 6, n >= 20),
        ("LOW_REVIEW_VOLUME", -6, (n > 0) & (n < 5)),
        ("HAS_SENTIMENT", 4, read > 0),
        ("RATING_REVIEW_MISMATCH", -8, (read > 0) & c("consistency").isin("mismatch", "severe_mismatch")),
        ("HAS_TECH_STACK", 3, c("sophistication").isNotNull()),
        ("SPAM_FLAGGED", -20, c("is_spam") | c("spam_level").isin("high", "critical")),
    ]


def with_confidence(df: DataFrame) -> DataFrame:
    """F161, T5: df and confidence (0-100), confidence_band, missing (fields), coverage (of eight phases), factors (strongest eight)."""
    c = F.col
    text = lambda n: F.coalesce(F.trim(c(n)) != "", F.lit(False))
    lost = [("name", ~text("name")), ("phone", ~text("phone")), ("address", ~text("address")), ("website", ~text("website")), ("rating", c("rating").isNull()), ("reviews", c("reviews_count").isNull()), ("lat/lng", c("lat").isNull() | c("lng").isNull())]
    d = df.withColumn("_lost", F.array_compact(F.array(*[F.when(t, k) for k, t in lost])))
    found = [F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(-abs(p)).alias("o"), F.lit(i).alias("i"), F.lit(k).alias("code"), F.lit(p).alias("points"))) for i, (k, p, t) in enumerate(factors())]
    d = d.withColumn("_found", F.array_sort(F.array_compact(F.array(*found))))
    covered = [c("phone_type").isNotNull() | text("phone_e164"), c("lat").isNotNull() & c("lng").isNotNull(), c("is_primary").isNotNull(), c("spam_score").isNotNull() | c("chain_id").isNotNull(), c("sophistication").isNotNull(), c("consistency").isNotNull(), c("coord_source").isNotNull(), c("lead_score").isNotNull() if "lead_score" in df.columns else F.lit(False)]
    score = clamp(50 - 2 * F.size("_lost") + F.aggregate("_found", F.lit(0), lambda a, f: a + f["points"])).cast("int")
    d = d.withColumn("confidence", score)
    return d.select(
        *df.columns, "confidence", band(c("confidence")).alias("confidence_band"), F.array_join("_lost", "|").alias("missing"), (reduce(lambda a, b: a + b, [_flag(x) for x in covered]) / len(covered)).alias("coverage"),
        F.array_join(F.transform(F.slice("_found", 1, 8), lambda f: f["code"]), "|").alias("factors"),
    )


def field_confidence() -> dict[str, Column]:
    """F162: how far each field can be trusted, 0 to 0.95."""
    c = F.col
    text = lambda n: F.coalesce(F.trim(c(n)) != "", F.lit(False))
    n, placed, sure = c("reviews_count"), c("lat").isNotNull() & c("lng").isNotNull(), c("geocode_confidence") >= 0.7
    parsed = text("address_street") | text("address_city") | text("address_state")
    return {
        "name": F.when(text("name"), 0.95).otherwise(0.3),
        "phone": F.when(~text("phone"), 0.3).when(F.coalesce(c("phone_valid"), F.lit(False)) | text("phone_e164"), 0.9).otherwise(0.5),
        "address": F.when(placed & sure, 0.9).when(parsed, 0.6).otherwise(0.3),
        "website": F.when(~text("website"), 0.2).when(c("website_liveness") == "live", 0.85).when(c("website_liveness").isin("dead", "error"), 0.5).otherwise(0.4),
        "category": F.when(text("category"), 0.9).otherwise(0.3),
        "rating": F.when(c("rating").isNull(), 0.2).when(n >= 20, 0.8).when(n >= 5, 0.5).otherwise(0.2),
        "reviews_count": F.when(n.isNotNull(), 0.9).otherwise(0.3),
        "lat": F.when(~placed, 0.0).when(sure | c("coord_source").isin("geocoded", "raw"), 0.9).otherwise(0.7),
    }
