"""Queries of lead scores and confidence (F150-F163, A17, A18, T4, T5, T7, T9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import half_up, settled
from ..operators import geo, scores, spam
from ..operators.chains import CHAIN_SQL, chain
from .geo import METRICS_SQL, located
from .registry import query
from .spam import PREPARED_SQL, SPAM_SQL, prepared

#: results of phases that need pages, reviews or a geocoder, made from the key; null where the phase didn't run
_GIVEN = {
    "website_liveness": "CASE k % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'dead' WHEN 2 THEN 'redirected' WHEN 3 THEN 'error' END",
    "sophistication": "CASE WHEN k % 4 = 0 THEN CAST(k * 7 % 101 AS INT) END",
    "reviews_read": "CASE WHEN k % 3 = 0 THEN CAST(k % 6 AS INT) END",
    "consistency": "CASE WHEN k % 3 = 0 THEN CASE k % 4 WHEN 0 THEN 'consistent' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'severe_mismatch' ELSE 'unknown' END END",
    "max_similarity": "CASE WHEN k % 2 = 0 THEN CAST(k % 11 AS DOUBLE) / 10 END",
    "is_primary": "CASE WHEN k % 2 = 0 THEN k % 6 <> 0 END",
    "geocode_confidence": "CASE WHEN lat IS NOT NULL THEN CAST(k % 11 AS DOUBLE) / 10 END",
}


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with what all phases found."""
    d = spam.with_spam(prepared(spark, sf_dir))
    d = d.select("*", settled(chain(F.col("name"))["chain_id"].alias("chain_id")))
    g = geo.geo_metrics(located(spark, sf_dir)).select(F.col("id").alias("place_id"), "isolation", "area_type", "coord_source")
    d = d.withColumn("phone_reused", F.exists("spam_flags", lambda f: f["code"] == "PHONE_REUSE")).withColumns({n: F.expr(e) for n, e in _GIVEN.items()})
    return d.join(g, "place_id", "left")


DESCRIBED_SQL = f"""{PREPARED_SQL}, {SPAM_SQL}, {METRICS_SQL.replace("P AS (", "PT AS (", 1).replace("FROM P a JOIN P b", "FROM PT a JOIN PT b").replace("G AS (SELECT place_id AS id", "GM AS (SELECT place_id AS id").replace("'|') AS flags FROM G)", "'|') AS geo_flags FROM GM)")},
D AS (SELECT SP.*, {CHAIN_SQL} AS chain_id, contains('|' || flags || '|', '|PHONE_REUSE|') AS phone_reused, {', '.join(f'{e} AS {n}' for n, e in _GIVEN.items())}, isolation, area_type, coord_source FROM SP JOIN GEO ON GEO.id = place_id)"""

_HAS = lambda c: f"coalesce({c} <> '', false)"
_CLAMP = lambda x: f"greatest(0.0, least(100.0, ({x})::DOUBLE))"
_R1 = lambda x: f"floor(({x})::DOUBLE * 10 + 0.5) / 10"
_N = "coalesce(reviews_count, 0)"
_SIGNALS = {
    "legitimacy": _CLAMP("100 - spam_score - CASE spam_level WHEN 'critical' THEN 20 WHEN 'high' THEN 10 ELSE 0 END - CASE WHEN chain_id IS NOT NULL THEN 15 ELSE 0 END"),
    "reputation": f"CASE WHEN rating IS NULL THEN 50.0 ELSE {_CLAMP(f'''CASE WHEN rating >= 4.5 THEN 100 WHEN rating >= 4 THEN 80 WHEN rating >= 3.5 THEN 60 WHEN rating >= 3 THEN 40 ELSE 20 END + CASE WHEN {_N} >= 100 THEN 10 WHEN {_N} >= 50 THEN 5 ELSE 0 END - CASE WHEN consistency IN ('mismatch', 'severe_mismatch') THEN 15 ELSE 0 END''')} END",
    "data_quality": _CLAMP(f"CASE WHEN phone IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN phone_valid THEN 10 WHEN phone_type = 'invalid' THEN -20 ELSE 0 END + CASE WHEN {_HAS('address_street')} AND ({_HAS('address_city')} OR {_HAS('address_state')} OR {_HAS('address_country')}) THEN 15 ELSE 0 END + CASE WHEN lat IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN {_HAS('website')} THEN 10 ELSE 0 END + CASE WHEN {_N} > 0 THEN 10 ELSE 0 END + CASE WHEN {_HAS('category')} THEN 5 ELSE 0 END + CASE WHEN consistency IS NOT NULL THEN 5 ELSE 0 END"),
    "digital_maturity": _CLAMP(f"coalesce(sophistication, CASE WHEN {_HAS('website')} THEN 30 ELSE 20 END) + CASE website_liveness WHEN 'live' THEN 20 WHEN 'dead' THEN -10 WHEN 'redirected' THEN 10 ELSE 0 END"),
    "establishment": f"CASE WHEN {_N} >= 200 THEN 100.0 WHEN {_N} >= 100 THEN 80.0 WHEN {_N} >= 50 THEN 60.0 WHEN {_N} >= 20 THEN 40.0 WHEN {_N} >= 5 THEN 20.0 ELSE 10.0 END",
    "uniqueness": f"CASE WHEN is_primary IS NULL THEN 50.0 ELSE {_CLAMP('(1 - greatest(0.0, least(1.0, coalesce(max_similarity, 0.0)))) * 100 - CASE WHEN NOT is_primary THEN 20 ELSE 0 END - CASE WHEN phone_reused THEN 20 ELSE 0 END')} END",
    "geo": _CLAMP("CASE isolation WHEN 'isolated' THEN 100 WHEN 'sparse' THEN 80 WHEN 'dense' THEN 40 ELSE 60 END + CASE area_type WHEN 'rural' THEN 10 WHEN 'urban' THEN -5 ELSE 0 END - CASE WHEN coord_source = 'none' THEN 15 ELSE 0 END"),
}


def lead_sql(profile: str) -> str:
    weights, angle = scores.PROFILES[profile]
    whole = " + ".join(_R1(f"{k} * {w}::DOUBLE") for k, w in zip(_SIGNALS, weights, strict=True))
    rows = ", ".join(f"{{'k': '{k}', 'l': '{lab}', 's': {k}, 'p': floor(abs({k} - 50) * {w}::DOUBLE * 1e6 + 0.5) / 1e6, 'i': {i}}}" for i, (k, lab, w) in enumerate(zip(_SIGNALS, scores.LABELS, weights, strict=True)))
    top = lambda test: f"array_to_string(list_transform(list_sort(list_transform(list_filter(rs, lambda r: r.s {test}), lambda r: {{'o': -r.p, 'i': r.i, 'k': r.k}}))[1:3], lambda r: r.k), '|')"
    pitch = f"'{angle} ({profile}).'"
    return f"""{DESCRIBED_SQL}, Z0 AS (SELECT *, {', '.join(f'{_R1(e)} AS {k}' for k, e in _SIGNALS.items())} FROM D),
Z1 AS (SELECT *, ({whole}) AS total, [{rows}] AS rs FROM Z0), Z2 AS (SELECT *, is_spam AND spam_score >= 65 AND total > 34 AS spam_capped FROM Z1),
Z3 AS (SELECT *, greatest(0, least(100, CASE WHEN spam_capped THEN 34 ELSE floor(floor(total * 1e6 + 0.5) / 1e6 + 0.5) END))::INT AS lead_score FROM Z2),
Z4 AS (SELECT *, CASE WHEN lead_score >= 85 THEN 'A' WHEN lead_score >= 70 THEN 'B' WHEN lead_score >= 55 THEN 'C' WHEN lead_score >= 40 THEN 'D' ELSE 'F' END AS lead_grade,
  CASE WHEN spam_capped THEN 'disqualify' WHEN lead_score >= 85 THEN 'priority' WHEN lead_score >= 70 THEN 'qualified' WHEN lead_score >= 55 THEN 'nurture' WHEN lead_score >= 40 THEN 'monitor' ELSE 'disqualify' END AS lead_tier, list_sort(list_transform(rs, lambda r: {{'s': r.s, 'i': r.i, 'l': r.l}}))[1].l AS weakest, {top('>= 70')} AS strengths, {top('< 45')} AS risks FROM Z3),
LS AS (SELECT *, CASE WHEN spam_capped THEN 'Disqualify' || coalesce(' ' || name, '') || ': likely spam.' WHEN lead_tier = 'disqualify' THEN 'Disqualify' || coalesce(' ' || name, '') || ': weakest is ' || weakest || '.' WHEN lead_tier = 'priority' THEN 'Priority' || coalesce(' ' || name, '') || ': ' || {pitch}
  WHEN lead_tier = 'qualified' THEN 'Qualified' || coalesce(' ' || name, '') || ': work on ' || weakest || ', ' || {pitch} WHEN lead_tier = 'nurture' THEN 'Nurture' || coalesce(' ' || name, '') || ': weakest is ' || weakest || ', ' || {pitch} ELSE 'Monitor' || coalesce(' ' || name, '') || ': weakest is ' || weakest || ', ' || {pitch} END AS recommendation FROM Z4)"""


_OUT = ("lead_score", "lead_grade", "lead_tier", "spam_capped", "weakest", "strengths", "risks", "recommendation")


@query(f"WITH {lead_sql('web-agency')} SELECT place_id, {', '.join(_SIGNALS)} FROM LS")
def lead_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F150-F156: the seven signals."""
    return scores.with_lead_score(described(spark, sf_dir)).select("place_id", *_SIGNALS)


@query(f"WITH {lead_sql('web-agency')} SELECT place_id, {', '.join(_OUT)} FROM LS")
def lead_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F157-F160, T4, T7: score, grade, tier, weakest signal, strengths, risks, recommendation."""
    return scores.with_lead_score(described(spark, sf_dir)).select("place_id", *_OUT)


@query(f"WITH {lead_sql('reputation-mgmt')} SELECT place_id, lead_score, lead_grade FROM LS")
def lead_score_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F157: another profile's weights."""
    return scores.with_lead_score(described(spark, sf_dir), "reputation-mgmt").select("place_id", "lead_score", "lead_grade")


@query(f"WITH {lead_sql('web-agency')} SELECT count(*)::BIGINT AS total, floor(avg(lead_score) * 100 + 0.5) / 100 AS avg_score, {', '.join(f'''count(*) FILTER (WHERE lead_grade = '{g}')::BIGINT AS grade_{g.lower()}''' for g in 'ABCDF')}, {', '.join(f'''count(*) FILTER (WHERE lead_tier = '{t}')::BIGINT AS {t}''' for t in ('priority', 'qualified', 'nurture', 'monitor', 'disqualify'))}, count(*) FILTER (WHERE spam_capped)::BIGINT AS capped FROM LS")
def lead_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's grades and tiers."""
    d = scores.with_lead_score(described(spark, sf_dir))
    return d.agg(
        F.count(F.lit(1)).alias("total"), half_up(F.avg("lead_score"), 2).alias("avg_score"), *[F.count_if(F.col("lead_grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"],
        *[F.count_if(F.col("lead_tier") == t).alias(t) for t in ("priority", "qualified", "nurture", "monitor", "disqualify")], F.count_if("spam_capped").alias("capped"),
    )


@query(f"WITH {lead_sql('web-agency')} SELECT place_id, lead_score FROM LS ORDER BY lead_score DESC, place_id LIMIT 50")
def top_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best leads (a top-k report)."""
    return scores.with_lead_score(described(spark, sf_dir)).select("place_id", "lead_score").orderBy(F.desc("lead_score"), "place_id").limit(50)


_FACTOR_SQL = [
    ("MISSING_PHONE", -10, "phone IS NULL"), ("HAS_PHONE", 8, "phone IS NOT NULL"), ("HAS_VALID_PHONE", 5, "phone_valid"), ("INVALID_PHONE", -12, "phone_type = 'invalid'"), ("MISSING_ADDRESS", -8, "address IS NULL"), ("MISSING_GEOCODE", -10, "lat IS NULL"),
    ("HAS_GEOCODE", 6, "lat IS NOT NULL"), ("HIGH_GEOCODE_CONFIDENCE", 4, "geocode_confidence >= 0.9"), ("MISSING_WEBSITE", -8, "website IS NULL"), ("HAS_WEBSITE", 6, "website IS NOT NULL"), ("HAS_LIVE_WEBSITE", 4, "website IS NOT NULL AND website_liveness = 'live'"),
    ("HAS_REVIEWS", 5, f"{_N} > 0"), ("HIGH_REVIEW_VOLUME", 6, f"{_N} >= 20"), ("LOW_REVIEW_VOLUME", -6, f"{_N} BETWEEN 1 AND 4"), ("HAS_SENTIMENT", 4, "reviews_read > 0"), ("RATING_REVIEW_MISMATCH", -8, "reviews_read > 0 AND consistency IN ('mismatch', 'severe_mismatch')"),
    ("HAS_TECH_STACK", 3, "sophistication IS NOT NULL"), ("SPAM_FLAGGED", -20, "is_spam OR spam_level IN ('high', 'critical')"),
]
_LOST = "list_filter([CASE WHEN name IS NULL THEN 'name' END, CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN address IS NULL THEN 'address' END, CASE WHEN website IS NULL THEN 'website' END, CASE WHEN rating IS NULL THEN 'rating' END, CASE WHEN reviews_count IS NULL THEN 'reviews' END, CASE WHEN lat IS NULL THEN 'lat/lng' END], lambda x: x IS NOT NULL)"
CONFIDENCE_SQL = f"""{DESCRIBED_SQL}, Y0 AS (SELECT *, {_LOST} AS lost, list_filter([{', '.join(f"CASE WHEN {t} THEN {{'o': {-abs(p)}, 'i': {i}, 'c': '{c}', 'p': {p}}} END" for i, (c, p, t) in enumerate(_FACTOR_SQL))}], lambda x: x IS NOT NULL) AS fs FROM D),
CF AS (SELECT *, greatest(0, least(100, 50 - 2 * len(lost) + list_sum(list_transform(fs, lambda f: f.p))))::INT AS confidence, ((phone_type IS NOT NULL)::INT + (lat IS NOT NULL)::INT + (is_primary IS NOT NULL)::INT + 1 + (sophistication IS NOT NULL)::INT + (consistency IS NOT NULL)::INT + 1) / 8.0::DOUBLE AS coverage FROM Y0)"""
_BAND = "CASE WHEN confidence >= 80 THEN 'very_high' WHEN confidence >= 60 THEN 'high' WHEN confidence >= 40 THEN 'medium' WHEN confidence >= 20 THEN 'low' ELSE 'very_low' END"


@query(f"WITH {CONFIDENCE_SQL} SELECT place_id, confidence, {_BAND} AS confidence_band, array_to_string(lost, '|') AS missing, coverage, array_to_string(list_transform(list_sort(fs)[1:8], lambda f: f.c), '|') AS factors FROM CF")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F161, F163, T5: confidence in a listing, and why."""
    return scores.with_confidence(described(spark, sf_dir)).select("place_id", "confidence", "confidence_band", "missing", "coverage", "factors")


@query(f"WITH {CONFIDENCE_SQL} SELECT count(*)::BIGINT AS total, floor(avg(confidence / 100.0::DOUBLE) * 100 + 0.5) / 100 AS avg_confidence, {', '.join(f'''count(*) FILTER (WHERE {_BAND} = '{b}')::BIGINT AS {b}''' for b in ('very_low', 'low', 'medium', 'high', 'very_high'))}, floor(avg(coverage) * 100 + 0.5) / 100 AS avg_coverage FROM CF")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's bands."""
    d = scores.with_confidence(described(spark, sf_dir))
    return d.agg(F.count(F.lit(1)).alias("total"), half_up(F.avg(F.col("confidence") / 100.0), 2).alias("avg_confidence"), *[F.count_if(F.col("confidence_band") == b).alias(b) for b in ("very_low", "low", "medium", "high", "very_high")], half_up(F.avg("coverage"), 2).alias("avg_coverage"))


_FIELD_SQL = {
    "name": "CASE WHEN name IS NOT NULL THEN 0.95 ELSE 0.3 END", "phone": "CASE WHEN phone IS NULL THEN 0.3 WHEN phone_valid THEN 0.9 ELSE 0.5 END",
    "address": f"CASE WHEN lat IS NOT NULL AND geocode_confidence >= 0.7 THEN 0.9 WHEN {_HAS('address_street')} OR {_HAS('address_city')} OR {_HAS('address_state')} THEN 0.6 ELSE 0.3 END",
    "website": "CASE WHEN website IS NULL THEN 0.2 WHEN website_liveness = 'live' THEN 0.85 WHEN website_liveness IN ('dead', 'error') THEN 0.5 ELSE 0.4 END", "category": "CASE WHEN category IS NOT NULL THEN 0.9 ELSE 0.3 END",
    "rating": "CASE WHEN rating IS NULL THEN 0.2 WHEN reviews_count >= 20 THEN 0.8 WHEN reviews_count >= 5 THEN 0.5 ELSE 0.2 END", "reviews_count": "CASE WHEN reviews_count IS NOT NULL THEN 0.9 ELSE 0.3 END", "lat": "CASE WHEN lat IS NULL THEN 0.0 ELSE 0.9 END",
}


@query(f"WITH {DESCRIBED_SQL} " + " UNION ALL ".join(f"SELECT place_id, '{f}' AS field, ({e})::DOUBLE AS confidence FROM D" for f, e in _FIELD_SQL.items()))
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F162: confidence by field, in long form."""
    d = described(spark, sf_dir).select("place_id", *[v.alias(f"v_{k}") for k, v in scores.field_confidence().items()])
    return d.select("place_id", F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"v_{k}").alias("confidence")) for k in scores.field_confidence()])))
