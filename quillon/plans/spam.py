"""Queries of chains and spam."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import half_up, haversine_sql, settled
from ..operators import addresses, chains, phones, spam
from ..sources.listings import listings
from .places import ADDRESS_SQL, PHONES_SQL
from .registry import query

#: addresses without the Japanese form, of which only the postal code is compared
PREPARED_SQL = f"{PHONES_SQL}, {ADDRESS_SQL}"


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with phones and addresses. Japanese addresses (no country hint) give a street and a city by position."""
    return addresses.with_addresses(phones.with_phones(listings(spark, sf_dir)))


@query(f"SELECT * FROM (SELECT place_id, {chains.CHAIN_SQL} AS chain_id, {chains.CHAIN_NAME_SQL} AS chain_name, {chains.CHAIN_CONFIDENCE_SQL} AS confidence FROM L ) WHERE chain_id IS NOT NULL")
def chain_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listings of chains."""
    return listings(spark, sf_dir).select("place_id", settled(chains.chain(F.col("name")).alias("c"))).filter("c is not null").select("place_id", "c.*")


@query(f"SELECT chain_id, chain_name, count(*)::BIGINT AS n, string_agg(place_id, '|' ORDER BY place_id) AS listings FROM (SELECT place_id, {chains.CHAIN_SQL} AS chain_id, {chains.CHAIN_NAME_SQL} AS chain_name FROM L ) WHERE chain_id IS NOT NULL GROUP BY ALL")
def chain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by chain."""
    return chains.chain_groups(listings(spark, sf_dir)).withColumn("listings", F.array_join("listings", "|"))


REUSE_SQL = f"""RN AS (SELECT phone_e164, count(*)::BIGINT AS reuse, bool_and(lat IS NOT NULL) AS placed FROM AD WHERE phone_e164 IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
RA AS (SELECT a.phone_e164, max(CASE WHEN {haversine_sql('a', 'b')} * 1000 > 150 THEN 1 ELSE 0 END) AS apart FROM AD a JOIN AD b ON a.phone_e164 = b.phone_e164 AND a.place_id < b.place_id GROUP BY 1),
RP AS (SELECT phone_e164, count(DISTINCT lower(coalesce(address_street, '')) || '|' || lower(coalesce(address_city, ''))) = 1 AND bool_and(address_street IS NOT NULL OR address_city IS NOT NULL) AS one_place FROM AD WHERE phone_e164 IS NOT NULL GROUP BY 1),
R AS (SELECT RN.phone_e164, reuse, one_place OR (placed AND apart = 0) AS cohesive FROM RN JOIN RA USING (phone_e164) JOIN RP USING (phone_e164))"""


@query(f"WITH {PREPARED_SQL}, {REUSE_SQL} SELECT * FROM R")
def phone_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of several listings, and whether those are at one place."""
    return spam.phone_reuse(prepared(spark, sf_dir))


_LOW = "lower(coalesce(name, ''))"
_HITS = " + ".join(f"regexp_matches({_LOW}, '\\b{w}\\b')::INT" for w in spam.KEYWORDS)
_AREA = "MAP {" + ", ".join(f"'{a}': '{s}'" for a, s in spam.AREA_STATE.items()) + "}"
SPAM_SQL = f"""{REUSE_SQL},
S0 AS (SELECT AD.*, reuse, cohesive, {_HITS} AS hits, length(regexp_replace(coalesce(name, ''), '[^A-Za-z]', '', 'g')) AS nl, length(regexp_replace(coalesce(name, ''), '[^A-Z]', '', 'g')) AS nc FROM AD LEFT JOIN R USING (phone_e164)),
S1 AS (SELECT *, nl > 0 AND nc >= 0.7 * nl AS caps, regexp_matches(coalesce(name, ''), '^a{{2,}}\\s+', 'i') AS aaa FROM S0),
S2 AS (SELECT *, [CASE WHEN hits > 0 OR caps THEN {{'w': least(35, hits * 8 + CASE WHEN caps THEN 10 ELSE 0 END)::INT, 'c': 'KEYWORD_STUFFING'}} END, CASE WHEN aaa THEN {{'w': 12, 'c': 'AAA_PREFIX'}} END,
  CASE WHEN address LIKE 'PO Box%' THEN {{'w': 18, 'c': 'PO_BOX_ADDRESS'}} END, CASE WHEN phone_type <> 'invalid' AND address_state <> {_AREA}[phone_national[1:3]] THEN {{'w': 15, 'c': 'PHONE_AREA_MISMATCH'}} END,
  CASE WHEN reuse >= 2 THEN {{'w': CASE WHEN cohesive THEN 4 ELSE least(30, 12 + reuse * 6) END::INT, 'c': 'PHONE_REUSE'}} END, CASE WHEN rating >= 4.95 AND reviews_count <= 5 THEN {{'w': (12 + greatest(0, 5 - reviews_count) * 2)::INT, 'c': 'SUSPICIOUS_RATING'}} END,
  CASE WHEN regexp_matches(name, '^(professional services|(quality|best|allied|city wide|abc|express) services?|1 stop )', 'i') THEN {{'w': 14, 'c': 'GENERIC_NAME'}} END, CASE WHEN regexp_matches(lower(website), '\\.({'|'.join(spam.TLDS)})') THEN {{'w': 16, 'c': 'SUSPICIOUS_TLD'}} END,
  CASE WHEN website IS NULL AND category = 'Plumber' THEN {{'w': 6, 'c': 'NO_WEBSITE_SERVICE'}} END, CASE WHEN website IS NULL AND category = 'Plumber' AND phone_type = 'toll_free' THEN {{'w': 10, 'c': 'CATEGORY_MISMATCH'}} END,
  CASE WHEN reuse >= 2 AND aaa THEN {{'w': 25, 'c': 'NETWORK_PATTERN'}} END] AS raw FROM S1),
S3 AS (SELECT * EXCLUDE (raw), list_filter(raw, lambda x: x IS NOT NULL) AS fl FROM S2),
S4 AS (SELECT *, least(100, coalesce(list_sum(list_transform(fl, lambda x: x.w)), 0))::INT AS spam_score FROM S3),
SP AS (SELECT *, CASE WHEN spam_score >= 65 THEN 'critical' WHEN spam_score >= 45 THEN 'high' WHEN spam_score >= 25 THEN 'medium' WHEN spam_score >= 10 THEN 'low' ELSE 'clean' END AS spam_level, spam_score >= 25 AS is_spam,
  array_to_string(list_transform(list_sort(list_transform(fl, lambda x: {{'o': -x.w, 'c': x.c}})), lambda x: x.c), '|') AS flags FROM S4)"""


@query(f"WITH {PREPARED_SQL}, {SPAM_SQL} SELECT place_id, spam_score, spam_level, is_spam, flags FROM SP")
def spam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, level and flags (heaviest first)."""
    d = spam.with_spam(prepared(spark, sf_dir))
    return d.select("place_id", "spam_score", "spam_level", "is_spam", F.array_join(F.transform("spam_flags", lambda f: f["code"]), "|").alias("flags"))


@query(f"WITH {PREPARED_SQL}, {SPAM_SQL} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE is_spam)::BIGINT AS spam, {', '.join(f'''count(*) FILTER (WHERE spam_level = '{x}')::BIGINT AS {x}''' for x in ('clean', 'low', 'medium', 'high', 'critical'))}, floor(avg(spam_score) * 100 + 0.5) / 100 AS avg_score FROM SP")
def spam_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's levels and mean score."""
    d = spam.with_spam(prepared(spark, sf_dir))
    return d.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_spam").alias("spam"), *[F.count_if(F.col("spam_level") == x).alias(x) for x in ("clean", "low", "medium", "high", "critical")], half_up(F.avg("spam_score"), 2).alias("avg_score"))


@query("SELECT k, CASE k % 4 WHEN 0 THEN CAST(k AS VARCHAR) || ' main street|springfield' WHEN 1 THEN CAST(k AS VARCHAR) || ' fifth avenue|x y' WHEN 2 THEN '3 oak road|' ELSE '' END AS place FROM L")
def street_city_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys of places."""
    k, n = F.col("k") % 4, F.col("k").cast("string")
    street = F.when(k == 0, F.concat(n, F.lit("th Main St., Suite 4b"))).when(k == 1, F.concat(n, F.lit(" Fifth Ave, 2 Fl"))).when(k == 2, "3 Oak Rd, Apt 9")
    city = F.when(k == 0, "Springfield").when(k == 1, "X  Y")
    return listings(spark, sf_dir).select("k", spam.street_city(street, city).alias("place"))
