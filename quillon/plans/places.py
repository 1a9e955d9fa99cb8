"""Queries of phones and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import addresses, phones
from ..sources.listings import listings
from .registry import query

_COUNTRY = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in addresses.COUNTRIES.items()) + "}"


def tidy_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'), '\\s+', ' ', 'g'))"


def country_sql(x: str) -> str:
    plain = f"regexp_replace(lower({tidy_sql(x)}), '\\.+$', '')"
    letters = f"regexp_replace({plain}, '[^a-z]', '', 'g')"
    return f"coalesce({_COUNTRY}[{plain}], CASE WHEN length({letters}) = 2 THEN {_COUNTRY}[{letters}] END)"


#: phones of the listings; all of them are read as North American
PHONES_SQL = f"""PH0 AS (SELECT *, regexp_replace(phone, '[^0-9+().\\-\\sa-zA-Z#;,]', '', 'g') AS p0 FROM L),
PH1 AS (SELECT *, nullif(regexp_extract(p0, '^(.*?)(?:\\s*(?:extension|ext\\.?|ex\\.?|x|#|;|,)\\s*)(\\d{{1,7}})\\s*$', 2, 'i'), '') AS ext, regexp_extract(p0, '^(.*?)(?:\\s*(?:extension|ext\\.?|ex\\.?|x|#|;|,)\\s*)(\\d{{1,7}})\\s*$', 1, 'i') AS head FROM PH0),
PH2 AS (SELECT *, regexp_replace(CASE WHEN ext IS NULL THEN p0 ELSE head END, '[^0-9]', '', 'g') AS digits FROM PH1),
PH3 AS (SELECT *, CASE WHEN length(digits) = 11 AND digits[1] = '1' THEN digits[2:] ELSE digits END AS nat FROM PH2),
PH AS (SELECT * EXCLUDE (p0, ext, head, digits, nat), CASE WHEN phone IS NOT NULL THEN regexp_matches(nat, '^[2-9]\\d{{2}}[2-9]\\d{{6}}$') END AS phone_valid, CASE WHEN regexp_matches(nat, '^[2-9]\\d{{2}}[2-9]\\d{{6}}$') THEN '+1' || nat END AS phone_e164,
  CASE WHEN phone IS NULL THEN NULL WHEN NOT regexp_matches(nat, '^[2-9]\\d{{2}}[2-9]\\d{{6}}$') THEN 'invalid' WHEN nat[1:3] IN ({', '.join(repr(x) for x in phones.TOLL_FREE)}) THEN 'toll_free' WHEN nat[1:3] = '900' THEN 'unknown' ELSE 'landline' END AS phone_type,
  CASE WHEN phone IS NOT NULL THEN 'US' END AS phone_country, CASE WHEN phone IS NOT NULL THEN nullif(nat, '') END AS phone_national, ext AS phone_extension FROM PH3)"""

_FIELDS = ("phone_e164", "phone_type", "phone_country", "phone_valid", "phone_national", "phone_extension")


@query(f"WITH {PHONES_SQL} SELECT place_id, {', '.join(_FIELDS)} FROM PH")
def phone_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phones of the listings."""
    return phones.with_phones(listings(spark, sf_dir).select("place_id", "phone")).select("place_id", *_FIELDS)


@query(f"WITH {PHONES_SQL} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE phone_valid)::BIGINT AS valid, count(*) FILTER (WHERE NOT phone_valid)::BIGINT AS invalid, count(*) FILTER (WHERE phone IS NULL)::BIGINT AS skipped, count(*) FILTER (WHERE phone_type = 'landline')::BIGINT AS landline, count(*) FILTER (WHERE phone_type = 'toll_free')::BIGINT AS toll_free, count(*) FILTER (WHERE phone_type = 'unknown')::BIGINT AS unknown FROM PH")
def phone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a batch's phones."""
    p = phones.with_phones(listings(spark, sf_dir).select("place_id", "phone"))
    kind = lambda t: F.count_if(F.col("phone_type") == t).alias(t)
    return p.agg(F.count(F.lit(1)).alias("total"), F.count_if("phone_valid").alias("valid"), F.count_if(~F.col("phone_valid")).alias("invalid"), F.count_if(F.col("phone").isNull()).alias("skipped"), kind("landline"), kind("toll_free"), kind("unknown"))


@query(f"WITH {PHONES_SQL} SELECT place_id, '+1 ' || nat[1:3] || ' ' || nat[4:6] || ' ' || nat[7:] AS international, '(' || nat[1:3] || ') ' || nat[4:6] || '-' || nat[7:] AS national FROM (SELECT place_id, phone_e164[3:] AS nat FROM PH WHERE phone_valid)")
def phone_for_dialing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """display forms."""
    p = phones.with_phones(listings(spark, sf_dir).select("place_id", "phone")).filter("phone_valid")
    return p.select("place_id", phones.for_dialing(F.col("phone_e164")).alias("d")).select("place_id", "d.international", "d.national")


@query(r"""
SELECT k, CASE k % 6 WHEN 0 THEN '+442079460' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN '+4930' || CAST(1000000 + k AS VARCHAR) WHEN 2 THEN '+81312345678' WHEN 3 THEN '+12125550' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') WHEN 4 THEN NULL ELSE NULL END AS phone_e164,
  CASE k % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'JP' WHEN 3 THEN 'US' WHEN 4 THEN 'FR' ELSE 'US' END AS phone_country, CASE k % 6 WHEN 3 THEN 'landline' WHEN 4 THEN 'invalid' WHEN 5 THEN 'invalid' ELSE 'unknown' END AS phone_type,
  CASE WHEN k % 6 = 0 THEN '77' END AS phone_extension FROM L
""")
def phones_of_the_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numbers with calling codes, foreign digits, extensions."""
    k = F.col("k")
    tail = F.lpad((k % 1000).cast("string"), 3, "0")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("+44 (20) 7946 0"), tail, F.lit(" x77"))).when(k % 6 == 1, F.concat(F.lit("+٤٩ 30/"), (1000000 + k).cast("string"))).when(k % 6 == 2, "+८१ 3-1234-5678")
        .when(k % 6 == 3, F.concat(F.lit("+1.212.555.0"), tail)).when(k % 6 == 4, "+33 12").otherwise("n/a")
    )
    return phones.with_phones(listings(spark, sf_dir).select("k", raw.alias("phone"))).select("k", "phone_e164", "phone_country", "phone_type", "phone_extension")


#: addresses of the listings, written out per form: the generator's forms are known, so the right parts are, too
ADDRESS_SQL = """AD AS (SELECT *,
  CASE WHEN address IS NULL THEN NULL WHEN address LIKE 'PO Box%' THEN trim(split_part(address, ',', 1)) WHEN address LIKE '%Germany' OR address LIKE '%Kingdom' OR address LIKE '%USA' OR address LIKE '%France' THEN trim(split_part(address, ',', 1)) WHEN address LIKE '%Japan' THEN trim(address[9:]) END AS address_street,
  CASE WHEN address LIKE '%Germany' THEN 'Berlin' WHEN address LIKE '%Japan' THEN NULL WHEN address IS NOT NULL THEN trim(split_part(address, ',', 2)) END AS address_city,
  CASE WHEN address LIKE 'PO Box%' THEN 'TX' WHEN address LIKE '%USA' THEN 'CA' END AS address_state,
  CASE WHEN address LIKE 'PO Box%' THEN '75001' WHEN address LIKE '%USA' THEN regexp_extract(address, 'CA ([0-9]{5})', 1) WHEN address LIKE '%Germany' THEN regexp_extract(address, ', ([0-9]{5})', 1) WHEN address LIKE '%Kingdom' THEN 'SW1A 1AA' WHEN address LIKE '%Japan' THEN address[1:8] END AS address_postal,
  CASE WHEN address LIKE '%USA' THEN 'US' WHEN address LIKE '%Germany' THEN 'DE' WHEN address LIKE '%Kingdom' THEN 'GB' WHEN address LIKE '%France' THEN 'FR' WHEN address LIKE '%Japan' THEN 'JP' END AS address_country FROM PH)"""

_PARTS = ("address_street", "address_city", "address_state", "address_postal", "address_country")


@query(f"WITH {PHONES_SQL}, {ADDRESS_SQL} SELECT place_id, {', '.join(_PARTS)} FROM AD WHERE place_id IS NOT NULL")
def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the listings in six forms, and null."""
    return addresses.with_addresses(listings(spark, sf_dir).select("place_id", "address")).select("place_id", *_PARTS)


_FORMS = {
    "12 King St W, Toronto, ON M5H 1J9, Canada": ("12 King St W", "Toronto", "ON", "M5H 1J9", "CA"),
    "1 Elm Ave, Suite 4, Austin TX 78701-1234, USA": ("1 Elm Ave, Suite 4", "Austin -1234", "TX", "78701", "US"),
    "5 Oak Rd, NY 10001, USA": ("5 Oak Rd", None, "NY", "10001", "US"),
    "Ring 3, 1010 Wien, Austria": ("Ring 3", "Wien", None, "1010", "AT"),
    "Am Markt 1, 50667 Köln, NRW, Germany": ("Am Markt 1", "Köln", "NRW", "50667", "DE"),
    "10 High St, Leeds, LS1 4AB, UK": ("10 High St", "Leeds", None, "LS1 4AB", "GB"),
    "Rue X 4, Lyon, Rhone, Etage 2, France": ("Rue X 4, Etage 2", "Lyon", "Rhone", None, "FR"),
    "Somewhere": ("Somewhere", None, None, None, None),
    "A, B": ("A", "B", None, None, None),
}
_quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query("SELECT k, " + ", ".join("CASE k % 9 " + " ".join(f"WHEN {i} THEN {_quote(v[j])}" for i, v in enumerate(_FORMS.values())) + f" END AS {p}" for j, p in enumerate(_PARTS)) + " FROM L")
def address_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address of each form, with the parts that it should give."""
    raw = F.element_at(F.array(*[F.lit(a) for a in _FORMS]), (F.col("k") % 9 + 1).cast("int"))
    return addresses.with_addresses(listings(spark, sf_dir).select("k", raw.alias("address"))).select("k", *_PARTS)


@query("SELECT k, CASE WHEN k % 2 = 0 THEN '東京都' END AS address_state, CASE WHEN k % 2 = 0 THEN '港区' END AS address_city, CASE WHEN k % 2 = 0 THEN '芝' || CAST(k AS VARCHAR) ELSE 'Unit ' || CAST(k AS VARCHAR) END AS address_street, '100-0001' AS address_postal FROM L")
def address_japan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefecture, city and street without commas, with the country as a hint."""
    n = F.col("k").cast("string")
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit("100-0001 東京都港区芝"), n)).otherwise(F.concat(F.lit("100-0001 Unit "), n))
    return addresses.with_addresses(listings(spark, sf_dir).select("k", raw.alias("address")), hint="JP").select("k", "address_state", "address_city", "address_street", "address_postal")


@query(f"""SELECT n_nationkey, n_name, {country_sql('n_name')} AS code, CASE n_nationkey % 3 WHEN 0 THEN {country_sql("n_name[1:2] || '.'")} WHEN 1 THEN {country_sql("'u.s.a.'")} ELSE {country_sql("' Great  Britain '")} END AS other FROM nation""")
def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names and codes of countries."""
    k = F.col("n_nationkey") % 3
    other = F.when(k == 0, F.concat(F.substring("n_name", 1, 2), F.lit("."))).when(k == 1, "u.s.a.").otherwise(" Great  Britain ")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", addresses.country_code(F.col("n_name")).alias("code"), addresses.country_code(other).alias("other"))


_GEO_SQL = """SELECT place_id, lat, CASE WHEN lat IS NULL THEN 0.0 ELSE floor(least(1.0, CASE k % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 WHEN 5 THEN 0.3 WHEN 6 THEN 0.9 ELSE 0.4 END
    + (CASE WHEN k % 3 = 0 THEN 0.05 ELSE 0.0 END) + (CASE WHEN k % 5 = 0 THEN 0.05 ELSE 0.0 END)) * 100 + 0.5) / 100 END::DOUBLE AS confidence FROM L"""


def _geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    accuracy = F.element_at(F.array(*[F.lit(x) for x in ("exact", "ROOFTOP", "RANGE_INTERPOLATED", "GEOMETRIC_CENTER", "APPROXIMATE", "CENTROID", None, None)]), (k % 8 + 1).cast("int"))
    importance = F.when(k % 8 == 6, 0.5).when(k % 8 == 7, 0.1)
    return listings(spark, sf_dir).select("place_id", "lat", addresses.geocode_confidence(accuracy, importance, F.col("lat"), k % 3 == 0, k % 5 == 0).alias("confidence"))


@query(f"SELECT * FROM ({_GEO_SQL}) WHERE place_id IN (SELECT place_id FROM L)")
def geocode_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """confidence by accuracy, importance and equal parts."""
    return _geocoded(spark, sf_dir)


@query(f"""WITH G AS ({_GEO_SQL}) SELECT CASE WHEN confidence >= 1 THEN 'exact' WHEN confidence >= 0.85 THEN 'rooftop' WHEN confidence >= 0.7 THEN 'interpolated' WHEN confidence >= 0.55 THEN 'center' WHEN confidence >= 0.3 THEN 'approximate' ELSE 'none' END AS bucket,
  count(*)::BIGINT AS n FROM G GROUP BY 1""")
def geocode_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by bucket of confidence."""
    return _geocoded(spark, sf_dir).groupBy(addresses.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT place_id, k, spent_before < 2.0 AS within_budget FROM (SELECT place_id, k, coalesce(sum(0.005) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent_before FROM L WHERE address IS NOT NULL)")
def geocode_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests stop when the budget is spent. Each request costs the same, so the running sum is a rank times the cost."""
    from ..operators.windows import global_rank

    rows = listings(spark, sf_dir).filter("address is not null").select("place_id", "k")
    return global_rank(rows, "k").select("place_id", "k", ((F.col("rank") - 1) * 5 < 2000).alias("within_budget"))


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(place_id) + 1), lambda i: ascii(place_id[i])::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296)"


@query(f"SELECT place_id, floor((h % 65536 / 65535.0::DOUBLE * 180 - 90) * 1e7 + 0.5) / 1e7 AS lat, floor(((h // 65536) / 65535.0::DOUBLE * 360 - 180) * 1e7 + 0.5) / 1e7 AS lng FROM (SELECT place_id, {_HASH} AS h FROM L )")
def mock_geocodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixed places by id."""
    return listings(spark, sf_dir).select("place_id", addresses.mock_geocode(F.col("place_id")).alias("g")).select("place_id", "g.lat", "g.lng")
