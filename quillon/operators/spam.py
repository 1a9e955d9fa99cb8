"""Signs of spam listings (F68-F81, J9, A12). Needs the columns of chains, phones and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import haversine_km, ladder, lookup, settled

KEYWORDS = "24 7|24/7|aaa|affordable|best|cheap|cheapest|discount|emergency|expert|fastest|free estimate|guaranteed|instant|insured|licensed|lowest price|number 1|#1|premium|professional|quality|reliable|top rated".split("|")
TLDS = "cf click gq loan ml tk top xyz".split()
GENERIC = r"(?i)^(professional services|(quality|best|allied|city wide|abc|express) services?|1 stop )"
EXPECTS_SITE, LOCAL_TRADE = r"(?i)contractor|electrician|hvac|landscap|locksmith|plumber|roofing|towing", r"(?i)electrician|hvac|locksmith|plumber|towing"
COHESION_M = 150
_AREAS = """
CA 213 310 323 408 415 510 650 669 707 747 805 818 858 909 916 925 949 951|CO 303 719 720 970|FL 239 305 321 352 386 407 561 727 754 772 786 813 850 863 904 941 954|IL 217 224 309 312 331 618 630 708 773 779 815 847 872|
MI 231 248 269 313 517 586 616 734 810 906 947 989|NC 252 336 704 743 828 910 919 980|NY 212 332 347 646 718 917 929|TN 423 615 629 731 865 901 931|
TX 210 214 254 281 346 409 469 512 682 713 726 737 806 817 830 832 903 915 936 940 945 956 972 979|VA 276 434 540 571 703 757 804|WA 206 253 360 425 509 564
"""
AREA_STATE = {a: line.split()[0] for line in _AREAS.replace("\n", "").split("|") for a in line.split()[1:]}
_SHORT = {"ave": "avenue", "st": "street", "bld": "boulevard", "bd": "boulevard", "blvd": "boulevard", "rd": "road", "dr": "drive", "ln": "lane", "ste": "suite", "apt": "apartment", "fl": "floor"}


def street_city(street: Column, city: Column) -> Column:
    """a key of a place, with abbreviations spelled out and floors, units and ordinal endings off; '' if both are empty."""

    def plain(x: Column) -> Column:
        x = F.lower(F.coalesce(x, F.lit("")))
        for short, long in _SHORT.items():
            x = F.regexp_replace(x, rf"\b{short}\b", long)
        for pattern, by in ((r"(\d+)(st|nd|rd|th)\b", "$1"), (r",?\s*(suite|ste|unit|apt|apartment)\s*\w+", " "), (r",?\s*\d*\s*floor\b", " "), (r"\bfloor\b", " "), (r"[^a-z0-9\s]", " "), (r"\s+", " ")):
            x = F.regexp_replace(x, pattern, by)
        return F.trim(x)

    a, b = plain(street), plain(city)
    return F.when((a == "") & (b == ""), "").otherwise(F.concat(a, F.lit("|"), b))


def phone_reuse(df: DataFrame, key: str = "place_id") -> DataFrame:
    """(phone_e164, reuse, cohesive) for each number of two or more listings.

    Cohesive: all have coordinates and are within 150 m of each other, or all share street and city. Instead of all pairs, first the box around the
    group is looked at: a diagonal of at most 150 m settles it, a side beyond 150 m as well; only groups between are compared in pairs.
    """
    rows = df.filter("phone_e164 is not null").select(key, "phone_e164", "lat", "lng", street_city(F.col("address_street"), F.col("address_city")).alias("place"))
    box = rows.groupBy("phone_e164").agg(
        F.count(F.lit(1)).alias("reuse"), F.count_if(F.col("lat").isNull() | F.col("lng").isNull()).alias("lost"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"),
        F.min("place").alias("p"), F.max("place").alias("q"),
    ).filter("reuse >= 2")
    metres = lambda a, b, c, d: haversine_km(F.col(a), F.col(b), F.col(c), F.col(d)) * 1000
    one_place = (F.col("p") == F.col("q")) & (F.col("p") != "")
    near, far = metres("s", "w", "n", "e") <= COHESION_M * 0.99, metres("s", "w", "n", "w") > COHESION_M * 1.01
    state = F.when(one_place, "yes").when(F.col("lost") > 0, "no").when(near, "yes").when(far, "no").otherwise("open")
    judged = box.withColumn("state", state)
    a = rows.join(judged.filter("state = 'open'").select("phone_e164"), "phone_e164", "left_semi").select(key, "phone_e164", "lat", "lng")
    b = a.select(F.col(key).alias("other"), "phone_e164", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    apart = a.join(b, "phone_e164").filter(F.col(key) < F.col("other")).filter(metres("lat", "lng", "lat2", "lng2") > COHESION_M).select("phone_e164").distinct().withColumn("apart", F.lit(True))
    return judged.join(apart, "phone_e164", "left").select("phone_e164", "reuse", ((F.col("state") == "yes") | ((F.col("state") == "open") & F.col("apart").isNull())).alias("cohesive"))


def with_spam(df: DataFrame, key: str = "place_id") -> DataFrame:
    """Df and spam_flags (array of struct(code, severity, weight), heaviest first), spam_score, spam_level, is_spam."""
    reuse = phone_reuse(df, key)
    d = df.join(reuse, "phone_e164", "left")
    name, lower = F.coalesce(F.col("name"), F.lit("")), F.lower(F.coalesce(F.col("name"), F.lit("")))
    n_letters, n_capitals = F.length(F.regexp_replace(name, "[^A-Za-z]", "")), F.length(F.regexp_replace(name, "[^A-Z]", ""))
    words = F.lit(0)
    for word in KEYWORDS:
        words = words + lower.rlike(rf"\b{word}\b").cast("int")
    d = d.withColumn("_hits", words).withColumn("_caps", (n_letters > 0) & (n_capitals >= 0.7 * n_letters))
    hits, caps, n = F.col("_hits"), F.col("_caps"), F.col("reuse")
    state_of = lookup(AREA_STATE, F.substring("phone_national", 1, 3))
    no_site = F.coalesce(F.col("website") == "", F.lit(True))
    category, site = F.coalesce(F.col("category"), F.lit("")), F.lower(F.coalesce(F.col("website"), F.lit("")))

    def flag(test: Column, code: str, severity: Column | str, weight: Column | int) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(F.coalesce(test, F.lit(False)), F.struct(as_column(weight).cast("int").alias("weight"), F.lit(code).alias("code"), as_column(severity).alias("severity")))

    few, rv = F.col("rating") >= 4.95, F.col("reviews_count")
    flags = F.array(
        flag((hits > 0) | caps, "KEYWORD_STUFFING", F.when(hits >= 4, "critical").when(hits >= 2, "high").otherwise("medium"), F.least(F.lit(35), hits * 8 + caps.cast("int") * 10)),
        flag(name.rlike(r"(?i)^a{2,}\s+"), "AAA_PREFIX", "medium", 12),
        flag(F.col("address").rlike(r"(?i)\bp\.?o\.?\s*box\b") | F.coalesce(F.col("address_street").rlike(r"(?i)\bbox\b"), F.lit(False)), "PO_BOX_ADDRESS", "high", 18),
        flag((F.col("phone_country") == "US") & (F.col("phone_type") != "invalid") & (F.upper("address_state") != state_of), "PHONE_AREA_MISMATCH", "high", 15),
        flag(n >= 2, "PHONE_REUSE", F.when(F.col("cohesive"), "info").when(n >= 3, "critical").otherwise("high"), F.when(F.col("cohesive"), 4).otherwise(F.least(F.lit(30), 12 + n * 6))),
        flag(few & (rv <= 5), "SUSPICIOUS_RATING", F.when(rv <= 2, "high").otherwise("medium"), 12 + F.greatest(F.lit(0), 5 - rv) * 2),
        flag(name.rlike(GENERIC), "GENERIC_NAME", "medium", 14),
        flag(site.rlike(r"\.(" + "|".join(TLDS) + ")"), "SUSPICIOUS_TLD", "high", 16),
        flag(no_site & category.rlike(EXPECTS_SITE), "NO_WEBSITE_SERVICE", "low", 6),
        flag(no_site & category.rlike(LOCAL_TRADE) & (F.col("phone_type") == "toll_free"), "CATEGORY_MISMATCH", "medium", 10),
        flag((n >= 2) & name.rlike(r"(?i)^a{2,}\s+"), "NETWORK_PATTERN", "critical", 25),
    )
    heaviest = F.array_sort(F.array_compact(flags), lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).when(a["code"] < b["code"], -1).when(a["code"] > b["code"], 1).otherwise(0))
    d = d.withColumn("spam_flags", heaviest)
    d = d.withColumn("spam_score", F.least(F.lit(100), F.aggregate("spam_flags", F.lit(0), lambda acc, f: acc + f["weight"])))
    return d.select(*df.columns, settled(F.col("spam_flags"), F.col("spam_score"), level(F.col("spam_score")).alias("spam_level"), (F.col("spam_score") >= 25).alias("is_spam")))


def level(score: Column) -> Column:
    return ladder([(score >= 65, "critical"), (score >= 45, "high"), (score >= 25, "medium"), (score >= 10, "low")], "clean")
