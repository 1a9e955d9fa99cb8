"""Parsers of listing cards and detail pages (F1-F22): raw text to typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ladder, text_or_null


def first(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return text_or_null(F.regexp_extract(x, pattern, group))


def rating(raw: Column) -> Column:
    value = first(raw, r"(\d+(?:\.\d+)?)").try_cast("double")
    return F.when(value.between(0, 5), value)


def reviews_count(raw: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(raw, r"[(),]", ""), r"(?i)reviews?", "")
    return first(plain, r"(\d+)").try_cast("bigint")


def price_level(raw: Column) -> Column:
    return first(raw, r"(\${1,4})")


def place_id(url: Column) -> Column:
    return F.coalesce(F.try_url_decode(first(url, r"[?&]place_id=([^&]+)")), first(url, r"(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)"), first(url, r"(ChIJ[A-Za-z0-9_-]{10,})"))


def plus_code(raw: Column) -> Column:
    return first(raw, r"([2-9CFGHJMPQRVWX0]{4,8}\+[2-9CFGHJMPQRVWX0]{2,3})")


def open_now(raw: Column) -> Column:
    low = F.lower(raw)
    opened = low.contains("open now") | (low.startswith("open") & ~low.startswith("opens") & ~low.contains("hours"))
    return F.when(raw == "", None).when(opened, True).when(low.contains("closed") | low.startswith("opens"), False).when(raw.rlike("營業中|营业中"), True).when(raw.rlike("已打烊|歇業|歇业|关门|關門"), False)


def business_status(card: Column) -> Column:
    low = F.lower(F.coalesce(card, F.lit("")))
    return ladder([(low.contains("permanently closed"), "permanently_closed"), (low.contains("temporarily closed") | low.contains("temp. closed"), "temporarily_closed")], "open")


def sponsored(card: Column, aria: Column) -> Column:
    return F.coalesce(card.rlike("(?i)sponsored|^ad$"), F.lit(False)) | F.coalesce(aria.rlike("(?i)sponsored"), F.lit(False))


TRACKING = "utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid|ref"


def clean_website(url: Column) -> Column:
    """Without tracking parameters; host in lower case; a bare closing slash goes."""
    head, rest = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    rest = F.regexp_replace(rest, rf"([?&])(?:(?:{TRACKING})(?:=[^&#]*)?(?:&|(?=#)|$))+", "$1")
    rest = F.regexp_replace(rest, r"[?&](#|$)", "$1")
    rest = F.when(rest == "/", "").otherwise(rest)
    return F.when(url == "", None).when(head == "", url).otherwise(F.concat(F.lower(head), rest))


def clean_phone(raw: Column) -> Column:
    return text_or_null(F.trim(F.regexp_replace(raw, r"^(?i:tel:)", "")))


def absolute_url(url: Column, base: str) -> Column:
    return F.when(url == "", None).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


DAYS = {"Monday": ["mon"], "Tuesday": ["tue", "tues"], "Wednesday": ["wed", "weds"], "Thursday": ["thu", "thur", "thurs"], "Friday": ["fri"], "Saturday": ["sat"], "Sunday": ["sun"]}


def normal_day(raw: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(raw)), r"\.+$", "")
    return F.when(raw == "", None).otherwise(F.coalesce(ladder([(low.isin(name.lower(), *short), name) for name, short in DAYS.items()]), F.trim(raw)))


def hours_table(rows: Column) -> Column:
    """array<struct<day, text>> to array<struct<day, hours>>, without empty hours; null if nothing is left."""
    out = F.transform(F.filter(rows, lambda r: F.trim(F.coalesce(r["text"], F.lit(""))) != ""), lambda r: F.struct(F.coalesce(normal_day(r["day"]), r["day"]).alias("day"), F.trim(r["text"]).alias("hours")))
    return F.when(F.size(out) > 0, out)


def busy_level(label: Column) -> Column:
    rules = [(r"(?i)(very|extremely)\s*busy", 4), (r"(?i)(usually|currently)\s*busy", 3), (r"(?i)(usually|currently)\s*(a little|slightly)\s*busy", 2), (r"(?i)(usually|currently)\s*not\s*(as|too)\s*busy", 2), (r"(?i)not\s*busy", 1)]
    return ladder([(label.rlike(p), level) for p, level in rules], 0)


def hour_of_label(label: Column) -> Column:
    hour, half = first(label, r"(?i)(\d{1,2})\s*(?:AM|PM)").cast("int"), F.upper(first(label, r"(?i)\d{1,2}\s*(AM|PM)"))
    return F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)


def popular_times(entries: Column) -> Column:
    """array<struct<day, bars: array<struct<hour, label>>>> to days with hour, level and label; null if none has bars."""

    def day(e: Column) -> Column:
        bars = F.transform(e["bars"], lambda b, i: F.struct(F.coalesce(b["hour"], hour_of_label(b["label"]), i).alias("hour"), busy_level(b["label"]).alias("level"), text_or_null(b["label"]).alias("label")))
        return F.struct(F.coalesce(normal_day(e["day"]), e["day"]).alias("day"), bars.alias("busy"))

    out = F.transform(F.filter(entries, lambda e: F.coalesce(F.size(e["bars"]), F.lit(0)) > 0), day)
    return F.when(F.size(out) > 0, out)


def review(author: Column, rating_raw: Column, text: Column, date: Column) -> Column:
    made = F.struct(text_or_null(F.trim(author)).alias("author"), rating(rating_raw).alias("rating"), text_or_null(F.trim(text)).alias("text"), text_or_null(F.trim(date)).alias("date"))
    return F.when(made["text"].isNotNull() | made["author"].isNotNull() | made["rating"].isNotNull(), made)


def social_platform(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return ladder(
        [
            (low.contains("instagram.com"), "instagram"), (low.contains("facebook.com") | low.contains("fb.com"), "facebook"), (low.contains("twitter.com") | low.contains("x.com"), "twitter"),
            (low.contains("linkedin.com"), "linkedin"), (low.contains("youtube.com") | low.contains("youtu.be"), "youtube"),
        ],
        "other",
    )


def social_profiles(urls: Column) -> Column:
    """Distinct (platform, url) in the order of first sight."""
    return F.transform(F.array_distinct(F.transform(F.filter(urls, lambda u: u != ""), clean_website)), lambda u: F.struct(social_platform(u).alias("platform"), u.alias("url")))


def format_signature(phone: Column) -> Column:
    return F.regexp_replace(F.trim(phone), r"\d", "9")


def address_parts(address: Column) -> Column:
    return F.filter(F.transform(F.split(address, ","), F.trim), lambda p: p != "")


def address_is_full(address: Column) -> Column:
    """its parts between commas, and one more each for something like a postal code and for a street number, are three or more."""
    parts = F.size(address_parts(address)) + address.rlike(r"(?i)\b[a-z0-9]{3,10}\s*[a-z0-9]{0,6}\b").cast("int") + address.rlike(r"(?i)\b\d+\s+[a-z]").cast("int")
    return parts >= 3


def plain_name(name: Column) -> Column:
    """letters and digits only, without one legal form or article at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]", ""), r"(co|inc|llc|ltd|the)$", "")


def backoff_ms(attempt: Column, base: float, cap: float | None = None) -> Column:
    wait = F.lit(float(base)) * F.pow(F.lit(2.0), attempt)
    return wait if cap is None else F.least(wait, F.lit(float(cap)))
