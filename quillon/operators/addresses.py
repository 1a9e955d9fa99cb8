"""Postal addresses (F40-F51): country names, postal codes, grammars by country, confidence of a geocode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import half_up, ladder, lookup, settled, text_or_null

_COUNTRIES = """
US:USA,us,united states,united states of america,america,u.s.a|CA:CAN,ca,canada|MX:MEX,mexico|BR:BRA,brazil,brasil|AR:ARG,argentina|CL:CHL,chile|CO:COL,colombia|PE:PER,peru|VE:VEN,venezuela|
GB:GBR,uk,u.k,united kingdom,britain,great britain,england,scotland,wales,northern ireland|DE:DEU,germany,deutschland|FR:FRA,france|ES:ESP,spain,españa,espana|IT:ITA,italy,italia|NL:NLD,netherlands,nederland,holland|
BE:BEL,belgium,belgië,belgique|CH:CHE,switzerland,schweiz,suisse|AT:AUT,austria,österreich|SE:SWE,sweden,sverige|NO:NOR,norway,norge|DK:DNK,denmark,danmark|FI:FIN,finland,suomi|IE:IRL,ireland|PT:PRT,portugal|GR:GRC,greece|
PL:POL,poland|CZ:CZE,czechia,czech republic|SK:SVK,slovakia|HU:HUN,hungary|RO:ROU,romania|BG:BGR,bulgaria|HR:HRV,croatia|RS:SRB,serbia|RU:RUS,russia|UA:UKR,ukraine|TR:TUR,turkey,türkiye|JP:JPN,japan|KR:KOR,korea,south korea|
CN:CHN,china|IN:IND,india|PK:PAK,pakistan|BD:BGD,bangladesh|LK:LKA,sri lanka|NP:NPL,nepal|TH:THA,thailand|VN:VNM,vietnam,viet nam|PH:PHL,philippines|ID:IDN,indonesia|MY:MYS,malaysia|SG:SGP,singapore|HK:HKG,hong kong|TW:TWN,taiwan|
SA:SAU,saudi arabia|AE:ARE,uae,united arab emirates|QA:QAT,qatar|KW:KWT,kuwait|BH:BHR,bahrain|OM:OMN,oman|IL:ISR,israel|IR:IRN,iran|IQ:IRQ,iraq|AU:AUS,australia|NZ:NZL,new zealand|ZA:ZAF,south africa|EG:EGY,egypt|NG:NGA,nigeria|
KE:KEN,kenya|MA:MAR,morocco|GH:GHA,ghana|ET:ETH,ethiopia|TZ:TZA,tanzania|UG:UGA,uganda
"""
COUNTRIES: dict[str, str] = {}  #: lower-case name, three-letter or two-letter code -> two-letter code
for _entry in _COUNTRIES.replace("\n", "").split("|"):
    _code, _, _names = _entry.partition(":")
    COUNTRIES |= {n.lower(): _code for n in [_code, *_names.split(",")]}

#: Digits of a code are written as 9, letters as A, an optional space as _, a hyphen as itself; several shapes by /.
_POSTAL = """
99999:DE FR IT ES FI KR PK TH ID MY EG KE MA PE UA TR SA AE|9999:BE CH AT NO DK BD PH AU NZ ZA VE|999999:CN IN VN SG NG CO RU|9999999:CL IL|9999-999:PT|9999_AA:NL|999_99:SE CZ|99-999:PL|999-9999:JP|99999-999:BR|A9A_9A9:CA
"""
POSTAL = {c: rf"\b({shape.replace('9', chr(92) + 'd').replace('A', '[A-Za-z]').replace('_', chr(92) + 's?')})\b" for shape, _, cs in (x.partition(":") for x in _POSTAL.strip().split("|")) for c in cs.split()}
POSTAL |= {"US": r"\b(\d{5})(?:-\d{4})?\b", "GB": r"\b([A-Za-z]{1,2}\d[A-Za-z\d]?\s?\d[A-Za-z]{2})\b", "IE": r"\b([A-Z]\d{2}\s?[A-Z\d]{4})\b", "AR": r"\b([A-Za-z]\d{4}[A-Za-z]{3}|\d{4})\b"}

STATES = "AK AL AR AS AZ CA CO CT DC DE FL GA GU HI IA ID IL IN KS KY LA MA MD ME MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR RI SC SD TN TX UT VA VI VT WA WI WV WY".split()
PROVINCES = "AB BC MB NB NL NS NT NU ON PE QC SK YT".split()
SPACES = r"[\u00A0\u2000-\u200A\u202F\u205F\u3000]"


def tidy(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, SPACES, " "), r"\s+", " "))


def country_code(x: Column) -> Column:
    """a name or code to a two-letter code; null for anything else."""
    plain = F.regexp_replace(F.lower(tidy(x)), r"\.+$", "")
    letters = F.regexp_replace(plain, r"[^a-z]", "")
    return F.coalesce(lookup(COUNTRIES, plain), F.when(F.length(letters) == 2, lookup(COUNTRIES, letters)))


def postal_code(x: Column, country: Column) -> Column:
    """by the country's pattern; without a country that has one, the longest match of all, ties by letter."""
    clean = lambda m: F.trim(F.regexp_replace(m, r"\s+", " "))
    found = [clean(F.regexp_extract(x, pattern, 1)) for pattern in sorted(set(POSTAL.values()))]
    cases = [(country.isin(*[c for c, p in POSTAL.items() if p == pattern]), text_or_null(m)) for pattern, m in zip(sorted(set(POSTAL.values())), found, strict=True)]
    named = F.when(*cases[0])
    for case in cases[1:]:
        named = named.when(*case)
    best = F.array_min(F.transform(F.filter(F.array(*found), lambda m: m != ""), lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m"))))["m"]
    return F.when(country.isin(*POSTAL), named).otherwise(best)


def cut_first(x: Column, part: Column) -> Column:
    """x with the first occurrence of part as a space; x if part is null or isn't there."""
    at = F.coalesce(F.position(part, x), F.lit(0))
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit(" "), F.substring(x, at + F.length(part), F.length(x)))).otherwise(x)


def _segments(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), tidy), lambda s: s != "")


def _join(parts: Column) -> Column:
    return text_or_null(F.array_join(parts, ", "))


def with_addresses(df: DataFrame, raw: str = "address", hint: str | None = None) -> DataFrame:
    """Df and address_street, address_city, address_state, address_postal, address_country.

    One grammar for the United States and Canada, one for Germany and Austria, one each for the United Kingdom and Japan, and one by position.
    """
    at = lambda a, k: F.get(F.col(a), F.lit(k) if isinstance(k, int) else k)
    d = df.withColumn("_raw", F.when(F.trim(F.col(raw)) != "", tidy(F.col(raw)))).withColumn("_seg", _segments(F.col("_raw"))).withColumn("_last", country_code(F.get("_seg", F.size("_seg") - 1)))
    d = d.withColumn("_cc", F.coalesce(country_code(F.lit(hint)), F.col("_last")) if hint is not None else F.col("_last"))
    closed = F.col("_last").eqNullSafe(F.col("_cc")) & F.col("_cc").isNotNull()
    inside = F.when(closed | (F.col("_cc") == "GB"), F.slice("_seg", 1, F.greatest(F.size("_seg") - 1, F.lit(0)))).otherwise(F.col("_seg"))
    d = d.withColumn("_parts", F.when(F.col("_cc").isin("US", "CA", "DE", "AT", "GB"), inside).otherwise(F.col("_seg")))
    scope = F.when(F.col("_cc").isin("DE", "AT"), at("_parts", 1)).when(F.col("_cc") == "JP", F.col("_raw")).otherwise(F.array_join("_parts", ", "))
    d = d.withColumn("_scope", scope).withColumn("_postal", postal_code(F.col("_scope"), F.col("_cc")))
    d = d.withColumn("_rest", F.when(F.col("_postal").isNull(), F.col("_scope")).otherwise(tidy(cut_first(F.col("_scope"), F.col("_postal")))))
    d = d.withColumn("_in", _segments(F.col("_rest")))
    # United States and Canada: the right-most segment with a state's letters.
    letters = lambda t: F.regexp_replace(F.upper(t), "[^A-Z]", "")
    state_of = lambda s: F.get(F.filter(F.transform(F.split(s, r"\s+"), letters), lambda t: F.when(F.col("_cc") == "US", t.isin(*STATES)).otherwise(t.isin(*PROVINCES))), F.lit(0))
    d = d.withColumn("_states", F.when(F.col("_cc").isin("US", "CA"), F.transform("_in", state_of)))
    d = d.withColumn("_k", F.array_max(F.transform("_states", lambda s, i: F.when(s.isNotNull(), i)))).withColumn("_state", at("_states", F.col("_k")))
    d = d.withColumn("_town", F.when(F.col("_k").isNotNull(), text_or_null(tidy(cut_first(at("_in", F.col("_k")), F.col("_state"))))))
    n, k = F.size("_in"), F.col("_k")
    first = lambda a, m: F.slice(a, F.lit(1), m)
    na_city = F.when(F.col("_town").isNotNull(), F.col("_town")).when(k >= 2, at("_in", k - 1)).when(k.isNull(), at("_in", 1))
    na_street = (
        F.when(F.col("_town").isNotNull(), _join(first("_in", F.greatest(k, F.lit(0))))).when(k >= 2, _join(first("_in", F.greatest(k - 1, F.lit(0))))).when(k == 1, at("_in", 0)).when(k.isNull() & (n > 2), F.concat_ws(", ", at("_in", 0), F.array_join(F.slice("_in", F.lit(3), F.greatest(n - 2, F.lit(0))), ", "))).when(k.isNull(), at("_in", 0))
    )
    # By position: a country at the end isn't a part.
    last_in = country_code(F.get("_in", n - 1))
    d = d.withColumn("_pos", F.when(F.col("_cc").isNotNull() & (n > 1) & last_in.eqNullSafe(F.col("_cc")), F.slice("_in", F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.col("_in")))
    m = F.size("_pos")
    any_street = F.when(m == 0, text_or_null(F.col("_rest"))).when(m >= 4, F.concat_ws(", ", at("_pos", 0), F.array_join(F.slice("_pos", F.lit(4), F.greatest(m - 3, F.lit(0))), ", "))).otherwise(at("_pos", 0))
    # Japan: prefecture, city, street.
    d = d.withColumn("_pref", F.when(F.col("_cc") == "JP", text_or_null(F.regexp_extract("_rest", "^[^都道府県]*[都道府県]", 0))))
    d = d.withColumn("_jp", F.when(F.col("_pref").isNull(), F.col("_rest")).otherwise(F.trim(F.expr("substring(_rest, length(_pref) + 1)"))))
    d = d.withColumn("_ward", F.when(F.col("_pref").isNotNull(), text_or_null(F.regexp_extract("_jp", "^[^市区町村]*[市区町村]", 0))))
    jp_street = text_or_null(F.when(F.col("_ward").isNull(), F.col("_jp")).otherwise(F.trim(F.expr("substring(_jp, length(_ward) + 1)"))))
    de_extra = F.array_join(F.slice("_parts", F.lit(3), F.greatest(F.size("_parts") - 2, F.lit(0))), ", ")
    cc, north, german = F.col("_cc"), F.col("_cc").isin("US", "CA"), F.col("_cc").isin("DE", "AT")
    pick = lambda us, de, gb, jp, other: F.when(north, us).when(german, de).when(cc == "GB", gb).when(cc == "JP", jp).otherwise(other)
    none = F.lit(None).cast("string")
    made = settled(
        pick(na_street, at("_parts", 0), at("_in", 0), jp_street, any_street).alias("address_street"),
        pick(na_city, text_or_null(F.col("_rest")), at("_in", 1), F.col("_ward"), F.when(m >= 2, at("_pos", 1))).alias("address_city"),
        pick(F.col("_state"), F.when((de_extra != "") & ~de_extra.rlike(r"\s"), de_extra), none, F.col("_pref"), F.when(m >= 3, at("_pos", 2))).alias("address_state"),
        F.col("_postal").alias("address_postal"),
        cc.alias("address_country"),
    )
    return d.select(*df.columns, made)


def geocode_confidence(accuracy: Column, importance: Column, lat: Column, postal_hit: Column, city_hit: Column) -> Column:
    """by accuracy (or importance), 0.05 more for an equal postal code and for an equal city, at most 1."""
    acc = F.upper(F.coalesce(accuracy, F.lit("")))
    base = ladder(
        [(acc == "EXACT", 1.0), (acc == "ROOFTOP", 0.9), (acc.contains("INTERPOLAT"), 0.75), (acc.contains("CENTER"), 0.6), (acc == "APPROXIMATE", 0.4), (acc == "CENTROID", 0.3), (importance >= 0.5, 0.9), (importance >= 0.2, 0.6)], 0.4
    )
    more = F.coalesce(postal_hit.cast("int"), F.lit(0)) * 0.05 + F.coalesce(city_hit.cast("int"), F.lit(0)) * 0.05
    return F.when(lat.isNull(), 0.0).otherwise(half_up(F.least(F.lit(1.0), base + more), 2))


def confidence_bucket(x: Column) -> Column:
    return ladder([(x.isNull(), "none"), (x >= 1.0, "exact"), (x >= 0.85, "rooftop"), (x >= 0.7, "interpolated"), (x >= 0.55, "center"), (x >= 0.3, "approximate")], "none")


def mock_geocode(key: Column) -> Column:
    """a fixed place for a key: its 31-hash in 32 bits, low half to latitude, high half to longitude."""
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: (acc * 31 + c) % 4294967296)
    return F.struct(half_up(h % 65536 / 65535.0 * 180 - 90, 7).alias("lat"), half_up(F.floor(h / 65536) / 65535.0 * 360 - 180, 7).alias("lng"))
