"""Phone numbers (F30-F37, A10): digits of several scripts, extensions, validity, E.164, type, display.

There is no library of numbering plans here, so the rules are the North American plan and a table of calling codes with the lengths of
national numbers; a number under another code is valid by its length and of unknown type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import lookup, settled, text_or_null

_SCRIPTS = [0x0660, 0x06F0, 0x0966, 0x09E6]
FOREIGN_DIGITS = "".join(chr(base + d) for base in _SCRIPTS for d in range(10))
TOLL_FREE = "800 833 844 855 866 877 888".split()
#: calling code, country, least and most digits of a national number
_PLANS = """
20 EG 8 10,27 ZA 9 9,30 GR 10 10,31 NL 9 9,32 BE 8 9,33 FR 9 9,34 ES 9 9,36 HU 8 9,39 IT 6 11,40 RO 9 9,41 CH 9 9,43 AT 7 13,44 GB 9 10,45 DK 8 8,46 SE 7 10,47 NO 8 8,48 PL 9 9,49 DE 6 11,
51 PE 8 9,52 MX 10 10,54 AR 10 11,55 BR 10 11,56 CL 9 9,57 CO 10 10,60 MY 8 10,61 AU 9 9,62 ID 8 12,63 PH 8 10,64 NZ 8 10,65 SG 8 8,66 TH 8 9,7 RU 10 10,81 JP 9 10,82 KR 8 10,84 VN 9 10,86 CN 10 11,
90 TR 10 10,91 IN 10 10,92 PK 9 10,351 PT 9 9,353 IE 7 9,358 FI 6 11,380 UA 9 9,420 CZ 9 9,852 HK 8 8,886 TW 8 9,966 SA 8 9,971 AE 8 9,972 IL 8 9
"""
PLANS = [(code, country, int(low), int(high)) for code, country, low, high in (x.split() for x in _PLANS.replace("\n", "").strip(",").split(","))]
#: At the end: a mark, then one to seven digits.
EXTENSION = r"(?i)^(.*?)(?:\s*(?:extension|ext\.?|ex\.?|x|#|;|,)\s*)(\d{1,7})\s*$"
NANP = r"^[2-9]\d{2}[2-9]\d{6}$"


def plain_digits(raw: Column) -> Column:
    return F.translate(raw, FOREIGN_DIGITS, "0123456789" * len(_SCRIPTS))


def strip_other(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^0-9+().\-\sa-zA-Z#;,]", "")


def split_extension(raw: Column) -> Column:
    """struct(phone, extension)."""
    ext = text_or_null(F.regexp_extract(raw, EXTENSION, 2))
    return F.struct(F.trim(F.when(ext.isNull(), raw).otherwise(F.regexp_extract(raw, EXTENSION, 1))).alias("phone"), ext.alias("extension"))


def default_region(option: str | None, *fields: Column) -> Column:
    """the option, else the first field that is filled, in capitals."""
    return F.upper(F.coalesce(F.lit(option), *[text_or_null(f) for f in fields]))


def with_phones(df: DataFrame, raw: str = "phone", region: str = "US") -> DataFrame:
    """df and phone_e164, phone_type, phone_country, phone_valid, phone_national, phone_extension; type and validity are null without a phone.

    Step by step, so that no expression is worked out twice.
    """
    blank = F.coalesce(F.trim(F.col(raw)) == "", F.lit(True))
    own = next((p for p in PLANS if p[1] == region), None)
    steps = df.withColumn("_split", split_extension(strip_other(plain_digits(F.col(raw)))))
    steps = steps.withColumn("_part", F.regexp_extract(F.col("_split.phone"), r"[+0-9].*", 0))
    steps = steps.withColumn("_plus", F.col("_part").startswith("+")).withColumn("_digits", F.regexp_replace("_part", r"[^0-9]", ""))
    nanp = F.when(F.col("_plus"), F.col("_digits").startswith("1")).otherwise(F.lit(region in ("US", "CA")))
    national = F.when(F.col("_plus") | (F.length("_digits") == 11) & F.col("_digits").startswith("1"), F.substring("_digits", 2, 20)).otherwise(F.col("_digits"))
    known = {code: code for code, _, _, _ in PLANS}
    code = F.coalesce(*[lookup(known, F.substring("_digits", 1, n)) for n in (3, 2, 1)])
    other = F.when(F.col("_plus"), code)
    if own is not None:
        other = F.coalesce(other, F.when(~F.col("_plus"), F.lit(own[0])))
    steps = steps.withColumn("_nanp", nanp & (F.col("_digits") != "")).withColumn("_code", F.when(~F.col("_nanp"), other))
    rest = F.when(F.col("_plus"), F.expr("substring(_digits, length(_code) + 1)")).otherwise(F.regexp_replace("_digits", "^0", ""))
    steps = steps.withColumn("_nat", F.when(F.col("_nanp"), national).otherwise(rest))
    country = lookup({code: name for code, name, _, _ in PLANS}, F.col("_code"))
    fits = F.length("_nat").between(lookup({p[0]: p[2] for p in PLANS}, F.col("_code")), lookup({p[0]: p[3] for p in PLANS}, F.col("_code")))
    valid = F.when(F.col("_nanp"), F.col("_nat").rlike(NANP)).otherwise(F.coalesce(fits, F.lit(False)))
    steps = steps.withColumn("phone_valid", F.when(~blank, valid))
    kind = (
        F.when(~F.col("phone_valid"), "invalid").when(F.col("_nanp") & F.substring("_nat", 1, 3).isin(*TOLL_FREE), "toll_free").when(F.col("_nanp") & F.col("_nat").startswith("900"), "unknown").when(F.col("_nanp"), "landline").otherwise("unknown")
    )
    made = settled(
        F.when(F.col("phone_valid"), F.concat(F.lit("+"), F.when(F.col("_nanp"), F.lit("1")).otherwise(F.col("_code")), F.col("_nat"))).alias("phone_e164"),
        F.when(~blank, kind).alias("phone_type"),
        F.when(~blank, F.coalesce(F.when(F.col("_nanp"), F.lit("CA" if region == "CA" else "US")), country, F.lit(region))).alias("phone_country"),
        F.col("phone_valid"),
        F.when(~blank, text_or_null(F.col("_nat"))).alias("phone_national"),
        F.when(~blank, F.col("_split.extension")).alias("phone_extension"),
    )
    return steps.select(*df.columns, made)


def for_dialing(e164: Column) -> Column:
    """struct(international, national) of a North American number; others keep their E.164 form."""
    nanp, cut = e164.rlike(r"^\+1\d{10}$"), lambda shape: F.regexp_replace(e164, r"^\+1(\d{3})(\d{3})(\d{4})$", shape)
    return F.struct(F.when(nanp, cut("+1 $1 $2 $3")).otherwise(e164).alias("international"), F.when(nanp, cut("($1) $2-$3")).alias("national"))


def phones_match(a: Column, b: Column, raw_a: Column, raw_b: Column) -> Column:
    """by E.164 where both have it, else by their digits; never null."""
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), a == b).when((raw_a != "") & (raw_b != ""), digits(raw_a) == digits(raw_b)), F.lit(False))
