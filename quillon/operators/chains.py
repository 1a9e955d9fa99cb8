"""Chains by name (F66, F67, F135): a catalogue of brands, whole words first, then parts of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import settled

#: id ; shown name ; whole words ; parts. Words and parts are in normal form.
_BRANDS = """
mcdonalds;McDonald's;mcdonald,mcdonalds;golden arches,mickey ds,micky ds
starbucks;Starbucks;starbucks;starbucks reserve
subway;Subway;subway;
7eleven;7-Eleven;seven eleven,7 eleven,7eleven;7 11
dunkin;Dunkin';dunkin;dunkin donuts
wendys;Wendy's;wendy,wendys;
chipotle;Chipotle;chipotle;chipotle mexican grill
target;Target;target;
walmart;Walmart;wal mart,walmart;supercenter
costco;Costco;costco;costco wholesale
wholefoods;Whole Foods Market;wholefoods,whole foods;whole food
"""
CATALOGUE = [tuple(line.split(";")) for line in _BRANDS.strip().splitlines()]


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "['‘’`]", ""), r"[^a-z0-9\s]", " "), r"\s+", " "))


def chain(name: Column, catalogue: list[tuple[str, str, str, str]] = CATALOGUE) -> Column:
    """struct(chain_id, chain_name, confidence), null for no chain. A whole word (1.0) of any brand beats a part (0.9); brands in order.

    The normal form is a lambda's variable, so that it is worked out once a row and not once a brand.
    """

    def found(plain: Column) -> Column:
        cases = []
        for key, shown, words, _ in catalogue:
            cases.append((plain.rlike(rf"(^|\s)({words.replace(',', '|')})(\s|$)"), key, shown, 1.0))
        for key, shown, _, parts in catalogue:
            for part in filter(None, parts.split(",")):
                cases.append((plain.contains(part), key, shown, 0.9))
        out = None
        for test, key, shown, sure in cases:
            value = F.struct(F.lit(key).alias("chain_id"), F.lit(shown).alias("chain_name"), F.lit(sure).alias("confidence"))
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    return F.transform(F.array(normal_name(name)), found)[0]


def chain_groups(df: DataFrame, name: str = "name", key: str = "place_id") -> DataFrame:
    """Listings and their ids by chain."""
    found = df.select(key, settled(chain(F.col(name)).alias("c"))).filter("c is not null")
    return found.groupBy(F.col("c.chain_id").alias("chain_id"), F.col("c.chain_name").alias("chain_name")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("listings"))


PLAIN_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[''‘’`]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _case(field: int, otherwise: str = "NULL") -> str:
    """SQL for a field of the chain: 0 id, 1 name, 2 confidence."""
    tests = [(f"regexp_matches({PLAIN_SQL}, '(^|\\s)({w.replace(',', '|')})(\\s|$)')", (k, s, 1.0)) for k, s, w, _ in CATALOGUE]
    tests += [(f"contains({PLAIN_SQL}, '{p}')", (k, s, 0.9)) for k, s, _, parts in CATALOGUE for p in filter(None, parts.split(","))]
    show = lambda v: f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {t} THEN {show(v[field])}" for t, v in tests) + f" ELSE {otherwise} END"


CHAIN_SQL, CHAIN_NAME_SQL, CHAIN_CONFIDENCE_SQL = _case(0), _case(1), _case(2)
