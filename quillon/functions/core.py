"""Coercions, rounding and small scalar rules shared by the operators. All are plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity (not away from zero), as a double."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def text_or_null(x: Column) -> Column:
    return F.when(x != "", x)


def filled(x: Column) -> Column:
    return x.isNotNull() & (x.cast("string") != "")


def to_number(x: Column) -> Column:
    """A finite double or null."""
    value = F.expr("cast(null as double)") if x is None else x.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_int(x: Column) -> Column:
    return to_number(x).cast("bigint")


def to_bool(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bands(x: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step (limit, value) whose limit x reaches, else the last; null x gives the last."""
    out = F.when(x >= steps[0][0], F.lit(steps[0][1]))
    for limit, value in steps[1:]:
        out = out.when(x >= limit, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def ladder(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, value in cases[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def settled(*columns: Column) -> Column:
    """The named columns as one generator. Filters on them stay above it: pushed below, they would repeat long expressions many times over."""
    return F.inline(F.array(F.struct(*columns)))


def lookup(table: dict[str, object], key: Column) -> Column:
    """The table's value for a key, null for others. A literal map, as one expression."""
    show = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.try_element_at(F.expr("map(" + ", ".join(f"{show(k)}, {show(v)}" for k, v in table.items()) + ")"), key)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: The same in SQL, for the oracles.
def haversine_sql(a: str, b: str) -> str:
    h = f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)"
    return f"(2 * 6371.0 * asin(least(1.0, sqrt({h}))))"
