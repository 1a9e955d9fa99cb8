"""Operator 9: repeat documents so that sources reach target weights.

Tokens (runs of non-white-space) are summed per source; a source's repetition rate is its target weight times the total
tokens wanted, over its own tokens; each document comes out floor(rate) times, and once more if a draw in [0, 1) seeded by a
hash of its id falls under the rate's fraction. The draw is md5-based: the same in every run, engine and partitioning.

Default weights are proportional to tokens ** alpha, which lifts small sources and holds back a hot one.

Results: a null source is a source of its own, a null id draws as the empty string. Repeated rows, and rows with equal
ids, make the same draw, each for itself. A source without tokens (empty or null texts only) has rate 1: nothing can be
reached by repeating it. Weights given explicitly are normalised; a source that they don't name has weight 0 and goes.
Extra columns are kept, clashing helper names avoided; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, small_enough

ALPHA, SEED = 0.5, "mix-1"
#: Sources up to this number are sent to every executor (some 20 bytes each and the name); more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 32 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def repetition_rates(df: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, total: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """A row per source: tokens, weight, rate. total: tokens wanted (as many as there are, if None)."""
    sums = df.groupBy(F.col(source).alias("source")).agg(F.sum(tokens(F.col(text))).alias("tokens"))
    sums = checkpoint(sums)
    if weights is None:
        raw = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
        raw = F.when(F.col("tokens") > 0, raw).otherwise(0.0)
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    weighed = sums.withColumn("raw", raw)
    whole = weighed.agg(F.sum("raw").alias("raw_sum"), F.sum("tokens").alias("token_sum"))
    wanted = F.lit(float(total)) if total is not None else F.col("token_sum").cast("double")
    weight = F.try_divide(F.col("raw"), F.col("raw_sum"))
    rate = F.when(F.col("tokens") > 0, F.coalesce(weight, F.lit(0.0)) * wanted / F.col("tokens")).otherwise(F.lit(1.0))
    return weighed.crossJoin(F.broadcast(whole)).select("source", "tokens", weight.alias("weight"), rate.alias("rate"))  # whole: one row


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, total: float | None = None, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    name, rate, copies, copy = fresh(df, "mix_source", "rate", "copies", "copy")
    rates = repetition_rates(df, weights, alpha, total, source, text).select(F.col("source").alias(name), F.col("rate").alias(rate))
    if small_enough(rates, BROADCAST_SOURCES):
        rates = F.broadcast(rates)
    whole = F.floor(F.col(rate))
    n = (whole + F.when(draw(F.col(doc_id), seed) < F.col(rate) - whole, 1).otherwise(0)).cast("int")
    return (
        df.join(rates, F.col(source).eqNullSafe(F.col(name)))
        .withColumn(copies, n)
        .filter(F.col(copies) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*[f"`{c}`" for c in df.columns])
    )


SQL = rf"""
WITH t AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')))::DOUBLE AS tokens FROM documents GROUP BY source),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens, {ALPHA}) ELSE 0 END AS raw FROM t),
r AS (
  SELECT source, CASE WHEN tokens > 0 THEN raw / (SELECT sum(raw) FROM w) * (SELECT sum(tokens) FROM w) / tokens ELSE 1 END AS rate FROM w),
n AS (
  SELECT d.*, floor(rate)::BIGINT
         + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, unnest(range(copies)) AS copy FROM n)
"""
