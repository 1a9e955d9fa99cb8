"""Operator 7: quality rules as a short-circuit cascade.

Each rule is a Spark expression that is true for a text to reject. On a bounded sample (sample_rows, SAMPLE_ROWS by default) each
rule's time a row and the rows that it rejects are measured; rules then run by rejections per cost, best first, where a rule's rejections are counted
among the rows that the rules before it leave, in one CASE expression, so that a text that a rule rejects isn't looked at by the later ones. What is kept doesn't depend
on the order, only the cost does. All of every text is read.

Results: a null text counts as empty, and a text without a word is rejected. The measures are shares of a text's own words or
characters, so long texts are treated like short ones; short clean texts stay, and texts in a language without a list of stop words. Repeated rows get the same verdict each. A measure
exactly at a limit passes. Extra columns are kept whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SAMPLE_ROWS, SAMPLE_SEED = 2000, 7


@dataclass(frozen=True)
class Limits:
    """Shares above which a rule rejects."""

    symbols: float = 0.08  #: characters that are markup symbols
    pipes: float = 0.10  #: bars a word
    capitals: float = 0.50  #: characters that are capitals
    shouting: float = 0.50  #: exclamation marks a word
    adjacent: float = 0.25  #: words equal to the word before
    trigrams: float = 0.40  #: runs of three words that occurred before in the text
    lines: float = 0.50  #: lines that occurred before in the text
    bullets: float = 0.90  #: lines that begin with a bullet
    ellipses: float = 0.30  #: lines that end with an ellipsis
    letterless: float = 0.40  #: words without a letter
    short_words: float = 2.0  #: mean length of a word, at least
    long_words: float = 15.0  #: and at most
    stop_words: int = 2  #: stop words of its language that a text of stop_text words or more needs
    stop_text: int = 50
    least_words: int = 30  #: words (or a tenth of it, lines and adjacent words) that a text needs for its repetitions to count


#: The commonest words by language; other languages have no such rule.
STOP_WORDS = {
    "en": ("the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on", "as", "by"),
    "de": ("der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine", "dem", "als"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "est", "pour", "au", "il", "elle"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "es", "al", "del", "se", "no"),
}


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once though it is used in inner functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _among(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*words)


def rules(text: Column, limits: Limits = Limits(), lang: Column | None = None) -> dict[str, Column]:
    """Each rule, true for a text to reject, never null. Without a language there is no rule on stop words."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n_words = F.regexp_count(text, F.lit(r"\S+"))
    size = F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, "\n")
    few = max(1, limits.least_words // 10)

    def adjacent(w: Column) -> Column:
        return (F.size(w) >= few) & (F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))) > limits.adjacent * F.size(w))

    def trigrams(w: Column) -> Column:
        n = F.size(w) - 2
        threes = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return (F.size(w) >= limits.least_words) & (n - F.size(F.array_distinct(threes)) > limits.trigrams * n)

    def repeated(x: Column) -> Column:
        return (F.size(x) >= few) & (F.size(x) - F.size(F.array_distinct(x)) > limits.lines * F.size(x))

    def stops(w: Column) -> Column:
        found = F.lit(False)
        for name, stop in STOP_WORDS.items():
            found = F.when(F.coalesce(lang, F.lit("")) == name, F.size(F.filter(w, _among(stop))) < limits.stop_words).otherwise(found)
        return (F.size(w) >= limits.stop_text) & found

    full = F.filter(lines, lambda x: x != "")
    letters = F.length(F.regexp_replace(text, r"\s+", ""))
    by_language = {"stop_words": _let(F.split(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " "), stops)} if lang is not None else {}
    return {
        "no_words": ~text.rlike(r"\S"),
        "symbols": _count(text, "#$%&*{}<>~^=\\@_") > limits.symbols * size,
        "pipes": _count(text, "|") > limits.pipes * n_words,
        "capitals": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")) > limits.capitals * size,
        "shouting": _count(text, "!") > limits.shouting * n_words,
        "adjacent": _let(words, adjacent),
        "lines": _let(full, repeated),
        "trigrams": _let(words, trigrams),
        "bullets": _let(full, lambda x: (F.size(x) >= few) & (F.size(F.filter(x, lambda y: y.rlike(r"^[ \t]*[-*•]"))) > limits.bullets * F.size(x))),
        "ellipses": _let(full, lambda x: (F.size(x) >= few) & (F.size(F.filter(x, lambda y: y.endswith("...") | y.endswith("…"))) > limits.ellipses * F.size(x))),
        "letterless": (n_words >= limits.least_words) & (n_words - F.regexp_count(text, F.lit(r"(?<!\S)[^\s\p{L}]*+\p{L}")) > limits.letterless * n_words),
        "word_length": (n_words >= limits.least_words) & ((letters < limits.short_words * n_words) | (letters > limits.long_words * n_words)),
        **by_language,
    }


def _lang(df: DataFrame, lang: str | None) -> Column | None:
    return F.col(f"`{lang}`") if lang is not None and lang in df.columns else None


def measure(df: DataFrame, text: str = "text", limits: Limits = Limits(), sample_rows: int = SAMPLE_ROWS, lang: str | None = "lang") -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share of the sample that it rejects after the rules before it), in the order in which the cascade runs them."""
    total = df.count()
    given = _lang(df, lang)
    column = df.select(F.col(f"`{text}`").alias("text"), *([given.alias("lang")] if given is not None else []))
    each = rules(F.col("text"), limits, F.col("lang") if given is not None else None)
    if not total:
        return [(name, 0.0, 0.0) for name in each]
    sample = checkpoint(column.sample(min(1.0, sample_rows / total), SAMPLE_SEED).coalesce(8))

    def timed(expression: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.sum(expression.cast("int"))).head()
            best = min(best, time.perf_counter() - began)
        return best

    # Which rules reject a row: at most sample_rows kinds of rows.
    kinds = sample.groupBy(*[rule.alias(name) for name, rule in each.items()]).count().collect()
    rows = max(1, sum(k["count"] for k in kinds))
    idle = timed(F.length("text") < 0)
    cost = {name: max(timed(rule) - idle, 1e-4) / rows for name, rule in each.items()}
    found, left = [], dict(cost)
    while left:
        gain = {name: sum(k["count"] for k in kinds if k[name]) / rows for name in left}
        best = max(left, key=lambda name: (gain[name] / cost[name], -cost[name]))
        found.append((best, left.pop(best), gain[best]))
        kinds = [k for k in kinds if not k[best]]
    return found


def first_failure(text: Column, order: list[str], limits: Limits = Limits(), lang: Column | None = None) -> Column:
    """The first rule, in this order, that rejects; null for a text to keep. Later rules aren't evaluated."""
    each = rules(text, limits, lang)
    out = F.when(each[order[0]], F.lit(order[0]))
    for name in order[1:]:
        out = out.when(each[name], F.lit(name))
    return out


def quality_filter(df: DataFrame, text: str = "text", limits: Limits = Limits(), sample_rows: int = SAMPLE_ROWS, lang: str | None = "lang") -> DataFrame:
    """The rows whose text no rule rejects."""
    order = [name for name, _, _ in measure(df, text, limits, sample_rows, lang)]
    return df.filter(first_failure(F.col(f"`{text}`"), order, limits, _lang(df, lang)).isNull())


def _sql() -> str:
    at = Limits()
    few = max(1, at.least_words // 10)
    stops = " ".join(f"WHEN '{name}' THEN len([x for x in words if lower(x) IN {stop}]) < {at.stop_words}" for name, stop in STOP_WORDS.items())
    return rf"""
WITH a AS (
  SELECT *, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS flat FROM documents),
b AS (
  SELECT *, string_split(flat, ' ') AS words, greatest(length(t), 1) AS size,
         list_filter(string_split(t, chr(10)), lambda x: x <> '') AS lines FROM a),
c AS (
  SELECT *, len(words) AS n,
         [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] AS threes FROM b)
SELECT doc_id, text, lang, source, n_chars FROM c
WHERE flat <> ''
  AND NOT (length(t) - length(regexp_replace(t, '[#$%&*{{}}<>~^=\\@_]', '', 'g')) > {at.symbols} * size)
  AND NOT (length(t) - length(replace(t, '|', '')) > {at.pipes} * n)
  AND NOT (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) > {at.capitals} * size)
  AND NOT (length(t) - length(replace(t, '!', '')) > {at.shouting} * n)
  AND NOT (n >= {few} AND len([i for i in range(2, n + 1) if words[i] = words[i - 1]]) > {at.adjacent} * n)
  AND NOT (len(lines) >= {few} AND len(lines) - len(list_distinct(lines)) > {at.lines} * len(lines))
  AND NOT (n >= {at.least_words} AND n - 2 - len(list_distinct(threes)) > {at.trigrams} * (n - 2))
  AND NOT (len(lines) >= {few} AND len([x for x in lines if regexp_matches(x, '^[ \t]*[-*•]')]) > {at.bullets} * len(lines))
  AND NOT (len(lines) >= {few} AND len([x for x in lines if ends_with(x, '...') OR ends_with(x, '…')]) > {at.ellipses} * len(lines))
  AND NOT (n >= {at.least_words} AND len([x for x in words if NOT regexp_matches(x, '\p{{L}}')]) > {at.letterless} * n)
  AND NOT (n >= {at.least_words} AND (length(regexp_replace(t, '\s', '', 'g')) < {at.short_words} * n OR length(regexp_replace(t, '\s', '', 'g')) > {at.long_words} * n))
  AND NOT (n >= {at.stop_text} AND CASE lang {stops} ELSE false END)
"""


SQL = _sql()
