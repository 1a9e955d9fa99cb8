"""Queries of sentiment (F110-F120, A15, A26, A27, T2, T3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import half_up
from ..operators import sentiment
from ..sources.listings import listings
from .registry import query

_LEX = "LEX(word, aspect, polarity) AS (VALUES " + ", ".join(f"('{w}', '{a}', {p})" for w, a, p in [*sentiment.LEXICON, *sentiment.PHRASES]) + ")"
_PHRASES = sorted(sentiment.PHRASES, key=lambda p: (-len(p[0]), p[0]))
#: sentences that the documents (made-up words) and conversations hardly have, added by key
_ADDED = ["The staff was friendly, never again.", "worth every penny worth it worth it", "Dirty, overpriced and bland. A tourist trap", "must try must try: delicious!", "", "on time and not-so slow; good value"]


def hits_sql(source: str) -> str:
    """CTEs that end in H(key, word, aspect, polarity) for a source with key and text. White space is widened, so that each phrase has its own edges."""
    steps, last = [], f"T0 AS (SELECT key, ' ' || regexp_replace(lower(coalesce(text, '')), '(\\s)', ' \\1 ', 'g') || ' ' AS t FROM {source})"
    steps.append(last)
    for i, (p, _, _) in enumerate(_PHRASES):
        wide = " " + p.replace(" ", "   ") + " "
        steps.append(f"T{i + 1} AS (SELECT *, ((length(t{i or ''}) - length(replace(t{i or ''}, '{wide}', ''))) // {len(wide)}) AS c{i}, replace(t{i or ''}, '{wide}', '  ~  ') AS t{i + 1} FROM T{i})")
    n = len(_PHRASES)
    lists = " || ".join(f"list_transform(range(c{i}), lambda x: '{p}')" for i, (p, _, _) in enumerate(_PHRASES))
    steps.append(f"TW AS (SELECT key, unnest(({lists}) || regexp_extract_all(t{n}, '[a-z0-9][a-z0-9''-]*')) AS word FROM T{n})")
    steps.append("H AS (SELECT key, TW.word, aspect, polarity FROM TW JOIN LEX ON TW.word = LEX.word)")
    return f"{_LEX}, " + ", ".join(steps)


_CASE = "CASE {k} % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ADDED)) + " END"
_DOCS_SQL = f"SRC AS (SELECT doc_id AS key, text || chr(10) || {_CASE.format(k='doc_id')} AS text FROM documents)"
_LABEL = "CASE WHEN {s} >= 0.5 THEN 'very_positive' WHEN {s} >= 0.1 THEN 'positive' WHEN {s} <= -0.5 THEN 'very_negative' WHEN {s} <= -0.1 THEN 'negative' ELSE 'neutral' END"


def _added(k: str):
    return F.element_at(F.array(*[F.lit(x) for x in _ADDED]), (F.col(k) % 6 + 1).cast("int"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), F.concat("text", F.lit("\n"), _added("doc_id")).alias("text"))


@query(f"WITH {_DOCS_SQL}, {hits_sql('SRC')} SELECT key, word, aspect, polarity, count(*)::BIGINT AS n FROM H GROUP BY ALL")
def sentiment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F110-F112: words and phrases of the lexicon in each text."""
    return sentiment.hits(_docs(spark, sf_dir), "key").groupBy("key", "word", "aspect", "polarity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_DOCS_SQL}, {hits_sql('SRC')}, A AS (SELECT key, aspect, word, count(*) AS n, any_value(polarity) AS p FROM H GROUP BY ALL),
S AS (SELECT key, aspect, sum(n)::BIGINT AS mentions, CASE WHEN coalesce(sum(n) FILTER (WHERE p <> 0), 0) > 0 THEN tanh(sum(n * p)::DOUBLE / (sum(n) FILTER (WHERE p <> 0) * 3)) ELSE 0.0 END AS s, array_to_string(list_transform(list_sort(list({{'o': -n, 'w': word}}))[1:4], lambda x: x.w), '|') AS keywords FROM A GROUP BY ALL)
SELECT key, aspect, mentions, floor(s * 1000 + 0.5) / 1000 AS score, {_LABEL.format(s='s')} AS label, keywords FROM S""")
def sentiment_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F117, A26, A27, T2: aspects of each text."""
    return sentiment.aspects(_docs(spark, sf_dir), "key")


@query(f"""WITH {_DOCS_SQL}, {hits_sql('SRC')}, A AS (SELECT key, word, polarity, count(*) AS n FROM H WHERE polarity <> 0 GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY key, polarity > 0 ORDER BY abs(polarity) DESC, n DESC, word) AS r FROM A)
SELECT key, coalesce(string_agg(word, '|' ORDER BY r) FILTER (WHERE polarity > 0), '') AS positive, coalesce(string_agg(word, '|' ORDER BY r) FILTER (WHERE polarity < 0), '') AS negative FROM R WHERE r <= 5 GROUP BY key""")
def sentiment_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest words of each text."""
    return sentiment.keyword_ranks(_docs(spark, sf_dir), "key")


#: reviews: the user turns of conversations and a sentence; owners: conversations with a rating
_REVIEW_SQL = f"""RV AS (SELECT conv_id * 1000 + turn AS key, conv_id AS owner, CASE WHEN turn % 4 = 3 THEN '  ' ELSE {_CASE.format(k='(turn + conv_id)')} || CASE WHEN conv_id % 3 = 0 THEN ' ' || text ELSE '' END END AS text FROM conversations),
OW AS (SELECT DISTINCT conv_id AS owner, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE 1 + (conv_id % 9) * 0.5 END::DOUBLE AS rating, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 130 END::BIGINT AS reviews_count FROM conversations UNION ALL SELECT -1, 5.0, 2),
OK AS (SELECT * FROM RV WHERE trim(text) <> '')"""
_JUDGED_SQL = f"""{_REVIEW_SQL}, {hits_sql('OK')}, HS AS (SELECT key, sum(polarity) AS p FROM H GROUP BY key), SC AS (SELECT OK.owner, OK.key, length(OK.text) AS l, len(regexp_split_to_array(trim(OK.text, chr(10) || ' '), '\\s+')) < 6 AS short, len(regexp_extract_all(lower(OK.text), '[a-z0-9][a-z0-9''-]*')) AS n, coalesce(p, 0) AS p FROM OK LEFT JOIN HS USING (key)),
BYO AS (SELECT owner, count(*) AS n, avg(CASE WHEN n > 0 THEN greatest(-1.0, least(1.0, p::DOUBLE / n)) ELSE 0.0 END) AS m, bool_and(short) AS all_short FROM SC GROUP BY owner),
J0 AS (SELECT OW.*, coalesce(n, 0)::BIGINT AS n, coalesce(m, 0.0)::DOUBLE AS m, coalesce(all_short, false) AS all_short, coalesce((greatest(1.0, least(5.0, rating)) - 3) / 2, 0.0)::DOUBLE AS e FROM OW LEFT JOIN BYO USING (owner)),
J1 AS (SELECT *, CASE WHEN n = 0 OR rating IS NULL THEN 'unknown' WHEN abs(m - e) < 0.3 THEN 'consistent' WHEN abs(m - e) < 0.6 THEN 'mismatch' ELSE 'severe_mismatch' END AS fit, CASE WHEN n = 0 THEN coalesce(reviews_count, 0) ELSE coalesce(reviews_count, n) END AS c FROM J0),
J AS (SELECT owner, n AS reviews, floor(m * 1000 + 0.5) / 1000 AS score, {_LABEL.format(s='m')} AS label, CASE WHEN n = 0 THEN 'low' WHEN coalesce(reviews_count, n) >= 100 THEN 'very_high' WHEN coalesce(reviews_count, n) >= 20 THEN 'high' WHEN coalesce(reviews_count, n) >= 5 THEN 'medium' ELSE 'low' END AS volume, floor(e * 1000 + 0.5) / 1000 AS expected, fit AS consistency,
  array_to_string(list_filter([CASE WHEN n = 0 THEN 'no_reviews' END, CASE WHEN fit = 'severe_mismatch' THEN 'rating_review_mismatch_high' END, CASE WHEN fit = 'mismatch' THEN 'rating_review_mismatch' END, CASE WHEN rating >= 4.8 AND c <= 5 THEN 'extreme_rating_low_volume' END, CASE WHEN n > 0 AND all_short AND m > 0.2 AND c <= 5 THEN 'uniformly_perfect_reviews' END], lambda x: x IS NOT NULL), '|') AS anomalies FROM J1)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.concat(F.element_at(F.array(*[F.lit(x) for x in _ADDED]), ((F.col("turn") + F.col("conv_id")) % 6 + 1).cast("int")), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" "), "text")).otherwise(""))
    reviews = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"), F.col("conv_id").alias("owner"), F.when(F.col("turn") % 4 == 3, "  ").otherwise(body).alias("text"))
    k = F.col("conv_id")
    owners = c.select("conv_id").distinct().select(k.alias("owner"), F.when(k % 7 != 0, 1 + (k % 9) * 0.5).cast("double").alias("rating"), F.when(k % 5 != 0, k % 130).alias("reviews_count"))
    lone = spark.range(1).select(F.lit(-1).cast("bigint").alias("owner"), F.lit(5.0).alias("rating"), F.lit(2).cast("bigint").alias("reviews_count"))
    return sentiment.review_sentiment(reviews, owners.unionByName(lone))


@query(f"WITH {_JUDGED_SQL} SELECT * FROM J")
def review_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F113-F119: mean score, agreement with the rating, anomalies."""
    return _judged(spark, sf_dir)


@query(f"WITH {_JUDGED_SQL} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE reviews > 0)::BIGINT AS with_reviews, floor(avg(score) FILTER (WHERE reviews > 0) * 1000 + 0.5) / 1000 AS avg_score, {', '.join(f'''count(*) FILTER (WHERE label = '{x}')::BIGINT AS {x}''' for x in ('very_positive', 'positive', 'neutral', 'negative', 'very_negative'))}, sum(CASE WHEN anomalies = '' THEN 0 ELSE len(string_split(anomalies, '|')) END)::BIGINT AS anomalies FROM J")
def sentiment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's labels, mean and anomalies."""
    j = _judged(spark, sf_dir)
    return j.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("reviews") > 0).alias("with_reviews"), half_up(F.avg(F.when(F.col("reviews") > 0, F.col("score"))), 3).alias("avg_score"), *[F.count_if(F.col("label") == x).alias(x) for x in ("very_positive", "positive", "neutral", "negative", "very_negative")],
        F.sum(F.when(F.col("anomalies") == "", 0).otherwise(F.size(F.split("anomalies", r"\|")))).alias("anomalies"),
    )
