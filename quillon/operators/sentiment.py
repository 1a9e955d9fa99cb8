"""Sentiment of reviews (F110-F120, A15, A26, A27, T2, T3): a small lexicon with aspects, phrases first.

The lexicon is this package's own: words are grouped by aspect and polarity (-3 to 3). A text's score is the sum of polarities over its
number of words, between -1 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import half_up, ladder

_LEXICON = """
food 0 food dish meal menu bread pizza soup coffee dessert drink|food 2 tasty fresh crispy juicy savory|food 3 delicious superb|food -2 bland stale soggy greasy undercooked|food -3 inedible disgusting
service 0 staff service waiter manager|service 2 friendly helpful polite attentive kind|service 3 outstanding|service -2 rude careless dismissive slow|service -3 hostile insulting
price 0 price cost bill|price 1 cheap affordable|price -1 pricey|price -2 expensive overpriced
cleanliness 2 clean spotless tidy|cleanliness -2 dirty dusty sticky|cleanliness -3 filthy
atmosphere 0 music decor|atmosphere 2 cozy charming lively pleasant|atmosphere -1 loud crowded|atmosphere -2 gloomy
wait 0 wait queue|wait 1 quick prompt|wait -1 late|wait -2 delayed endless
value 1 deal|value 2 worth bargain great good|value -2 bad poor disappointing waste|value -3 scam worthless
location 0 location parking street|location 1 central nearby near|location 2 convenient|location -1 remote
"""
LEXICON = [(word, aspect, int(p)) for line in _LEXICON.strip().replace("\n", "|").split("|") for aspect, p, *words in [line.split()] for word in words]
PHRASES = [("worth every penny", "value", 3), ("would not recommend", "value", -3), ("waste of time", "wait", -3), ("tourist trap", "atmosphere", -3), ("never again", "service", -3), ("must try", "food", 3), ("worth it", "value", 2), ("on time", "wait", 2)]
TOKEN = r"[a-z0-9][a-z0-9'-]*"


def label(score: Column) -> Column:
    return ladder([(score >= 0.5, "very_positive"), (score >= 0.1, "positive"), (score <= -0.5, "very_negative"), (score <= -0.1, "negative")], "neutral")


def expected(rating: Column) -> Column:
    return F.coalesce((F.greatest(F.lit(1.0), F.least(F.lit(5.0), rating)) - 3) / 2, F.lit(0.0))


def volume(n: Column) -> Column:
    return ladder([(n >= 100, "very_high"), (n >= 20, "high"), (n >= 5, "medium")], "low")


def consistency(rating: Column, score: Column) -> Column:
    off = F.abs(score - expected(rating))
    return ladder([(rating.isNull(), "unknown"), (off < 0.3, "consistent"), (off < 0.6, "mismatch")], "severe_mismatch")


def hits(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """F110, F111: (key, word, aspect, polarity) for each phrase or word of the lexicon in a text, phrases (longest first) before words, no place twice."""
    spark: SparkSession = df.sparkSession
    rest, found = F.lower(F.coalesce(F.col(text), F.lit(""))), df.select(key, F.col(text).alias("_text"))
    step = found.withColumn("_rest", F.lower(F.coalesce("_text", F.lit(""))))
    del rest
    for k, (phrase, _, _) in enumerate(sorted(PHRASES, key=lambda p: (-len(p[0]), p[0]))):
        bounded = rf"(?<!\S){phrase}(?!\S)"
        step = step.withColumn(f"_p{k}", F.regexp_count("_rest", F.lit(bounded))).withColumn("_rest", F.regexp_replace("_rest", bounded, " \u0001 "))
    counted = [F.struct(F.lit(p).alias("word"), F.col(f"_p{k}").alias("n")) for k, (p, _, _) in enumerate(sorted(PHRASES, key=lambda p: (-len(p[0]), p[0])))]
    many = F.flatten(F.transform(F.filter(F.array(*counted), lambda c: c["n"] > 0), lambda c: F.array_repeat(c["word"], c["n"])))
    words = step.select(key, F.explode(F.concat(many, F.regexp_extract_all("_rest", F.lit(TOKEN), F.lit(0)))).alias("word"))
    table = spark.createDataFrame([(w, a, p) for w, a, p in [*LEXICON, *PHRASES]], "word string, aspect string, polarity int")
    return words.join(F.broadcast(table), "word").select(key, "word", "aspect", "polarity")  # the lexicon: under 200 rows


def text_scores(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """F113: (key, n_words, score): sum of polarities over words, within -1 and 1."""
    polarity = hits(df, key, text).groupBy(key).agg(F.sum("polarity").alias("total"))
    words = df.select(key, F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))).alias("n_words"))
    score = F.when(F.col("n_words") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("total", F.lit(0)) / F.col("n_words")))).otherwise(0.0)
    return words.join(polarity, key, "left").select(key, "n_words", score.alias("score"))


def aspects(df: DataFrame, key: str, text: str = "text", top: int = 4) -> DataFrame:
    """F117, F120, A26, A27, T2: (key, aspect, mentions, score, label, keywords): tanh of polarity over three times the words that have one; most frequent words, ties by word."""
    by_word = hits(df, key, text).groupBy(key, "aspect", "word").agg(F.count(F.lit(1)).alias("n"), F.first("polarity").alias("p"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "word")))
    g = by_word.groupBy(key, "aspect").agg(F.sum("n").alias("mentions"), F.sum(F.col("n") * F.col("p")).alias("total"), F.sum(F.when(F.col("p") != 0, F.col("n")).otherwise(0)).alias("charged"), listed.alias("l"))
    score = F.when(F.col("charged") > 0, F.tanh(F.col("total") / (F.col("charged") * 3.0))).otherwise(0.0)
    return g.withColumn("s", score).select(key, "aspect", "mentions", half_up(F.col("s"), 3).alias("score"), label(F.col("s")).alias("label"), F.array_join(F.transform(F.slice("l", 1, top), lambda x: x["word"]), "|").alias("keywords"))


def themes(found: DataFrame, key: str) -> DataFrame:
    """F120: a map from aspect to score by key."""
    return found.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("aspect", "score")))).alias("themes"))


def keyword_ranks(df: DataFrame, key: str, text: str = "text", top: int = 5) -> DataFrame:
    """Strongest, then most frequent positive and negative words by key (ties by word)."""
    by_word = hits(df, key, text).filter("polarity <> 0").groupBy(key, "word", "polarity").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key, F.col("polarity") > 0).orderBy(F.desc(F.abs("polarity")), F.desc("n"), "word")
    best = by_word.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("r", "word")))), lambda x: x["word"]), "|")
    return best.groupBy(key).agg(listed(F.col("polarity") > 0).alias("positive"), listed(F.col("polarity") < 0).alias("negative"))


def review_sentiment(reviews: DataFrame, owners: DataFrame) -> DataFrame:
    """F114-F119: a row per owner. reviews: review_id, owner, text; owners: owner, rating, reviews_count. Score is the mean of the reviews' scores."""
    real = reviews.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    scored = text_scores(real, "review_id").join(real.select("review_id", "owner", (F.size(F.split(F.trim("text"), r"\s+")) < 6).alias("short")), "review_id")
    by = scored.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.min("short").alias("all_short"))
    d = owners.join(by, "owner", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    d = d.withColumn("mean", F.coalesce("mean", F.lit(0.0))).withColumn("fit", F.when(F.col("n") == 0, "unknown").otherwise(consistency(F.col("rating"), F.col("mean"))))
    count = F.when(F.col("n") == 0, F.coalesce("reviews_count", F.lit(0))).otherwise(F.coalesce("reviews_count", F.col("n")))
    codes = [
        F.when(F.col("n") == 0, "no_reviews"), F.when(F.col("fit") == "severe_mismatch", "rating_review_mismatch_high"), F.when(F.col("fit") == "mismatch", "rating_review_mismatch"), F.when((F.col("rating") >= 4.8) & (count <= 5), "extreme_rating_low_volume"),
        F.when((F.col("n") > 0) & F.col("all_short") & (F.col("mean") > 0.2) & (count <= 5), "uniformly_perfect_reviews"),
    ]
    return d.select(
        "owner", F.col("n").alias("reviews"), half_up(F.col("mean"), 3).alias("score"), label(F.col("mean")).alias("label"), F.when(F.col("n") == 0, "low").otherwise(volume(F.coalesce("reviews_count", F.col("n")))).alias("volume"),
        half_up(expected(F.col("rating")), 3).alias("expected"), F.col("fit").alias("consistency"), F.array_join(F.array_compact(F.array(*codes)), "|").alias("anomalies"),
    )
