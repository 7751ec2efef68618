"""What a book costs to read aloud, and how long it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# US dollars per character in two price lists, which disagree on one model.
PRICES = [
    ("per_1k", "gpt-4o-mini-tts", 0.015 / 1000),
    ("per_1k", "tts-1", 0.015 / 1000),
    ("per_1k", "tts-1-hd", 0.030 / 1000),
    ("per_1m", "gpt-4o-mini-tts", 12.0 / 1_000_000),
    ("per_1m", "tts-1", 15.0 / 1_000_000),
    ("per_1m", "tts-1-hd", 30.0 / 1_000_000),
    ("local", "local", 0.0),
]
FALLBACK = {"per_1k": 0.015 / 1000, "per_1m": 12.0 / 1_000_000, "local": 0.0}
WORDS_PER_MINUTE = 150


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "profile string, model string, usd_per_char double")


def priced(rows: DataFrame, profile: str, model_col: str = "model") -> DataFrame:
    """Adds usd_per_char; unknown models have the list's fallback. The price list is the constant above, so it is broadcast."""
    prices = F.broadcast(pricing(rows.sparkSession).where(F.col("profile") == profile).select(F.col("model").alias(model_col), "usd_per_char"))
    return rows.join(prices, model_col, "left").withColumn("usd_per_char", F.coalesce("usd_per_char", F.lit(FALLBACK[profile])))


def listening_seconds(words: Column) -> Column:
    return words / F.lit(WORDS_PER_MINUTE) * F.lit(60.0)


def reading_minutes(chars: Column) -> Column:
    """A thousand characters a minute, to a tenth."""
    return F.bround(chars / F.lit(1000.0), 1)


def book_costs(chapters: DataFrame, extra_chars: int = 0, announce: bool = True) -> DataFrame:
    """(book_id, total_chars, total_words, usd, extra_chars, extra_usd) of chapters with usd_per_char.

    Extra are the given characters and, where chapters are announced, each title and ten characters.
    """
    announced = F.sum(F.length("title") + 10) if announce else F.lit(0)
    sums = chapters.groupBy("book_id", "usd_per_char").agg(F.sum("char_count").alias("total_chars"), F.sum("word_count").alias("total_words"), (announced + extra_chars).cast("long").alias("extra_chars"))
    return sums.select("book_id", "total_chars", "total_words", (F.col("total_chars") * F.col("usd_per_char")).alias("usd"), "extra_chars", (F.col("extra_chars") * F.col("usd_per_char")).alias("extra_usd"))


def cost_rollup(chapters: DataFrame, *levels: str) -> DataFrame:
    """Characters and dollars at every level of the given columns, with the level's number (0: the finest)."""
    return chapters.rollup(*levels).agg(F.grouping_id().alias("level"), F.sum("char_count").alias("chars"), F.sum(F.col("char_count") * F.col("usd_per_char")).alias("usd"))
