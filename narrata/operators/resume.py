"""What is left to do: checkpoints, cached results and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(work: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    """Work that progress (keys, status) doesn't have as completed."""
    done = progress.where(F.col("status") == "completed").select(*keys).distinct()
    return work.join(done, keys, "left_anti")


def valid_progress(progress: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress of books that aren't finished and whose number of chunks (book_id, n_chunks) is still the one it was made with."""
    return progress.join(totals, ["book_id", "n_chunks"], "left_semi")


def cache_lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the cached path of their key and whether there was one; of several entries the first path counts."""
    one = cache.groupBy("cache_key").agg(F.min("path").alias("path"))
    return chunks.join(one, "cache_key", "left").withColumn("hit", F.col("path").isNotNull())


def duplicate_accounting(chunks: DataFrame, by: str) -> DataFrame:
    """(by, chunks, unique_keys, repeats): equal keys are made once."""
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.countDistinct("cache_key").alias("unique_keys")).withColumn("repeats", F.col("chunks") - F.col("unique_keys"))


def batch_summary(results: DataFrame) -> DataFrame:
    """(book_id, total, ok, failed, missing, usable) of results (book_id, chunk_idx, ok)."""
    missing = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("chunk_idx"))))
    return results.groupBy("book_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), missing.alias("missing")).withColumn("usable", F.col("ok") > 0)


def progress_report(totals: DataFrame, done: DataFrame, minutes_each: int = 4) -> DataFrame:
    """(book_id, total, completed, percent, remaining, minutes_left) of totals (book_id, total) and done (book_id, seq); a
    repeated completion counts once."""
    counts = done.select("book_id", "seq").distinct().groupBy("book_id").agg(F.count("*").alias("completed"))
    joined = totals.join(counts, "book_id", "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    left = F.greatest(F.lit(0), F.col("total") - F.col("completed"))
    return joined.select("book_id", "total", "completed", F.coalesce(F.try_divide(F.col("completed") * 100.0, F.col("total")), F.lit(0.0)).alias("percent"), left.alias("remaining"), (left * minutes_each).alias("minutes_left"))
