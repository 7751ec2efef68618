"""Rows that are made of patches: each field has the value of its last writer, in tables and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOB_FIELDS = ["status", "progress", "result", "error_message"]


def job_patch(kind: Column, values: dict[str, Column]) -> Column:
    """The fields (a map of text) that an event of the kind sets: created all, update those of its values that are there,
    completed the status, the progress and the result, failed the status and the error."""
    text = {f: values.get(f, F.lit(None)).cast("string") for f in JOB_FIELDS}
    pairs = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), v))).cast("map<string,string>")
    created = {"status": F.coalesce(text["status"], F.lit("pending")), "progress": F.coalesce(text["progress"], F.lit("0.0")), "result": text["result"], "error_message": text["error_message"]}
    given = F.map_filter(pairs(text), lambda _, v: v.isNotNull())
    return (
        F.when(kind == "created", pairs(created))
        .when(kind == "update", given)
        .when(kind == "completed", pairs({"status": F.lit("completed"), "progress": F.lit("1.0"), "result": text["result"]}))
        .when(kind == "failed", pairs({"status": F.lit("failed"), "error_message": text["error_message"]}))
    )


def last_writes(patches: DataFrame, fields: list[str], key: str = "job_id") -> DataFrame:
    """(key, created, one struct(seq, value) a field): the last write of each field, by the patches' seq.

    patches has key, seq, created (whether the patch makes the row) and fields (a map; a key that is there is written, even
    with null). The result is a sum of its input: last_writes of parts merge by merged(), in any order, and groups are
    combined before the shuffle. Ties on seq go to the greater value, a written null being the least.
    """
    write = lambda f: F.max(F.when(F.coalesce(F.map_contains_key("fields", f), F.lit(False)), F.struct("seq", F.element_at("fields", f).alias("value")))).alias(f)
    return patches.groupBy(key).agg(F.max(F.when(F.col("created"), F.col("seq"))).alias("created"), *(write(f) for f in fields))


def merged(writes: DataFrame, fields: list[str], key: str = "job_id") -> DataFrame:
    """Parts of last_writes as one."""
    return writes.groupBy(key).agg(F.max("created").alias("created"), *(F.max(f).alias(f) for f in fields))


def rows_of(writes: DataFrame, fields: list[str], key: str = "job_id") -> DataFrame:
    """(key, created, fields): the rows as they are now, of those that were created; earlier patches of them don't count, as
    a creation writes all fields; patches of rows never created make none."""
    return writes.where("created IS NOT NULL").select(key, "created", *(F.col(f"{f}.value").alias(f) for f in fields))


def patched(patches: DataFrame, fields: list[str], key: str = "job_id") -> DataFrame:
    """The rows that all patches make, in whatever order they come; an empty table gives none; a null key is a key."""
    return rows_of(last_writes(patches, fields, key), fields, key)


def upsert_stream(patches: DataFrame, fields: list[str], path: str, checkpoint: str, key: str = "job_id") -> StreamingQuery:
    """Each batch's last writes in a folder of its own, which a batch that runs again writes anew; late patches take their
    place by seq when the folders are merged."""

    def save(batch: DataFrame, batch_id: int) -> None:
        last_writes(batch, fields, key).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return patches.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, path: str, fields: list[str], key: str = "job_id") -> DataFrame:
    """The rows that the stream's batches have made so far."""
    return rows_of(merged(spark.read.parquet(path).drop("batch"), fields, key), fields, key)


def compacted(spark: SparkSession, path: str, to: str, fields: list[str], key: str = "job_id") -> None:
    """Writes the merged last writes of all batches to a new folder as one batch, which reads as they do."""
    merged(spark.read.parquet(path).drop("batch"), fields, key).write.parquet(f"{to}/batch=0")
