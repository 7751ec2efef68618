"""Queries that run a stream over the stored events to its end and read what it left, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.plans import job_queries as JQ
from narrata.sources.shared import new_folder
from narrata.sources.tables import EVENT_OPS
from narrata.streaming import jobs as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = S.stream_table(spark, f"{sf_dir}/events.parquet*", stored.schema)
    op = F.create_map(*(F.lit(x) for p in EVENT_OPS.items() for x in p))[F.col("event_type")]
    return raw.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws("-", "user_id", F.pmod("event_id", F.lit(5))).alias("job_id"),
        F.col("user_id").alias("session_id"),
        op.alias("op"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("progress"),
    )


def finished(spark: SparkSession, rows: DataFrame, mode: str = "update") -> DataFrame:
    """All rows that the stream emits until its input is used up."""
    folder = new_folder(spark, "stream")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/part={batch_id}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{folder}/out").drop("part")


def r01_job_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that the stateful stream leaves; equal to the batch fold."""
    states = finished(spark, S.job_states(event_stream(spark, sf_dir)))
    last = states.groupBy("job_id", "session_id").agg(F.max_by(F.struct("status", "progress", "accepted", "rejected"), "batch").alias("s"))
    return last.select("job_id", "session_id", "s.status", "s.progress", "s.accepted", "s.rejected")


def r02_session_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counts by session from the stream's changes of status."""
    deltas = S.stat_deltas(finished(spark, S.job_states(event_stream(spark, sf_dir))))
    of = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("delta"))), F.lit(0))
    return deltas.groupBy("session_id").agg(of("completed").alias("completed"), of("failed").alias("failed"), of("pending", "running", "paused").alias("total_active"))


def r06_first_end_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as they ended first; later events are dropped."""
    states = finished(spark, S.job_states(event_stream(spark, sf_dir), until_end=True))
    last = states.groupBy("job_id", "session_id").agg(F.max_by("status", "batch").alias("status"))
    return last.where(F.col("status").isin("completed", "failed"))


QUERIES = {f.__name__: f for f in (r01_job_states_stream, r02_session_stats_stream, r06_first_end_stream)}
ORACLE_SQL = {
    "r01_job_states_stream": JQ.ORACLE_SQL["r01_job_states"],
    "r02_session_stats_stream": f"with {JQ.EVENTS_SQL}, l as (select * from fold qualify n = max(n) over (partition by job_id, session_id)) select session_id, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, count(*) filter (status in ('pending', 'running', 'paused')) as total_active from l where status is not null group by 1",
    "r06_first_end_stream": f"with {JQ.EVENTS_SQL} select job_id, session_id, arg_min(status, n) as status from fold where status in ('completed', 'failed') group by 1, 2",
}
