"""Job events as streams: the guarded state machine, live counts, fan-out and drop folders."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from narrata.operators.jobs import next_state

STATE_SCHEMA = "status string, progress double, accepted int, rejected int"
OUT_SCHEMA = "job_id string, session_id long, seq long, before string, status string, progress double, accepted int, rejected int"
OUT = Row(*(f.split()[0] for f in OUT_SCHEMA.split(", ")))
EVENT_COLUMNS = ["job_id", "session_id", "ts", "seq", "op", "progress"]


def _place(event: Row) -> tuple:
    """Events without a time, or a number, come last."""
    return event["ts"] is None, event["ts"] or 0, event["seq"] is None, event["seq"] or 0


class JobMachine(StatefulProcessor):
    """Applies a job's events in the order (ts, seq) inside each batch and emits the job's state after the batch.

    With ttl_ms a job that had no event for so long is forgotten; with until_end events after the first end are dropped.
    """

    def __init__(self, ttl_ms: int | None = None, until_end: bool = False):
        self.ttl_ms, self.until_end = ttl_ms, until_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", STATE_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        events = sorted(rows, key=_place)
        old = self.state.get() if self.state.exists() else None
        status, progress, accepted, rejected = (old[0], old[1], old[2], old[3]) if old else (None, 0.0, 0, 0)
        before, seq = status, None
        for e in events:
            if self.until_end and status in ("completed", "failed"):
                continue
            status, progress, good = next_state(status, progress, e["op"], None if e["progress"] is None or math.isnan(e["progress"]) else float(e["progress"]))
            accepted, rejected, seq = accepted + good, rejected + (not good), int(e["seq"])
        self.state.update((status, float(progress), int(accepted), int(rejected)))
        if seq is not None:
            yield OUT(*key, seq, before, status, float(progress), int(accepted), int(rejected))

    def close(self) -> None:
        pass


def job_states(events: DataFrame, ttl_ms: int | None = None, until_end: bool = False) -> DataFrame:
    """The state of each job after each batch of its events, with the state before it."""
    keyed = events.select(*EVENT_COLUMNS).groupBy("job_id", "session_id")
    mode = "ProcessingTime" if ttl_ms else "None"
    return keyed.transformWithState(JobMachine(ttl_ms, until_end), outputStructType=OUT_SCHEMA, outputMode="update", timeMode=mode)


def stat_deltas(states: DataFrame) -> DataFrame:
    """(session_id, status, delta): a job leaves its old status and enters the new one."""
    left = F.struct("session_id", F.col("before").alias("status"), F.lit(-1).alias("delta"))
    entered = F.struct("session_id", "status", F.lit(1).alias("delta"))
    changed = F.when(F.col("before").eqNullSafe(F.col("status")), F.array().cast("array<struct<session_id:long,status:string,delta:int>>")).otherwise(F.array(left, entered))
    return states.select(F.explode(changed).alias("d")).select("d.*").where("status IS NOT NULL")


def write_stats(deltas: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's sums of deltas to path; the live counts are the sums over it."""

    def save(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("session_id", "status").agg(F.sum("delta").alias("delta"))
        sums.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return deltas.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def fan_out(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each event to its session's folder and to the feed of all; a batch that runs again writes the same files."""

    def save(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        held.write.mode("overwrite").partitionBy("session_id").parquet(f"{path}/sessions/batch={batch_id}")
        held.write.mode("overwrite").parquet(f"{path}/all/batch={batch_id}")
        held.unpersist()

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completions(done: DataFrame) -> DataFrame:
    """First completions of each (book_id, seq) of a stream."""
    return done.dropDuplicates(["book_id", "seq"])


def to_parquet(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, once, appended to path; started again it goes on from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def stream_table(spark: object, path: str, schema: object, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
