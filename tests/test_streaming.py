"""Streams over small logs that come in several files."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from narrata.operators import jobs as J
from narrata.streaming import expiry as E
from narrata.streaming import jobs as S

SCHEMA = "job_id string, session_id long, ts long, seq long, op string, progress double"
LOG = [
    ("a", 1, 1, 1, "create", None), ("a", 1, 2, 2, "start", None), ("b", 1, 2, 3, "create", None), ("c", 2, 2, 4, "progress", 0.3),
    ("a", 1, 3, 5, "progress", 0.4), ("b", 1, 3, 6, "pause", None), ("c", 2, 3, 7, "create", None), ("a", 1, 4, 8, "complete", None),
    ("a", 1, 5, 9, "cancel", None), ("b", 1, 5, 10, "start", None), ("b", 1, 6, 11, "pause", None), ("a", 1, 7, 12, "fail", None),
]


def log_stream(spark, folder):
    for i in range(0, len(LOG), 4):
        spark.createDataFrame(LOG[i : i + 4], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return S.stream_table(spark, str(folder), spark.createDataFrame([], SCHEMA).schema)


def test_states_and_live_counts(spark, tmp_path):
    stream = log_stream(spark, tmp_path / "in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def save(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"b={batch_id}"))

    S.job_states(stream).writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(str(tmp_path / "out"))
    last = {r.job_id: r.s for r in states.groupBy("job_id").agg(F.max_by(F.struct("status", "progress"), "batch").alias("s")).collect()}
    want = {r.job_id: (r.status, r.progress) for r in J.fold_events(spark.createDataFrame(LOG, SCHEMA)).collect()}
    assert {k: (v.status, v.progress) for k, v in last.items()} == want
    live = S.stat_deltas(states).groupBy("session_id", "status").agg(F.sum("delta").alias("n")).where("n <> 0").collect()
    assert {(r.session_id, r.status): r.n for r in live} == {(1, "failed"): 1, (1, "paused"): 1, (2, "pending"): 1}


def test_machine_takes_rows_and_orders_them():
    """Rows in any order, without a time last, and a progress that is none or no number."""
    row = Row("ts", "seq", "op", "progress")

    class Value:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept

        def update(self, value):
            self.kept = value

    machine = S.JobMachine()
    machine.state = Value()
    first = [row(None, 9, "complete", None), row(3, 4, "progress", float("nan")), row(1, 2, "start", None), row(1, 1, "create", None)]
    assert list(machine.handleInputRows(("a", 1), iter(first), None)) == [S.OUT("a", 1, 9, None, "completed", 1.0, 4, 0)]
    assert list(machine.handleInputRows(("a", 1), iter([row(5, 10, "create", None)]), None)) == [S.OUT("a", 1, 10, "completed", "completed", 1.0, 4, 1)]


def test_fan_out(spark, tmp_path):
    S.fan_out(log_stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "all" / "*")).count() == len(LOG)
    assert spark.read.parquet(str(tmp_path / "out" / "sessions" / "*" / "session_id=2")).count() == 2


def test_completions_count_once(spark, tmp_path):
    rows = [(1, 1), (1, 1), (1, 2), (2, 1)]
    spark.createDataFrame(rows, "book_id long, seq int").write.parquet(str(tmp_path / "in"))
    stream = S.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], "book_id long, seq int").schema)
    S.to_parquet(S.completions(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_expiry_takes_rows():
    """Touches in any order, more than are joined at once, and a life that ended inside the batch."""
    at = Row("at_ms")
    held, timers = [], []

    class Life:
        exists = lambda self: bool(held)
        get = lambda self: held[-1]
        update = lambda self, value: held.append(value)

    class Handle:
        registerTimer = lambda self, when: timers.append(when)
        deleteTimer = lambda self, when: timers.remove(when)

    expiry = E.Expiry({"k": 10})
    expiry.life, expiry.handle = Life(), Handle()
    rows = [at(i % 5) for i in range(E.AT_ONCE + 7)] + [at(40), at(30), at(40)]
    assert list(expiry.handleInputRows(("k", "x"), iter(rows), None)) == [E.OUT("k", "x", 4, 14, E.AT_ONCE + 7), E.OUT("k", "x", 30, 40, 1)]
    assert held == [(40, 2)] and timers == [50]
    assert list(expiry.handleInputRows(("k", "x"), iter([at(45)]), None)) == [] and held[-1] == (45, 3) and timers == [55]
