"""Python stages work on pieces of bounded size, with the rows of whole batches."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from narrata.functions.cleaners import ROWS, Cleaners
from narrata.operators import chunking as K
from narrata.operators import manifests as M
from narrata.operators.batches import in_slices


def test_slices_hold_all_rows_and_bounded_bytes():
    texts = ["a" * 700_000, None, "b" * 5_000_000, "", *["c" * 300_000] * 20]
    sizes = []

    def run(batches):
        for b in batches:
            sizes.append((b.num_rows, sum(len(t or "") for t in b.column(1).to_pylist())))
            yield b

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    out = pa.Table.from_batches(in_slices(run, 1)(iter([batch, batch.slice(0, 0), batch])))
    assert out["t"].to_pylist() == texts * 2
    assert all(size <= 2_000_000 or n == 1 for n, size in sizes) and len(sizes) > 8


def test_vectorised_cleaners_get_bounded_pieces(spark):
    def count(s: pd.Series) -> pd.Series:
        return s + str(len(s))

    cleaners = Cleaners().vectorised("count", count)
    df = spark.range(3 * ROWS, numPartitions=1).select("id", F.lit("n").alias("t"))
    rows = df.select(cleaners.apply(F.col("t"), F.array(F.lit("count"))).alias("t")).collect()
    assert {int(r.t[1:]) for r in rows} == {ROWS} and len(rows) == 3 * ROWS
    assert df.limit(0).select(cleaners.apply(F.col("t"), F.array(F.lit("count"))).alias("t")).collect() == []


def test_hook_and_chunks_over_several_slices(spark):
    df = spark.range(12, numPartitions=1).select("id", F.when(F.col("id") != 5, F.repeat(F.concat(F.col("id").cast("string"), F.lit("x ")), 300_000)).alias("text"))
    hooked = {r.id: (r.n, r.ok) for r in M.apply_hook(df, lambda t: t[:3] if t else None, ["id"]).select("id", F.length("output").alias("n"), "ok").collect()}
    assert hooked == {i: (None if i == 5 else 3, True) for i in range(12)}
    chunks = K.chunk_bytes(df, 500_000).groupBy("id").agg(F.count("*").alias("n"), F.max("chunk_idx").alias("last")).collect()
    assert {r.id: r.n for r in chunks} == {i: 1 if i == 5 else 3 if i > 9 else 2 for i in range(12)} and all(r.last == r.n - 1 for r in chunks)


def test_clean_requests_shuffle_no_text(spark, sf):
    """Whatever size Spark takes the presets for, the chunks stay where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        presets = spark.createDataFrame([("ocr_cleanup", "b"), ("ocr_cleanup", "a"), ("x", "c")], "preset string, prompt string")
        chunks = spark.createDataFrame([(1, "t", "x", None), (2, "u", "?", None), (3, None, "?", "own")], "i int, text string, preset string, custom_prompt string")
        done = M.clean_requests(chunks, presets, ["i"])
        assert "SortMergeJoin" not in done._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(tuple, done.collect())) == [(1, "x", "c", "t"), (2, "ocr_cleanup", "a", "u"), (3, "?", "own", None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
