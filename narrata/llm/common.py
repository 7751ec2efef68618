"""Shared helpers: intermediate tables in the cluster's shared folder, and bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python worker handles at once.
SLICE_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary
    one; a cluster has no other folder that all can see, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to a new folder of the shared one and read again: cuts the lineage, and survives lost executors.
    Options are those of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_name(df: DataFrame, name: str) -> str:
    """A column name for a step's own use that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release_memory() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
    if trim:
        trim(0)


def releasing(run: Run) -> Run:
    """run, after whose end the worker gives free memory back to the system: workers are used again by later stages, whose
    peak would come on top of what this one leaves."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about limit bytes of the text column, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.names.index(name)).to_pylist()]


def hashed_fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


class Recent(dict):
    """key -> make(key), of a bounded number of keys in two generations: one that is met again moves to the young generation,
    which takes the place of the old one in tidy() when it has `most` keys, so frequent keys stay."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: object) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def tidy(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


#: Numbers in a piece of a partial sum, and the columns of partial sums.
PIECE = 1 << 16
SUMS = "place long, block int, part binary"


def partial_sum(total: np.ndarray, kind: type = np.float64) -> pa.RecordBatch:
    """A task's array as rows of SUMS: cut into blocks of a fixed size and named by the task's place."""
    x = total.astype(kind)
    cut = [x[i : i + PIECE].tobytes() for i in range(0, len(x), PIECE)]
    place = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([place] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["place", "block", "part"])


def tree_sum(parts: DataFrame, fan_in: int = 16, kind: type = np.float64) -> np.ndarray:
    """The sum of the tasks' arrays of the given kind, whose rows are those of partial_sum(); empty if there is no row.

    Arrays are added level by level, fan_in places at a time and each block for itself, so a group is fan_in rows of PIECE
    numbers at most, however many tasks and numbers there are. How large the arrays are doesn't depend on the data.
    """

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(0)
        for raw in group["part"]:
            x = np.frombuffer(raw.as_buffer(), kind).astype(np.float64)
            total = x if not len(total) else total + x
        return pa.table([group["place"][:1], group["block"][:1], pa.array([total.astype(kind).tobytes()], pa.binary())], names=["place", "block", "part"])

    parts = staged(parts, "sums")
    most = parts.agg(F.max("place")).first()[0]
    while most:
        most //= fan_in
        last, parts = parts, staged(parts.withColumn("place", F.floor(F.col("place") / fan_in)).groupBy("block", "place").applyInArrow(add, SUMS), "sums")
        discard(last)
    found = sorted((r.block, r.part) for r in parts.collect())
    discard(parts)
    return np.concatenate([np.frombuffer(part, kind).astype(np.float64) for _, part in found]) if found else np.zeros(0)
