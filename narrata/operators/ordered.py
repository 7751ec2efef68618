"""Places of rows within keys of any size: sorted ranges are counted each for itself, and what a key has before is carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from narrata.sources.shared import written


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with `name`, the row's place from 0 among those of equal `by`, in the order of `order` (nulls first).

    The rows are cut into ranges of (by, order), so a key with a third of them is many tasks. Each range is counted in one
    pass; a key that goes on over several ranges, at most one for each border, adds what its ranges before hold. Nulls in `by`
    are one key; rows that are equal in by and order stay in one range and get places in any order, so give an
    order that tells rows apart; an empty table stays empty. The rows are written to the shared folder, since ranges aren't the same twice.
    """
    given = rows.columns
    local, part = f"{name}__local", f"{name}__part"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        last, held = None, 0
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            keys = [batch.column(batch.schema.names.index(c)) for c in by]
            starts = np.zeros(m, bool)
            for key in keys:
                a, b = key.slice(0, m - 1), key.slice(1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                starts[1:] |= ~np.asarray(same)
            first = [key[0].as_py() for key in keys]
            starts[0] = True
            at = np.arange(m)
            count = at - np.maximum.accumulate(np.where(starts, at, 0))
            if first == last:
                until = int(np.argmax(starts[1:])) + 1 if starts[1:].any() else m
                count[:until] += held
            last, held = [key[m - 1].as_py() for key in keys], int(count[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count, pa.int64()), pa.array(np.full(m, place, np.int32))], names=[*given, local, part])

    schema = StructType([*rows.schema.fields, StructField(local, LongType()), StructField(part, IntegerType())])
    counted = written(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(run, schema), "numbered")
    pieces = counted.groupBy(*by, part).agg((F.max(local) + 1).alias("n"))
    of_key = Window.partitionBy(*by)
    earlier = of_key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("ranges", F.count("*").over(of_key)).withColumn("before", F.sum("n").over(earlier)).where("ranges > 1")
    # a key in several ranges fills all but its first and last, so there are fewer than two rows for each range
    carried = pieces.select(*(F.col(c).alias(f"{c}__key") for c in by), F.col(part).alias("carried_part"), "before")
    met = F.col(part) == F.col("carried_part")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"{c}__key"))
    joined = counted.join(F.broadcast(carried), met, "left")
    return joined.select(*given, (F.col(local) + F.coalesce("before", F.lit(0))).alias(name))
