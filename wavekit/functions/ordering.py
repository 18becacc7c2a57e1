"""Totals and ranks over a global order, without a window that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: Sequence[str], value: str, dst: str) -> DataFrame:
    """Add ``dst``: Σ ``value`` over all rows before this one in the order of ``order`` (rows of one key must be one row).
    One range-partitioned sort; a task adds up its own rows as they stream by, and the partitions' totals (one number
    each) give where it starts. No window holds more than a batch."""
    import pyarrow as pa
    from pyspark.sql import types as T

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = df.columns.index(value)

    def add_up(batches):
        import numpy as np
        from pyspark import TaskContext

        total, task = 0, TaskContext.get().partitionId()
        for b in batches:
            v = b.column(at).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(v)
            if len(v):
                total = int(ends[-1])
            cols = [*b.columns, pa.array(ends - v, pa.int64()), pa.array(np.full(len(v), task), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "__before", "__task"])

    schema = T.StructType([*df.schema, T.StructField("__before", T.LongType()), T.StructField("__task", T.IntegerType())])
    summed = placed.mapInArrow(add_up, schema).checkpoint()
    totals = summed.groupBy("__task").agg(F.sum(value).alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("__task", first.alias("__first"))  # one row a partition
    return summed.join(F.broadcast(starts), "__task").withColumn(dst, F.col("__first") + F.col("__before")).drop("__task", "__first", "__before")
