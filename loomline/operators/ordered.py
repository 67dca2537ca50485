"""Running totals in order within batches of any size: a batch is dealt out over tasks by ranges of its order.

A window over the batch alone would take each batch through one task. Here rows are dealt by ranges of (batch, order),
summed within a task's range, and each range adds what the batch's ranges before it hold. Only rows of equal batch and
order must share a task. The dealt rows are written once, since another pass might draw the ranges elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources import shared

_AT, _PART, _BEFORE, _FIRST = "__at", "__part", "__before", "__first"


def running(rows: DataFrame, batch: list[str], keys: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """rows with the total of weight up to and with each row of its batch, in the order of keys, as long; of 1 without
    a weight, which numbers rows from 1. Null batches are a batch; rows of equal keys come in any order.
    """
    order = [*map(F.col, batch), *keys]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number is made of the task's, and the row's within it.
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id())
    dealt = shared.written(dealt, shared.folder(rows.sparkSession, "ordered")).withColumn(_PART, F.shiftright(_AT, 33))
    # At most a row for each task and one for each batch.
    total = F.count("*") if weight is None else F.sum(weight)
    ranges = dealt.groupBy(_PART, *batch).agg(F.min(_AT).alias(_FIRST), total.cast("long").alias("__total"))
    earlier = Window.partitionBy(*batch).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn(_BEFORE, F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
    if weight is None:
        own = F.col(_AT) - F.col(_FIRST) + 1
    else:
        own = F.sum(weight).over(Window.partitionBy(_PART, *batch).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0))
    # A range's rows have the place of its first one in common, however its batch is null.
    ranges = ranges.select(F.col(_PART).alias("__r"), F.struct(*batch).alias("__b"), _FIRST, _BEFORE)
    joined = dealt.join(ranges, (F.col(_PART) == F.col("__r")) & (F.struct(*(dealt[b] for b in batch)) == F.col("__b")))
    return joined.withColumn(name, (own + F.col(_BEFORE)).cast("long")).drop(_AT, _PART, _BEFORE, _FIRST, "__r", "__b")
