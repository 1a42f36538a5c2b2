"""Positions and running sums over a whole table, without a window that holds it: by ranges of the leading key.

The key's range is cut into a fixed number of even buckets. Each bucket is its own window; the buckets' totals, a small
table, say what lies before each. Equal keys meet in one bucket, so a key has to be selective.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def running(df: DataFrame, key: str, order: list[str], value: Column, *, name: str = "before", buckets: int = BUCKETS) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row, in order of the number ``key`` and then of ``order``."""
    low, high = df.agg(F.min(key).cast("double"), F.max(key).cast("double")).first()
    width = ((high or 0.0) - (low or 0.0)) / buckets or 1.0
    at = F.least(F.lit(buckets - 1), F.floor((F.col(key).cast("double") - F.lit(low or 0.0)) / F.lit(width)))
    rows = df.withColumn("_sl_bucket", F.coalesce(at, F.lit(-1)).cast("long")).withColumn("_sl_value", value)
    # At most ``buckets`` rows of totals, and one for null keys, which come first.
    totals = rows.groupBy("_sl_bucket").agg(F.sum("_sl_value").alias("_sl_sum"))
    until = Window.orderBy("_sl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_sl_bucket", F.coalesce(F.sum("_sl_sum").over(until), F.lit(0)).alias("_sl_offset"))
    inside = Window.partitionBy("_sl_bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_sl_inside", F.coalesce(F.sum("_sl_value").over(inside), F.lit(0))).join(F.broadcast(offsets), "_sl_bucket")
    return out.withColumn(name, F.col("_sl_offset") + F.col("_sl_inside")).drop("_sl_bucket", "_sl_value", "_sl_inside", "_sl_offset")


def positions(df: DataFrame, key: str, order: list[str] | None = None, *, name: str = "at") -> DataFrame:
    """Adds each row's place, from 0."""
    return running(df, key, order or [], F.lit(1).cast("long"), name=name)
