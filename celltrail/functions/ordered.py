"""The row before of the same key, without a task that holds a key's whole history.

A key's rows are dealt over buckets that follow their order; within a bucket an ordinary
window looks back, and the first row of a bucket takes the last one of the bucket before,
of which a partial aggregate keeps a single row a key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_before(df: DataFrame, key: str, order: list[str], bucket: Column, columns: list[str], into: str = "_before") -> DataFrame:
    """``df`` with a struct ``into`` of the ``columns`` of the row before of the same key, null for a key's first.

    ``bucket`` must not fall as the ``order`` rises.
    """
    dealt = df.withColumn("_bucket", bucket)
    held = F.struct(*columns)
    near = dealt.withColumn("_near", F.lag(held).over(Window.partitionBy(key, "_bucket").orderBy(*order)))
    lasts = dealt.groupBy(key, "_bucket").agg(F.max_by(held, F.struct(*order)).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket"))
    far = lasts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_at"), carried.alias("_far")).filter("_far IS NOT NULL")
    met = near.join(far, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left")
    return met.withColumn(into, F.coalesce("_near", "_far")).drop("_bucket", "_near", "_far", "_key", "_at")


def with_last(df: DataFrame, key: str, order: list[str], bucket: Column, value: str, into: str) -> DataFrame:
    """``df`` with ``into``: the last ``value`` that is not null up to each row of its key, its own included; buckets as in :func:`with_before`."""
    dealt = df.withColumn("_bucket", bucket)
    up_to = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.withColumn("_near", F.last(value, ignorenulls=True).over(up_to))
    lasts = dealt.groupBy(key, "_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = lasts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_at"), F.last("_last", ignorenulls=True).over(before).alias("_far")).filter("_far IS NOT NULL")
    met = near.join(far, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left")
    return met.withColumn(into, F.coalesce("_near", "_far")).drop("_bucket", "_near", "_far", "_key", "_at")
