"""Running totals and ordered takes in which no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.sources.session import materialized


def running_totals(df: DataFrame, group: list[str], order: str, tie: list[str], size: str, rows_per_bucket: int = 50_000, place: str | None = None) -> DataFrame:
    """df with `before`: the sum of size over the rows of the same group that come earlier by (order, tie).

    place is a DOUBLE in [0, 1], about even over the rows of a group, that never falls where order rises; order itself
    unless given.  It is cut into buckets, as many as the number of rows asks for; totals of the buckets are summed up
    first, and rows are only sorted inside their bucket.  So a group of any size is spread over many tasks.  Rows whose
    order is null come first; null sizes count as 0.  An empty df gives no rows.
    """
    rows = materialized(df)
    n = rows.count()
    buckets = max(1, -(-n // rows_per_bucket))
    rows = rows.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(F.coalesce(F.col(place or order), F.lit(0.0)) * buckets)).cast("long"))
    amount = F.coalesce(F.col(size), F.lit(0))
    totals = rows.groupBy(*group, "_bucket").agg(F.sum(amount).alias("_total"))
    earlier = F.coalesce(F.sum("_total").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [f"_k{i}" for i in range(len(group))]
    totals = totals.select(*(F.col(g).alias(k) for g, k in zip(group, keys)), F.col("_bucket").alias("_b"), earlier.alias("_earlier"))
    same = F.col("_bucket") == F.col("_b")
    for g, k in zip(group, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    inside = Window.partitionBy(*group, "_bucket").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(totals, same).withColumn("before", F.col("_earlier") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_bucket", "_b", "_earlier", *keys)


def numbered(df: DataFrame, group: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """df with `out`: the place of each row in its group by order, from 1.

    bucket must never fall where the order rises.  Rows are counted by bucket first and sorted only inside their bucket,
    so that a hot group is spread over many tasks.  Null groups form a group of their own.
    """
    rows = df.withColumn("_bucket", bucket)
    keys = [f"_k{i}" for i in range(len(group))]
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(g).alias(k) for g, k in zip(group, keys)), F.col("_bucket").alias("_b"), earlier.alias("_earlier"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for g, k in zip(group, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    place = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order))
    return rows.withColumn("_inside", place).join(counts, same).withColumn(out, F.col("_earlier") + F.col("_inside")).drop("_bucket", "_b", "_earlier", "_inside", *keys)


def hashed_order(*columns: str, seed: int = 0) -> Column:
    """A DOUBLE in [0, 1), spread evenly and fixed by the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / F.lit(float(1 << 53))
