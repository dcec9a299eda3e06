"""Append-only logs, upserts, batches, shards and validation of logged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.plans.prefix import numbered

# The fields that a judge's answer must have.
REQUIRED = ("form_group", "form_basis", "form_kind", "form_inflection_discounted", "rationale")


def last_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key by order, found by aggregation without sorting; null keys give nothing."""
    names = [c for c in log.columns if c != key]
    g = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("_r"))
    return g.select(key, *(F.col("_r").getField(c).alias(c) for c in names))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes in place of those of the same key, and new ones added; keys are unique in both."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def once_per_batch(items: DataFrame, value: Column, order: str, block: int = 10_000) -> DataFrame:
    """items with `batch`: the number of earlier rows of the same value, so that no value repeats inside a batch.  A hot
    value is counted by blocks of the order column (a whole number), never sorted in one task."""
    x = numbered(items.withColumn("_v", value), ["_v"], [order], F.floor(F.col(order) / block), "_place")
    return x.withColumn("batch", (F.col("_place") - 1).cast("int")).drop("_v", "_place")


def shards(items: DataFrame, size: Column, order: str, most: int, parts: int = 1_000) -> DataFrame:
    """items with `shard`: the total size before the row, cut at multiples of `most`.  Running totals go over blocks of
    the order column first, as many rows each, and then inside each block; the blocks, `parts` of them, are cut at
    approximate quantiles, however sparse or uneven the order is."""
    x = items.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    cuts = items.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts).alias("q")).select(F.array_distinct("q").alias("_cuts"))
    # a row's block is the number of cuts below it, found by halving
    low_high = F.aggregate(F.sequence(F.lit(1), F.lit(parts.bit_length())), F.struct(F.lit(0).alias("low"), F.coalesce(F.size("_cuts"), F.lit(0)).alias("high")), lambda s, _: F.when(s["low"] >= s["high"], s).when(F.get("_cuts", F.floor((s["low"] + s["high"]) / 2).cast("int")) < F.col(order), F.struct((F.floor((s["low"] + s["high"]) / 2) + 1).cast("int").alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high"))))
    x = x.join(F.broadcast(cuts)).withColumn("_block", low_high["low"]).drop("_cuts")
    blocks = x.groupBy("_block").agg(F.sum("_size").alias("_sum"))
    blocks = blocks.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return x.join(F.broadcast(blocks), F.col("_block") == F.col("_b")).withColumn("shard", F.floor(before / F.lit(most)).cast("int")).drop("_size", "_block", "_b", "_start")


def answer_status(raw: Column) -> Column:
    """Why a logged answer can't be used: 'no text', 'not an object', 'missing <field>', or 'ok'."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    out = F.when(raw.isNull() | (text == ""), "no text").when(~text.rlike(r"(?s)^\{.*\}$"), "not an object")
    for field in REQUIRED:
        out = out.when(~F.contains(text, F.lit(f'"{field}"')), f"missing {field}")
    return out.otherwise("ok")
