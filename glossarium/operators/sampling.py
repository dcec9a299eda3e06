"""Deterministic samples: strata, matched draws, apportionment, round robin and null models.

Draws are ordered by the MD5 of a seed and a key, so that any engine draws the same rows.  Each keeps at most a quota of
rows per cell: the quota-th smallest key of a cell is found first, by bounded top-k aggregation, so that a large cell is
never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.plans.prefix import numbered


def draw_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def draw_bucket(draw: Column) -> Column:
    """One of 4,096 buckets in the order of the draw keys."""
    return F.left(draw, F.lit(3))


def stratified(items: DataFrame, cell: list[str], key: str, quota: int, seed: int = 20260806, salts: int = 16) -> DataFrame:
    """The quota rows of each cell with the smallest draw keys; key must be unique.  Salted parts of a cell are cut down
    to the quota first."""
    x = items.withColumn("_draw", draw_key(seed, key)).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = x.withColumn("_rn", F.row_number().over(Window.partitionBy(*cell, "_salt").orderBy("_draw"))).where(F.col("_rn") <= quota)
    return part.withColumn("_rn", F.row_number().over(Window.partitionBy(*cell).orderBy("_draw"))).where(F.col("_rn") <= quota).drop("_draw", "_salt", "_rn")


def matched(pool: DataFrame, need: DataFrame, cell: list[str], key: str, seed: int = 20260812) -> tuple[DataFrame, DataFrame]:
    """(drawn rows, shortfall per cell): as many pool rows in each cell as `need` rows; cells are never filled from
    others."""
    wanted = need.groupBy(*cell).agg(F.count(F.lit(1)).alias("need"))
    have = pool.groupBy(*cell).agg(F.count(F.lit(1)).alias("have"))
    x = pool.withColumn("_draw", draw_key(seed, key)).join(wanted, cell)
    drawn = numbered(x, cell, ["_draw"], draw_bucket(F.col("_draw")), "_rn").where("_rn <= need").drop("_draw", "_rn", "need")
    short = wanted.join(have, cell, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).withColumn("short", F.greatest(F.col("need") - F.col("have"), F.lit(0).cast("long")))
    return drawn, short


def largest_remainder(shares: DataFrame, key: str, share: str, total: int) -> DataFrame:
    """(key, quota): whole quotas that sum to total: the floors, and one more for the largest remainders (ties by key)."""
    exact = F.lit(total) * F.col(share) / F.sum(share).over(Window.partitionBy())
    x = shares.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    order = Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), key)
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    return x.withColumn("_left", left).select(key, (F.col("_floor") + F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def round_robin(items: DataFrame, cell: str, key: str, n: int, seed: int = 20260811) -> DataFrame:
    """n rows, taken in turn from each cell: rows in the order of (place in the cell, cell)."""
    x = stratified(items, [cell], key, n, seed).withColumn("_draw", draw_key(seed, key))
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy(cell).orderBy("_draw")))
    return x.orderBy("turn", cell).limit(n).drop("_draw")


def permuted_pairs(items: DataFrame, key: str, payload: str, seed: int = 20260808) -> DataFrame:
    """Each row with `other`, the payload of the row that follows it in draw order; the last takes that of the first, so
    that no row keeps its own unless it is the only one.  Rows are numbered by buckets of the draw, and each asks for its
    follower by number; key must be unique."""
    rows = numbered(items.withColumn("_draw", draw_key(seed, key)), [], ["_draw"], draw_bucket(F.col("_draw")), "_place").drop("_draw")
    whole = items.agg(F.count(F.lit(1)).alias("_n"))
    lent = rows.select(F.col("_place").alias("_next"), F.col(payload).alias("other"))
    asked = rows.join(F.broadcast(whole)).withColumn("_next", F.pmod(F.col("_place"), F.col("_n")) + 1).drop("_place", "_n")
    return asked.join(lent, "_next").drop("_next")


def shuffled(words: Column, key: Column, seed: int = 20260806) -> Column:
    """The words of one row in an order fixed by seed, key and word; null for null."""
    marked = F.transform(words, lambda w: F.concat(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), w)), w))
    return F.transform(F.array_sort(marked), lambda m: F.substring(m, F.lit(33), F.length(m)))


def stride(items: DataFrame, key: str, n: int, seed: int = 20260815) -> DataFrame:
    """n rows, or all if there are fewer, evenly spaced in draw order, with their place; key must be unique."""
    rows = numbered(items.withColumn("_draw", draw_key(seed, key)), [], ["_draw"], draw_bucket(F.col("_draw")), "place").drop("_draw")
    whole = items.agg(F.greatest(F.floor(F.count(F.lit(1)) / n), F.lit(1)).alias("_step"))
    return rows.join(F.broadcast(whole)).where(F.pmod(F.col("place") - 1, F.col("_step")) == 0).drop("_step").orderBy("place").limit(n)


def whole_items(rows: DataFrame, item: str, n: int, seed: int = 20260813) -> DataFrame:
    """All rows of n items, or of all if there are fewer: items are drawn, not rows.  Rows without an item are left out.
    The drawn keys, at most n, are what is broadcast."""
    keys = rows.where(F.col(item).isNotNull()).groupBy(item).agg(F.min(draw_key(seed, item)).alias("_draw")).orderBy("_draw").limit(n)
    return rows.join(F.broadcast(keys.select(item)) if n <= 100_000 else keys.select(item), item, "left_semi")


def with_backfill(items: DataFrame, cell: list[str], part: str, key: str, quotas: DataFrame, per_cell: int, seed: int = 20260814) -> DataFrame:
    """per_cell rows of each cell: first up to the quota of each part, then the next by draw from whatever is left.

    quotas: (part, quota); parts without one only fill gaps.  A cell with fewer rows gives all it has.  A part is cut to
    per_cell rows by salted draws first, which can't lose a row that would be taken."""
    x = stratified(items, [*cell, part], key, per_cell, seed).withColumn("_draw", draw_key(seed, key))
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy(*cell, part).orderBy("_draw"))).join(quotas, part, "left")
    x = x.withColumn("filled", (F.col("_rn") > F.coalesce("quota", F.lit(0))).cast("int"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("filled", "_draw"))
    return x.withColumn("_place", place).where(F.col("_place") <= per_cell).select(key, *cell, part, "filled")
