"""Ranked word predictions: recall, leakage, bins over years, strata and contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossarium.functions.canonical import canonical_form
from glossarium.functions.text import item_key, lenient_int, norm, prefix_before
from glossarium.operators.packed import with_slots
from glossarium.sources.session import spread, table

KS = (10, 20, 50, 100)


def hit(rank: Column, k: int) -> Column:
    """1 if the rank is between 1 and k, else 0; a null rank or -1 is a miss."""
    return F.coalesce(rank.between(1, k), F.lit(False)).cast("int")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One row per decoded item: is_future is 1 if the year lies beyond the model's cutoff, 0 also for undated items;
    text is in the consistent form, and words are the values of top_10_words however the list is written, without empty
    slots."""
    p, m = spread(table(spark, d, "postcutoff_words")), table(spark, d, "models").select("model", "cutoff_year")
    words = F.coalesce(F.filter("slots", lambda v: v != ""), F.array().cast("array<string>"))
    rows = with_slots(p, "top_10_words").join(m, "model").select("row_id", "model", "item_id", canonical_form(F.col("text")).alias("text"), "target_word", "year", lenient_int(F.col("entry_start_year")).alias("entry_year"), "rank", words.alias("words"), "cutoff_year")
    return rows.withColumn("is_future", F.coalesce(F.col("year") > F.col("cutoff_year"), F.lit(False)).cast("int"))


def prediction_details(rows: DataFrame) -> DataFrame:
    """rows with the prefix before the target, a key by content, the place of the target in the list (-1: not there) and
    a hit column for each k."""
    target = norm(F.col("target_word"))
    place = F.array_position(F.transform("words", norm), target).cast("int")
    prefix = prefix_before(F.col("text"), F.col("target_word"))
    return rows.select("row_id", "model", item_key(target, prefix).alias("key"), F.length(prefix).alias("prefix_chars"), "is_future", F.when(target == "", -1).when(place > 0, place).otherwise(-1).alias("list_rank"), *(hit(F.col("rank"), k).alias(f"correct_{k}") for k in KS))


def recall_and_leakage(rows: DataFrame) -> DataFrame:
    """Per model and k: recall on items up to the cutoff, leakage on items beyond it, and leakage over recall (infinite
    where recall is 0); shares of empty groups are 0."""
    long = rows.select("model", "is_future", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), hit(F.col("rank"), k).alias("hit")) for k in KS))).alias("x")).select("model", "is_future", "x.*")
    past, future = F.col("is_future") == 0, F.col("is_future") == 1
    g = long.groupBy("model", "k").agg(F.count_if(past).alias("n_past"), F.count_if(future).alias("n_future"), F.sum(F.when(past, F.col("hit")).otherwise(0)).alias("past_hits"), F.sum(F.when(future, F.col("hit")).otherwise(0)).alias("future_hits"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    g = g.withColumns({"recall": share("past_hits", "n_past"), "leakage": share("future_hits", "n_future")})
    return g.withColumn("normalised", F.when(F.col("recall") > 0, F.col("leakage") / F.col("recall")).otherwise(F.lit(float("inf"))))


def bin_plan(rows: DataFrame, wished: int = 25, tolerance: int = 15) -> DataFrame:
    """(model, start, width): bins of years aligned to the cutoff.  Starts go from the century of the first year in
    steps of 10 to 50 years after it; widths are the divisors from 10 to 200 of the span up to the cutoff; the width
    nearest the wished one within the tolerance wins, then the earlier start and the smaller width."""
    years = rows.where("year is not null").groupBy("model", "cutoff_year").agg(F.min("year").alias("first"))
    starts = years.withColumn("start", F.explode(F.expr("sequence(first - pmod(first, 100), first + 49, 10)"))).where("start < cutoff_year")
    pairs = starts.withColumn("width", F.explode(F.expr("sequence(10, 200)"))).where("pmod(cutoff_year - start, width) = 0").withColumn("off", F.abs(F.col("width") - wished)).where(F.col("off") <= tolerance)
    best = pairs.groupBy("model").agg(F.min(F.struct("off", "start", "width")).alias("b"))
    return best.select("model", "b.start", "b.width")


def year_bins(rows: DataFrame, plan: DataFrame, k: int = 100) -> DataFrame:
    """Recall, mean reciprocal rank (a miss counts as rank k + 1), number and standard error of each bin of years."""
    last = rows.groupBy("model").agg(F.max("year").alias("last"))
    x = rows.where("year is not null").join(plan, "model").join(last, "model").where("year >= start")
    x = x.withColumn("bin", F.floor((F.col("year") - F.col("start")) / F.col("width"))).where("start + (bin + 1) * width <= start + ceil((last - start) / width) * width")
    got = hit(F.col("rank"), k)
    g = x.groupBy("model", (F.col("start") + F.col("bin") * F.col("width")).cast("int").alias("year_bin"), "width")
    reciprocal = 1.0 / F.when(F.col("rank") > 0, F.col("rank")).otherwise(k + 1)
    return g.agg(F.avg(got).alias("recall"), F.avg(reciprocal).alias("adj_mrr"), F.count(F.lit(1)).alias("n"), (F.stddev_samp(got) / F.sqrt(F.count(F.lit(1)))).alias("std_err"))


def before_and_after(bins: DataFrame, models: DataFrame) -> DataFrame:
    """Weighted means of recall in bins before the cutoff and from it on, and their ratio."""
    x = bins.join(models.select("model", "cutoff_year"), "model").withColumn("post", (F.col("year_bin") >= F.col("cutoff_year")).cast("int"))
    mean = lambda v: F.sum(F.when(F.col("post") == v, F.col("recall") * F.col("n"))) / F.sum(F.when(F.col("post") == v, F.col("n")))
    g = x.groupBy("model").agg(mean(0).alias("pre"), mean(1).alias("post_mean"))
    return g.withColumn("ratio", F.when(F.col("pre") > 0, F.col("post_mean") / F.col("pre")))


def population_strata(rows: DataFrame, k: int = 100) -> DataFrame:
    """Number, hits and percentage of the dated strata of each model: in_cutoff, post_cutoff, anchored (post, but the
    word is entered before the cutoff), unanchored (post and entered after it or never), and bands of word age."""
    cut, year, entry = F.col("cutoff_year"), F.col("year"), F.col("entry_year")
    post = F.coalesce(year > cut, F.lit(False))
    strata = [("in_cutoff", F.coalesce(year <= cut, F.lit(False))), ("post_cutoff", post), ("anchored", post & F.coalesce(entry <= cut, F.lit(False))), ("unanchored", post & ~F.coalesce(entry <= cut, F.lit(False)))]
    age = year - entry
    for name, low, high in (("age_000", 0, 50), ("age_050", 50, 150), ("age_150", 150, 400), ("age_400", 400, 10**6)):
        strata.append((name, post & F.coalesce((age >= low) & (age < high), F.lit(False))))
    flags = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in strata)), lambda s: s.isNotNull())
    g = rows.select("model", F.explode(flags).alias("stratum"), hit(F.col("rank"), k).alias("hit")).groupBy("model", "stratum")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("recalled"), (F.sum("hit") * 100.0 / F.count(F.lit(1))).alias("rate"))


def subset_contributions(rows: DataFrame, members: DataFrame, k: int = 100) -> DataFrame:
    """How the words inside and outside a vocabulary (a column `word`) add up to each model's hit rate: number, share of
    the items, recall and contribution n.recall/N, which sums to the whole rate."""
    inside = members.select(F.col("word").alias("w")).where("w is not null").distinct().withColumn("inside", F.lit(1))
    x = rows.withColumn("w", norm(F.col("target_word"))).join(inside, "w", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    g = x.groupBy("model", "inside").agg(F.count(F.lit(1)).alias("n"), F.sum(hit(F.col("rank"), k)).alias("hits"))
    whole = Window.partitionBy("model")
    return g.select("model", "inside", "n", "hits", (F.col("hits") / F.col("n")).alias("recall"), (F.col("n") / F.sum("n").over(whole)).alias("share"), (F.col("hits") / F.sum("n").over(whole)).alias("contribution"))


def both_missed(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Items that two models both missed, matched on target and year (undated with undated); of repeated decodings the
    last counts."""
    last = rows.withColumn("w", norm(F.col("target_word"))).where("w <> ''").groupBy("model", "w", "year").agg(F.max_by("rank", "row_id").alias("rank"), F.max("row_id").alias("row_id"))
    missed = last.where(hit(F.col("rank"), 100) == 0)
    a = missed.where(F.col("model") == one).select("w", "year", F.col("row_id").alias("row_a"))
    b = missed.where(F.col("model") == other).select(F.col("w").alias("w2"), F.col("year").alias("year2"), F.col("row_id").alias("row_b"))
    return a.join(b, (F.col("w") == F.col("w2")) & F.col("year").eqNullSafe(F.col("year2"))).select(F.col("w").alias("target"), "year", "row_a", "row_b")
