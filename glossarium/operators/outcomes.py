"""Readings of neighborhoods by what became of the item: means by outcome, shared misses, and nested parts of a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.operators.predictions import hit

MEASURES = ("filler_share", "n_stem", "n_affix", "n_coined", "n_distant")


def outcome_views(profiled: DataFrame) -> DataFrame:
    """(view, model, part, n, related, coined, and the mean of each measure) in one pass: 'outcome' are the items beyond
    the cutoff by their outcome, 'miss' those that were missed by whether their prompt asks for one word only, and
    'reference' the items up to the cutoff that were recalled.  related and coined are shares of lists with a sibling, or a coined one.

    profiled: profiles() with is_future and cued BOOLEAN."""
    post, found = F.col("is_future") == 1, F.col("outcome") == "hit"
    view = lambda c, v, part: F.when(c, F.struct(F.lit(v).alias("view"), part.alias("part")))
    views = F.array(view(post, "outcome", F.col("outcome")), view(~found, "miss", F.when(F.col("cued"), "cued").otherwise("shared")), view(~post & found, "reference", F.lit("recalled")))
    x = profiled.withColumn("v", F.explode(F.filter(views, lambda v: v.isNotNull())))
    some = lambda c: F.avg((c > 0).cast("int"))
    return x.groupBy("v.view", "model", "v.part").agg(F.count(F.lit(1)).alias("n"), some(F.col("n_stem") + F.col("n_affix")).alias("related"), some(F.col("n_coined")).alias("coined"), *(F.avg(m).alias(m) for m in MEASURES))


def shared_miss_means(profiled: DataFrame, one: str, other: str) -> DataFrame:
    """(stratum, n, mean of each measure for both models): items of two models, matched on target and year, that both
    missed; of repeated decodings the last counts.  So the models' hit rates play no part.

    profiled: profiles() with target, year, cutoff_year and entry_year; the strata are those of the first model."""
    key = ["target", "year"]
    last = profiled.groupBy("model", *key).agg(F.max_by(F.struct("rank", "cutoff_year", "entry_year", *MEASURES), "row_id").alias("r")).select("model", *key, "r.*")
    missed = last.where(hit(F.col("rank"), 100) == 0)
    a = missed.where(F.col("model") == one)
    b = missed.where(F.col("model") == other).select(F.col("target").alias("_t"), F.col("year").alias("_y"), *(F.col(m).alias(f"{m}_b") for m in MEASURES))
    x = a.join(b, (F.col("target") == F.col("_t")) & F.col("year").eqNullSafe(F.col("_y")))
    post = F.coalesce(F.col("year") > F.col("cutoff_year"), F.lit(False))
    anchored = F.coalesce(F.col("entry_year") <= F.col("cutoff_year"), F.lit(False))
    strata = {"in_cutoff": F.coalesce(F.col("year") <= F.col("cutoff_year"), F.lit(False)), "post_cutoff": post, "anchored": post & anchored, "unanchored": post & ~anchored}
    x = x.withColumn("stratum", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in strata.items())), lambda s: s.isNotNull())))
    return x.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"{m}_{side}") for m in MEASURES for side, c in (("one", m), ("other", f"{m}_b"))))


def nested_parts(rows: DataFrame, inside: Column) -> DataFrame:
    """(model, is_future, inside, n, hits, recall, share_of_stratum, share_of_model, contribution): a vocabulary's part
    of each stratum, with the stratum and the whole model as denominators; contributions of a model sum to its hit rate."""
    g = rows.groupBy("model", "is_future", inside.cast("int").alias("inside")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit(F.col("rank"), 100)).alias("hits"))
    total = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    return g.select("model", "is_future", "inside", "n", "hits", (F.col("hits") / F.col("n")).alias("recall"), (F.col("n") / total("model", "is_future")).alias("share_of_stratum"), (F.col("n") / total("model")).alias("share_of_model"), (F.col("hits") / total("model")).alias("contribution"))


def last_of_text(rows: DataFrame, text: str, order: str) -> DataFrame:
    """(order, last): for each row the last row of the same text, null texts among themselves; texts meet as digests, and the last
    of each is found map-side first."""
    x = rows.select(F.col(order), F.md5(text).alias("_h"))
    last = x.groupBy("_h").agg(F.max(order).alias("last")).withColumnRenamed("_h", "_g")
    return x.join(last, F.col("_h").eqNullSafe(F.col("_g"))).select(order, "last")


def modal_values(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, n, modal, share): the value that a key was given most often, of equally frequent ones that given first, and
    its share; null values don't count."""
    g = log.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("k"), F.min(order).alias("first"))
    return g.groupBy(key).agg(F.sum("k").alias("n"), F.max(F.struct("k", (-F.col("first")).alias("f"), F.col(value).alias("v"))).alias("m")).select(key, "n", F.col("m.v").alias("modal"), (F.col("m.k") / F.col("n")).alias("share"))
