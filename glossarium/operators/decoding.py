"""Ranked next words from counts of word pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossarium.functions.text import letter_tokens


def word_pairs(docs: DataFrame, text: str) -> DataFrame:
    """(word, next, n): how often a word follows another; counted map-side first."""
    x = docs.select(letter_tokens(docs[text]).alias("t")).select(F.explode_outer(F.arrays_zip(F.col("t").alias("a"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))).alias("p"))
    p = x.select(F.col("p").getField("a").alias("word"), F.col("p").getField("b").alias("next")).where("next is not null")
    return p.groupBy("word", "next").agg(F.count(F.lit(1)).alias("n"))


def top_next(pairs: DataFrame, k: int) -> DataFrame:
    """(word, next, n, rank): the k most frequent followers of each word, ties by the alphabet."""
    w = Window.partitionBy("word").orderBy(F.desc("n"), "next")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
