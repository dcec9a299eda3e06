"""Fields that look like others but differ in their characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossarium.functions.canonical import canonical_form, is_unstable


def lookalike_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, original, consistent) of the field values that aren't in the consistent form.

    The quick check drops, inside the JVM, the values that cannot change; the others are normalised segment by segment
    and compared.  Null and empty values are in the form; repeated keys each give their rows; further columns are
    ignored.
    """
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), df[f].alias("original")) for f in fields)))
    rows = df.select(df[key].alias("key"), values.alias("v")).select("key", "v.*").where(is_unstable(F.col("original")))
    rows = rows.withColumn("consistent", canonical_form(F.col("original"))).where("original <> consistent")
    return rows.select(F.col("key").alias(key), "field", "original", "consistent")


def lookalike_report(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n_values, n_cases): how many values of each field there are, nulls left out, and how many weren't in the
    consistent form.  A field without values counts 0 and 0."""
    counts = df.agg(*(F.count(df[f]).alias(f) for f in fields))
    filled = counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_values")) for f in fields))).alias("v")).select("v.*")
    cases = lookalike_fields(df, key, fields).groupBy("field").agg(F.count(F.lit(1)).alias("n_cases"))
    return filled.join(cases, "field", "left").select("field", "n_values", F.coalesce("n_cases", F.lit(0)).alias("n_cases"))
