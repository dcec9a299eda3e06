"""The label log as a stream: new lines are folded into a table that holds the last record of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossarium.operators.records import last_wins

SCHEMA = "line_no bigint, id string, form int, meaning int, labelled_at string"


def label_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JSON files in a folder; torn lines, and lines without an id, are left out."""
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(folder).where("id is not null and line_no is not null")


def labels_at(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """The last record per id under `target`, as it was before batch `number`, or as it is now.  Each bucket of ids has a
    part for each batch that changed it, of which the newest counts; the choice reads names of folders, not records."""
    parts = spark.read.parquet(target)
    parts = parts if number is None else parts.where(F.col("version") < number)
    newest = parts.groupBy(F.col("bucket").alias("_b")).agg(F.max("version").alias("_v"))
    return parts.join(F.broadcast(newest), (F.col("bucket") == F.col("_b")) & (F.col("version") == F.col("_v"))).drop("_b", "_v", "bucket", "version")


def compacted(stream: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the last record per id under `target`, read by labels_at().  A batch writes the buckets of the ids that it
    changes, and no others.  One that runs again after a failure writes the same parts again from those before it, so
    that nothing is counted twice."""

    def fold(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        fresh = last_wins(batch, "id", "line_no")
        if number:
            touched = fresh.select(bucket.alias("_t")).distinct()
            held = labels_at(spark, target, number).select(fresh.columns).withColumn("_t", bucket).join(F.broadcast(touched), "_t", "left_semi").drop("_t")
            fresh = last_wins(fresh.unionByName(held), "id", "line_no")
        out = fresh.withColumns({"bucket": bucket, "version": F.lit(number)}).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, time: str, late: str = "7 days") -> DataFrame:
    """(window, n): records a day, late ones counted as long as the watermark allows; for streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("n"))
