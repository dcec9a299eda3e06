"""Text formats beside parquet: typed tables, logs of JSON lines, lists of ids, and writing them back.

Files are read by Spark in splits; a malformed line never stops a read.  Order matters only where the last line of a
key wins: lines are numbered in the order of files and splits.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.operators.records import last_wins


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """A table with a header line; quoted values may hold separators, doubled quotes and line ends.  Values that don't
    fit the schema are null."""
    options = {"header": True, "multiLine": True, "escape": '"', "sep": separator, "mode": "PERMISSIVE", "enforceSchema": False}
    return spark.read.schema(schema).options(**options).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): line_no rises with the order of lines, but has gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last record of each key of a log to which lines are appended.  Torn lines and lines without the key are left
    out."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    parsed = read_lines(spark, path).select("line_no", F.from_json("value", schema).alias("r")).select("line_no", *(F.col("r").getField(n).alias(n) for n in names))
    return last_wins(parsed, key, "line_no").select(*names)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id), each once: the first value of each line; blank lines, lines that start with # and a header 'id' are left
    out."""
    first = F.trim(F.split("value", "\t").getItem(0))
    return spark.read.text(path).select(first.alias("id")).where("id <> '' and not startswith(id, '#') and id <> 'id'").distinct()


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """(key, candidates) of lines that hold their list under 'payload' or under 'candidates'; a line with neither has a
    null list, one that can't be parsed is left out."""
    v = read_lines(spark, path).select("line_no", F.try_parse_json("value").alias("v")).where("v is not null")
    got = lambda name: F.try_variant_get("v", f"$.{name}", "array<string>")
    rows = v.select("line_no", F.try_variant_get("v", "$.key", "string").alias("key"), F.coalesce(got("payload"), got("candidates")).alias("candidates"))
    return last_wins(rows, "key", "line_no").select("key", "candidates")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(name, measure, value) of a JSON object of objects of numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, double>>")).alias("name", "measures"))
    return whole.select("name", F.explode("measures").alias("measure", "value"))


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """df as parquet, csv (with a header), tsv or json, in one folder for each value of `by`.  Writing is by parts; rows
    are brought together by `by` first, so that a value has few files."""
    out = (df.repartition(*by) if by else df).write.mode(mode)
    if by:
        out = out.partitionBy(*by)
    if kind in ("csv", "tsv"):
        out = out.options(header=True, escape='"', sep="\t" if kind == "tsv" else ",")
    out.format("csv" if kind == "tsv" else kind).save(path)


def frozen(df: DataFrame, path: str) -> DataFrame:
    """The rows stored under path; if nothing is stored there, df is stored first.  So a sample is drawn once."""
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    write(df, path)
    return df.sparkSession.read.parquet(path)


def require_all(ids: DataFrame, known: DataFrame, key: str) -> None:
    """Raises if an id isn't among the known ones; names up to five."""
    missing = [r[0] for r in ids.join(known, key, "left_anti").select(key).limit(5).collect()]
    if missing:
        raise ValueError(f"unknown {key}: {missing}")
