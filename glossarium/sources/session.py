"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder it was loaded from."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor sees: spark.checkpoint.dir.  Where the session names none
    and runs on this machine alone, as in tests, a folder of our own; elsewhere ValueError."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glossarium-checkpoint-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as a compressed table to the shared folder; for wide rows that are read again by
    columns.  The session's checkpoint folder is cleared with the session's data."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores; only a small input, read in few splits, is moved."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
