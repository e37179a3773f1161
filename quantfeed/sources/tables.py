"""Tables that jobs write and read again: panels by day and the ledger of sent keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, for what a job writes and reads again."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.gettempdir() + '/checkpoints'}/feeds-{uuid.uuid4().hex}"


def written_down(df: DataFrame) -> DataFrame:
    """The rows, written to a shared folder and read from there: what made them isn't run again."""
    path = work_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_days(df: DataFrame, path: str, day: str = "day", parts: int = 1) -> None:
    """Replace the days that ``df`` holds, and only those; other days stay. A day is dealt to ``parts`` tasks, a file each."""
    df.repartition(day, F.pmod(F.xxhash64(*df.columns), F.lit(parts))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_whole(df: DataFrame, path: str) -> None:
    """Replace a table all or not at all: rows go to a folder of their own, then one small file names it.

    A write that fails leaves the table as it was; readers see the old rows or the new ones. Earlier versions stay.
    """
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/rows-{version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written_at")).write.mode("append").parquet(f"{path}/versions")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that write_whole finished."""
    newest = spark.read.parquet(f"{path}/versions").agg(F.max_by("version", "written_at")).first()[0]
    return spark.read.parquet(f"{path}/rows-{newest}")


def read_ledger(spark: SparkSession, path: str, ref: Column, hours: int = 72) -> DataFrame:
    """Ledger (key, first_seen) from JSON lines: damaged lines, bad times and old entries are left out."""
    raw = spark.read.schema("key string, first_seen string").option("mode", "DROPMALFORMED").json(path)
    seen = F.try_to_timestamp("first_seen")
    x = raw.select("key", seen.alias("first_seen")).filter("key is not null and first_seen is not null")
    return x.filter(F.unix_micros("first_seen") >= F.unix_micros(ref) - hours * 3_600_000_000)


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger.select("key", F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss").alias("first_seen")).write.mode("overwrite").json(path)
