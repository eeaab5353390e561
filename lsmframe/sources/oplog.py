"""Tables as op-logs (seq, op, key, value), and the names of stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import cents


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return d.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"), F.col("user_id").alias("key"), cents("value").alias("value"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return d.select(F.col("o_orderkey").alias("seq"), F.lit("P").alias("op"), F.col("o_orderkey").alias("key"), cents("o_totalprice").alias("value"))


def run_number(path: Column) -> Column:
    """The number in a run's file name, -1 if the name is none."""
    found = F.regexp_extract(path, r"sst_(\d+)\.dat", 1)
    return F.when(found == "", -1).otherwise(found.try_cast("int"))


def run_level(number: Column) -> Column:
    return F.when(number >= 0, F.floor(number / 2)).cast("int")
