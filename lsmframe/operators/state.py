"""Reads: the latest state, point and batched gets, range scans. Filters on the key reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import NOT_FOUND


def newest(*keys: str):
    """Aggregates (op, value, seq) of the newest row of a group; the struct keeps null values from being skipped."""
    return F.max_by(F.struct("op", "value", "seq"), "seq").alias("new")


def versions(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per group of `keys`, tombstones included. Partial aggregation before the shuffle absorbs hot keys."""
    return rows.groupBy(*keys).agg(newest()).select(*keys, "new.op", "new.value", "new.seq")


def latest(oplog: DataFrame) -> DataFrame:
    return versions(oplog, "key").where("op = 'P'").select("key", "value")


def get(oplog: DataFrame, key: int) -> DataFrame:
    """(key, value); no row if the key is absent or deleted."""
    return latest(oplog.where(F.col("key") == key))


def multi_get(oplog: DataFrame, keys: DataFrame) -> DataFrame:
    """Each distinct key of `keys` with its value, null if absent or deleted. Only its keys are aggregated."""
    wanted = keys.select("key").distinct()
    return wanted.join(latest(oplog.join(wanted, "key", "left_semi")), "key", "left")


def newest_of_levels(rows: DataFrame, *more: str) -> DataFrame:
    """(key, value, *more) of rows (seq, op, key, value, level): the least level that has a key decides, within it the last op."""
    order = F.struct((-F.col("level")).alias("depth"), F.col("seq").alias("at"))
    got = rows.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), order).alias("new"))
    return got.where("new.op = 'P'").select("key", "new.value", *[f"new.{c}" for c in more])


def scan(oplog: DataFrame, start: int, end: int) -> DataFrame:
    """Latest values of keys in [start, end], both inclusive, without tombstones."""
    return latest(oplog.where(F.col("key").between(start, end)))


def scan_versions(placed: DataFrame, start: int, end: int) -> DataFrame:
    """Every physical version, one per level and key; a tombstone's value is the not-found sentinel."""
    rows = versions(placed.where(F.col("key").between(start, end)), "level", "key")
    return rows.select("level", "key", F.when(F.col("op") == "D", NOT_FOUND).otherwise(F.col("value")).cast("long").alias("value"))


def memtable_scan(placed: DataFrame, start: int, end: int) -> DataFrame:
    return scan_versions(placed.where("level = -1"), start, end)


def newest_level_wins(runs: DataFrame) -> DataFrame:
    """Point reads of all keys over stored levels, without sequence numbers: the lowest level that has a key decides."""
    return runs.groupBy("key").agg(F.min_by(F.struct("is_tombstone", "value"), "level").alias("new")).where("not new.is_tombstone").select("key", "new.value")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables of equal columns has, or has more often: (*columns, more), more on the left counting up.

    Two tables are equal in content if there are none. Nulls equal nulls.
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("_side").alias("more")).where("more <> 0")


def identical(left: DataFrame, right: DataFrame) -> bool:
    return sorted(left.columns) == sorted(right.columns) and differences(left, right).isEmpty()
