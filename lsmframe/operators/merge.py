"""Runs and their merges: newest wins, tombstones go where nothing older lies below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import versions


def runs(placed: DataFrame) -> DataFrame:
    """(level, key, value, is_tombstone, seq) of the stored levels."""
    return versions(placed.where("level >= 0"), "level", "key").select("level", "key", F.when(F.col("op") == "P", F.col("value")).alias("value"), (F.col("op") == "D").alias("is_tombstone"), "seq")


def merge(older: DataFrame, newer: DataFrame, last_level: bool = False) -> DataFrame:
    """Two runs of (key, value, is_tombstone, seq) into one; at the last level without tombstones."""
    both = older.select("key", "value", "is_tombstone", "seq").unionByName(newer.select("key", "value", "is_tombstone", "seq"))
    out = both.groupBy("key").agg(F.max_by(F.struct("value", "is_tombstone", "seq"), "seq").alias("new")).select("key", "new.value", "new.is_tombstone", "new.seq")
    return out.where("not is_tombstone") if last_level else out


def newest_run(rows: DataFrame, last_level: bool) -> DataFrame:
    """One run out of rows (key, value, is_tombstone, seq, run): of each key the last op of its newest run."""
    got = rows.groupBy("key").agg(F.max_by(F.struct("value", "is_tombstone", "seq"), F.struct("run", F.col("seq").alias("at"))).alias("new")).select("key", "new.value", "new.is_tombstone", "new.seq")
    return got.where("not is_tombstone") if last_level else got


def compact(levels: DataFrame) -> DataFrame:
    """All levels into one in a single aggregation, where a cascade would rewrite a key once a level."""
    return levels.groupBy("key").agg(F.max_by(F.struct("value", "is_tombstone", "seq"), "seq").alias("new")).where("not new.is_tombstone").select("key", "new.value", "new.seq")


def collected(levels: DataFrame) -> DataFrame:
    """Levels without the tombstones of the highest occupied one, if that is above 0."""
    top = levels.agg(F.max("level").alias("top"))
    return levels.crossJoin(F.broadcast(top)).where("not (is_tombstone and level = top and top >= 1)").drop("top")


def flush_batches(placed: DataFrame) -> DataFrame:
    p = F.col("op") == "P"
    return placed.groupBy("run").agg(F.count("*").alias("ops"), F.sum(p.cast("long")).alias("puts"), F.count_distinct("key").alias("keys"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def level_layout(placed: DataFrame) -> DataFrame:
    stored = placed.where("level >= 0")
    return stored.groupBy("level").agg(F.count_distinct("run").alias("runs"), F.count_distinct("key").alias("keys"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), (F.first("level") * 2).cast("long").alias("sst_num"))
