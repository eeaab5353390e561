"""Value domain: unsigned 32-bit numbers held as LONG, with the two sentinels of the compatibility edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NOT_FOUND = 2**32 - 1
TOMBSTONE = 2**32 - 2
FANOUT, LEAF = 509, 508
BLOOM_MAX = 4088
SIZE_RATIO = 2
#: Entries of a memtable in the benchmarks.
MEMTABLE = 131_072

KEY_BITS = 32


def valid(oplog: DataFrame) -> DataFrame:
    """The op-log, which fails on rows outside the domain: unknown ops, keys or put values that are null or no user value."""
    key_ok = F.col("key").between(0, TOMBSTONE - 1)
    ok = F.col("seq").isNotNull() & key_ok & (F.col("op").isin("D", "C") | ((F.col("op") == "P") & F.col("value").between(0, TOMBSTONE - 1)))
    return oplog.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("not a valid op-log row: "), F.to_json(F.struct("seq", "op", "key", "value"))))))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")
