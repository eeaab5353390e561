"""Bloom filters with exact bit positions. For pruning at scale the runs' own Parquet Bloom filters do the work."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import key32, unsigned_mod, xxh64
from ..functions.values import BLOOM_MAX


def total_bits(per_entry: int, entries: Column) -> Column:
    return F.least(F.lit(per_entry) * entries, F.lit(BLOOM_MAX)).cast("int")


def hashes(per_entry: int) -> int:
    return round(math.log(2) * per_entry)


def positions(key: Column, bits: int | Column, k: int) -> Column:
    return F.array(*[unsigned_mod(xxh64(key32(key), seed), bits).cast("int") for seed in range(k)])


def build(keys: DataFrame, bits: int | Column, k: int, *by: str) -> DataFrame:
    """One filter per group of `by`, or one in all: (*by, total_bits, k, positions, bitmap), from rows (key, *by).

    bits may be a column that is the same throughout a group. bitmap holds 64 bits a number. A filter has at most BLOOM_MAX
    positions, whatever the number of keys.
    """
    found = keys.select(*by, F.lit(bits).alias("total_bits"), F.explode(positions(F.col("key"), bits, k)).alias("p"))
    words = found.groupBy(*by, "total_bits", F.floor(F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("set"), F.collect_set("p").alias("ps"))
    one = words.groupBy(*by, "total_bits").agg(F.sort_array(F.flatten(F.collect_list("ps"))).alias("positions"), F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("m"))
    last = F.floor((F.col("total_bits") - 1) / 64).cast("int")
    bitmap = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long")))
    return one.select(*by, "total_bits", F.lit(k).alias("k"), "positions", bitmap.alias("bitmap"))


def maybe(key: Column, bits: int | Column, k: int, bitmap: Column) -> Column:
    """Whether all positions of a key are set."""
    return F.forall(positions(key, bits, k), lambda p: F.call_function("shiftright", F.element_at(bitmap, (F.floor(p / 64) + 1).cast("int")), p % 64).bitwiseAND(F.lit(1).cast("long")) == 1)


def probe(keys: DataFrame, bloom: DataFrame, bits: int, k: int) -> DataFrame:
    """Keys with `maybe`: whether all their positions are set. The filter is one row; without one, no key may be in it."""
    held = F.broadcast(bloom.agg(F.first("bitmap").alias("bitmap")))
    return keys.select("key").crossJoin(held).select("key", F.coalesce(maybe(F.col("key"), bits, k, F.col("bitmap")), F.lit(False)).alias("maybe"))
