"""XXH64 with a seed on Catalyst's own expression (no UDF), and its unsigned remainder."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def xxh64(c: Column, seed: int = 0) -> Column:
    """The hash of a 4-byte integer or of a string's UTF-8 bytes, as a signed 64-bit number."""
    from pyspark.sql.classic.column import Column as Classic

    jvm = SparkContext._active_spark_context._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    child = jvm.scala.jdk.javaapi.CollectionConverters.asScala(jvm.java.util.ArrayList([utils.expression(c._jc)])).toSeq()
    return Classic(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(child, seed)))


def key32(c: Column) -> Column:
    """A key of 0..2^32-1 as the 4-byte integer with the same bytes."""
    return F.when(c >= 2**31, c - 2**32).otherwise(c).cast("int")


def unsigned_mod(h: Column, m: int | Column) -> Column:
    return ((F.shiftrightunsigned(h, 1) % m) * 2 + h.bitwiseAND(F.lit(1).cast("long"))) % m


def low_bits(h: Column, depth: int) -> Column:
    """The low `depth` bits as a string of 0 and 1."""
    return F.lpad(F.bin(h.bitwiseAND(F.lit((1 << depth) - 1).cast("long"))), depth, "0") if depth else F.lit("")
