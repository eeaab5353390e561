"""Running sums and ranks over a whole table in order of a key, without a task that sees the whole table.

Keys are dealt into stretches of 2^STRETCH numbers. Each stretch sums for itself; what lies before a stretch comes from the
sums of stretches, which are dealt into stretches of their own, and so on until at most 2^TOP are left for one window.
Unique keys put at most 2^STRETCH rows into a stretch, whatever the table's size; nothing is sampled or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH, TOP = 20, 24


def _before(sums: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """(stretch, *columns) with sums of all earlier stretches in place of a stretch's own; stretches have `bits` bits."""
    so_far = lambda w, c: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c)
    if bits <= TOP:
        w = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select("stretch", *[so_far(w, c) for c in columns])
    marked = sums.withColumn("upper", F.shiftright("stretch", STRETCH))
    w = Window.partitionBy("upper").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    own = marked.select("upper", "stretch", *[so_far(w, c) for c in columns])
    upper = marked.groupBy(F.col("upper").alias("stretch")).agg(*[F.sum(c).alias(c) for c in columns])
    above = _before(upper, columns, bits - STRETCH).select(F.col("stretch").alias("upper"), *[F.col(c).alias(f"{c}_above") for c in columns])
    return own.join(above, "upper").select("stretch", *[(F.col(c) + F.col(f"{c}_above")).alias(c) for c in columns])


def running(rows: DataFrame, key: str, amounts: dict[str, Column], bits: int = 64) -> DataFrame:
    """rows with a column per amount: its sum over all rows up to and with each, in order of the key, a number of `bits` bits.

    Null amounts count 0. Rows of equal keys have one order among them, which is not fixed. No column may be named `stretch`.
    """
    names = list(amounts)
    marked = rows.withColumns({n: F.coalesce(c, F.lit(0)).cast("long") for n, c in amounts.items()}).withColumn("stretch", F.shiftright(F.col(key).cast("long"), STRETCH))
    sums = marked.groupBy("stretch").agg(*[F.sum(n).alias(n) for n in names])
    before = _before(sums, names, bits - STRETCH).select("stretch", *[F.col(n).alias(f"{n}_before") for n in names])
    w = Window.partitionBy("stretch").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marked.withColumns({n: F.sum(n).over(w) for n in names})
    return inside.join(before, "stretch").withColumns({n: F.col(n) + F.col(f"{n}_before") for n in names}).drop("stretch", *[f"{n}_before" for n in names])
