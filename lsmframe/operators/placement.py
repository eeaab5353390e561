"""Which run and level each op lands in, in closed form: no replay of flushes or merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def level_of(run: Column, n: Column) -> Column:
    """The level that a run is in once n runs have been flushed; -1 is the memtable."""
    return F.when(run >= n, -1).otherwise(F.length(F.bin(run.bitwiseXOR(n))) - 1).cast("int")


def run_of(op: Column, puts: Column, memtable: int) -> Column:
    """The run of an op, given the puts up to and with it. Deletes don't count towards the memtable's size, overwrites do."""
    return F.floor(F.when(op == "P", puts - 1).otherwise(puts) / memtable).cast("long")


def place(oplog: DataFrame, memtable: int) -> DataFrame:
    """The op-log with `run`, `n` (runs flushed in all) and `level`; level -1 is the memtable. A log without ops gives no rows."""
    put = (F.col("op") == "P").cast("long")
    total = oplog.agg(F.floor(F.coalesce(F.sum(put), F.lit(0)) / memtable).cast("long").alias("n"))
    counted = running(oplog, "seq", {"puts": put}).withColumn("run", run_of(F.col("op"), F.col("puts"), memtable))
    return counted.crossJoin(F.broadcast(total)).withColumn("level", level_of(F.col("run"), F.col("n"))).drop("puts")


def place_with_closes(oplog: DataFrame, memtable: int) -> DataFrame:
    """As `place`, for a log that also has closes (op 'C'), which flush what the memtable holds and begin a new count.

    A close over an empty memtable adds no run. Closes cut the log into segments, numbered by a running count; puts and runs
    before a segment are running sums over the table of segments.
    """
    put, close = (F.col("op") == "P").cast("long"), (F.col("op") == "C").cast("long")
    counted = running(oplog, "seq", {"puts": put, "segment": close})
    ops = counted.where("op <> 'C'")
    closes = counted.where("op = 'C'").select((F.col("segment") - 1).alias("segment"), F.lit(True).alias("closed"))
    own = ops.groupBy("segment").agg(F.sum(put).alias("own"), F.max(F.when(F.col("op") == "D", F.col("puts"))).alias("last_delete"), F.max("puts").alias("last_put"))
    segments = own.join(closes, "segment", "left")
    based = running(segments, "segment", {"until": F.col("own")}).withColumn("base", F.col("until") - F.col("own"))
    # after the last full run something is left to flush if a put or a delete came later
    rest = (F.col("own") % memtable > 0) | (F.col("last_delete") - F.col("base") >= F.floor(F.col("own") / memtable) * memtable)
    runs = F.floor(F.col("own") / memtable) + F.when(F.col("closed") & rest, 1).otherwise(0)
    summed = running(based.withColumn("runs", runs.cast("long")), "segment", {"runs_until": F.col("runs")}).select("segment", "base", "runs", (F.col("runs_until") - F.col("runs")).alias("first_run"))
    total = summed.agg(F.coalesce(F.sum("runs"), F.lit(0)).cast("long").alias("n"))
    placed = ops.join(summed, "segment").withColumn("run", F.col("first_run") + run_of(F.col("op"), F.col("puts") - F.col("base"), memtable))
    return placed.crossJoin(F.broadcast(total)).withColumn("level", level_of(F.col("run"), F.col("n"))).select("seq", "op", "key", "value", "run", "n", "level")
