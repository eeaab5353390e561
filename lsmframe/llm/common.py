"""What the operators share: reading tables, intermediate tables, slices of bounded size, memory handed back, names that clash
with none."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, scratch, shared_dir, written

__all__ = ["crc_mod", "discard", "free_name", "scratch", "shared_dir", "shed", "slices", "table", "text_list", "tidy", "written"]

#: Bytes of text that a Python worker turns into strings at once, unless one text is longer.
SLICE = 2 << 20
#: Rows of an Arrow batch between the JVM and a Python worker. Texts vary in length: Spark's own 10,000 can be very many bytes.
ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. For this session it also holds Arrow batches to ROWS rows, if they are allowed more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have `most` bytes together at most; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def tidy(run: Callable) -> Callable:
    """A task's function that hands freed memory back to the system in the end: Python workers live on and serve other operators."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def shed(spark: SparkSession) -> None:
    """Has executors' JVMs hand unused heap back to the system: they keep the heap that earlier work needed until all of it is
    collected at once, and Python workers beside them need room. A task for each core, so every executor that is idle gets some;
    one that gets none only keeps its heap."""
    sc = spark.sparkContext
    n = 1 if sc.master.split("[")[0] == "local" else sc.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def text_list(column) -> list[str]:
    """An Arrow string column as str, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def free_name(wanted: str, columns: list[str]) -> str:
    """wanted, with underscores before it until no column has that name or begins with it, whatever the case."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(wanted.lower()) for c in taken):
        wanted = "_" + wanted
    return wanted


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))
