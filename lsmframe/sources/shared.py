"""The folder that driver and executors share, and intermediate tables in it.

Everything written here lies below one folder per application, which goes when the driver ends; what a later table replaces
goes at once (`discard`).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder serves local sessions only: on a cluster no executor could
    read another's, so there it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="lsmframe-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


def removed(spark: SparkSession, path: str) -> bool:
    """Whether the path was there; it is gone now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _end(spark: SparkSession, path: str) -> None:
    try:
        removed(spark, path)
    except Exception:  # the JVM is gone: nothing is left to remove it with  # noqa: BLE001
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Runs never reuse one, so a repeated run reads nothing stale."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
        atexit.register(_end, spark, _RUNS[app])
    return f"{_RUNS[app]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage ends there and lost executors cost no rerun."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that `written` made, once nothing reads them any more. Others, and None, are left alone."""
    for t in tables:
        if path := getattr(t, "_written_at", None):
            removed(t.sparkSession, path)
