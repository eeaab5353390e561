"""Streams of ops into a store: what a micro-batch leaves in the memtable is flushed at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Config, Store


def stream_to_store(ops: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """ops: a streaming DataFrame (seq, op, key, value). A batch that is run again adds the same versions, which changes no
    read."""

    def flush(batch: DataFrame, _: int) -> None:
        store = Store(batch.sparkSession, Config(root))
        store.put_batch(batch)
        store.flush()

    out = ops.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def read_oplog_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("seq long, op string, key long, value long").parquet(path)
