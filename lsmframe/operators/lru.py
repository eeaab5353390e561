"""Least-recently-used order, victims, hits and evictions of an access trace (seq, page).

`replay_whole` replays one trace of any length: it is cut into stretches, and a cache's content at the start of a stretch is
the pages accessed last before it, so stretches are replayed on their own once these are known.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 16


def order(trace: DataFrame) -> DataFrame:
    """(page, last_seq); the most recent page has the greatest."""
    return trace.groupBy("page").agg(F.max("seq").alias("last_seq"))


def victims(trace: DataFrame, capacity: int) -> DataFrame:
    """(page, last_seq) of the pages that a cache of this capacity no longer holds; its `capacity` newest stay."""
    held = order(trace)
    kept = held.orderBy(F.desc("last_seq"), "page").limit(capacity)
    return held.join(F.broadcast(kept.select("page")), "page", "left_anti") if capacity <= 100_000 else held.join(kept.select("page"), "page", "left_anti")


def stepped(cache: OrderedDict, ops, capacity: int) -> tuple[list, list]:
    """Plays (op, page) on a cache, least recent first: whether each was there, and what it evicted.

    Ops: A access (puts a missing page in front, a present one to the front), R remove (nothing, if absent), E evict the least
    recent page. Null ops are accesses.
    """
    hit, out = [], []
    for op, page in ops:
        hit.append(page in cache if op != "E" else False)
        gone = None
        if op == "R":
            cache.pop(page, None)
        elif op == "E":
            gone = cache.popitem(last=False)[0] if cache else None
        else:
            cache[page] = True
            cache.move_to_end(page)
            if len(cache) > capacity:
                gone = cache.popitem(last=False)[0]
        out.append(gone)
    return hit, out


def replay(trace: DataFrame, capacity: int) -> DataFrame:
    """(trace, seq, page, hit, evicted): each trace replayed on its own, in order; memory holds one trace. Rows may have an op."""
    ops = trace if "op" in trace.columns else trace.withColumn("op", F.lit("A"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        hit, out = stepped(OrderedDict(), zip(pdf["op"], pdf["page"], strict=True), capacity)
        return pdf.assign(hit=hit, evicted=pd.Series(out, pdf.index, dtype=object))[["trace", "seq", "page", "hit", "evicted"]]

    kind = trace.schema["page"].dataType.simpleString()
    return ops.select("trace", "seq", "page", "op").groupBy("trace").applyInPandas(one, f"trace {trace.schema['trace'].dataType.simpleString()}, seq long, page {kind}, hit boolean, evicted {kind}")


def states(trace: DataFrame, capacity: int, bits: int = STRETCH) -> DataFrame:
    """(stretch, page, age): what a cache holds before each stretch of 2^bits sequence numbers, the most recent at age 0.

    Each stretch hands on its `capacity` most recent pages; one task streams these in order and holds one cache. Its rows grow
    with the number of stretches, not with the trace.
    """
    kind = trace.schema["page"].dataType.simpleString()
    last = trace.groupBy(F.shiftright("seq", bits).alias("stretch"), "page").agg(F.max("seq").alias("seq"))
    newest = last.withColumn("k", F.row_number().over(Window.partitionBy("stretch").orderBy(F.desc("seq")))).where(F.col("k") <= capacity).select("stretch", "page", "seq")

    def run(batches):
        cache, at = OrderedDict(), None
        for pdf in batches:
            out = []
            for stretch, page in zip(pdf["stretch"].tolist(), pdf["page"].tolist(), strict=True):
                if stretch != at:
                    at = stretch
                    out += [(stretch, p, age) for age, p in enumerate(reversed(cache))]
                cache[page] = True
                cache.move_to_end(page)
                if len(cache) > capacity:
                    cache.popitem(last=False)
            yield pd.DataFrame(out, columns=["stretch", "page", "age"])

    return newest.repartition(1).sortWithinPartitions("stretch", "seq").mapInPandas(run, f"stretch long, page {kind}, age int")


def replay_whole(trace: DataFrame, capacity: int, bits: int = STRETCH) -> DataFrame:
    """(seq, page, hit, evicted) of one trace of accesses; a task holds the accesses of one stretch."""
    kind = trace.schema["page"].dataType.simpleString()
    accesses = trace.select("seq", "page").withColumn("stretch", F.shiftright("seq", bits))

    def one(key, before: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        cache = OrderedDict.fromkeys(before.sort_values("age", ascending=False)["page"], True)
        hit, out = stepped(cache, (("A", p) for p in pdf["page"]), capacity)
        return pdf.assign(hit=hit, evicted=pd.Series(out, pdf.index, dtype=object))[["seq", "page", "hit", "evicted"]]

    return states(trace, capacity, bits).groupBy("stretch").cogroup(accesses.groupBy("stretch")).applyInPandas(one, f"seq long, page {kind}, hit boolean, evicted {kind}")
