"""Sharding by extendible hashing: a directory of hash prefixes, in which only oversized buckets split on another bit.

The hash of a row is 60 bits of the md5 of its key as text. One bucket holds everything at depth 0; a bucket above the byte
limit splits on its next bit, and so on until all fit, so no two buckets that differ in their last bit would fit together.
Sums of bytes come from one aggregation by a prefix STEP bits deeper than that at which an average bucket would fit; rolled
up, STEP depths at a time, it tells which buckets split. Prefixes too large even there go to another round on the next STEP
bits, with their rows only.

Rows whose 60 bits are all equal (repeats of a key) can't be split by the hash: if they exceed the limit, they are dealt
into numbered shards of their bucket (`overflow`), in groups of CHUNK rows on average, so that no task orders them all. A
single row above the limit has a shard of its own. Null keys hash as the empty text; null or empty payloads have 0 bytes. An
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BITS, STEP, LIMIT = 60, 6, 8 << 20
#: Rows of one hash that are dealt into shards together, on average.
CHUNK = 100_000


def prefix(depth) -> object:
    """The first `depth` bits of column h as a number."""
    return F.shiftright("h", BITS - depth) if depth else F.lit(0).cast("long")


def rolled(fine: DataFrame, low: int, deep: int) -> DataFrame:
    """(depth, prefix, bytes, n) of all prefixes of low to deep bits, from rows (prefix, bytes, n) of deep bits."""
    out = None
    while True:
        first = max(low, deep - STEP)
        at = fine.select("prefix", "bytes", "n", F.explode(F.sequence(F.lit(first), F.lit(deep))).alias("depth"))
        sums = at.groupBy("depth", F.expr(f"shiftright(prefix, {deep} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        if first == low:
            return sums if out is None else out.unionByName(sums)
        fine, deep = written(sums.where(F.col("depth") == first).select("prefix", "bytes", "n"), "directory"), first
        sums = sums.where(F.col("depth") > first)
        out = sums if out is None else out.unionByName(sums)


def directory(rows: DataFrame, limit: int, average: int) -> DataFrame:
    """(depth, prefix, bytes, n): the buckets of rows (h, size). A bucket at depth BITS may exceed the limit.

    average: the depth at which an average bucket fits. It sets how deep the first round looks, not the result.
    """
    out, low, deep, left = None, 0, min(BITS, average + STEP), rows
    while True:
        fine = written(left.groupBy(prefix(deep).alias("prefix")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "directory")
        sums = written(rolled(fine, low, deep), "directory")
        whole = (F.col("bytes") <= limit) | (F.col("depth") == BITS)
        parents = sums.where(~whole).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        leaves = sums.where(whole).withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi").drop("parent")
        if not low:
            leaves = leaves.unionByName(sums.where(whole & (F.col("depth") == 0)))
        out = leaves if out is None else out.unionByName(leaves)
        over = sums.where(~whole & (F.col("depth") == deep)).select("prefix")
        if deep == BITS or over.isEmpty():
            return written(out, "directory")
        left = written(left.withColumn("prefix", prefix(deep)).join(over, "prefix", "left_semi").select("h", "size"), "oversized")
        low, deep = deep, min(BITS, deep + STEP)


def overflow(rows: DataFrame, limit: int, chunk: int) -> DataFrame:
    """Rows of one hash that exceed the limit together, in numbered shards: rows above half the limit stand alone (`b`), the
    others go by the running sum of their sizes in steps of half the limit (`s`), so no shard of several rows exceeds it.
    Both run within groups of some `chunk` rows, by the hash of the row's number, which make a hash's rows many tasks' work."""
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("shard_rows") / chunk))
    rows = rows.withColumn("big", F.col("size") * 2 > limit).withColumn("part", part)
    w = Window.partitionBy("h", "big", "part").orderBy("size", "row")
    before = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    number = F.when(F.col("big"), F.row_number().over(w)).otherwise(F.floor(before / max(1, limit // 2)))
    rows = rows.withColumn("number", F.concat(F.when(F.col("big"), "b").otherwise("s"), F.col("part").cast("string"), F.lit("-"), number.cast("string")))
    one = Window.partitionBy("h", "number")
    return rows.withColumn("shard_bytes", F.sum("size").over(one)).withColumn("shard_rows", F.count("*").over(one)).drop("big", "part")


def shard(df: DataFrame, key_col: str, payload_col: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """Per row: key, n_bytes, shard (bits of its bucket, with a number after a dot where rows of one hash overflow), depth,
    shard_bytes and shard_rows."""
    key = F.coalesce(df[key_col].cast("string"), F.lit(""))
    rows = df.select(df[key_col].alias("key"), F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long").alias("h"), F.coalesce(F.octet_length(df[payload_col]), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "sizes")  # which also fixes the rows' numbers
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = directory(rows.select("h", "size"), limit, math.ceil(math.log2(total / limit)) if total > limit else 0)
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())
    out = None
    for d in depths:
        at = leaves.where(F.col("depth") == d).select(F.col("prefix").alias("p"), "depth", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))
        got = rows.withColumn("p", prefix(d)).join(at, "p")
        bits = F.lpad(F.bin("p"), d, "0") if d else F.lit("")
        if d == BITS:
            over = overflow(got.where(F.col("shard_bytes") > limit), limit, chunk)
            got = got.where(F.col("shard_bytes") <= limit).withColumn("number", F.lit(None).cast("string")).unionByName(over)
            bits = F.concat_ws(".", bits, F.col("number"))
        found = got.select("key", F.col("size").alias("n_bytes"), bits.alias("shard"), "depth", "shard_bytes", "shard_rows")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select("key", F.col("size").alias("n_bytes"), F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"))
    return out.withColumnRenamed("key", key_col)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), "doc_id", "text")


OP8_SQL = f"""
WITH r AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS h, coalesce(octet_length(encode(text)), 0) AS size
  FROM documents
), b AS (
  SELECT d AS depth, h >> ({BITS} - d) AS p, sum(size) AS shard_bytes, count(*) AS shard_rows
  FROM r, range(0, {BITS + 1}) AS t(d) GROUP BY 1, 2
), f AS (
  SELECT r.doc_id, r.h, r.size, min(b.depth) AS depth
  FROM r, b WHERE b.p = (r.h >> ({BITS} - b.depth)) AND b.shard_bytes <= {LIMIT} GROUP BY ALL
)
SELECT f.doc_id, CAST(f.size AS BIGINT) AS n_bytes,
       CASE WHEN f.depth = 0 THEN '' ELSE lpad(CAST(CAST(b.p AS BIT) AS VARCHAR)[64 - f.depth + 1:], CAST(f.depth AS INTEGER), '0') END AS shard,
       CAST(f.depth AS INTEGER) AS depth, CAST(b.shard_bytes AS BIGINT) AS shard_bytes, b.shard_rows
FROM f JOIN b ON b.depth = f.depth AND b.p = (f.h >> ({BITS} - f.depth))
"""
