"""An extendible hash directory over page ids: buckets, insertion, look-up, removal, expansion, shrinking, splits and merges.

The directory is a function of the pages it holds: (bucket, local_depth, pages), a bucket being the low bits that its pages'
hashes share. Pages are a DataFrame with `page_id`; repeated ids are one page, null ids none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import low_bits, xxh64

#: Bits by which one round of `split` looks deeper: four rounds at most for 64 bits, as a plan doubles with each.
STEP = 20


def bucket_id(page_id: Column, depth: int) -> Column:
    return low_bits(xxh64(page_id, 0), depth)


def depths(min_size: int, max_size: int) -> tuple[int, int]:
    """Global depth at first and at most, for a directory of min_size to max_size entries."""
    if not 1 <= min_size <= max_size:
        raise ValueError("1 <= min_size <= max_size is needed")
    return min_size.bit_length() - 1, max_size.bit_length() - 1


def create(spark: SparkSession, min_size: int) -> DataFrame:
    """The first entries (id, bucket): as many as the greatest power of two within min_size, each with a bucket of its own."""
    depth = depths(min_size, min_size)[0]
    bits = F.lpad(F.bin("id"), depth, "0") if depth else F.lit("")
    return spark.range(1 << depth).select(bits.alias("id"), bits.alias("bucket"))


def expand(directory: DataFrame) -> DataFrame:
    """Twice the entries (id, bucket): each id with 0 and 1 before it shares its bucket."""
    return directory.select(F.explode(F.array(F.lit("0"), F.lit("1"))).alias("bit"), "id", "bucket").select(F.concat("bit", "id").alias("id"), "bucket")


def shrink(directory: DataFrame) -> DataFrame:
    """Half the entries: ids without their first bit, with the lesser bucket of the pair."""
    return directory.groupBy(F.expr("substr(id, 2)").alias("id")).agg(F.min("bucket").alias("bucket"))


def pair(bucket: Column) -> Column:
    """The bucket that differs in the first bit."""
    return F.concat(F.translate(F.substring(bucket, 1, 1), "01", "10"), bucket.substr(F.lit(2), F.length(bucket)))


def distinct_pages(pages: DataFrame) -> DataFrame:
    return pages.where("page_id is not null").select("page_id").distinct()


def insert(pages: DataFrame, more: DataFrame) -> DataFrame:
    """The pages with more pages; those that are there already stay as they are."""
    return distinct_pages(pages.select("page_id").unionByName(more.select("page_id")))


def get(pages: DataFrame, page_id: str, depth: int) -> DataFrame:
    """(page_id, bucket) of one page, or no row."""
    return distinct_pages(pages.where(F.col("page_id") == page_id)).select("page_id", bucket_id(F.col("page_id"), depth).alias("bucket"))


def remove(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """The pages without those that are named; names that aren't there do nothing."""
    return distinct_pages(pages).join(gone.select("page_id").distinct(), "page_id", "left_anti")


def sizes(pages: DataFrame, depth: int) -> DataFrame:
    """(bucket, pages) at a depth; distinct pages, so shared buckets don't repeat them."""
    return distinct_pages(pages).groupBy(bucket_id(F.col("page_id"), depth).alias("bucket")).agg(F.count("*").alias("pages"))


def split(pages: DataFrame, bucket_max: int, depth: int, max_depth: int) -> DataFrame:
    """(bucket, local_depth, pages): buckets above bucket_max split on the next low bit, down to max_depth.

    Pages are counted by the low bits of their hashes, STEP bits below the depth; these counts, not the pages, are added up
    for the depths between. Only the pages of buckets too large even there go to the next round.
    """
    bits = lambda d: F.expr(f"right(lpad(bin(h), 64, '0'), {d})") if d else F.lit("")
    left, low, out = distinct_pages(pages).select(xxh64(F.col("page_id"), 0).alias("h")), depth, None
    while True:
        deep = min(max_depth, low + STEP)
        fine = left.groupBy(bits(deep).alias("id")).agg(F.count("*").alias("pages"))
        at = fine.select("id", "pages", F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("local_depth"))
        counted = at.groupBy("local_depth", F.expr("right(id, local_depth)").alias("bucket")).agg(F.sum("pages").alias("pages"))
        small = (F.col("pages") <= bucket_max) | (F.col("local_depth") == max_depth)
        over = counted.where(~small).select((F.col("local_depth") + 1).alias("local_depth"), F.col("bucket").alias("parent"))
        fits = counted.where(small).withColumn("parent", F.expr("substr(bucket, 2)"))
        leaves = fits.join(over, ["local_depth", "parent"], "left_semi").select("bucket", "local_depth", "pages")
        if low == depth:
            leaves = leaves.unionByName(fits.where(F.col("local_depth") == depth).select("bucket", "local_depth", "pages"))
        out = leaves if out is None else out.unionByName(leaves)
        if deep == max_depth:
            return out
        more = counted.where((F.col("local_depth") == deep) & ~small).select(F.col("bucket").alias("id"))
        left, low = left.withColumn("id", bits(deep)).join(more, "id", "left_semi").select("h"), deep


def merge(buckets: DataFrame, bucket_max: int) -> DataFrame:
    """Buckets after one round of merging: pairs of the same local depth that fit together become one, a bit shallower."""
    sides = buckets.where("local_depth > 0").groupBy("local_depth", F.expr("substr(bucket, 2)").alias("parent")).agg(F.sum("pages").alias("both"), F.count("*").alias("sides"))
    fits = sides.where((F.col("both") <= bucket_max) & (F.col("sides") == 2)).select("local_depth", "parent", "both")
    marked = buckets.withColumn("parent", F.expr("substr(bucket, 2)")).join(fits, ["local_depth", "parent"], "left")
    joined = F.col("both").isNotNull()
    return marked.select(F.when(joined, F.col("parent")).otherwise(F.col("bucket")).alias("bucket"), F.when(joined, F.col("local_depth") - 1).otherwise(F.col("local_depth")).alias("local_depth"), F.coalesce("both", "pages").alias("pages")).distinct()


def counters(buckets: DataFrame, depth: int) -> DataFrame:
    """(global_depth, size, num_directory, num_buckets): the deepest bucket, the pages, 2^global_depth entries, and the buckets that hold pages."""
    got = buckets.agg(F.greatest(F.lit(depth), F.coalesce(F.max("local_depth"), F.lit(0))).alias("global_depth"), F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("size"), F.count("*").alias("num_buckets"))
    return got.select("global_depth", "size", F.pow(F.lit(2.0), "global_depth").cast("long").alias("num_directory"), "num_buckets")


