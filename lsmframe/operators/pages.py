"""Page layout of a sorted run as metadata: leaves, offsets, node counts, fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import FANOUT, KEY_BITS, LEAF
from .running import STRETCH, running

#: Levels of internal nodes at most: a tree of fan-out 8 over all keys has eight.
HEIGHT = 8


def leaves(keys: DataFrame, per_leaf: int = LEAF) -> DataFrame:
    """(leaf_no, num_keys, min_key, max_key) of a run's distinct keys in order."""
    ranked = running(keys.select("key").distinct(), "key", {"rank": F.lit(1)}, KEY_BITS)
    return ranked.groupBy(F.floor((F.col("rank") - 1) / per_leaf).cast("int").alias("leaf_no")).agg(F.count("*").alias("num_keys"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def node_count(n: Column, fanout: int = FANOUT) -> Column:
    """Leaves and internal nodes of a tree with n leaves; a single leaf still has a root above it."""
    out = n + F.ceil(n / fanout)
    for k in (k for k in range(2, HEIGHT + 1) if fanout**k < 2**62):  # dividing level by level comes to dividing by a power
        out = out + F.when(F.ceil(n / fanout ** (k - 1)) > 1, F.ceil(n / fanout**k)).otherwise(0)
    return out.cast("long")


def with_offsets(pages: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves with the page they stand at: the first leaf has the highest offset."""
    total = pages.agg(node_count(F.count("*"), fanout).alias("total"))
    return pages.crossJoin(F.broadcast(total)).withColumn("offset", (F.col("total") - F.col("leaf_no")).cast("int")).drop("total")


def internal_fences(pages: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(node_no, children, fence): the internal level above the leaves; a fence is the greatest key below it."""
    return pages.groupBy(F.floor(F.col("leaf_no") / fanout).cast("int").alias("node_no")).agg(F.count("*").alias("children"), F.max("max_key").alias("fence"))


def tree(pages: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(height, node_no, children, fence) of all internal nodes; height 1 stands above the leaves, the root is alone at its height."""
    nodes = None
    below = pages.select(F.col("leaf_no").cast("long").alias("child"), F.col("max_key").alias("fence"))
    total = pages.agg(F.count("*").alias("leaves"))
    for height in range(1, HEIGHT + 1):
        level = below.groupBy(F.floor(F.col("child") / fanout).alias("node_no")).agg(F.count("*").alias("children"), F.max("fence").alias("fence"))
        one = level.select(F.lit(height).alias("height"), "node_no", "children", "fence")
        nodes = one if nodes is None else nodes.unionByName(one)
        below = level.select(F.col("node_no").alias("child"), "fence")
    return nodes.crossJoin(F.broadcast(total)).where((F.col("height") == 1) | (F.col("leaves") > F.pow(F.lit(float(fanout)), F.col("height") - 1))).drop("leaves")


def fence_lookup(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, leaf_no): the first leaf whose greatest key is not below the key, null if there is none.

    Pages and keys are dealt by stretches of the key range. A key's leaf is the least one at or above it in its stretch, or
    else the first of the next stretch that has one.
    """
    asked = keys.select("key").distinct().select("key", F.lit(None).cast("int").alias("leaf_no"))
    marked = asked.unionByName(pages.select(F.col("max_key").alias("key"), "leaf_no")).withColumn("stretch", F.shiftright("key", STRETCH))
    down = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = marked.groupBy("stretch").agg(F.min("leaf_no").alias("first")).select("stretch", F.last("first", ignorenulls=True).over(down).alias("later"))
    w = Window.partitionBy("stretch").orderBy(F.desc("key"), F.col("leaf_no").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marked.withColumn("found", F.last("leaf_no", ignorenulls=True).over(w)).where("leaf_no is null")
    return found.join(later, "stretch").select("key", F.coalesce("found", "later").alias("leaf_no"))


def page_id(path: Column, offset: Column) -> Column:
    return F.concat_ws("-", path, offset.cast("string"))
