"""A corpus pipeline of five stages, each calling one operator of lsmframe.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The first four return the columns
of documents; the last returns the packed pieces. A null text is an empty one; it has no language and goes in the first
stage. Empty tables pass through. Executors live on from stage to stage, so each stage has them shed the heap of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lsmframe.llm import decontamination, jaccard_join, language_id, packing, quality
from lsmframe.llm.common import discard, shed, table, written


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shed(spark)
    return language_id.stage(spark, docs, sf_dir)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shed(spark)
    return quality.stage(spark, docs, sf_dir)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shed(spark)
    return jaccard_join.stage(spark, docs, sf_dir)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shed(spark)
    return decontamination.stage(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shed(spark)
    return packing.stage(spark, docs, sf_dir)


STAGES = [
    ("language ID", recognised),
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", clean),
    ("packing", packed),
]

#: The stages learn models and hash shingles, which SQL does not express; a test holds run()'s rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's table stands in the shared folder until the next one's is written; the last one's stays
    for the result, which reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        was, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        discard(was)
    return STAGES[-1][1](spark, docs, sf_dir)
