"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, decontamination, jaccard_join, language_id, media, packing, quality, sharding, token_counts, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_media": media.op3_media,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_chat_format": chat.op5_chat_format,
        "op6_token_files": token_files.op6_token_files,
        "op7_quality": quality.op7_quality,
        "op8_sharding": sharding.op8_sharding,
        "op9_language_id": language_id.op9_language_id,
        "op10_packing": packing.op10_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_sharding": sharding.OP8_SQL}
