"""Registry of the queries over the text tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, mixing, neardup, packing, pii, pipeline, quality, substrings, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_urls": urls.op2_urls,
        "op3_neardup": neardup.op3_neardup,
        "op4_licenses": licenses.op4_licenses,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_chat": chat.op6_chat,
        "op7_quality": quality.op7_quality,
        "op8_pii": pii.op8_pii,
        "op9_substrings": substrings.op9_substrings,
        "op10_packing": packing.op10_packing,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontaminate.OP5_SQL, "op6_chat": chat.OP6_SQL}
