"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ans, cdc, chat, decontam, mixing, pii, quality, simhash, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_substring_dedup": cdc.op2_substring_dedup,
        "op3_topk": topk.op3_topk,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_token_output": ans.op5_token_output,
        "op6_quality": quality.op6_quality,
        "op7_mixing": mixing.op7_mixing,
        "op8_warc": warc.op8_warc,
        "op9_simhash": simhash.op9_simhash,
        "op10_chat": chat.op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": topk.OP3_SQL, "op4_decontamination": decontam.OP4_SQL, "op7_mixing": mixing.OP7_SQL, "op8_warc": warc.OP8_SQL, "op10_chat": chat.OP10_SQL}
