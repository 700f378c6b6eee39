"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import chat, decontaminate, exact_dedup, langid, lm_score, simhash, token_counts, token_ids, warc, word_table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": token_ids.query,
        "op2_warc": warc.query,
        "op3_token_counts": token_counts.query,
        "op4_word_table_bpe": word_table.query,
        "op5_simhash": simhash.query,
        "op6_chat_format": chat.query,
        "op7_decontaminate": decontaminate.query,
        "op8_language_id": langid.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_lm_score": lm_score.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": chat.SQL, "op9_exact_dedup": exact_dedup.SQL}
