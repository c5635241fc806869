"""The queries of this folder and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, chat, conversation, decontam, exact_dedup, license_scan, quality, runs, sharding, simhash, substring, toxicity, wrapper


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": toxicity.op1_toxicity, "op2_exact_dedup": exact_dedup.op2_exact_dedup, "op3_license_scan": license_scan.op3_license_scan, "op4_simhash": simhash.op4_simhash, "op5_quality": quality.op5_quality, "op6_sharding": sharding.op6_sharding, "op7_decontamination": decontam.op7_decontamination, "op8_chat_formatting": chat.op8_chat_formatting, "op9_bpe": bpe.op9_bpe, "op10_substring_dedup": substring.op10_substring_dedup, "op11_periodic_runs": runs.op11_periodic_runs, "op12_conversation_repair": conversation.op12_conversation_repair, "op13_html_extraction": wrapper.op13_html_extraction, "license_base_places": license_scan.base_places}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.OP2_SQL, "op8_chat_formatting": chat.OP8_SQL, "op10_substring_dedup": substring.OP10_SQL, "op12_conversation_repair": conversation.OP12_SQL, "op13_html_extraction": wrapper.OP13_SQL, "license_base_places": license_scan.BASE_SQL}
