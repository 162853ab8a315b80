"""Queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import brown, chat, decontaminate, huffman, langid, mpegaudio, packing, phrases, simhash, suffixes, tokens, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_mpeg_audio": mpegaudio.op2_mpeg_audio,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_language_id": langid.op5_language_id,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_brown_scores": brown.op8_brown_scores,
        "op9_simhash_neardup": simhash.op9_simhash_neardup,
        "op10_huffman_ids": huffman.op10_huffman_ids,
        "op11_phrase_collocations": phrases.op11_phrase_collocations,
        "op12_chat_formatting": chat.op12_chat_formatting,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_phrase_collocations": phrases.ORACLE_SQL}
