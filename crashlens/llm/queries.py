"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crashlens.llm import bins, chat, decontamination, importance, jaccard, language, lexical, lines, packing, substrings, token_counts, token_files, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_language_id": language.op3_language_id,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_token_output": token_files.op9_token_output,
    "op10_exact_top_k": topk.op10_exact_top_k,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_packing": bins.op12_packing,
    "op13_ranked_search": lexical.op13_ranked_search,
}
ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op6_substring_dedup": substrings.ORACLE,
    "op7_chat_formatting": chat.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op13_ranked_search": lexical.ORACLE,
}
