"""The queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import chat, decontaminate, laesa, ngram_join, repair
from plumbline.llm.chat import op2_chat_formatting
from plumbline.llm.decontaminate import op10_benchmark_decontamination
from plumbline.llm.laesa import op12_laesa_clustering
from plumbline.llm.language_model import op4_language_model
from plumbline.llm.ngram_join import op1_ngram_jaccard_join
from plumbline.llm.pieces import op9_sentencepiece
from plumbline.llm.pii import op7_personal_data
from plumbline.llm.quality import op5_quality_rules
from plumbline.llm.repair import op11_conversation_repair
from plumbline.llm.sharding import op3_histogram_sort
from plumbline.llm.suffix_dedup import op6_suffix_array_dedup
from plumbline.llm.token_counts import op13_token_counts
from plumbline.llm.toxicity import op8_string_kernel_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_histogram_sort": op3_histogram_sort,
    "op4_language_model": op4_language_model,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_string_kernel_toxicity": op8_string_kernel_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_laesa_clustering": op12_laesa_clustering,
    "op13_token_counts": op13_token_counts,
}
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op2_chat_formatting": chat.SQL,
    "op10_benchmark_decontamination": decontaminate.SQL,
    "op11_conversation_repair": repair.SQL,
    "op12_laesa_clustering": laesa.SQL,
}
