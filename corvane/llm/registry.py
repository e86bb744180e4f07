"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.q_bpe import op1_bpe_encode_decode
from corvane.llm.q_bytebpe import op11_byte_bpe
from corvane.llm import q_collocations, q_decontam, q_hmm, q_langid, q_linededup, q_quality, q_topk, q_trie, q_urlfilter
from corvane.llm.q_rans import op9_token_id_output
from corvane.llm.q_simhash import op8_simhash_near_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_encode_decode": op1_bpe_encode_decode,
        "op2_quality_classifier": q_quality.op2_quality_classifier,
        "op3_benchmark_decontamination": q_decontam.op3_benchmark_decontamination,
        "op4_line_dedup": q_linededup.op4_line_dedup,
        "op5_lm_scoring": q_hmm.op5_lm_scoring,
        "op6_url_filter": q_urlfilter.op6_url_filter,
        "op7_language_id": q_langid.op7_language_id,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_token_id_output": op9_token_id_output,
        "op10_exact_top_k": q_topk.op10_exact_top_k,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_prefix_trie": q_trie.op12_prefix_trie,
        "op13_phrase_collocations": q_collocations.op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": q_linededup.ORACLE, "op6_url_filter": q_urlfilter.ORACLE, "op10_exact_top_k": q_topk.ORACLE, "op12_prefix_trie": q_trie.ORACLE, "op13_phrase_collocations": q_collocations.ORACLE}
