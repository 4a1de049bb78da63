"""Operators that prepare training data for language models.

Nothing outside this package imports it; ``queries()`` and ``oracle_sql()`` hold its
registered queries.
"""

from __future__ import annotations


def queries() -> dict:
    from . import chat_format, decontamination, license_scan, line_dedup, lm_scoring, near_dedup, neighbours, packing, token_alignment, token_counts, token_files, toxicity, whitening

    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op1_line_dedup_words": line_dedup.op1_line_dedup_words,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_chat_formatting": chat_format.op3_chat_formatting,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_packing": packing.op5_packing,
        "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_nearest_neighbours": neighbours.op9_nearest_neighbours,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_token_files": token_files.op12_token_files,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    from . import chat_format, line_dedup

    return {"op1_line_dedup": line_dedup.ORACLE, "op1_line_dedup_words": line_dedup.ORACLE_WORDS, "op3_chat_formatting": chat_format.ORACLE}
