"""Queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from auditlake.llm import decontaminate, exact_dedup, html_labeller, language, line_dedup, mixing, near_dedup, quality, revisits, substring_dedup


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_warc_revisits": revisits.op2_warc_revisits,
        "op3_quality": quality.op3_quality,
        "op4_main_text": html_labeller.op4_main_text,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_language": language.op8_language,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The pipeline, the classifiers and near duplicates have none: tests hold them against brute force or held-out rows."""
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL,
        "op2_warc_revisits": revisits.ORACLE_SQL,
        "op5_decontaminate": decontaminate.ORACLE_SQL,
        "op6_mix_sources": mixing.ORACLE_SQL,
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    }
