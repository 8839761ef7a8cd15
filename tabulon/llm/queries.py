"""Queries and SQL of this subpackage's operators."""

from __future__ import annotations

from tabulon.llm import chunk_reuse, jpeg, language, licenses, packing, quality, simhash, token_counts, token_files, toxicity

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_language": language.op2_language,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_near_duplicates": simhash.op6_near_duplicates,
    "op7_bpe": chunk_reuse.op7_bpe,
    "op8_progressive_jpeg": jpeg.op8_progressive_jpeg,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_licenses": licenses.op10_licenses,
}

ORACLES = {"op10_licenses": licenses.oracle()}
