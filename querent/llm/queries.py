"""Registered queries of this subpackage: one per operator, and the pipeline's SQL where there is any."""

from __future__ import annotations

from querent.llm import decontamination, html_text, language_model, packing, quality, simhash, suffix_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_quality": quality.query,
    "op2_toxicity": toxicity.query,
    "op3_language_model": language_model.query,
    "op4_simhash": simhash.query,
    "op5_packing": packing.query,
    "op6_decontamination": decontamination.query,
    "op7_token_files": token_files.query,
    "op8_html_text": html_text.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_token_counts": token_counts.query,
}
ORACLES: dict[str, str] = {"op6_decontamination": decontamination.ORACLE}
