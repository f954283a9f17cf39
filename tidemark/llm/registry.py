"""Queries of this subpackage by name."""

from __future__ import annotations

import importlib

#: Query name -> module that holds it.
NAMES = {
    "op2_license_scan": "q_licenses",
    "op6_toxicity": "q_toxicity",
    "op10_nearest_neighbours": "q_nearest",
    "op3_lm_scores": "q_language_model",
    "op8_near_duplicates": "q_near_dedup",
    "op4_fingerprints": "q_fingerprints",
    "op9_url_filter": "q_urls",
    "op1_best_fit_packing": "q_tokens",
    "op5_bpe_round_trip": "q_tokens",
    "op7_secret_scan": "q_secrets",
    "op11_fill_in_middle": "q_infill",
    "op12_line_dedup": "q_line_dedup",
    "op13_filter_audit": "q_filter_audit",
    # What SQL can check of operators whose whole result it cannot express.
    "facts_op1_places": "q_tokens",
    "facts_op4_texts": "q_fingerprints",
    "facts_op7_base": "q_secrets",
    "facts_op9_rules": "q_urls",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tidemark.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in dict.fromkeys(NAMES.values()) for name, sql in getattr(importlib.import_module(f"tidemark.llm.{module}"), "SQL", {}).items()}
