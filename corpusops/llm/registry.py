"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: module, query, SQL constant
ENTRIES = [
    ("byte_bpe", "op1_byte_bpe", None),
    ("token_counts", "op2_token_counts", None),
    ("decontaminate", "op3_decontaminate", None),
    ("suffix_dedup", "op4_suffix_dedup", None),
    ("language_id", "op5_language_id", None),
    ("topk_search", "op6_topk_search", "OP6_SQL"),
    ("simhash", "op7_simhash", None),
    ("line_dedup", "op8_line_dedup", None),
    ("chat_format", "op9_chat_format", "OP9_SQL"),
    ("license_scan", "op10_license_scan", "OP10_SQL"),
    ("centroids", "op11_centroid_clustering", "OP11_SQL"),
    ("whitening", "op12_whitening", None),
    ("mixing", "op13_source_mix", None),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"corpusops.llm.{module}"), name) for module, name, _ in ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"corpusops.llm.{module}"), sql) for module, name, sql in ENTRIES if sql}
