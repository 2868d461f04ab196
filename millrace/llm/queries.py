"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query: module of its operator. A module's ORACLE, where it has one, is DuckDB SQL for the query's rows.
MODULES = {
    "op1_exact_dedup": "exact_dedup",
    "op2_quality": "quality",
    "op3_packing": "packing",
    "op4_toxicity": "toxicity",
    "op5_simhash": "simhash",
    "op6_secrets": "secrets",
    "op7_topk_search": "topk_search",
    "op8_byte_bpe": "byte_bpe",
    "op9_token_files": "token_files",
    "op10_url_filter": "url_filter",
    "op11_lexical_search": "lexical_search",
    "op12_bpe": "speculative_bpe",
    "op13_importance": "importance",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
