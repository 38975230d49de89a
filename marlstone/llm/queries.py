"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_OPERATORS = {
    "op1_quality_classifier": "quality",
    "op2_license_scan": "license_scan",
    "op3_minhash_dedup": "near_dedup",
    "op4_url_filter": "url_filter",
    "op5_line_dedup": "line_dedup",
    "op6_token_count": "token_count",
    "op7_byte_bpe": "byte_bpe",
    "op8_tiff_media": "tiff",
    "op9_decontaminate": "decontaminate",
    "op10_html_extraction": "wrapper_html",
    "op11_filter_audit": "filter_audit",
    "op12_simhash_dedup": "simhash_dedup",
    "op13_phrase_collocations": "phrases",
}


# imported with this module, so that where one can't be, whoever imports this learns it at once
_MODULES = {name: import_module(f"marlstone.llm.{module}") for name, module in _OPERATORS.items()}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(module, "ORACLE", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
