"""Queries of this subpackage and, where SQL can express them, the SQL for DuckDB."""

from importlib import import_module

#: Query: module with query(spark, sf_dir) and perhaps SQL.
MODULES = {
    "op4_preference_pairs": "preferences",
    "op9_license_scan": "licenses",
    "op1_trie_scores": "ngram_lm",
    "op2_ngram_join": "ngram_join",
    "op5_slack_packing": "packing",
    "op10_byte_bpe": "byte_bpe",
    "op7_telephony_audio": "audio",
    "op6_rule_quality": "quality",
    "op8_exact_dedup": "exact_dedup",
    "op3_secret_scan": "secrets",
    "op11_decontamination": "decontamination",
    "op12_importance_sample": "resampling",
    "op13_collocations": "collocations",
}


def _module(name: str):
    return import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict:
    return {name: _module(name).SQL for name in MODULES if getattr(_module(name), "SQL", None)}
