"""The subpackage's queries and their SQL, for `__spark_entry__.py`."""

from __future__ import annotations

import importlib

#: Module and the query that it offers; a module's ORACLE_SQL is the query's SQL.
MODULES = {
    "op1_language_id": "language_id",
    "op2_license_scan": "license_scan",
    "op3_ngram_join": "ngram_join",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_packing": "packing",
    "op6_toxicity": "toxicity",
    "op7_exact_dedup": "exact_dedup",
    "op8_substring_dedup": "substring_dedup",
    "op9_decontaminate": "decontaminate",
    "op10_warc": "warc",
    "op11_periodic_runs": "periodic_runs",
    "op12_weighted_sampling": "weighted_sampling",
    "op13_whitening": "whitening",
}


def _modules():
    return {name: importlib.import_module(f"{__package__}.{module}") for name, module in MODULES.items()}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _modules().items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _modules().items() if getattr(module, "ORACLE_SQL", None)}
