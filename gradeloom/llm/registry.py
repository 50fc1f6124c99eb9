"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("jaccard_join", "language_id", "toxicity", "quality", "secrets", "sentence_pieces", "token_records", "exact_dedup", "mixing", "license_scan", "token_counts", "clustering", "hard_negatives")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLE.items()}
