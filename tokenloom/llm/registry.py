"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("language_id", "line_dedup", "mixing", "quality_rules", "lm_scoring", "jaccard_join", "exact_dedup", "html_extract", "license_scan", "bpe")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tokenloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"tokenloom.llm.{m}"), "ORACLE", {}).items()}
