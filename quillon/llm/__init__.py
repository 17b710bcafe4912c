"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "html_extract", "minhash", "langid", "mixing", "quality", "secrets", "binary_output", "embed_dedup", "ann", "spelling", "exact_dedup", "phrases")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"quillon.llm.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
