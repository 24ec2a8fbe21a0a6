"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from importlib import import_module

MODULES = ["sharding", "toxicity", "language_id", "fingerprints", "decontamination", "packing", "token_files", "line_dedup", "ngram_join", "url_filter"]


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
