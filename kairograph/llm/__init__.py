"""Training-data operators.  queries() and oracle_sql() gather what the modules register."""

from __future__ import annotations

import importlib

#: Modules that register queries, in the order of their operators.
MODULES = (
    "language_id",
    "simhash_dedup",
    "suffix_dedup",
    "sharding",
    "sentencepiece_codec",
    "content_chunks",
    "secret_scan",
    "quality_rules",
    "token_counts",
    "packing",
    "cross_tokenizer",
    "conversation_repair",
    "quality_classifier",
)


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), attribute)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
