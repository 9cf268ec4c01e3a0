"""The queries and SQL of the text operators."""

from __future__ import annotations

import importlib

MODULES = ["toxicity", "lm", "decontaminate", "bpe", "quality", "sharding", "embedding_dedup", "minhash", "warc", "langid", "alignment", "suffix_dedup", "importance"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"graphloom.llm.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
