"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

from . import pipeline

MODULES = ["license_scan", "pii", "quality_knn", "quality_rules", "packing", "html_extract", "toxicity", "tiff", "near_dedup", "bpe"]


def _gathered(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _gathered("QUERIES") | {"pipeline": pipeline.run}


def oracle_sql() -> dict:
    return _gathered("ORACLES") | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
