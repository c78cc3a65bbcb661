"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("bpe", "decontamination", "divergence", "language", "near_dup", "packing", "quality", "sharding", "substring_dedup", "toxicity", "url_rules", "warc", "whitening")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _m = importlib.import_module(f"quillon.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
