"""Imports every query module, which registers its queries."""

from __future__ import annotations

from tidewatch.llm import bpe, jaccard_join, language, line_dedup, merkle, packing, quality_classifier, quality_rules, sharding, spelling, suffix_dedup, warc, whitening  # noqa: F401
from tidewatch.llm.registry import RUNS, SQL


def load() -> tuple[dict, dict]:
    return RUNS, SQL
