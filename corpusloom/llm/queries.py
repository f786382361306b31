"""Registers the queries of every operator here."""

from corpusloom.llm import (  # noqa: F401
    decontamination,
    filter_audit,
    fingerprints,
    jaccard_join,
    line_dedup,
    lm_scoring,
    packing,
    pieces,
    quality,
    sharding,
    substring_dedup,
    url_filter,
    whitening,
)
from corpusloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
