"""Operators for large training-data corpora; nothing else in the library imports this subpackage."""

from __future__ import annotations

from behaviorframe.llm import embedding_dedup, exact_dedup, filter_audit, jaccard_join, language_id, language_model, mixing, packing, pii, quality, sharding, spelling, token_counts

MODULES = (quality, exact_dedup, mixing, token_counts, jaccard_join, language_model, sharding, packing, language_id, pii, embedding_dedup, spelling, filter_audit)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE for m in MODULES if m.ORACLE}
