"""Queries and oracle SQL of the operators of this subpackage."""

from __future__ import annotations

from plaudit.llm import fingerprints, gru_lm, jaccard_join, line_dedup, merkle, mixing, packing, personal_data, quality_crf, quality_rules, token_alignment, url_filters, warc

MODULES = (packing, quality_crf, warc, gru_lm, fingerprints, jaccard_join, line_dedup, mixing, quality_rules, url_filters, token_alignment, personal_data, merkle)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
