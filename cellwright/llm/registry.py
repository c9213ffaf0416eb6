"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import classifier, conversations, decontamination, filter_audit, html_text, katz, mixing, pii, quality, secrets, simhash, token_shards, toxicity

MODULES = (mixing, quality, katz, pii, decontamination, html_text, secrets, simhash, token_shards, toxicity, conversations, filter_audit, classifier)

QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLES.items()}
