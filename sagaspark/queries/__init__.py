"""Named queries of the core and their SQL."""

from __future__ import annotations

from sagaspark.queries import evidence, general, knowledge, reports, texts

MODULES = [general, knowledge, reports, texts, evidence]


def all_queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: s.strip() for m in MODULES for k, s in m.ORACLE.items()}
