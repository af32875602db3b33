"""Operators on text and scores for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from sagaspark.llm import queries


def all_queries() -> dict:
    return dict(queries.QUERIES)


def all_oracles() -> dict:
    return {k: s.strip() for k, s in queries.ORACLE.items()}
