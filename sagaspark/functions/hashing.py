"""Content-addressed ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def digest(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def prefixed(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), digest(*parts))


def event_fact_id(kind: Column, participants: Column, place: Column) -> Column:
    """Event ids don't depend on the order or repetition of participants."""
    return prefixed("fact", F.lit("event"), kind, F.array_join(F.array_sort(F.array_distinct(F.coalesce(participants, F.array().cast("array<string>")))), ","), place)


def semantic_fact_id(kind: str, **fields: Column) -> Column:
    """Id of a fact by what it is about: the fields that are there, by name, as JSON text, hashed; null fields play no role.

    Fields are strings without characters that JSON escapes.
    """
    shown = [F.concat(F.lit(f'"{k}":"'), fields[k], F.lit('"')) for k in sorted(fields)]
    return prefixed("fact", F.lit(kind), F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}")), 256))


def config_hash(values: dict) -> str:
    """Hash of a configuration: keys sorted, no blanks, non-ASCII kept."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(values, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
