"""Splitting oversized texts at natural boundaries, with overlap.

Every position of a text gets the strength of the boundary there. A sparse table over the strengths answers "the
strongest cut in this range, the rightmost of equals" in two look-ups; each piece ends at the strongest cut within
its permissible lengths, and the next one starts the overlap before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, LINE, CLAUSE, BLANK, NONE, INSIDE = 6, 5, 3, 4, 2, 1, 0

_ENDS = re.compile(r"(?:[。！？!?…｡]|\.(?!\d))+[”’」』）)\]\"'»]*[ \t　\xa0]*")
_CLAUSES = re.compile(r"[，,；;：:、—](?!\d)[”’」』）)\]\"'»]*[ \t　\xa0]*")
_BLANKS = re.compile(r"\s+")
_PARAGRAPHS = re.compile(r"(?:\r\n|\r|\n)[ \t　]*(?:\r\n|\r|\n)\s*")
#: A full stop after these is no sentence's end.
_SHORT = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|St|Prof|Capt|Col|Gen|Lt|Sr|Jr|vs|etc|No|vol|ch|pp|e\.g|i\.e)|\b[A-Z])\.$", re.I)


def strengths(text: str) -> np.ndarray:
    """Strength of the cut before each position 0..len(text); a cut within a visible character or a line end is 0."""
    s = np.full(len(text) + 1, NONE, np.int8)
    for m in _BLANKS.finditer(text):
        s[m.end()] = LINE if "\n" in m[0] or "\r" in m[0] else BLANK
    for m in _CLAUSES.finditer(text):
        s[m.end()] = CLAUSE
    for m in _ENDS.finditer(text):
        if not (m[0].rstrip()[-1:] == "." and _SHORT.search(text[max(0, m.start() - 8) : m.start() + 1]) and not m[0].startswith("..")):
            s[m.end()] = SENTENCE
            if m.end() < len(text) and text[m.end()] in "\r\n":
                end = _BLANKS.match(text, m.end()).end()
                s[end] = max(s[end], SENTENCE)
    for m in _PARAGRAPHS.finditer(text):
        s[m.end()] = PARAGRAPH
    if not text.isascii():
        for i, ch in enumerate(text):
            if ch > "˿" and (unicodedata.combining(ch) or ch in "‍️︎"):
                s[i] = INSIDE
    for m in re.finditer("\r\n", text):
        s[m.start() + 1] = INSIDE
    return s


class Strongest:
    """Sparse table for the rightmost maximum; built over blocks so that it stays small on very long texts."""

    def __init__(self, s: np.ndarray, longest: int, block: int = 1 << 16):
        self.s, self.longest, self.block = s, longest, max(block, longest)
        self.base, self.rows = -1, []

    def _build(self, base: int) -> None:
        part = self.s[base : base + 2 * self.block].astype(np.int64)
        # Position in the low bits makes the later of equal strengths the larger.
        key = (part << 40) | np.arange(base, base + len(part))
        self.base, self.rows, width = base, [key], 1
        while 2 * width <= min(self.longest, len(key)):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, low: int, high: int) -> int:
        """Position of the strongest cut in low..high, both included."""
        if self.base < 0 or low < self.base or high >= self.base + 2 * self.block:
            self._build(low // self.block * self.block)
        k = (high - low + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[low - self.base], row[high - self.base - (1 << k) + 1]) & ((1 << 40) - 1))


def pieces(text: str, limit: int, overlap: int, shortest: int) -> list[tuple[int, int]]:
    """Half-open ranges that cover ``text``, none longer than ``limit``, each starting ``overlap`` before the last one's end.

    A piece is at least ``shortest`` long (the last one may be shorter) and always longer than the overlap.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    least = min(limit, max(1, shortest, overlap + 1))
    cut, out, start = Strongest(strengths(text), limit - least + 1), [], 0
    while n - start > limit:
        end = cut(start + least, start + limit)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def split_oversized(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of every chunk: raw_chunk_id, chunking_version, piece, pieces, token_start, token_end, content, oversized.

    Sizes are code points (one token each). A chunk within its limit is one piece with its right token_end. Offsets
    are the chunk's ``token_start`` (``char_start`` where that is null, else 0) plus the place in its content. Whole
    rows delivered twice give their pieces once; a null content or an unknown configuration gives none.
    """
    c = chunks.select("raw_chunk_id", "chunking_version", F.coalesce("token_start", "char_start", F.lit(0)).cast("long").alias("base"), "content").where("content is not null and raw_chunk_id is not null")
    cfg = configs.select("chunking_version", F.col("target_tokens").alias("limit"), F.coalesce("overlap_ratio", F.lit(0.0)).alias("ratio"), F.coalesce("min_tokens", F.lit(1)).alias("least")).where("limit >= 1").dropDuplicates(["chunking_version"])
    c = c.join(cfg, "chunking_version").withColumn("h", F.xxhash64("content")).dropDuplicates(["raw_chunk_id", "chunking_version", "base", "h"]).drop("h")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, v, base, text, limit, ratio, least in zip(b.raw_chunk_id, b.chunking_version, b.base, b.content, b.limit, b.ratio, b.least):
                p = pieces(text, limit, round(limit * ratio), least)
                out += [(i, v, k, len(p), base + s, base + e, text[s:e], len(text) > limit) for k, (s, e) in enumerate(p)]
            yield pd.DataFrame(out, columns=["raw_chunk_id", "chunking_version", "piece", "pieces", "token_start", "token_end", "content", "oversized"])

    return c.mapInPandas(cut, "raw_chunk_id string, chunking_version string, piece int, pieces int, token_start long, token_end long, content string, oversized boolean")
