"""Tokens of many texts at once, with arrays instead of loops.

A token is a run of letters and digits, or one Han character. Its hash is that of its letters in lower case, without
accents, width or look-alikes, so that typography doesn't matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from sagaspark.llm.skeleton import prototypes

OTHER, BLANK, LINE, LETTER, DIGIT, HAN, END, LIST, QUOTE = range(9)
#: Characters handled together; bounds the memory of a batch.
BATCH_CHARS = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For the first plane: the folded code point (0 for none) and the class of each character."""
    proto, fold = prototypes(), np.arange(1 << 16, dtype=np.uint32)
    for o in range(1 << 16):
        if 0xD800 <= o < 0xE000 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4:
            continue
        s = unicodedata.normalize("NFKD", proto.get(o, chr(o)) if o > 0x7F else chr(o)).lower()
        s = "".join(proto.get(ord(c), c) if ord(c) > 0x7F else c for c in s if not unicodedata.combining(c))
        fold[o] = ord(s[0]) if s else 0
    kind = np.zeros(1 << 16, np.uint8)
    for o in range(1 << 16):
        c = unicodedata.category(chr(o))
        kind[o] = DIGIT if c == "Nd" else LETTER if c[0] in "LN" else BLANK if c == "Zs" else OTHER
    kind[0x3400:0xA000] = HAN
    kind[0x3040:0x3100] = HAN
    for chars, k in (("\t", BLANK), ("\n\r", LINE), ("。！？!?…", END), ("|/\\_#[]<>=~•·►»«★☆●■,，、;；", LIST), ("“”「」『』\"", QUOTE)):
        for ch in chars:
            kind[ord(ch)] = k
    return fold, kind


@dataclass
class Tokens:
    """``hash``, ``start``, ``end`` (places in the batch's characters) and ``text`` (which of the batch) of each token."""

    codes: np.ndarray
    kinds: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    han: np.ndarray


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_CHARS together; a text is never divided."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def tokenise(texts: list[str], hidden: np.ndarray | None = None) -> Tokens:
    """Tokens of some texts; characters marked in ``hidden`` count as blanks.

    ``codes`` and ``kinds`` are the folded characters (0 for invisible ones) and their classes, ``bounds`` where each
    text begins and the last one ends.
    """
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    fold, kind = _tables()
    codes = np.where(raw < 1 << 16, fold[np.minimum(raw, 0xFFFF)], raw)
    kinds = np.where(codes < 1 << 16, kind[np.minimum(codes, 0xFFFF)], HAN)
    if hidden is not None:
        kinds = np.where(hidden, BLANK, kinds)
    # Invisible characters are taken out of words: they belong to what is before them.
    shown = np.flatnonzero(codes != 0)
    k = kinds[shown]
    alnum = (k == LETTER) | (k == DIGIT)
    han = k == HAN
    fresh = np.zeros(len(shown) + 1, bool)
    fresh[np.searchsorted(shown, bounds[:-1])] = True
    begins = han | alnum & (np.concatenate([[True], ~alnum[:-1]]) | fresh[:-1])
    first = np.flatnonzero(begins)
    stop = ~(alnum | han) | begins
    at = np.flatnonzero(stop)
    if len(first):
        j = np.searchsorted(at, first, side="right")
        last = np.where(j < len(at), at[np.minimum(j, len(at) - 1)], len(shown))
    else:
        last = first
    c = codes[shown].astype(np.uint64)
    power = _powers(len(shown) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((c + np.uint64(7)) * power[:-1], dtype=np.uint64)]) if len(shown) else np.zeros(1, np.uint64)
        h = (total[last] - total[first]) * _inverse(len(shown) + 1)[first]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    start = shown[first] if len(first) else first
    end = shown[last - 1] + 1 if len(first) else first
    return Tokens(codes, kinds, bounds, h, start, end, np.searchsorted(bounds, start, side="right") - 1, han[first])


_POW: dict[str, np.ndarray] = {}


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _POW or len(_POW[name]) < n:
        with np.errstate(over="ignore"):
            _POW[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, BATCH_CHARS + 1), base, np.uint64), dtype=np.uint64)])
    return _POW[name][:n]


def _powers(n: int) -> np.ndarray:
    return _grown("p", _P, n)


def _inverse(n: int) -> np.ndarray:
    return _grown("i", _INV, n)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` tokens (len - n + 1 of them, texts not told apart)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = out * np.uint64(0x100000001B3) + hashes[i : len(hashes) - n + 1 + i]
            out ^= out >> np.uint64(31)
    return out


class Lookup:
    """Places of hashes in a sorted table; a bitmap turns most away before the search."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << max(16, min(26, (8 * len(table)).bit_length())), bool)
        self.mask = np.uint64(len(self.bits) - 1)
        self.bits[table & self.mask] = True

    def places(self, x: np.ndarray) -> np.ndarray:
        """Indices of ``x`` that are in the table."""
        maybe = np.flatnonzero(self.bits[x & self.mask])
        if not len(maybe) or not len(self.table):
            return maybe[:0]
        y = x[maybe]
        return maybe[self.table[np.minimum(np.searchsorted(self.table, y), len(self.table) - 1)] == y]


def word_hashes(words) -> np.ndarray:
    """Sorted hashes of some words, each one token."""
    t = tokenise([w + "\n" for w in words])
    return np.unique(t.hash)
