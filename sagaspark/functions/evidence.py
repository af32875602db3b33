"""Finding quotations in texts: places that match but for blanks and punctuation, and the span that covers most anchors."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaspark.functions.text import PUNCTUATION

#: Longest span that quotations from several sentences are put together to.
LONGEST = 150
_SENTENCE = re.compile(r"[^。！？!?\n]+[。！？!?\n]*|[。！？!?\n]+")
_DROP = re.compile(PUNCTUATION)


def bare(text: Column) -> Column:
    """Text without blanks and punctuation."""
    return F.regexp_replace(text, PUNCTUATION, "")


class Text:
    """A text without blanks and punctuation that knows where its characters came from."""

    def __init__(self, text: str):
        self.text = text
        self.kept = [i for a, b in _between(text) for i in range(a, b)]
        self.bare = "".join(text[i] for i in self.kept)

    def places(self, needle: str) -> list[tuple[int, int]]:
        """Spans of the text that read as ``needle``, from left to right and apart from one another."""
        want = _DROP.sub("", needle)
        if not want:
            return []
        return [(self.kept[m.start()], self.kept[m.end() - 1] + 1) for m in re.finditer(re.escape(want), self.bare)]

    def sentences(self) -> list[tuple[int, int]]:
        return [m.span() for m in _SENTENCE.finditer(self.text)] or [(0, len(self.text))]


def _between(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _DROP.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def spans(text: str, anchors: list[tuple[str, bool]], longest: int = LONGEST) -> list[tuple[int, int, float, float, float]]:
    """Spans of a text that hold anchors (text, hard), the best first: start, end, share of hard ones, share of all, score.

    A span is a sentence with the anchors inside it, or grows from one place of an anchor by the nearest places of the
    others as long as it stays within ``longest``. The score is 1000 for all hard anchors, 100 for all, less the length.
    Without hard anchors their share is 1.
    """
    t = Text(text)
    found = [(k, p) for k, (a, _) in enumerate(anchors) for p in t.places(a)]
    hard = {k for k, (_, h) in enumerate(anchors) if h}
    out: dict[tuple[int, int], tuple[float, float, float]] = {}

    def offer(a: int, b: int, covered: set[int]) -> None:
        firm = len(covered & hard) / len(hard) if hard else 1.0
        share = len(covered) / len(anchors)
        row = (firm, share, firm * 1000 + share * 100 - (b - a))
        if (a, b) not in out or out[a, b][2] < row[2]:
            out[a, b] = row

    sentence = t.sentences()
    starts = [a for a, _ in sentence]
    inside: dict[int, set[int]] = {}
    for k, (a, b) in found:
        s = bisect_right(starts, a) - 1
        if s >= 0 and b <= sentence[s][1]:
            inside.setdefault(s, set()).add(k)
    for s, covered in inside.items():
        offer(*sentence[s], covered)
    places: dict[int, list[tuple[int, int]]] = {}
    for k, p in found:
        places.setdefault(k, []).append(p)
    for k, (a, b) in found:
        covered = {k}
        for other, where in places.items():
            if other in covered:
                continue
            x, y = min(where, key=lambda p: max(p[0] - b, a - p[1], 0))
            if max(b, y) - min(a, x) <= longest:
                a, b = min(a, x), max(b, y)
                covered.add(other)
        offer(a, b, covered)
    return sorted(((a, b, *row) for (a, b), row in out.items()), key=lambda r: (-r[4], r[0], r[1]))


def best_spans(rows: DataFrame, keys: list[str], text: str, anchors: str) -> DataFrame:
    """The best span of each row's text: keys, char_start, char_end, hard_rate, rate, score; no row without a hit.

    ``anchors``: array of structs (text, hard). Null texts and empty lists give no row.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for *k, t, a in zip(*(f[c] for c in [*keys, text, anchors])):
                got = spans(t, [(x["text"], bool(x["hard"])) for x in a])
                if got:
                    out.append((*k, *got[0]))
            yield pd.DataFrame(out, columns=[*keys, "char_start", "char_end", "hard_rate", "rate", "score"])

    some = rows.where(F.col(text).isNotNull() & (F.size(anchors) > 0)).select(*keys, text, anchors)
    return some.mapInPandas(run, f"{schema}, char_start int, char_end int, hard_rate double, rate double, score double")


def segments(text: str, most: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters that make up a text, of as many whole sentences as fit; longer sentences are cut."""
    most = max(1, most)
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    out, at = [], 0
    while at < len(text):
        last = bisect_right(ends, at + most) - 1
        to = ends[last] if last >= 0 and ends[last] > at else min(len(text), at + most)
        out.append((at, to))
        at = to
    return out


def segment_table(texts: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Segments of each text with the manifest by which they are cited: key, no, char_start, char_end, content_hash."""
    kind = dict(texts.dtypes)[key]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, a, b, t[a:b]) for k, t in zip(f["k"], f["t"]) for n, (a, b) in enumerate(segments(t, most))]
            yield pd.DataFrame(rows, columns=["k", "no", "char_start", "char_end", "content"])

    src = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).dropna()
    out = src.mapInPandas(run, f"k {kind}, no int, char_start int, char_end int, content string")
    return out.select(F.col("k").alias(key), "no", "char_start", "char_end", F.sha2("content", 256).alias("content_hash"))
