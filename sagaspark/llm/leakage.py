"""Test passages that occur in corpus documents, wholly or in part, even when edited.

Seeds: the n-grams of the test items, however many items share them. A corpus text that holds enough of an item's seeds
and enough of its tokens in any order is a candidate; around its seeds it is aligned with the item by Smith-Waterman,
piece after piece, and the share of the item's tokens that the pieces reproduce decides.

The test items are a stated query set, held against all documents in blocks of at most ``BLOCK`` items; documents are
read once per block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaspark.llm import tokens as tk

#: Items handled in one pass; bounds what each task receives (about 1 KB an item).
BLOCK = 4096
SEED_EN, SEED_HAN = 3, 4
#: Least share of an item's seeds in a text for it to be aligned.
SEED_SHARE = 0.05
MATCH, MISMATCH, GAP = 2, -2, -2
#: Least score of a piece, in matches net of edits, for long items of words and of Han characters.
PIECE_EN, PIECE_HAN = 7, 11
#: Cells of the alignments scored together; bounds memory.
ALIGN_CELLS = 4_000_000


class Items:
    """Tokens and seeds of a block of test items; the seed of an item shorter than a seed is all of it."""

    def __init__(self, ids: list, texts: list[str]):
        t = tk.tokenise(texts)
        cuts = np.searchsorted(t.text, np.arange(len(texts) + 1))
        self.ids, self.tokens = ids, [t.hash[a:b] for a, b in zip(cuts, cuts[1:])]
        self.han = [bool(len(x) and t.han[a:b].mean() > 0.5) for x, a, b in zip(self.tokens, cuts, cuts[1:])]
        self.vocabulary = np.unique(t.hash)
        self.words = [np.unique(x) for x in self.tokens]
        self.count = np.zeros(len(texts))
        self.size = [min(SEED_HAN if h else SEED_EN, len(x)) for h, x in zip(self.han, self.tokens)]
        seeds: dict[tuple[bool, int], list] = {}
        for i, x in enumerate(self.tokens):
            if len(x):
                g = np.unique(tk.ngrams(x, self.size[i]))
                self.count[i] = len(g)
                seeds.setdefault((self.han[i], self.size[i]), []).append((g, np.full(len(g), i)))
        self.seeds = {}
        for key, parts in seeds.items():
            g, who = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
            order = np.argsort(g, kind="stable")
            g, who = g[order], who[order]
            self.seeds[key] = g, who, tk.Lookup(np.unique(g))

    def least(self, i: int, least_share: float) -> int:
        """Least score of a piece: a short item's is the share asked for, though no less than a seed."""
        return min(PIECE_HAN if self.han[i] else PIECE_EN, max(self.size[i], int(np.ceil(least_share * len(self.tokens[i])))))


def _best_pieces(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, slice, slice]]:
    """Of each (item, text) the best local alignment: score, equal tokens, ranges in item and text. All are scored together."""
    rows, cols = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item, doc = np.zeros((rows, len(pairs)), np.uint64), np.ones((len(pairs), cols), np.uint64)
    for k, (a, b) in enumerate(pairs):
        item[: len(a), k] = a
        doc[k, : len(b)] = b
    gaps = (np.arange(1, cols + 1) * -GAP).astype(np.int32)
    h = np.zeros((rows + 1, len(pairs), cols + 1), np.int32)
    for i in range(rows):
        row = h[i, :, :-1] + np.where(doc == item[i][:, None], np.int32(MATCH), np.int32(MISMATCH))
        np.maximum(row, h[i, :, 1:] + GAP, out=row)
        np.maximum(row, 0, out=row)
        # Gaps along the row: the running maximum of what each place gives after its gaps.
        row += gaps
        np.maximum.accumulate(row, axis=1, out=row)
        row -= gaps
        h[i + 1, :, 1:] = row
    out = []
    for k, (a, b) in enumerate(pairs):
        g = h[:, k]
        i, j = divmod(int(g.argmax()), cols + 1)
        score, same, end_i, end_j = int(g[i, j]), 0, i, j
        while i and j and g[i, j]:
            equal = item[i - 1, k] == doc[k, j - 1]
            if g[i, j] == g[i - 1, j - 1] + (MATCH if equal else MISMATCH):
                same += bool(equal)
                i, j = i - 1, j - 1
            elif g[i, j] == g[i - 1, j] + GAP:
                i -= 1
            else:
                j -= 1
        out.append((score, same, slice(i, end_i), slice(j, end_j)))
    return out


def reproduced(pairs: list[tuple[np.ndarray, np.ndarray]], least: list[int], enough: list[float]) -> list[int]:
    """Tokens of each item that its text reproduces, in pieces of at least ``least`` matches net of edits; stops at ``enough``."""
    got = [0] * len(pairs)
    todo = sorted((k for k, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda k: len(pairs[k][1]))
    held = {k: (pairs[k][0].copy(), pairs[k][1].copy()) for k in todo}
    while todo:
        again, at = [], 0
        while at < len(todo):
            take = at
            while take < len(todo) and (take == at or (take - at + 1) * 200 * len(pairs[todo[take]][1]) <= ALIGN_CELLS):
                take += 1
            some = todo[at:take]
            for k, (score, same, x, y) in zip(some, _best_pieces([held[k] for k in some])):
                if score < MATCH * least[k]:
                    continue
                got[k] += same
                if got[k] < enough[k]:
                    # What is matched is taken out: 0 and 1 are no token's hash.
                    held[k][0][x], held[k][1][y] = 0, 1
                    again.append(k)
            at = take
        todo = again
    return got


def _windows(places: np.ndarray, reach: int, end: int) -> np.ndarray:
    """Places of a text within ``reach`` of a seed."""
    if len(places) * 2 * reach >= end * 4:
        edge = np.zeros(end + 1, np.int64)
        np.add.at(edge, np.maximum(0, places - reach), 1)
        np.add.at(edge, np.minimum(end, places + reach), -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return np.unique(np.concatenate([np.arange(max(0, p - reach), min(end, p + reach)) for p in places]))


def _within(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens are among the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def _reach(there: np.ndarray, least: int) -> np.ndarray:
    """Which places a piece of at least ``least`` may cover: each token that the other side lacks costs it a match or more."""
    p = np.concatenate([[0], np.cumsum(np.where(there, 1, -1))])
    return np.maximum.accumulate(p[::-1])[::-1][1:] - np.minimum.accumulate(p)[:-1] >= least


def find(texts: list[str], items: Items, least_share: float) -> list[tuple[int, int, float]]:
    """(text, item, share) of all texts that reproduce at least ``least_share`` of an item."""
    t = tk.tokenise(texts)
    sizes = np.bincount(t.text, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    found, pairs, least, enough = [], [], [], []
    for (_, n), (seeds, who, lookup) in items.seeds.items():
        g = tk.ngrams(t.hash, n)
        hit = lookup.places(g)
        hit = hit[t.text[hit] == t.text[hit + n - 1]]
        if not len(hit):
            continue
        lo, hi = np.searchsorted(seeds, g[hit]), np.searchsorted(seeds, g[hit], side="right")
        times = hi - lo
        place = np.repeat(hit, times)
        item = who[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        pair = t.text[place] * len(items.ids) + item
        order = np.lexsort((g[place], pair))
        place, pair, gg = place[order], pair[order], g[place][order]
        cuts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (gg[1:] != gg[:-1])])
        enough_seeds = np.add.reduceat(new.astype(np.int64), cuts) >= np.maximum(1.0, SEED_SHARE * items.count[pair[cuts] % len(items.ids)])
        ends = np.concatenate([cuts[1:], [len(pair)]])
        for a, b in zip(cuts[enough_seeds], ends[enough_seeds]):
            x, i = divmod(int(pair[a]), len(items.ids))
            tok = items.tokens[i]
            near = _windows(np.unique(place[a:b]) - first[x], 40 + len(tok) // 8, int(sizes[x]))
            text = t.hash[first[x] : first[x] + sizes[x]][near]
            # What no piece can reach is left out of the text, but for enough of it that no piece leads over the gap.
            score = items.least(i, least_share)
            reach = _reach(_within(text, items.words[i]), score)
            if not reach.any():
                continue
            text = text[_windows(np.flatnonzero(reach), 2 * PIECE_HAN, len(text))]
            there = _within(tok, np.sort(text))
            if (there & _reach(there, score)).sum() < least_share * len(tok):
                continue
            pairs.append((tok, text))
            found.append((x, i))
            least.append(score)
            enough.append(least_share * len(tok))
    got = reproduced(pairs, least, enough)
    return [(x, i, n / len(items.tokens[i])) for (x, i), n, e in zip(found, got, enough) if n >= e]


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least_share: float = 0.4) -> DataFrame:
    """Documents that reproduce at least ``least_share`` of an item's wording: doc_key, item_key, share.

    Case, width, accents, look-alikes and punctuation play no role. Null texts and items without a token give nothing;
    repeated items or documents give one row per pair of ids. ``share`` counts pieces until the least share is reached. Items shorter than a seed are found only by texts
    of their length or more that hold all of it.
    """
    doc_type, item_type = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    rows = items.select(F.col(item_key).alias("i"), F.col(text).alias("t")).dropna().dropDuplicates().orderBy("i", "t")
    d = docs.select(F.col(doc_key).alias("d"), F.col(text).alias("t")).dropna()
    schema = f"d {doc_type}, i {item_type}, share double"
    out = None
    taken = [(r.i, r.t) for r in rows.toLocalIterator()]
    for at in range(0, max(1, len(taken)), BLOCK):
        block = taken[at : at + BLOCK]

        def run(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            held = Items([i for i, _ in block], [t for _, t in block])
            for f in frames:
                ids, texts = f["d"].to_numpy(), f["t"].tolist()
                found = [(ids[a + x], held.ids[i], s) for a, b in tk.batches(texts) for x, i, s in find(texts[a:b], held, least_share)]
                yield pd.DataFrame(found, columns=["d", "i", "share"])

        part = d.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("d", "i").agg(F.max("share").alias("share")).select(F.col("d").alias(doc_key), F.col("i").alias(item_key), "share")
