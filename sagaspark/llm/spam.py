"""Keyword-stuffed pages, link lists and tag lists, found as outliers from the language's prose.

Texts are cut into short segments. Each gets features of density, entropy, repetition and function words. Per language
a robust centre and scatter are fitted to all segments of the corpus (medians and MADs, then a covariance over the
segments within the cutoff, twice). A segment is spam if its Mahalanobis distance is beyond the cutoff and its
displacement points in the direction in which the features turn to spam; nothing else decides. A document is spam if such segments make up more than half of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaspark.llm import tokens as tk
from sagaspark.session import cut

# Function words of English and function characters of Chinese.
EN_WORDS = frozenset("a an the and or but nor so yet of to in on at by for from with without into onto over under up down off out through as if when while before after until since because than that this these those it its he she they them his her their him you your i me my we us our who whom whose which what where how there here not no never only be is are was were been being am do does did has have had will would shall should can could may might must one all any each both more most some such even still again once".split())
ZH_CHARS = frozenset("的了着在是不也就把被与和而却又才只从到向那这他她我你们谁连还都有没等过得地似让给对所以为可并但若")

FEATURES = ["function", "ends", "links", "separators", "quotes", "repeats", "entropy", "distinct"]
#: Spam-directed side of each feature: +1 more of it, -1 less of it.
SIDES = np.array([-1, -1, 1, 1, -1, 1, -1, -1], float)
#: Least cosine between a segment's whitened displacement and the direction in which all features turn to spam.
DIRECTION = 0.1
#: Least scale of a feature, and a scale fixed for quotes, which prose has in plenty or not at all.
LEAST = np.array([0.04, 0.04, 0.02, 0.05, 0.06, 0.05, 0.03, 0.05])
SEGMENT = 160
#: A line of this length is not put together with the next one.
SHORT_LINE = 60
#: 0.99 quantile of chi-squared with eight degrees of freedom.
CUTOFF = 20.1

_LINK = re.compile(r"<[aA]\b[^>]*>|</[aA]>|\]\([^)\s]*\)|(?:[hH][tT][tT][pP][sS]?://|[wW]{3}\.)[^\s<>\")\]]+|\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,7}\b(?:/\S*)?")
#: What every link holds; most texts are told by it to have none.
_HINT = re.compile(r"</|\]\(|://|[wW]\.|[a-z0-9-]\.[a-z]{2}|<[aA]\b")


def _segments(t: tk.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the segments and the text of each: sentences and lines put together up to SEGMENT, longer ones cut."""
    kinds, codes = t.kinds, t.codes
    ahead = np.concatenate([kinds[1:], [tk.LINE]])
    dot = (codes == 46) & ((ahead == tk.BLANK) | (ahead == tk.LINE) | (ahead == tk.QUOTE))
    end = ((kinds == tk.END) | dot) & (ahead != tk.END)
    # A closing quote belongs to its sentence; quoted lines ("> ") run on.
    closing = np.flatnonzero(end & (ahead == tk.QUOTE))
    quoted = np.concatenate([codes[1:], [0]]) == 62
    line = (kinds == tk.LINE) & ~quoted
    end[closing] = False
    end[closing + 1] = True
    at = np.flatnonzero(end | line) + 1
    at = np.union1d(at, t.bounds[1:])
    is_line = line[at - 1]
    starts, texts, start, text, bounds = [], [], 0, 0, t.bounds.tolist()
    for b, ln in zip(at.tolist(), is_line.tolist()):
        while b - start > 2 * SEGMENT:
            starts.append(start)
            texts.append(text)
            start += SEGMENT
        last = b == bounds[text + 1]
        if b > start and (last or b - start >= SEGMENT or ln and b - start >= SHORT_LINE):
            starts.append(start)
            texts.append(text)
            start = b
        while text + 1 < len(bounds) - 1 and bounds[text + 1] <= b:
            text += 1
    return np.array(starts, np.int64), np.array(texts, np.int64)


_WORDS: list[tk.Lookup] = []


def _function_words(t: tk.Tokens, lang: np.ndarray) -> np.ndarray:
    if not _WORDS:
        _WORDS.extend([tk.Lookup(tk.word_hashes(EN_WORDS)), tk.Lookup(tk.word_hashes(ZH_CHARS))])
    out = np.zeros(len(t.hash))
    for k, table in enumerate(_WORDS):
        at = table.places(t.hash)
        out[at[lang[t.text[at]] == k]] = 1
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all segments of some texts: the text's place, its language (0 alphabetic, 1 Han), visible length, features."""
    hidden = None
    for i, x in enumerate(texts):
        if _HINT.search(x):
            if hidden is None:
                at = np.concatenate([[0], np.cumsum([len(y) for y in texts])])
                hidden = np.zeros(at[-1], bool)
            for m in _LINK.finditer(x):
                hidden[at[i] + m.start() : at[i] + m.end()] = True
    t = tk.tokenise(texts, hidden)
    begin, of = _segments(t)
    if not len(begin):
        return of, of, of, np.zeros((0, len(FEATURES)))
    stop = np.concatenate([begin[1:], [t.bounds[-1]]])
    stop = np.minimum(stop, t.bounds[of + 1])

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (c[stop] - c[begin]).astype(float)

    codes, kinds = t.codes, t.kinds
    link = hidden if hidden is not None else np.zeros(len(codes), bool)
    before, ahead = np.concatenate([[tk.LINE], kinds[:-1]]), np.concatenate([kinds[1:], [tk.LINE]])
    shown = codes != 0
    size = count(shown & (link | (kinds != tk.BLANK) & (kinds != tk.LINE)))
    dot = (codes == 46) & (kinds == tk.OTHER) & ((ahead == tk.BLANK) | (ahead == tk.LINE) | (ahead == tk.QUOTE))
    gap = (kinds == tk.BLANK) & ~link & (before == tk.HAN) & ((ahead == tk.HAN) | (ahead == tk.LETTER) | (ahead == tk.DIGIT))
    dash = (codes == 45) & (before == tk.BLANK) & (ahead == tk.BLANK)
    quoted = (codes == 62) & (before == tk.LINE)
    seps = count((kinds == tk.LIST) & ~quoted | gap | dash & ~link)
    chars = np.maximum(1.0, count(shown))
    bare = np.maximum(1.0, count(shown & ~link))

    n_text = len(texts)
    han = np.bincount(t.text[t.han], minlength=n_text)
    words = np.bincount(t.text, minlength=n_text) - han
    lang = (han > 2 * words).astype(np.int64)
    seg = np.searchsorted(begin, t.start, side="right") - 1
    n = np.bincount(seg, minlength=len(begin)).astype(float)
    function = np.bincount(seg, weights=_function_words(t, lang), minlength=len(begin)) / np.maximum(n, 1)

    # How much of a segment says what its text says over and over.
    tri = tk.ngrams(t.hash, 3)
    rep = np.zeros(len(begin))
    if len(tri):
        with np.errstate(over="ignore"):
            mixed = tri + t.text[: len(tri)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        inside = t.text[: len(tri)] == t.text[2:]
        whole, where, times = np.unique(mixed[inside], return_inverse=True, return_counts=True)
        s = seg[: len(tri)][inside]
        near = s == seg[2:][inside]
        s, again = s[near], np.minimum(times[where][near] - 1, 8)
        many = np.bincount(s, minlength=len(begin))
        rep = np.bincount(s, weights=again, minlength=len(begin)) / np.maximum(1, 8 * many)
        rep *= np.minimum(1.0, 40 / np.sqrt(1.0 + (han + words)[of]))

    # Entropy and distinct share of the tokens of a segment.
    with np.errstate(over="ignore"):
        mixed = t.hash + seg.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mixed)
    m = mixed[order]
    new = np.concatenate([[True], m[1:] != m[:-1]]) if len(m) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    c = np.diff(np.concatenate([at, [len(m)]])).astype(float)
    s = seg[order][at]
    part = np.bincount(s, weights=c * np.log2(np.maximum(c, 1)), minlength=len(begin))
    nn = np.maximum(n, 2)
    entropy = 1 - part / (nn * np.log2(nn))
    distinct = np.bincount(s, minlength=len(begin)) / np.maximum(n, 1)
    few = n < 4
    x = np.stack([
        np.sqrt(function),
        np.minimum(1.0, 40 * count(((kinds == tk.END) & (before != tk.END) | dot) & ~link) / (bare + 1) / np.where(lang[of] == 1, 3, 1)),
        np.sqrt(count(link & shown) / chars),
        np.sqrt(np.minimum(1.0, seps / chars)),
        np.sqrt(np.minimum(1.0, count(kinds == tk.QUOTE) / chars)),
        np.sqrt(rep),
        np.where(few, 1.0, entropy),
        np.where(few, 1.0, distinct),
    ], axis=1)
    keep = size > 0
    return of[keep], lang[of][keep], size[keep].astype(np.int64), x[keep]


def segment_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per segment of every document: id, lang, size and features x (whole texts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, texts = f["id"].to_numpy(), f["t"].tolist()
            for a, b in tk.batches(texts):
                of, lang, size, x = features(texts[a:b])
                yield pd.DataFrame({"id": ids[a:b][of], "lang": lang.astype(np.int32), "size": size.astype(np.int32), "x": list(x.astype(np.float32))})

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).dropna().mapInPandas(run, f"id {kind}, lang int, size int, x array<float>")


def fit(segments: DataFrame, rounds: int = 2) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per language: medians, scales, centre and whitening of scaled features, from all segments.

    What reaches the driver are these few numbers. The covariance is taken over segments within the cutoff of the
    round before, with a ridge of 0.05.
    """
    p = len(FEATURES)
    cols = [F.col("x")[i].cast("double") for i in range(p)]
    med = {r[0]: np.array(r[1:], float) for r in segments.groupBy("lang").agg(*(F.percentile_approx(c, 0.5, 2000) for c in cols)).collect()}
    if not med:
        return {}

    def per_lang(values: dict[int, np.ndarray], i: int):
        out = F.lit(None).cast("double")
        for k, v in values.items():
            out = F.when(F.col("lang") == k, F.lit(float(v[i]))).otherwise(out)
        return out

    off = [c - per_lang(med, i) for i, c in enumerate(cols)]
    mad = {r[0]: np.array(r[1:], float) * 1.4826 for r in segments.groupBy("lang").agg(*(F.percentile_approx(F.abs(o), 0.5, 2000) for o in off)).collect()}
    scale = {k: np.maximum(v, LEAST) for k, v in mad.items()}
    for v in scale.values():
        v[4] = LEAST[4]
    model = {k: (med[k], scale[k], np.zeros(p), np.eye(p)) for k in med}
    for _ in range(rounds):
        for k, (n, s, q) in _moments(segments, model).items():
            mu = s / n
            w, vec = np.linalg.eigh(q / n - np.outer(mu, mu) + 0.05 * np.eye(p))
            model[k] = (med[k], scale[k], mu, vec @ np.diag(np.maximum(w, 1e-3) ** -0.5) @ vec.T)
    return model


def _displacements(f: pd.DataFrame, model: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each language's segments: language, their places, scaled features, whitened displacement from the centre."""
    x, lang = np.stack(f["x"].to_numpy()).astype(float), f["lang"].to_numpy()
    for k, (med, scale, mu, white) in model.items():
        on = np.flatnonzero(lang == k)
        z = (x[on] - med) / scale
        yield k, on, z, (z - mu) @ white


def _moments(segments: DataFrame, model: dict) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of the scaled features of all segments within the cutoff, per language."""
    p = len(FEATURES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for f in frames:
            for k, _, z, y in _displacements(f, model) if len(f) else ():
                z = z[(y * y).sum(1) < CUTOFF]
                total[k] = total.get(k, 0) + np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pd.DataFrame([(k, i, v) for k, t in total.items() for i, v in enumerate(t)], columns=["lang", "i", "v"])

    sums: dict = {}
    for r in segments.select("lang", "x").mapInPandas(run, "lang int, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.lang, np.zeros(1 + p + p * p))[r.i] = r.v
    return {k: (t[0], t[1 : 1 + p], t[1 + p :].reshape(p, p)) for k, t in sums.items() if t[0] > 0}


def spam_share(segments: DataFrame, model: dict, direction: float = DIRECTION) -> DataFrame:
    """Share of each document's visible characters in segments that are outliers in a spam-directed direction: id, share."""
    towards = SIDES / np.sqrt(len(SIDES))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            spam = np.zeros(len(f), bool)
            for _, on, _, y in _displacements(f, model):
                far = np.sqrt((y * y).sum(1))
                spam[on] = (far * far > CUTOFF) & (y @ towards >= direction * far)
            yield pd.DataFrame({"id": f["id"], "size": f["size"].astype("int64"), "spam": np.where(spam, f["size"], 0).astype("int64")})

    kind = dict(segments.dtypes)["id"]
    marked = segments.mapInPandas(run, f"id {kind}, size long, spam long")
    return marked.groupBy("id").agg((F.sum("spam") / F.sum("size")).alias("share"))


def spam_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", more_than: float = 0.5) -> DataFrame:
    """Documents more than half of which is keywords, links or tags: ``key`` and ``share``.

    Null and blank texts are no spam. A repeated id counts as one document of all its texts. Features are computed
    once and written to the shared folder; the model is a few numbers per language.
    """
    segments = cut(segment_features(docs, key, text))
    return spam_share(segments, fit(segments)).where(F.col("share") > more_than).withColumnRenamed("id", key)
