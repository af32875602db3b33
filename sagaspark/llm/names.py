"""Linking the spellings of one person or organisation.

Names become weighted vectors of character n-grams. A sparse join with a prefix filter finds every pair of names of a
book whose cosine reaches a threshold; of those an exact check of the names' parts keeps the ones that can be one. Records
are grouped by average linkage over the cosines. Short forms, titles, affixes and characters written for one another are
learnt from the names that records disclose; what a name that several records disclose is worth is told from how alike
their own names are.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaspark.llm.skeleton import skeleton
from sagaspark.session import cut

#: Words that join the parts of a name.
JOINING = frozenset(["the", "of", "and"])
#: Least cosine of two names, and least average linkage of two groups.
COSINE, LINKAGE = 0.45, 0.4
#: What is left of the similarity of two records that both have by-names and share none.
CONFLICT = 0.45
#: Least mean cosine of the own names of the records that share a by-name; below it the by-name addresses anybody.
COHERENCE = 0.3
#: A word of so few records, or of at most this share of the records of a near word, can be its misspelling.
FEW, SLIP_SHARE = 2, 0.1
#: Items whose components one call groups, about.
BUCKET = 4000
#: Least share of the evidence of its kind that a learnt form must have; there are at most as many as its inverse.
LEAST = {"form": 1 / 1000, "title": 1 / 50, "after": 1 / 100, "before": 1 / 20, "char": 1 / 2000}

_HAN = re.compile(r"[㐀-鿿]")
_PINYIN = re.compile(r"(?:(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:iang|iong|uang|ang|eng|ing|ong|ian|iao|uai|uan|ai|ei|ao|ou|an|en|in|un|ia|ie|iu|ua|ue|ui|uo|er|a|o|e|i|u)){1,3}")


@dataclass(frozen=True)
class Forms:
    """What is known of a corpus's names: words to the fuller ones they stand for, titles, Han affixes, Han characters."""

    full: dict = field(default_factory=dict)
    titles: frozenset = frozenset()
    before: tuple = ()
    after: tuple = ()
    chars: dict = field(default_factory=dict)

    def of(self, w: str) -> frozenset:
        return self.full.get(w, frozenset()) | {w}


NOTHING = Forms()


def plain(text: str) -> str:
    """Look-alikes, case, accents and blanks folded."""
    s = unicodedata.normalize("NFD", skeleton(text)).casefold()
    return " ".join("".join(c for c in s if not unicodedata.combining(c)).split())


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s.replace("-", "").replace("'", ""))


def _runs(s: str) -> list[str]:
    s = re.sub(r"之", " ", s) if re.search(r"^..之", s) else s
    return re.findall(r"[㐀-鿿a-z0-9]+", s)


def parts(text: str, forms: Forms = NOTHING) -> list[str]:
    """Parts of a name: words without titles and joining words, or runs of Han characters without what is put before."""
    s = plain(text)
    if not _HAN.search(s):
        words = _words(s)
        return [w for w in words if w not in JOINING and w not in forms.titles] or words
    out = _runs(s.translate(str.maketrans(forms.chars)))
    if len(out) == 1:
        w = out[0]
        for p in forms.before:
            if w.startswith(p) and len(w) - len(p) >= 2:
                return [w[len(p) :]]
    return out


def is_han(p: list[str]) -> bool:
    return any(_HAN.search(w) for w in p)


def _close(a: str, b: str) -> bool:
    """Equal up to one character put in, left out, replaced, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


def agreement(a: list[str], b: list[str], rare_a: list[bool], rare_b: list[bool], held_a: list[int] | None = None, held_b: list[int] | None = None, forms: Forms = NOTHING) -> float:
    """How far two names can be one: 1 the same in all parts, 0.8 one is a shortened form of the other, 0 neither.

    ``rare`` says of each part whether few records of the book have it: only then can it be a slip of the pen for
    a near one. ``held`` says how many records have it: it can also be a slip for one that is far more common.
    """
    if is_han(a) != is_han(b):
        return 0.0
    if is_han(a):
        return _han_agreement(a, b, forms)
    if sorted(a) == sorted(b):
        return 1.0
    if len("".join(a)) == len("".join(b)) and {_turned(a, i) for i in range(len(a))} & {_turned(b, i) for i in range(len(b))}:
        return 1.0
    left_a, left_b, short, slips = list(range(len(a))), list(range(len(b))), False, 0
    for test in ("same", "form", "slip", "initial"):
        for i in list(left_a):
            for j in list(left_b):
                x, y = a[i], b[j]
                if test == "same":
                    ok = x == y
                elif test == "form":
                    ok = len(x) > 1 and len(y) > 1 and bool(forms.of(x) & forms.of(y))
                elif test == "slip":
                    rare = rare_a[i] or rare_b[j] or (held_a is not None and held_b is not None and _much_rarer(held_a[i], held_b[j]))
                    ok = min(len(x), len(y)) >= 3 and rare and _slip(x, y)
                    slips += ok
                else:
                    ok = (len(x) == 1) != (len(y) == 1) and x[0] == y[0]
                    short |= ok
                if ok:
                    left_a.remove(i)
                    left_b.remove(j)
                    break
    rest_a, rest_b = [a[i] for i in left_a], [b[j] for j in left_b]
    if rest_a and rest_b or slips > 1 or not any(len(w) > 2 for w in a) or not any(len(w) > 2 for w in b):
        return 0.0
    rest = rest_a or rest_b
    if all(len(w) == 1 for w in rest):
        return 0.8 if short else 1.0
    # One part more is a place or a kind that the shorter name leaves out.
    return 0.8 if min(sum(len(w) > 1 for w in a), sum(len(w) > 1 for w in b)) >= 2 and not short and len(rest) == 1 else 0.0


def _much_rarer(x: int, y: int) -> bool:
    return min(x, y) <= SLIP_SHARE * max(x, y)


def _turned(p: list[str], i: int) -> str:
    return "".join(p[i:] + p[:i])


def _slip(x: str, y: str) -> bool:
    if not _close(x, y):
        return False
    # Two well-formed names in pinyin that differ by a letter are two names.
    return not (_PINYIN.fullmatch(x) and _PINYIN.fullmatch(y))


def _core(w: str, forms: Forms) -> tuple[str, frozenset]:
    """A Han name without the learnt endings, and these."""
    ends: set = set()
    while True:
        end = next((t for t in forms.after if w.endswith(t) and len(w) - len(t) >= 2), None)
        if end is None:
            return w, frozenset(ends)
        w, ends = w[: -len(end)], ends | {end}


def _han_agreement(a: list[str], b: list[str], forms: Forms) -> float:
    sa, sb = "".join(a), "".join(b)
    turned_a, turned_b = {_turned(a, i) for i in range(len(a))}, {_turned(b, i) for i in range(len(b))}
    if turned_a & turned_b or len(sa) == len(sb) and (len(a) > 1 or len(b) > 1) and sb in (sa[2:] + sa[:2], sa[1:] + sa[:1]):
        return 1.0
    best = 0.0
    for x in turned_a:
        for y in turned_b:
            (ca, ea), (cb, eb) = _core(x, forms), _core(y, forms)
            if not (ea <= eb or eb <= ea):
                continue
            if ca == cb:
                best = max(best, 1.0 if len(ca) > 2 or ea == eb else 0.8)
            elif (ea or eb or len(a) == len(b) == 1) and min(len(ca), len(cb)) >= 2 and 1 <= abs(len(ca) - len(cb)) <= 2 and (ca.endswith(cb) or cb.endswith(ca)):
                best = max(best, 0.8)
    return best


def grams(p: list[str], forms: Forms = NOTHING) -> dict[str, float]:
    """Character n-grams of a name, parts in any order: ones and pairs for Han, threes with ends and initials for words.

    A short form counts as the names it stands for, each by its share; learnt endings of Han names don't count.
    """
    out: Counter = Counter()
    if is_han(p):
        for w in (_core(w, forms)[0] for w in p):
            out.update(w[i : i + 2] for i in range(len(w) - 1))
            out.update(w)
        return out
    for w in p:
        full = sorted(forms.full.get(w, ())) or [w]
        for v in full:
            x = f"^{v}$"
            for g in [*(x[i : i + 3] for i in range(max(1, len(x) - 2))), f"^{v[0]}"]:
                out[g] += 1 / len(full)
    return out


def disclosed_names(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct names of each record, own and disclosed: book, rec, name (folded), own."""
    r = records.where("canonical_id is not null and book_id is not null")
    own = r.select(F.col("book_id").alias("book"), F.col("canonical_id").alias("rec"), F.col("canonical_name").alias("raw"), F.lit(True).alias("own"))
    other = aliases.select(F.col("canonical_id").alias("rec"), F.col("surface_name").alias("raw")).dropna().join(r.select(F.col("book_id").alias("book"), F.col("canonical_id").alias("rec")), "rec").select("book", "rec", "raw", F.lit(False).alias("own"))
    both = own.unionByName(other).dropna().distinct()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["name"] = [plain(x) for x in f.pop("raw")]
            yield f[["book", "rec", "name", "own"]]

    return both.mapInPandas(fold, "book string, rec string, name string, own boolean").where("name != ''").groupBy("book", "rec", "name").agg(F.max("own").alias("own"))


def evidence(own: str, other: str) -> tuple[str, str, str] | None:
    """What two folded names of one record say about names: kind, and the two sides (the second empty for affixes).

    form: all words but one are equal; title: one word more; char: Han names equal but for one character; before,
    after: a Han name with something at an end.
    """
    if _HAN.search(own) or _HAN.search(other):
        x, y = sorted(("".join(_runs(own)), "".join(_runs(other))), key=lambda s: (len(s), s))
        if len(x) == len(y):
            differ = [(p, q) for p, q in zip(x, y) if p != q]
            return ("char", *sorted(differ[0])) if len(differ) == 1 and len(x) > 2 else None
        if len(x) < 2:
            return None
        return ("after", y[len(x) :], "") if y.startswith(x) else ("before", y[: -len(x)], "") if y.endswith(x) else None
    a, b = (Counter(w for w in _words(s) if w not in JOINING) for s in (own, other))
    here, there = list((a - b).elements()), list((b - a).elements())
    shared = (a & b).total()
    if len(here) + len(there) == 1 and shared >= 2 and len((here + there)[0]) > 1:
        return "title", (here + there)[0], ""
    if len(here) == len(there) == 1 and shared and min(len(here[0]), len(there[0])) > 1 and not _close(here[0], there[0]):
        return ("form", *sorted((here[0], there[0])))
    return None


def learn_forms(names: DataFrame, least: dict[str, float] = LEAST) -> Forms:
    """Short forms, titles, affixes and characters written for one another, from the names each record discloses.

    Each record's own name is held against the others it has. A form needs two records and at least a share ``least``
    of the evidence of its kind, so that the table has at most 1 / share rows, whatever the corpus. Of two forms the one
    with more evidence in all is the full one. All records count.
    """
    pairs = names.where("own").select("book", "rec", F.col("name").alias("x")).join(names.where("not own").select("book", "rec", F.col("name").alias("y")), ["book", "rec"]).where("x != y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, r, *e) for b, r, x, y in zip(f["book"], f["rec"], f["x"], f["y"]) if (e := evidence(x, y))]
            yield pd.DataFrame(rows, columns=["book", "rec", "kind", "a", "b"])

    seen = pairs.mapInPandas(run, "book string, rec string, kind string, a string, b string").distinct().groupBy("kind", "a", "b").agg(F.count("*").alias("n"))
    share = F.lit(None).cast("double")
    for k, v in least.items():
        share = F.when(F.col("kind") == k, F.lit(v)).otherwise(share)
    whole = seen.groupBy("kind").agg(F.sum("n").alias("all"))
    kept = seen.join(whole, "kind").where((F.col("n") >= 2) & (F.col("n") >= share * F.col("all"))).select("kind", "a", "b", "n").collect()
    by = {k: sorted((r for r in kept if r.kind == k), key=lambda r: (-r.n, r.a, r.b)) for k in least}
    titles = frozenset(r.a for r in by["title"])
    pairs_ = [r for r in by["form"] if not {r.a, r.b} & titles]
    weight: Counter = Counter()
    for r in pairs_:
        weight[r.a] += r.n
        weight[r.b] += r.n
    full: dict = {}
    for r in pairs_:
        short, long_ = sorted((r.a, r.b), key=lambda w: (weight[w], len(w), w))
        full[short] = full.get(short, frozenset()) | {long_}
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for r in by["char"]:
        x, y = find(r.a), find(r.b)
        if x != y:
            root[max(x, y)] = min(x, y)
    chars = {c: find(c) for c in root}
    # Affixes are looked for after characters have been replaced.
    one = str.maketrans(chars)
    return Forms(full, titles, tuple(r.a.translate(one) for r in by["before"]), tuple(sorted({r.a.translate(one) for r in by["after"]}, key=lambda t: (-len(t), t))), chars)


def similar_names(names: DataFrame, forms: Forms = NOTHING, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """Every pair of names of a book with a cosine of at least ``cosine``, and all vectors.

    ``names``: book, sid (a number), parts, and whatever is to be carried along in a struct ``said``. Returns the
    pairs (book, s, t, cos, p, q; s < t) and the vectors (book, sid, ids, ws). A gram weighs as much as it is rare among
    the names of the book. Grams of a name are ordered from rare to common; two names that reach the threshold share one
    in the part of each before the rest is too short to matter, and the pair comes out at the first they share. There is
    no limit to the partners of a name. Weights are kept in units of 1 / 32767.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0")

    def gram_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, s, g, c) for b, s, p in zip(f["book"], f["sid"], f["parts"]) for g, c in grams(list(p), forms).items()]
            yield pd.DataFrame(rows, columns=["book", "sid", "g", "c"])

    g = names.select("book", "sid", "parts").mapInPandas(gram_rows, "book string, sid long, g string, c double").select("book", "sid", F.hash("g").alias("g"), "c")
    total = names.groupBy("book").agg(F.count("*").alias("total"))
    weight = g.groupBy("book", "g").agg(F.count("*").alias("df")).join(total, "book").select("book", "g", "df", F.log1p(F.col("total") / F.col("df")).alias("w"))
    rows = g.join(weight, ["book", "g"]).groupBy("book", "sid").agg(F.array_sort(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "g", (F.col("c") * F.col("w")).cast("float").alias("x")))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.x.cast("double") * e.x))
    vectors = cut(rows.withColumn("n", norm).select("book", "sid", F.transform("v", lambda e: e.g).alias("ids"), F.transform("v", lambda e: F.round(e.x / F.col("n") * 32767).cast("smallint")).alias("ws")))

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for ids, ws in zip(f["ids"], f["ws"]):
                x = np.asarray(ws, float) / 32767
                rest = np.maximum(0.0, (x * x).sum() - np.concatenate([[0], np.cumsum(x * x)]))
                k = int((np.sqrt(rest[:-1]) >= cosine - 1e-3).sum())
                marks, row = 0, []
                for i in range(k):
                    row.append((int(ids[i]), float(x[i]), float(np.sqrt(rest[i + 1])), i, marks))
                    marks |= 1 << int(ids[i]) % 63
                out.append(row)
            yield f.assign(pre=out)

    schema = vectors.schema.simpleString()[7:-1] + ",pre:array<struct<gram:int,x:float,rest:float,at:int,marks:bigint>>"
    post = vectors.mapInPandas(prefixes, schema).join(names.select("book", "sid", "said"), ["book", "sid"]).select("book", "sid", "ids", "ws", "said", F.explode("pre").alias("e"))
    post = post.select("book", F.col("e.gram").alias("gram"), "sid", F.col("e.x").alias("x"), F.col("e.rest").alias("rest"), F.col("e.at").alias("at"), F.col("e.marks").alias("marks"), "ids", "ws", "said")
    a, b = post.alias("a"), post.alias("b")
    earlier = lambda n: F.slice(F.col(f"{n}.ids"), F.lit(1), F.col(f"{n}.at"))
    bound = F.col("a.x") * F.col("b.x") + F.col("a.rest") * F.col("b.rest") >= cosine - 1e-3
    # Marks of the grams before this one say at once that most pairs share none of them.
    first = (F.col("a.marks").bitwiseAND(F.col("b.marks")) == 0) | ~F.arrays_overlap(earlier("a"), earlier("b"))
    met = a.join(b, (F.col("a.book") == F.col("b.book")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.sid") < F.col("b.sid")) & bound & first)
    both = met.select(F.col("a.book").alias("book"), F.col("a.sid").alias("s"), F.col("b.sid").alias("t"), F.col("a.said").alias("p"), F.col("b.said").alias("q"), F.col("a.ids").alias("ia"), F.col("a.ws").alias("wa"), F.col("b.ids").alias("ib"), F.col("b.ws").alias("wb"))

    def near(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            cos = _dots(*(f.column(c) for c in ("ia", "wa", "ib", "wb")))
            keep = np.flatnonzero(cos >= cosine)
            some = f.select(["book", "s", "t", "p", "q"]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(cos[keep]), *some.columns[3:]], ["book", "s", "t", "cos", "p", "q"])

    said = dict(names.dtypes)["said"]
    return both.mapInArrow(near, f"book string, s long, t long, cos double, p {said}, q {said}"), vectors


def _dots(ia: pa.Array, wa: pa.Array, ib: pa.Array, wb: pa.Array) -> np.ndarray:
    """Inner product of each row's two sparse vectors, all rows together."""
    if not len(ia):
        return np.zeros(0)

    def keyed(ids: pa.Array, ws: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(ids), dtype=np.int64), np.diff(ids.offsets.to_numpy()))
        return row << 32 | (ids.flatten().to_numpy().astype(np.int64) & 0xFFFFFFFF), ws.flatten().to_numpy().astype(np.float64) / 32767

    (ka, xa), (kb, xb) = keyed(ia, wa), keyed(ib, wb)
    order = np.argsort(kb)
    kb, xb = kb[order], xb[order]
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[at] == ka
    return np.bincount(ka[same] >> 32, weights=xa[same] * xb[at[same]], minlength=len(ia))


def average_linkage(size: list[float], sim: dict[tuple[int, int], float], least: float) -> list[int]:
    """Group number (its least item) of each item: the two groups of the largest mean similarity are merged while it is at least ``least``.

    ``size`` says how many equal items an item stands for; pairs that ``sim`` (i < j) lacks have similarity 0.
    """
    n = len(size)
    size, near = list(size), [dict() for _ in range(n)]
    for (i, j), s in sim.items():
        near[i][j] = near[j][i] = s * size[i] * size[j]
    group = list(range(n))
    heap = [(-s, i, j, size[i], size[j]) for (i, j), s in sim.items() if s >= least]
    heapq.heapify(heap)
    while heap:
        _, i, j, si, sj = heapq.heappop(heap)
        # A group that has grown or gone since makes the entry stale.
        if group[i] != i or group[j] != j or size[i] != si or size[j] != sj:
            continue
        group[j] = i
        size[i] += size[j]
        near[i].pop(j)
        for k, s in near[j].items():
            if k != i:
                near[i][k] = near[i].get(k, 0.0) + s
                near[k][i] = near[i][k]
                del near[k][j]
        near[j] = {}
        for k, s in near[i].items():
            mean = s / (size[i] * size[k])
            if mean >= least:
                a, b = min(i, k), max(i, k)
                heapq.heappush(heap, (-mean, a, b, size[a], size[b]))
    out = []
    for i in range(n):
        while group[i] != i:
            i = group[i]
        out.append(i)
    return out


def _entities(items: list[tuple[dict[int, bool], int]], links: Iterable[tuple[int, int, float]], linkage: float) -> list[int]:
    """Group number of each item; an item is its names (id to whether it is a by-name) and how many records have just these."""
    by: dict[int, list[int]] = {}
    for i, (names, _) in enumerate(items):
        for s in names:
            by.setdefault(s, []).append(i)
    sim: dict[tuple[int, int], float] = {}

    def say(i: int, j: int, s: float) -> None:
        if i != j:
            k = (min(i, j), max(i, j))
            sim[k] = max(sim.get(k, 0.0), s)

    for who in by.values():
        for x, i in enumerate(who):
            for j in who[:x]:
                say(i, j, 1.0)
    for s, t, v in links:
        for i in by.get(s, ()):
            for j in by.get(t, ()):
                say(i, j, v)
    # By-names that two records do not share speak against them.
    known = [{s for s, byname in names.items() if byname} for names, _ in items]
    for i, j in sim:
        if known[i] and known[j] and not known[i] & known[j]:
            sim[i, j] *= CONFLICT
    return average_linkage([n for _, n in items], sim, linkage)


def components(edges: DataFrame) -> DataFrame:
    """Connected parts by spreading the least id: columns node, part. Goes on until nothing changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("part")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "part"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near"))
        # A node also takes the part of its part, which halves the way each round.
        new = label.join(near, "node").select("node", F.least("part", "near").alias("part"), F.col("part").alias("old"))
        jump = new.select(F.col("node").alias("part"), F.col("part").alias("far"))
        new = cut(new.join(jump, "part", "left").select("node", F.least("part", F.coalesce("far", "part")).alias("part"), "old"))
        if not new.where("part != old").limit(1).count():
            return new.select("node", "part")
        label = new.select("node", "part")


def unclear_forms(links: DataFrame, holds: DataFrame) -> DataFrame:
    """Short forms whose longer names are several persons: column short.

    Longer names are one person's if full agreement, a record that holds both, or a short form that fits nothing else
    leads from one to the other; forms that fit several names lead nowhere.
    """
    fits = cut(links.where("ok < 1").select("short", F.when(F.col("short") == F.col("s"), F.col("t")).otherwise(F.col("s")).alias("node")).distinct())
    doubtful = cut(fits.groupBy("short").count().where("count > 1").select(F.col("short").alias("sid")))
    near = links.select(F.col("s").alias("sid"), "t").join(doubtful, "sid", "left_anti").select(F.col("sid").alias("a"), F.col("t").alias("sid")).join(doubtful, "sid", "left_anti").select("a", F.col("sid").alias("b"))
    own = holds.join(doubtful, "sid", "left_anti").select("node", "sid")
    same = own.join(own.groupBy("node").agg(F.min("sid").alias("first")), "node").where("sid != first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    groups = components(near.unionByName(same).distinct())
    known = fits.join(doubtful.select(F.col("sid").alias("short")), "short").join(groups, "node", "left")
    return known.groupBy("short").agg(F.countDistinct(F.coalesce("part", "node")).alias("n")).where("n > 1").select("short")


def by_names_of_anybody(holds: DataFrame, vectors: DataFrame, coherence: float) -> DataFrame:
    """By-names whose holders' own names are unlike one another: column sid.

    The mean cosine of all pairs of holders comes from the length of the sum of their vectors, so no pairs are formed.
    """
    shared = holds.groupBy("sid").agg(F.count("*").alias("n"), F.min("byname").alias("byname")).where("n > 1 and byname").select("sid", "n")
    proper = holds.where("own").groupBy("node").agg(F.min("sid").alias("own_sid"))
    who = holds.join(shared, "sid").select("sid", "n", "node").join(proper, "node").groupBy("sid", "n", "own_sid").agg(F.count("*").alias("c"))
    x = who.join(vectors.select(F.col("sid").alias("own_sid"), F.explode(F.arrays_zip("ids", "ws")).alias("e")), "own_sid")
    length = x.groupBy("sid", "n", F.col("e.ids").alias("g")).agg(F.sum(F.col("c") * F.col("e.ws") / 32767.0).alias("x")).groupBy("sid", "n").agg(F.sum(F.col("x") * F.col("x")).alias("d"))
    return length.where((F.col("d") - F.col("n")) / (F.col("n") * (F.col("n") - 1)) < coherence).select("sid")


def linked_records(records: DataFrame, aliases: DataFrame, forms: Forms | None = None, cosine: float = COSINE, linkage: float = LINKAGE, coherence: float = COHERENCE) -> DataFrame:
    """Groups of entity records of a book that mean the same person or organisation: book, rec, entity (its least record).

    Records without a partner are groups of their own. Names fold to one form first, so repeated and withdrawn
    disclosures and ways of encoding play no role. Null or blank names say nothing; records without a book or id are
    left out; the same id in two books is two records. Without ``forms`` they are learnt from all the names given; with
    the same ``forms`` a book comes out alike whatever other books are there.
    """
    names = cut(disclosed_names(records, aliases))
    forms = learn_forms(names) if forms is None else forms
    own_name = names.where("own").groupBy("book", "rec").agg(F.min("name").alias("proper"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A by-name is a disclosed name that shortens or varies no part of the record's own.
        for f in frames:
            p = [parts(x, forms) for x in f["name"]]
            q = [parts(x, forms) if isinstance(x, str) else [] for x in f.pop("proper")]
            f["parts"] = p
            f["byname"] = [bool(a and b and not own and not agreement(a, b, [True] * len(a), [True] * len(b), forms=forms)) for a, b, own in zip(p, q, f["own"])]
            yield f

    schema = "book string, rec string, name string, own boolean, parts array<string>, byname boolean"
    surfaces = cut(names.join(own_name, ["book", "rec"], "left").mapInPandas(split, schema).where("size(parts) > 0").withColumn("sid", F.xxhash64("book", F.concat_ws("\u001f", "parts"))))
    counts = surfaces.select("book", "rec", F.explode(F.array_distinct("parts")).alias("w")).distinct().groupBy("book", "w").count()
    kinds = surfaces.groupBy("book", "sid").agg(F.first("parts").alias("parts"), F.min("byname").alias("byname"))
    held = kinds.select("book", "sid", F.posexplode("parts").alias("i", "w")).join(counts, ["book", "w"]).groupBy("book", "sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("count").cast("int").alias("n")))), lambda s: s.n).alias("held"))
    kinds = cut(kinds.join(held, ["book", "sid"]).select("book", "sid", "parts", "byname", F.struct("parts", "held").alias("said")))

    # Names of persons and organisations; by-names link by being shared only.
    pairs, vectors = similar_names(kinds.where("not byname"), forms, cosine)

    def agree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, t, cos, p, hp, q, hq in zip(*(f[c].tolist() for c in ("s", "t", "cos", "p", "hp", "q", "hq"))):
                p, q, hp, hq = list(p), list(q), hp.tolist(), hq.tolist()
                if ok := agreement(p, q, [n <= FEW for n in hp], [n <= FEW for n in hq], hp, hq, forms):
                    rows.append((s, t, cos, ok, 0 if ok == 1 else t if sum(map(len, p)) >= sum(map(len, q)) else s))
            yield pd.DataFrame(rows, columns=["s", "t", "cos", "ok", "short"])

    flat = pairs.select("s", "t", "cos", F.col("p.parts").alias("p"), F.col("p.held").alias("hp"), F.col("q.parts").alias("q"), F.col("q.held").alias("hq"))
    links = cut(flat.mapInPandas(agree, "s long, t long, cos double, ok double, short long"))
    node = F.concat_ws("\u001f", "book", "rec")
    holds = cut(surfaces.groupBy(node.alias("node"), "sid").agg(F.min("byname").alias("byname"), F.max("own").alias("own")))
    holds = cut(holds.join(by_names_of_anybody(holds, vectors, coherence), "sid", "left_anti"))
    links = cut(links.join(unclear_forms(links, holds), "short", "left_anti").select("s", "t", F.sqrt(F.col("ok") * F.col("cos")).alias("sim")))

    # Records as nodes: stars around each name that several hold, and links between holders of two names.
    first = holds.groupBy("sid").agg(F.min("node").alias("hub"))
    stars = holds.join(first, "sid").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    across = links.join(first.select(F.col("sid").alias("s"), F.col("hub").alias("a")), "s").join(first.select(F.col("sid").alias("t"), F.col("hub").alias("b")), "t").where("a != b").select("a", "b")
    parts_of = components(stars.unionByName(across).distinct())

    # Average linkage within each component. Records with the same names are one item, however many they are; components
    # are spread over buckets of a few thousand items, each of which is one call.
    told = holds.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("sid", "byname"))).alias("names")).join(parts_of, "node").withColumn("sig", F.xxhash64("part", "names"))
    told = cut(told)
    items = told.groupBy("part", "sig").agg(F.first("names").alias("names"), F.count("*").cast("int").alias("n"))
    held = items.select("part", F.explode("names.sid").alias("s")).distinct()
    between = links.join(held, "s").select("part", "s", "t", "sim")
    rows = items.select("part", "sig", "names", "n", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"), F.lit(0.0).alias("sim")).unionByName(between.select("part", F.lit(None).cast("long").alias("sig"), F.lit(None).cast("array<struct<sid:bigint,byname:boolean>>").alias("names"), F.lit(0).alias("n"), "s", "t", "sim"))
    buckets = max(1, items.count() // BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets))).select("bucket", "part", "sig", F.col("names.sid").alias("ids"), F.col("names.byname").alias("by"), "n", "s", "t", "sim")

    def group(f: pd.DataFrame) -> pd.DataFrame:
        of: dict[str, tuple[dict, list]] = {}
        for part, sig, ids, by, n, s, t, v in zip(*(f[c].tolist() for c in ("part", "sig", "ids", "by", "n", "s", "t", "sim"))):
            items, links = of.setdefault(part, ({}, []))
            if ids is None:
                links.append((s, t, v))
            else:
                items[int(sig)] = dict(zip(ids, by)), n
        out = []
        for items, links in of.values():
            sigs = sorted(items)
            out += zip(sigs, _entities([items[k] for k in sigs], links, linkage))
        return pd.DataFrame(out, columns=["sig", "grp"])

    # Signatures are turned to text for the way through pandas, which has no whole numbers with gaps.
    grouped = rows.withColumn("sig", F.col("sig").cast("string")).groupBy("bucket").applyInPandas(group, "sig long, grp long")
    placed = told.select("node", "part", "sig").join(grouped, "sig")
    entity = cut(placed).groupBy("part", "grp").agg(F.min("node").alias("entity"))
    grouped = placed.join(entity, ["part", "grp"]).select("node", "entity")
    everyone = names.select("book", "rec").distinct().withColumn("node", node)
    out = everyone.join(grouped, "node", "left").withColumn("entity", F.coalesce(F.element_at(F.split("entity", "\u001f"), 2), F.col("rec")))
    return out.select("book", "rec", "entity")


def linked_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of each group, smaller id first."""
    a, b = groups.select("book", "entity", F.col("rec").alias("canonical_id_a")), groups.select("book", "entity", F.col("rec").alias("canonical_id_b"))
    return a.join(b, ["book", "entity"]).where("canonical_id_a < canonical_id_b").select("canonical_id_a", "canonical_id_b")
