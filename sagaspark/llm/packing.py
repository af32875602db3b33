"""Filling containers of fixed capacity with texts, under several limits at once.

A text is a vector: its tokens, one segment, its loss-bearing tokens. Its first line is what the rest answers to and bears
no loss, nor does a segment's first token, which has nothing to be predicted from. A container is filled by the dot-product
heuristic: of the items that still fit in every dimension, take the one whose vector points most along what is left.
Items are spread over shards by hash; each shard is packed on its own and leaves at most a few containers open.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaspark.session import cut

#: Place of a rank file of a public byte-level BPE tokenizer, and the public pattern that splits text before its merges.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a shard, about: enough for some hundred containers, few enough for one task.
SHARD_ITEMS = 20_000


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        widths[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def _breaks(text: str, at: int) -> bool:
    """Whether the tokenizer's pattern always splits before ``at``, so that both sides encode alike on their own."""
    a, b = text[at - 1], text[at]
    if a.isspace():
        return False
    if b == " ":
        return at + 1 < len(text) and not text[at + 1].isspace()
    return not b.isspace() and _kind(a) != _kind(b) and "'" not in (a, b)


def _kind(c: str) -> int:
    k = unicodedata.category(c)[0]
    return 1 if k == "L" else 2 if k == "N" else 0


def cut_text(text: str, capacity: int, ids: list[int], widths: np.ndarray, encode) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) of a text, each at most ``capacity`` tokens when encoded on its own, nothing lost.

    ``widths`` holds the bytes of each token. A cut falls where the tokenizer splits anyway, if the last sixteenth of a
    piece has such a place, else between two characters, as late as both sides allow. A single character of more
    tokens than the capacity stays whole.
    """
    out, base = [], 0
    while len(ids) > capacity:
        lead = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
        ends = np.cumsum(widths[ids])
        good = np.flatnonzero(np.concatenate([lead, [True]])[ends])  # tokens after which a character is complete
        chars = np.concatenate([np.cumsum(lead) - lead, [len(text)]])[ends[good]]  # and how many characters are then
        at = done = k = 0
        while len(ids) - done > capacity:
            last = max(k, int(np.searchsorted(good, done + capacity)) - 1)
            g = last
            while g > k and good[g] - done > capacity * 15 // 16 and not _breaks(text, int(chars[g])):
                g -= 1
            inside = not (chars[g] < len(text) and _breaks(text, int(chars[g])))
            n = int(good[g]) + 1 - done
            if inside:
                g = last
                while (n := len(encode(text[at : int(chars[g])]))) > capacity and g > k:
                    g -= 1
            end = int(chars[g])
            out.append((base + at, base + end, n))
            at, done, k = end, int(good[g]) + 1, g + 1
            if inside:
                break
        text, base = text[at:], base + at
        # After a cut inside a word the rest encodes otherwise.
        ids = encode(text) if inside else ids[done:]
    if text or not out:
        out.append((base, base + len(text), len(ids)))
    return out


def sized_items(docs: DataFrame, specs: list[tuple[int, int]], key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Items to pack for each (spec_id, capacity): spec_id, id, piece, char_start, char_end, tokens, loss_tokens. Only too long texts are cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, widths = _encoder(tokenizer)
        for f in frames:
            rows = []
            for i, t in zip(f["id"], f["t"]):
                ids = enc.encode_ordinary(t)
                head = len(t[: t.find("\n") + 1].encode("utf-8", "replace"))
                asked = int(np.searchsorted(np.cumsum(widths[ids[:head]]), head, side="right")) if head else 0
                for spec, capacity in specs:
                    parts = cut_text(t, capacity, ids, widths, enc.encode_ordinary)
                    rows += [(spec, i, k, *p, max(0, p[2] - max(1, 0 if k else asked))) for k, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["spec_id", "id", "piece", "char_start", "char_end", "tokens", "loss_tokens"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).dropna().mapInPandas(run, f"spec_id int, id {kind}, piece int, char_start long, char_end long, tokens int, loss_tokens int")


def _pick_in_two(classes: np.ndarray, limits: np.ndarray, used: list[int], count: list[int]):
    """The class of largest product with what is left, where classes differ in two dimensions only.

    Classes are sorted by the first of the two. From the largest that fits in it downwards they are tried in stretches that
    double, until no smaller one can reach the best so far.
    """
    p, q = np.flatnonzero(np.ptp(classes, axis=0) > 0).tolist()
    same = [(d, int(classes[0, d])) for d in range(classes.shape[1]) if d not in (p, q)]
    spent = np.inf
    of = np.argsort(classes[:, p], kind="stable")
    first, second = classes[of, p].astype(float), classes[of, q].astype(float)
    highest, dead = np.maximum.accumulate(second), 0

    def pick(left: list[int]) -> int:
        nonlocal of, first, second, highest, dead
        if any(left[d] < v for d, v in same):
            return -1
        if dead * 2 > len(of):
            keep = second != spent
            of, first, second, dead = of[keep], first[keep], second[keep], 0
            highest = np.maximum.accumulate(second)
        lp, lq = int(left[p]), int(left[q])
        a, b = lp / float(limits[p]) ** 2, lq / float(limits[q]) ** 2
        hi, width, best, score = int(first.searchsorted(lp, side="right")), 512, -1, -1.0
        while hi > 0:
            lo = max(0, hi - width)
            other = second[lo:hi]
            product = first[lo:hi] * a
            product += other * b
            product[other > lq] = -1.0
            k = int(product.argmax())
            if product[k] > score:
                if used[of[lo + k]] == count[of[lo + k]]:
                    second[lo + k] = spent
                    dead += 1
                    continue
                best, score = int(of[lo + k]), float(product[k])
            if best >= 0 and lo and first[lo - 1] * a + min(lq, highest[lo - 1]) * b <= score:
                break
            hi, width = lo, width * 2
        return best

    return pick


def fill(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item; ``sizes`` is items x dimensions, ``limits`` the capacity in each.

    An item that alone exceeds a limit gets a container of its own.
    """
    classes, which, count = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    begin = np.concatenate([[0], np.cumsum(count)])
    used, begin, count, rows = [0] * len(classes), begin.tolist(), count.tolist(), classes.tolist()
    out = np.empty(len(sizes), np.int64)
    scaled = classes / limits
    # Where no class is larger in one dimension and smaller in another, the product is largest for the last that fits.
    if (np.diff(classes, axis=0) >= 0).all():
        below = list(range(len(classes)))  # the next class at or below with items left, found by halving paths

        def pick(left: list[int]) -> int:
            c = min(int(np.searchsorted(classes[:, d], left[d], side="right")) for d in range(classes.shape[1])) - 1
            while c >= 0 and used[c] == count[c]:
                n = below[c] - (used[below[c]] == count[below[c]])
                below[c] = n
                c = n
            return c
    elif (np.ptp(classes, axis=0) > 0).sum() == 2:
        pick = _pick_in_two(classes, limits, used, count)
    else:
        live = np.arange(len(classes))

        def pick(left: list[int]) -> int:
            nonlocal live
            live = live[np.asarray(used)[live] < np.asarray(count)[live]]
            fits = live[(classes[live] <= np.asarray(left)).all(1)]
            return int(fits[np.argmax(scaled[fits] @ (left / limits))]) if len(fits) else -1

    box, packed, total = 0, 0, len(sizes)
    while packed < total:
        left = limits.tolist()
        first = True
        while packed < total:
            c = pick(left)
            if c < 0:
                if not first:
                    break
                c = next(k for k in range(len(rows) - 1, -1, -1) if used[k] < count[k])
            size = rows[c]
            n = max(1, min(count[c] - used[c], *(m // v for m, v in zip(left, size) if v > 0)))
            at = begin[c] + used[c]
            out[order[at : at + n]] = box
            used[c] += n
            packed += n
            left = [m - n * v for m, v in zip(left, size)]
            first = False
            if min(left) <= 0:
                break
        box += 1
    return out


def pack(items: DataFrame, limits: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign items (spec_id, id, piece, tokens, loss_tokens, ...) to containers of their spec.

    ``limits``: spec_id, capacity_tokens, max_segments, max_loss_tokens. Adds ``container`` (unique within the spec).
    """
    counts = {r[0]: max(1, round(r[1] / shard_items)) for r in items.groupBy("spec_id").count().collect()}
    held = {r.spec_id: np.array([r.capacity_tokens, r.max_segments, r.max_loss_tokens], np.int64) for r in limits.collect()}
    shards = F.lit(1)
    for spec, n in counts.items():
        shards = F.when(F.col("spec_id") == spec, F.lit(n)).otherwise(shards)
    spread = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), shards).cast("int"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["id", "piece", "char_start"], kind="stable").reset_index(drop=True)
        sizes = np.stack([f["tokens"], np.ones(len(f), int), f["loss_tokens"]], axis=1).astype(np.int64)
        box = fill(sizes, held[int(f["spec_id"].iloc[0])])
        return f.assign(container=f["shard"].astype("int64") * (1 << 32) + box)

    schema = items.schema.simpleString()[7:-1] + ",shard:int,container:bigint"
    return spread.groupBy("spec_id", "shard").applyInPandas(run, schema).drop("shard")


def pack_documents(docs: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers of every spec filled with all texts: spec_id, container, key, piece, char_start, char_end, tokens.

    The specs are a short stated list. A container takes at most one segment per 8 tokens of capacity, and of loss-bearing
    tokens the share of its capacity that lies half way between their share of all tokens and the whole; a piece that alone
    bears more has a container of its own. Null texts are left out, an empty text is an item of no tokens; a repeated
    document is packed as often as it comes.
    """
    s = specs.where("spec_id is not null and capacity_tokens >= 1").dropDuplicates(["spec_id"])
    listed = sorted((r.spec_id, r.capacity_tokens) for r in s.collect())
    items = cut(sized_items(docs, listed, key, text, tokenizer))
    share = items.groupBy("spec_id").agg((F.sum("loss_tokens") / F.greatest(F.sum("tokens"), F.lit(1))).alias("share"))
    most = F.ceil(F.col("capacity_tokens") * (1 + F.coalesce("share", F.lit(1.0))) / 2)
    limits = s.join(F.broadcast(share), "spec_id", "left").select("spec_id", "capacity_tokens", F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") / 8)).alias("max_segments"), most.alias("max_loss_tokens"))
    return pack(items, limits).select("spec_id", "container", F.col("id").alias(key), "piece", "char_start", "char_end", "tokens", "loss_tokens")
