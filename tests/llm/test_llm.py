import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagaspark.llm import leakage, names, packing, queries, ranking, skeleton, spam, splitting
from sagaspark.llm import tokens as tk

sk = skeleton.skeleton


def test_same_look():
    for a, b in [("Ｃｈａｐ　１", "Chap 1"), ("Сhаpter", "Chapter"), ("é", "é"), ("a​b­c", "abc"), ("⼀⽉", "一月"), ("六", "六"), ("LⅪ：", "LXI:"), ("a b ", "a b"), ("ﬁn", "fin"), ("书‧山・水", "书·山·水"), ("a\r\nb", "a\nb"), ("x︀", "x"), ("ραgе", "page"), ("Уоυ", "You"), ("ӏіɡhtօ", "lighto"), ("Ꭺ", "A"), ("ıf", "if")]:
        assert sk(a) == sk(b), (a, b)
    for a, b in [("A", "a"), ("é", "e"), ("②", "2"), ("东", "東"), ("a b", "ab"), ("I", "l"), ("0", "O"), ("", "x")]:
        assert sk(a) != sk(b), (a, b)
    for t in ["", " ", "​", "Ⅻ章", "á"]:
        assert sk(sk(t)) == sk(t)


def test_look_alike_pairs(spark):
    rows = [("g", "k1", "Title"), ("g", "k2", "Тitle"), ("g", "k3", "title"), ("g", "k2", "Тitle"), ("h", "k4", "Тitle"), ("g", "k5", None), (None, "k6", "Title"), ("g", "k7", "Title"), ("e", "k8", ""), ("e", "k9", "​")]
    df = spark.createDataFrame(rows, "g string, key_a string, t string")
    assert {(r.key_a, r.key_b) for r in skeleton.look_alike_pairs(df, ["g"], "key_a", "t").collect()} == {("k1", "k2"), ("k2", "k7"), ("k8", "k9")}
    assert skeleton.look_alike_pairs(df.limit(0), ["g"], "key_a", "t").count() == 0
    assert [r.f for r in skeleton.one_form(df.where("t is null"), "t", "f").collect()] == [None]


def test_leximin(spark):
    nan = float("nan")
    h = [(1, "a", "x", 1e6), (1, "a", "y", 5.0), (1, "a", "z", 4.0), (1, "a", "y", 5.0), (1, "b", "y", 0.9), (1, "b", "z", 0.8), (1, "b", "w", nan), (1, "c", "w", None), (2, "a", "x", 1.0), (2, "a", "v", 1.0), (None, "a", "x", 1.0)]
    df = spark.createDataFrame(h, "query_id int, route string, raw_chunk_id string, score double")
    out = {(r.query_id, r.raw_chunk_id): r for r in ranking.leximin(df).collect()}
    assert [round(x, 3) for x in out[1, "y"].score] == [0.667, 1.0] and [round(x, 3) for x in out[1, "x"].score] == [0.0, 1.0]
    assert out[1, "y"].route_ranks == {"a": 2, "b": 1} and (1, "w") not in out
    top = ranking.top_items(ranking.leximin(df), 2).collect()
    assert {(r.query_id, r.raw_chunk_id, r.place) for r in top} == {(1, "y", 1), (1, "z", 2), (2, "v", 1), (2, "x", 2)}
    lists = spark.createDataFrame([(3, "p", {"a": 2}), (3, "q", {"a": 1}), (1, "z", {"a": 1})], "query_id int, raw_chunk_id string, route_ranks map<string,int>")
    assert {(r.raw_chunk_id, tuple(r.score)) for r in ranking.leximin(df, lists=lists).where("query_id = 3").collect()} == {("p", (0.5,)), ("q", (1.0,))}
    assert ranking.leximin(df.limit(0)).count() == 0


def test_pieces_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        t = "".join(rng.choice("abc 字，。\n\n.!") for _ in range(rng.randint(0, 400)))
        limit, ratio, least = rng.randint(2, 60), rng.choice([0, 0.1, 0.25]), rng.randint(0, 20)
        over = round(limit * ratio)
        p = splitting.pieces(t, limit, over, least)
        s, want, start = splitting.strengths(t), [], 0
        low = min(limit, max(1, least, min(over, limit - 1) + 1))
        while len(t) > limit and len(t) - start > limit:
            end = max(range(start + low, start + limit + 1), key=lambda i: (s[i], i))
            want.append((start, end))
            start = end - min(over, limit - 1)
        want.append((start, len(t)))
        assert p == want and all(b - a <= limit for a, b in p)


def test_strongest_over_blocks():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 7, 5000).astype(np.int8)
    best = splitting.Strongest(s, 50, block=64)
    for low in range(0, 4900, 37):
        assert best(low, low + 49) == max(range(low, low + 50), key=lambda i: (s[i], i))


def test_no_cut_at_abbreviations_and_numbers():
    t = "He paid 3.5 marks to Mr. Garo and left. Then he slept."
    s = splitting.strengths(t)
    assert [i for i in range(len(t) + 1) if s[i] == splitting.SENTENCE] == [t.index("Then"), len(t)]
    assert splitting.strengths("a\r\nb")[2] == splitting.INSIDE and splitting.strengths("éx")[1] == splitting.INSIDE


def test_split_table(spark):
    c = spark.createDataFrame([("r", "v", 100, None, "字" * 25), ("r", "v", 100, None, "字" * 25), ("s", "v", None, 7, "ok"), ("n", "v", 0, 0, None), ("u", "unknown", 0, 0, "x" * 99), ("e", "v", 0, 0, "")], "raw_chunk_id string, chunking_version string, token_start int, char_start int, content string")
    cfg = spark.createDataFrame([("v", 10, 0.2, 3)], "chunking_version string, target_tokens int, overlap_ratio double, min_tokens int")
    out = splitting.split_oversized(c, cfg).orderBy("raw_chunk_id", "piece").collect()
    assert [(r.token_start, r.token_end) for r in out if r.raw_chunk_id == "r"] == [(100, 110), (108, 118), (116, 125)]
    assert {(r.raw_chunk_id, r.token_start, r.token_end, r.oversized) for r in out if r.raw_chunk_id != "r"} == {("s", 7, 9, False), ("e", 0, 0, False)}


def _encoder():
    try:
        return packing._encoder(packing.TOKENIZER)
    except OSError:
        pytest.skip("no tokenizer file")


def test_cut_text_loses_nothing():
    enc, widths = _encoder()
    rng = random.Random(9)
    for t in ["", "x", "word " * 300, "无标点" * 200, "😀é" * 100, "".join(rng.choice("ab 字。\n!") for _ in range(900)), "a" * 700]:
        for cap in (5, 16, 64):
            p = packing.cut_text(t, cap, enc.encode_ordinary(t), widths, enc.encode_ordinary)
            assert "".join(t[a:b] for a, b, _ in p) == t
            assert all(n == len(enc.encode_ordinary(t[a:b])) <= cap for a, b, n in p)


def test_fill_keeps_limits():
    rng = np.random.default_rng(2)
    for same in (True, False):
        tok = rng.integers(0, 90, 400)
        sizes = np.stack([tok, np.ones(400, int), np.maximum(0, tok - 1) if same else rng.integers(0, 50, 400)], axis=1)
        limits = np.array([100, 7, 60 if not same else 100])
        box = packing.fill(sizes, limits)
        used = np.stack([np.bincount(box, weights=sizes[:, d]) for d in range(3)], axis=1)
        assert (used <= limits).all() and len(box) == 400 and box.max() + 1 <= 1.3 * max(np.ceil(sizes.sum(0) / limits))
    assert list(packing.fill(np.array([[500, 1, 1], [3, 1, 1]]), np.array([100, 7, 60]))) == [1, 0] or packing.fill(np.array([[500, 1, 1], [3, 1, 1]]), np.array([100, 7, 60])).tolist()[0] != packing.fill(np.array([[500, 1, 1], [3, 1, 1]]), np.array([100, 7, 60])).tolist()[1]


def test_pack_documents(spark):
    _encoder()
    d = spark.createDataFrame([(1, "one two three"), (2, "字。" * 400), (3, ""), (4, None), (5, "x y"), (5, "x y")], "doc_id long, text string")
    s = spark.createDataFrame([(1, 64), (2, 512), (2, 512)], "spec_id int, capacity_tokens int")
    out = packing.pack_documents(d, s).toPandas()
    assert out.groupby(["spec_id", "container"]).tokens.sum().max() <= 512 and (out[out.spec_id == 1].tokens <= 64).all()
    for spec in (1, 2):
        x = out[(out.spec_id == spec) & (out.doc_id == 2)].sort_values("piece")
        assert list(x.char_start)[0] == 0 and list(x.char_end)[-1] == 800 and list(x.char_end)[:-1] == list(x.char_start)[1:]
        assert sorted(out[out.spec_id == spec].doc_id.unique()) == [1, 2, 3, 5] and (out[out.spec_id == spec].doc_id == 5).sum() == 2


def test_tokens_fold_typography():
    a, b = tk.tokenise(["Ｈello, wоrld​! café 字a"]), tk.tokenise(["hello WORLD cafe 字 A"])
    assert list(a.hash) == list(b.hash) and len(a.hash) == 5
    assert len(tk.tokenise([""]).hash) == 0 and len(tk.tokenise(["", "...", "x"]).hash) == 1
    t = tk.tokenise(["ab", "cd"])
    assert list(t.text) == [0, 1] and list(t.start) == [0, 2]


def _sw(item, doc, least):
    h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == doc[j - 1] else -2), h[i - 1][j] - 2, h[i][j - 1] - 2)
    return max(map(max, h))


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.integers(5, 12, rng.integers(1, 25)).astype(np.uint64), rng.integers(5, 12, rng.integers(1, 40)).astype(np.uint64)
        (score, same, x, y), _ = leakage._best_pieces([(a, b), (b[:1], a)])
        assert score == _sw(list(a), list(b), 1) and 2 * same >= score and same <= min(x.stop - x.start, y.stop - y.start)


def test_leakage(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    items = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    han = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(120))
    w = items[0].split()
    edited = [x if i % 9 else rng.choice(words) for i, x in enumerate(w)]
    docs = [(1, "before it all " + items[0].upper() + "!"), (2, " ".join(edited)), (3, " ".join(w[:14])), (4, " ".join(w[:16]) + " some other talk " * 30 + " ".join(w[30:48])), (5, "，".join(han[i : i + 7] for i in range(0, 70, 7))), (6, han[:30]), (7, ""), (8, None), (1, items[1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(10 + k, t) for k, t in enumerate(items)] + [(20, han), (21, ""), (22, None), (20, han)], "item_id int, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, i).collect()} == {(1, 10), (2, 10), (4, 10), (5, 20), (1, 11)}
    assert leakage.leaked_items(d.limit(0), i).count() == 0 and leakage.leaked_items(d, i.limit(0)).count() == 0


PROSE = ["When the rain had stopped she walked down to the harbour, and nobody on the steps asked her where the letter was.", "He counted the coins into the palm of his brother, though the fire in the room was nearly out.", "“If you trust me, then leave it here,” said the old man with a shrug, and he turned away at last."]


def test_spam(spark):
    rng = random.Random(8)
    names_ = ["Mara", "Edwin", "Iselin", "Tobias"]
    rows = [(k, " ".join(rng.choice(PROSE).replace("he", rng.choice(["he", "she"])).replace("brother", rng.choice(names_)) for _ in range(12))) for k in range(150)]
    links = "\n".join(f'<a href="https://x{k}.example/{k}">Chapter {k}</a>' for k in range(40))
    stuffed = " ".join(rng.choice(["free", "novel", "epub", "The Iron Bell", "download", "full chapters"]) for _ in range(150))
    rows += [(1000, links), (1001, stuffed), (1002, rows[0][1] + "\n" + links[:300]), (1003, ""), (1004, None), (1005, " \n ")]
    got = {r.doc_id for r in spam.spam_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1000, 1001}
    assert spam.spam_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_names_agree():
    def ok(a, b, rare=True):
        f = names.Forms(full={"kate": frozenset(["katherine"]), "acad": frozenset(["academy"])}, titles=frozenset(["captain"]), after=("将军", "楼", "门", "帮"))
        p, q = names.parts(a, f), names.parts(b, f)
        return names.agreement(p, q, [rare] * len(p), [rare] * len(q), forms=f)

    for a, b in [("Captain Mary Stone", "mary stone"), ("Stone, Mary", "Mary Stone"), ("Kate Stonefield", "Katherine Stonefield"), ("Maryy Stonefield", "Mary Stonefield"), ("Mo Wu Luo", "Wuluo Mo"), ("Ning-Zhao Cen", "Cen, Ningzhao"), ("Acad. of the Copper Mirror", "The Academy of the Copper Mirror"), ("云霜·呼木", "呼木云霜"), ("呼木云霜将军", "呼木云霜"), ("苍炉门（轩台）", "轩台苍炉门")]:
        assert ok(a, b) == 1.0, (a, b)
    for a, b in [("M. Stonefield", "Mary Stonefield"), ("云霜", "呼木云霜"), ("白松", "长镇白松楼"), ("Quiet Orchard Company", "Company of the Quiet Orchard of Belas")]:
        assert ok(a, b) == 0.8, (a, b)
    for a, b in [("Mary Stonefield", "Robert Stonefield"), ("Mary Stonefield", "Mary Harbour"), ("Mo Wuluo", "Mo Wutuo"), ("呼木云霜", "呼木明寒"), ("轩台苍炉门", "轩台苍炉帮"), ("Mary A. Stone", "Mary B. Stone")]:
        assert ok(a, b) == 0.0, (a, b)
    assert ok("Mary Stonefeld", "Mary Stonefield", rare=False) == 0.0


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "e"), ("e", "f")], "a string, b string")
    assert {tuple(r) for r in names.components(e).collect()} == {(x, "a") for x in "abcdef"} | {("x", "x"), ("y", "x")}


def test_linked_records(spark):
    rec = [("1", "Katherine Stonefield", "B"), ("2", "Katherine Stonefeld", "B"), ("3", "Robert Stonefield", "B"), ("5", "Katherine Stonefield", "C"), ("6", None, "B"), ("7", "", "B"), (None, "x", "B"), ("8", "Somebody Else", None), ("1", "Katherine Stonefield", "B")]
    r = spark.createDataFrame(rec, "canonical_id string, canonical_name string, book_id string").withColumn("part", F.lit(1))
    a = spark.createDataFrame([("3", "the Grey Piper"), ("1", None), ("zz", "Kate Stonefield"), (None, "x")], "canonical_id string, surface_name string")
    assert {tuple(x) for x in names.linked_pairs(names.linked_records(r, a)).collect()} == {("1", "2")}
    assert names.linked_pairs(names.linked_records(r.limit(0), a.limit(0))).count() == 0


def test_queries_are_registered():
    assert {f"p{n}_found" for n in (1, 4, 6, 7, 9, 10)} < set(queries.QUERIES) and set(queries.ORACLE) < set(queries.QUERIES)
    assert unicodedata.normalize("NFC", "é") == "é"


def test_loss_bearing_tokens_are_limited(spark):
    _encoder()
    d = spark.createDataFrame([(k, ("question " * (k % 5) + "\n" if k % 5 else "") + "answer words here " * (3 + k % 7)) for k in range(200)], "doc_id long, text string")
    s = spark.createDataFrame([(1, 128)], "spec_id int, capacity_tokens int")
    out = packing.pack_documents(d, s).toPandas()
    share = out.loss_tokens.sum() / out.tokens.sum()
    boxes = out.groupby("container").agg(t=("tokens", "sum"), n=("tokens", "size"), loss=("loss_tokens", "sum"))
    most = int(np.ceil(128 * (1 + share) / 2))
    assert (boxes.t <= 128).all() and (boxes.n <= 16).all() and (boxes.loss <= most).all() and most < 128
    assert (boxes.loss > most - 20).any() and out.tokens.sum() / (128 * len(boxes)) > 0.9
    one = out.sort_values("doc_id").iloc[0]
    assert one.loss_tokens == one.tokens - 1 and out[out.doc_id == 4].loss_tokens.iloc[0] < out[out.doc_id == 4].tokens.iloc[0] - 1


def test_pick_in_two_equals_scan():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(2, 60))
        classes = np.unique(np.stack([rng.integers(0, 12, n), np.ones(n, int), rng.integers(0, 12, n)], axis=1), axis=0)
        if (np.ptp(classes, axis=0) > 0).sum() != 2:
            continue
        limits, count, used = np.array([20, 5, 15]), rng.integers(1, 4, len(classes)), np.zeros(len(classes), np.int64)
        pick = packing._pick_in_two(classes, limits, used, count)
        while (used < count).any():
            left = np.array([rng.integers(0, 21), rng.integers(0, 6), rng.integers(0, 16)])
            c = pick(left)
            fits = [k for k in range(len(classes)) if used[k] < count[k] and (classes[k] <= left).all()]
            product = lambda k: float((classes[k] / limits) @ (left / limits))
            if not fits:
                assert c == -1
                k = int(np.flatnonzero(used < count)[0])
                used[k] += 1
                continue
            assert c in fits and abs(product(c) - max(map(product, fits)) + 0.0) < 1e-9
            used[c] += 1
