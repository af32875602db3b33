import random

import numpy as np

from sagaspark.llm import leakage


def found(texts, items):
    return {(x, i) for x, i, _ in leakage.find(texts, leakage.Items(list(range(len(items))), items), 0.4)}


def test_wording_that_many_items_share_is_found():
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    han = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(90))
    items = [passage] * 5 + [f"{passage} question {k}" for k in range(3)] + [han] * 6
    assert found([f"before {passage} after", " ".join(passage.split()[:30]), "序" + han, "nothing of it"], items) == {(d, i) for d in (0, 1) for i in range(8)} | {(2, i) for i in range(8, 14)}


def test_short_items_are_found():
    items = ["brass key", "seven brass keys hung there", "铜钥匙", "七把铜钥匙挂着"]
    assert found(["He took the brass, key and all.", "There seven brass keys hung there.", "他拿了铜钥匙。", "墙上七把铜钥匙挂着", "key brass"], items) == {(0, 0), (1, 1), (2, 2), (3, 2), (3, 3)}


def test_reach_loses_no_piece():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = rng.integers(5, 14, 30).astype(np.uint64), rng.integers(5, 24, 80).astype(np.uint64)
        (score, _, x, y), = leakage._best_pieces([(a, b)])
        least = score // leakage.MATCH
        if least:
            assert leakage._reach(leakage._within(b, np.unique(a)), least)[y].all() and leakage._reach(leakage._within(a, np.unique(b)), least)[x].all()
