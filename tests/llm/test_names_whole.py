import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagaspark.llm import names

FORMS = names.Forms(full={"kate": frozenset(["katherine"]), "pip": frozenset(["philippa"]), "ted": frozenset(["edward", "theodore"]), "co": frozenset(["company"])}, titles=frozenset(["captain"]), before=("小",), after=("将军", "门", "帮"), chars={"孀": "霜"})


def slip(rng, w):
    k = rng.randrange(len(w) - 1)
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("bhxz") + w[k:], w[:k] + rng.choice("bhxz") + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])


def pool(rng):
    given = ["katherine", "kate", "philippa", "pip", "robert", "josephine", "alexander", "edward", "ted", "theodore", "abigail"]
    surnames = [a + b for a in ("kela", "oson", "fali", "stone") for b in ("hurst", "field", "gate", "thorn")]
    said = [[rng.choice(given), rng.choice(surnames)] for _ in range(120)]
    said += [[g[0], s] for g, s in said[::3]] + [[slip(rng, g), s] for g, s in said] + [[s, g] for g, s in said[::4]]
    han = ["呼木云霜", "云霜·呼木", "呼木云寒", "呼木云霜将军", "木长白松门", "木长白松", "白松门", "丁一"]
    return sorted({" ".join(p) for p in said} | set(han))


def test_join_equals_brute_force(spark):
    said = [(k, names.parts(t, FORMS)) for k, t in enumerate(pool(random.Random(5)))]
    df = spark.createDataFrame([("B", k, p) for k, p in said] + [("C", 10_000 + k, p) for k, p in said[:40]], "book string, sid long, parts array<string>").withColumn("said", F.struct("parts"))
    pairs, _ = names.similar_names(df, FORMS, 0.45)
    got = {(r.s, r.t): r.cos for r in pairs.where("book = 'B'").collect()}
    grams = [names.grams(p, FORMS) for _, p in said]
    count = {}
    for g in grams:
        for k in g:
            count[k] = count.get(k, 0) + 1
    vec = [{k: c * np.log1p(len(said) / count[k]) for k, c in g.items()} for g in grams]
    norm = [sum(x * x for x in v.values()) ** 0.5 for v in vec]
    want = {(i, j): sum(x * vec[j].get(k, 0) for k, x in v.items()) / norm[i] / norm[j] for i, v in enumerate(vec) for j in range(i + 1, len(vec))}
    sure = {k for k, c in want.items() if c >= 0.451}
    assert len(sure) > 500 and sure <= set(got) and all(want[k] >= 0.449 and abs(want[k] - c) < 0.002 for k, c in got.items())
    assert pairs.where("book = 'C'").count() and not pairs.where("book = 'C' and (s < 10000 or t < 10000)").count()
    with pytest.raises(ValueError):
        names.similar_names(df, FORMS, 0.0)


def test_forms_are_learnt(spark):
    rec, ali = [], []
    for k, s in enumerate(["Brackhurst", "Winterfield", "Oxengate", "Hallowmoor"]):
        rec += [(f"a{k}", f"Katherine {s}"), (f"b{k}", f"Edward {s}"), (f"c{k}", f"Theodore {s}"), (f"d{k}", "木呼云" + "霜寒松柏"[k])]
        ali += [(f"a{k}", f"Kate {s}"), (f"a{k}", f"Captain Katherine {s}"), (f"b{k}", f"Ted {s}"), (f"b{k}", f"Ned {s}"), (f"c{k}", f"Ted {s}"), (f"c{k}", f"Theo {s}"), (f"d{k}", "木呼云" + "霜寒松柏"[k] + "将军"), (f"d{k}", "小木呼云" + "霜寒松柏"[k]), (f"d{k}", "木忽云" + "霜寒松柏"[k])]
    ali += [("a0", "Margaret Brackhurst"), ("zz", "Kate Stone"), ("a1", None)]
    r = spark.createDataFrame([(*x, "B") for x in rec], "canonical_id string, canonical_name string, book_id string")
    a = spark.createDataFrame(ali, "canonical_id string, surface_name string")
    f = names.learn_forms(names.disclosed_names(r, a))
    assert f.full == {"kate": {"katherine"}, "ted": {"edward", "theodore"}, "ned": {"edward"}, "theo": {"theodore"}}
    assert f.titles == {"captain"} and f.before == ("小",) and f.after == ("将军",) and f.chars == {"忽": "呼"}
    assert names.learn_forms(names.disclosed_names(r.limit(0), a)) == names.Forms()


def linked(spark, rec, ali=(), forms=FORMS, **how):
    r = spark.createDataFrame([x if len(x) == 3 else (*x, "B") for x in rec], "canonical_id string, canonical_name string, book_id string")
    a = spark.createDataFrame(list(ali), "canonical_id string, surface_name string")
    return {tuple(x) for x in names.linked_pairs(names.linked_records(r, a, forms, **how)).collect()}


PEOPLE = ["1 Philippa Kelaysworth", "2 Pip Kelaysworth", "3 Philipppa Kelaysworth", "4 P. Kelaysworth", "5 Robert Falivdane", "6 Rosalind Falivdane", "7 R. Falivdane"]
SURNAMES = [a + b for a in ("brack", "winter", "oxen", "hallow", "dunmor") for b in ("hurst", "field", "gate", "thorn", "stow", "wick", "moor", "bridge")]
BOOK = ["1 Katherine Stonefield", "2 Kate Stonefield", "3 Robert Oxengate", "4 Kathrine Stonefield", "5 Ellen Moorland", "6 Nell of Moorland", "7 John Hillbrook", "8 Mary Winterbourne"]
ALIASES = [("B5", "the Blue Tinker"), ("B6", "the Blue Tinker"), *((f"B{k}", "the captain") for k in "1378")]


def book(b, rows):
    return [(b + i, name, b) for i, name in (x.split(" ", 1) for x in rows)]


@pytest.fixture(scope="module")
def everything(spark):
    """All books at once."""
    rec = book("P", PEOPLE) + book("B", BOOK)
    rec += book("S", [f"a{k} Katherine {s}" for k, s in enumerate(SURNAMES)] + [f"b{k} Kathrine {s}" for k, s in enumerate(SURNAMES[:3])])
    rec += book("E", [f"{k:03} Katherine Stonefield" for k in range(60)] + ["900 Kathrine Stonefield", "901 Robert Oxengate"])
    rec += book("O", [f"{n} {g} Stonefield" for n, g in enumerate(["Katherine", "Kathrine", "Robert", "John", "Ellen", "Mary"])])
    return linked(spark, rec, [*ALIASES, *((f"O{n}", "the Blue Tinker") for n in range(6))])


def of(pairs, b):
    return {(x[1:], y[1:]) for x, y in pairs if x[0] == b}


def test_short_form_of_one_person_with_several_spellings(everything):
    assert of(everything, "P") == {(a, b) for a in "1234" for b in "1234" if a < b}


def test_a_common_slip_of_a_far_more_common_word(everything):
    assert of(everything, "S") == {(f"a{k}", f"b{k}") for k in range(3)}
    said = ["Kathrine", "Moor"], ["Katherine", "Moor"], [False] * 2, [False] * 2
    assert names.agreement(*said, [30, 9], [300, 9]) == 1.0 and names.agreement(*said, [60, 9], [300, 9]) == 0.0


def test_by_names_and_forms_of_address(everything):
    assert of(everything, "B") == {("1", "2"), ("1", "4"), ("2", "4"), ("5", "6")}


def test_many_equal_records_are_one_item(everything):
    assert len(of(everything, "E")) == 61 * 60 // 2


def test_a_book_comes_out_alike_alone(spark, everything):
    assert of(linked(spark, book("B", BOOK), ALIASES), "B") == of(everything, "B")


def test_the_vectors_decide(spark, everything):
    assert of(linked(spark, book("B", BOOK), ALIASES, cosine=0.97), "B") == {("1", "2"), ("5", "6")}


def test_average_linkage_equals_dense():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        size = rng.integers(1, 4, n)
        s = rng.random((n, n)).round(3) * (rng.random((n, n)) < 0.6)
        s = np.triu(s, 1) + np.triu(s, 1).T
        got = names.average_linkage(size.tolist(), {(i, j): s[i, j] for i in range(n) for j in range(i + 1, n) if s[i, j]}, 0.4)
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            mean, a, b = max((sum(s[i, j] * size[i] * size[j] for i in x for j in y) / size[x].sum() / size[y].sum(), -a, -b) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b)
            if mean < 0.4:
                break
            groups[-a] += groups.pop(-b)
        assert {tuple(sorted(x)) for x in groups} == {tuple(i for i in range(n) if got[i] == k) for k in set(got)}
