import random

import pytest

from sagaspark.functions import evidence as ev


def test_tolerant_places():
    t = ev.Text("“云霜，” 他说，“拔剑！” 云 霜走了。")
    assert [t.text[a:b] for a, b in t.places("云霜")] == ["云霜", "云 霜"] and t.places("，！") == [] and t.places("剑云霜") == [(11, 18)]
    assert ev.Text("").places("x") == [] and ev.Text("a.b").places("a.b") == [(0, 3)]


def test_spans_prefer_hard_anchors_then_all_then_short():
    text = "云霜走进来。天黑了。她拔出剑，剑光一闪。" + "雨下着。" * 60 + "云霜又来。"
    best = ev.spans(text, [("云霜", True), ("拔出剑", True), ("剑光", False)])[0]
    assert text[best[0] : best[1]] == "云霜走进来。天黑了。她拔出剑，剑光" and best[2:4] == (1.0, 1.0)
    assert ev.spans(text, [("没有", True)]) == [] and ev.spans("", [("a", True)]) == []
    far = ev.spans(text, [("拔出剑", True), ("又来", True)])
    assert far[0][2] == 0.5 and all(b - a <= max(ev.LONGEST, 12) for a, b, *_ in far)
    assert ev.spans("天黑。", [("天黑", False)])[0][2] == 1.0


def test_segments_lose_nothing():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("ab字。！\n ") for _ in range(rng.randint(0, 120)))
        most = rng.randint(1, 30)
        s = ev.segments(t, most)
        assert "".join(t[a:b] for a, b in s) == t and all(0 < b - a <= most for a, b in s)
        ends = [m.end() for m in ev._SENTENCE.finditer(t)]
        for a, b in s:
            fits = [e for e in ends if a < e <= a + most]
            assert b == (max(fits) if fits else min(len(t), a + most))


def test_tables(spark):
    d = spark.createDataFrame([(1, "一二。三四五六"), (2, ""), (3, None)], "k int, t string")
    assert [(r.k, r.no, r.char_start, r.char_end) for r in ev.segment_table(d, "k", "t", 4).orderBy("k", "no").collect()] == [(1, 0, 0, 3), (1, 1, 3, 7)]
    a = spark.createDataFrame([("c", "他拔剑。", [("拔剑", True)]), ("e", None, [("x", True)]), ("f", "x", [])], "k string, t string, anchors array<struct<text:string,hard:boolean>>")
    assert [tuple(r)[:3] for r in ev.best_spans(a, ["k"], "t", "anchors").collect()] == [("c", 1, 3)]
    assert ev.best_spans(a.limit(0), ["k"], "t", "anchors").count() == 0


def test_small_queries_equal_sql(spark):
    """Every query of the module on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from sagaspark.queries import evidence as q
    from tools.verify import rows

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in d.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for name in sorted(q.ORACLE):
        df = q.QUERIES[name](spark, str(d))
        cur = con.execute(q.ORACLE[name])
        assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall()), name
