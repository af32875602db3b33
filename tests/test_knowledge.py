import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sagaspark.functions import hashing
from sagaspark.functions import text as tx
from sagaspark.operators.ranks import running_share
from sagaspark.plans import graph, retrieval as rt, temporal as tm
from sagaspark.sources import books
from sagaspark.streaming import views

LOG = "fact_id string, claim_version_id string, operation string, claim_status string, observed_ordinal int, world_valid_kind string, world_valid_from int, world_valid_to int, write_seq long"


def log(spark):
    return spark.createDataFrame([
        ("a", "a1", "assert", "supported", 1, "story_time", 0, 5, 1), ("a", "a2", "update", "supported", 9, "story_time", 6, None, 2),
        ("b", "b1", "assert", "supported", 1, "chapter_proxy", 1, None, 3), ("b", "b2", "update", "contested", 2, "chapter_proxy", 2, None, 4),
        ("c", "c1", "assert", "supported", 1, "unknown", None, None, 5), ("c", "c2", "retract", "supported", 3, "unknown", None, None, 6),
        ("d", "d1", "assert", "supported", None, "story_time", 0, None, 7),
    ], LOG)


def got(df):
    return {r.claim_version_id for r in df.collect()}


def test_newest_contested_or_withdrawn_hides_older(spark):
    assert got(tm.current(log(spark))) == {"a2", "d1"}
    assert got(tm.current(log(spark), cutoff=1)) == {"a1", "b1", "c1"}
    assert got(tm.current(log(spark), cutoff=2)) == {"a1", "c1"}


def test_world_time(spark):
    assert got(tm.current(log(spark), world=3)) == {"a1", "d1"}
    assert got(tm.current(log(spark), world=6)) == {"a2", "d1"}
    assert got(log(spark).where(tm.held_at(1))) == {"a1", "b1", "d1"}
    plan = tm.current(log(spark))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_visibility_and_projection(spark):
    runs = spark.createDataFrame([("r1", "active"), ("r2", "failed")], "run_id string, status string")
    df = spark.createDataFrame([("v", "r2", 1), ("v", "r1", 2), ("v", "r1", 3), ("w", "r2", 4), (None, "r1", 5)], "claim_version_id string, created_by_run_id string, write_seq long")
    assert [tuple(r) for r in tm.visible(df, runs).collect()] == [("v", 2, "r1")]
    res = spark.createDataFrame([("m", "c")], "mention_id string, canonical_id string")
    assert {r.e for r in tm.project(spark.createDataFrame([("m",), ("x",)], "e string"), "e", res).collect()} == {"c", "x"}


def test_evidence(spark):
    e = spark.createDataFrame([(1, "s", "supports", "now"), (1, "s", "refutes", None), (1, "t", "refutes", None), (2, "s", "unclear", None)], "claim int, span string, stance string, verification_run_id string")
    sel = tm.select_evidence(e, ["claim", "span"])
    assert sel.count() == 3
    assert {(r.claim, r.status) for r in tm.stance_status(sel, ["claim"]).collect()} == {(1, "contested"), (2, "unverified")}


def test_paths_end_in_cycles(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 1, 0.5), (2, 4, 1.0)], "source int, target int, confidence double")
    s = spark.createDataFrame([(1,)], "event int")
    assert {(r.path, r.confidence) for r in graph.paths(s, e).collect()} == {("1>2", 0.5), ("1>2>3", 0.25), ("1>2>4", 0.5)}
    assert {r.path for r in graph.paths(s, e, reverse=True).collect()} == {"1<3", "1<3<2"}


def test_candidates(spark):
    e = spark.createDataFrame([("a", ["p", "p"], "x", 1), ("b", ["p"], "x", 5), ("c", ["p", "q"], "y", 150), ("d", ["q"], "y", None), ("e", None, "y", 3)], "fact string, who array<string>, place string, ord int")
    assert {tuple(r) for r in graph.candidates(e).collect()} == {("a", "b", "causes", 0.8, 4)}
    assert graph.candidates(e, 150).count() == 3


def test_fusion(spark):
    x = spark.createDataFrame([(1, "fts", "c1", 1), (1, "fts", "c2", 2), (1, "vector", "c2", 1), (1, "vector", "c3", 2), (1, "fts", "c2", 9)], "q int, route string, item string, r int")
    s = {r.item: r.score for r in rt.rrf(x, "q", "item", "r").collect()}
    assert abs(s["c2"] - (1 / 62 + 1 / 61)) < 1e-12 and max(s, key=s.get) == "c2"
    with pytest.raises(ValueError):
        rt.rrf(x, "q", "item", "r", 0)


def test_windows_cover(spark):
    df = spark.createDataFrame([(1, 0), (2, 40), (3, 41), (4, 1000)], "id int, n int")
    for k, rows in {i: sorted((r.w_start, r.w_end) for r in rt.windows(df, F.col("n"), 40, 0.15).where(f"id = {i}").collect()) for i in (1, 2, 3, 4)}.items():
        n = {1: 0, 2: 40, 3: 41, 4: 1000}[k]
        assert rows[0][0] == 0 and rows[-1][1] == n and all(b[0] <= a[1] for a, b in zip(rows, rows[1:]))


def test_running_share(spark):
    rows = [("a", i, 1 + i % 3) for i in range(500)] + [("b", 1, 4)]
    out = {(r.g, r.v): (r.upto, r.total) for r in running_share(spark.createDataFrame(rows, "g string, v int, w int"), ["g"], "v", "w").collect()}
    total = sum(1 + i % 3 for i in range(500))
    assert out["a", 499] == (total, total) and out["a", 10] == (sum(1 + i % 3 for i in range(11)), total) and out["b", 1] == (4, 4)


def test_ids(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["a", "b"],), (None,)], "p array<string>")
    ids = [r[0] for r in df.select(hashing.event_fact_id(F.lit("duel"), F.col("p"), F.lit("x"))).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("fact_") and len(ids[0]) == 21
    assert hashing.config_hash({"b": 1, "a": "书"}) == hashing.config_hash({"a": "书", "b": 1})


def test_text_functions(spark):
    assert tx.html_text("<title>x</title><p>a&amp;b</p>\n\n\n<script>no</script><div>c</div>") == "a&b\n\nc"
    assert tx.find_tolerant("他说：“走 吧。”", "走吧") == (4, 7) and tx.find_tolerant("x", "") is None
    assert [tx.chapter_number(s) for s in ("第12章", "第一百零五章", "第十二回", "第两百章", "第一六七章", "序")] == [12, 105, 12, 200, 167, None]
    df = spark.createDataFrame([("甲。乙！丙",), ("",), (None,)], "t string")
    assert [r[0] and [tuple(x) for x in r[0]] for r in df.select(tx.sentence_spans(F.col("t"))).collect()] == [[(0, 2), (2, 4), (4, 5)], [], None]


def test_books(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("序\n第一章 开始\n正文\n第二章 结束\n完".encode("gb18030"))
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="p" xmlns:dc="d"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="i" href="x.html"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("o/x.html", "<h1>One</h1><p>text</p>")
    (tmp_path / "b.epub").write_bytes(box.getvalue())
    (tmp_path / "c.epub").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in books.read_books(spark, str(tmp_path)).collect()}
    assert rows["b.epub"].title == "Book" and "text" in rows["b.epub"].text and rows["c.epub"].error
    ch = books.split_chapters(spark.createDataFrame([(1, rows["a.txt"].text), (2, "none"), (3, None)], "id int, t string"), "id", "t").collect()
    assert [(r.id, r.ordinal, r.title, r.char_start) for r in ch] == [(1, 0, "第一章 开始", 0), (1, 1, "第二章 结束", 12), (2, 0, None, 0)]
    ln = books.lines(spark.createDataFrame([(1, "a\nbc\n")], "id int, t string"), "id", "t").collect()
    assert [(r.no, r.start, r.line) for r in ln] == [(0, 0, "a"), (1, 2, "bc"), (2, 5, "")]


def test_import_twice_changes_nothing(spark):
    a = spark.createDataFrame([("b", 1, "x"), ("b", 1, "y"), ("b", 2, "z")], "book string, n int, id string")
    new = books.new_rows(a, a.limit(0), ["book", "n"], "id")
    assert {r.id for r in new.collect()} == {"x", "z"} and books.new_rows(a, new, ["book", "n"], "id").count() == 0


def test_streaming_view(spark, tmp_path):
    src = tmp_path / "in"
    for i, rows in enumerate(([("a", 1), ("b", 5)], [("a", 3), ("b", 2)], [("a", 3)])):
        spark.createDataFrame(rows, "k string, seq int").coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema("k string, seq int").option("maxFilesPerTrigger", 1).parquet(str(src))
        views.run_view(s, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "seq").awaitTermination()
    last = max((tmp_path / "out").iterdir())
    assert {tuple(r) for r in spark.read.parquet(str(last)).collect()} == {("a", 3), ("b", 5)}


def test_limiter(spark):
    assert views.allow([0, 1, 2, 60, 61, 62], 60, 2) == [True, True, False, True, True, False]
    df = spark.createDataFrame([("k", 1704067200 + t, t) for t in (0, 1, 2, 60, 61, 62)], "k string, t long, c int").withColumn("ts", F.timestamp_seconds("t"))
    out = {r.c: r.allowed for r in views.rate_limited(df, "k", "ts", "c", 60.0, 2).collect()}
    assert [out[c] for c in (0, 1, 2, 60, 61, 62)] == [True, True, False, True, True, False]


def test_queries_have_sql():
    from sagaspark.queries import all_oracles, all_queries

    assert set(all_oracles()) <= set(all_queries()) and len(all_oracles()) > 120
