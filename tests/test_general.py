import random
from collections import defaultdict

from sagaspark.operators import changefeed, history, pointintime

CLAIM = "fact_id string, claim_version_id string, operation string, supersedes_version_id string, observed_ordinal int"


def current(spark, rows):
    df = spark.createDataFrame(rows, CLAIM)
    return {(r[0], r[1]) for r in changefeed.current_versions(df).collect()}


def test_current_takes_last_and_drops_withdrawn(spark):
    rows = [
        ("a", "a1", "assert", None, 1), ("a", "a2", "update", "a1", 5), ("a", "a2", "update", "a1", 5), ("a", "a1", "assert", None, 1),
        ("b", "b1", "assert", None, 1), ("b", "b2", "retract", "b1", 2),
        ("c", "c2", "update", "c1", 3), ("c", "c1", "assert", None, 3), ("c", "c3", "update", "c2", 3),
        ("d", "d1", "assert", None, 4), ("d", "d2", "update", "d1", None), ("d", "d3", "update", "d2", None),
        ("e", "e2", "update", "never came", 2), (None, "x", "assert", None, 1), ("f", None, "assert", None, 1),
    ]
    assert current(spark, rows) == {("a", "a2"), ("c", "c3"), ("d", "d3"), ("e", "e2")}


def test_current_supersession_through_an_earlier_place(spark):
    rows = [("a", "z", "assert", None, 5), ("a", "m", "update", "z", 2), ("a", "b", "update", "m", 5)]
    assert current(spark, rows) == {("a", "b")}


def test_current_empty_and_unplaced(spark):
    assert current(spark, []) == set()
    assert current(spark, [("a", "a1", "update", None, None), ("a", "a0", "assert", None, None)]) == {("a", "a1")}
    assert current(spark, [("a", "a1", "update", "a2", None), ("a", "a2", "update", "a1", None)]) == set()


def shuffled_rows(spark, run):
    """What ``run`` returns, and the rows that its stages write for exchanges."""
    sc = spark.sparkContext
    jsc, gateway = sc._jsc.sc(), sc._gateway

    def stages():
        jsc.listenerBus().waitUntilEmpty()
        seq = jsc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (seq.apply(i) for i in range(seq.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_current_exchanges_each_version_few_times(spark):
    # Three versions a fact, the last without a place in every tenth: versions used to be written more than seven times each.
    rows = [(f"f{i}", f"v{i}_{j}", "update" if j else "assert", f"v{i}_{j - 1}" if j else None, None if j == 2 and i % 10 == 0 else 2 * j) for i in range(2000) for j in range(3)]
    got, n = shuffled_rows(spark, lambda: current(spark, rows))
    assert got == {(f"f{i}", f"v{i}_2") for i in range(2000)}
    assert len(rows) < n < 4 * len(rows)


def test_current_equals_a_walk(spark):
    # Deliveries that disagree, chains without places, rings and chains that go back, each fact on its own.
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(400):
        f, ids = f"f{i}", [f"{c}{i}" for c in rng.sample("abcdef", rng.randint(1, 6))]
        said = defaultdict(list)
        for v in ids * 2:
            said[v].append((rng.choice(["assert", "update", "retract", None]), rng.choice([None, "never came", *ids]), rng.choice([None, 0, 1, 2])))
        rows += [(f, v, *x) for v in said for x in said[v]]
        one = {v: tuple(min((y for y in c if y is not None), default=None) for c in zip(*x)) for v, x in said.items()}

        def chain(v):
            seen = []
            while v in one and v not in seen:
                seen.append(v)
                v = one[v][1]
            return seen

        place = {v: next((one[x][2] for x in chain(v) if one[x][2] is not None), -1) for v in one}
        top = [v for v in one if place[v] == max(place.values())]
        left = [v for v in top if not any(v in chain(x) for x in top if x != v)]
        if left and one[best := max(left, key=lambda v: (one[v][0] not in (None, "assert"), v))][0] != "retract":
            want.add((f, best))
    rng.shuffle(rows)
    assert current(spark, rows) == want


def test_patches_equal_a_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), p, rng.choice(["insert", "update", "update", "delete"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for p in range(400)]
    base = [("a", 9, "base"), ("d", 8, "kept")]
    want = {k: [x, y] for k, x, y in base}
    for k, _, kind, x, y in rows:
        if kind == "delete":
            want.pop(k, None)
        elif kind == "insert":
            want[k] = [x, y]
        elif k in want or x is not None or y is not None:
            cur = want.setdefault(k, [None, None])
            want[k] = [cur[0] if x is None else x, cur[1] if y is None else y]
    feed = rows + rng.sample(rows, 100)
    rng.shuffle(feed)
    ops = spark.createDataFrame(feed, "k string, pos long, kind string, x int, y string")
    out = changefeed.apply_patches(spark.createDataFrame(base, "k string, x int, y string"), changefeed.compose_patches(ops, ["k"], "pos", "kind", ["x", "y"], 16), ["k"], ["x", "y"])
    assert {r.k: [r.x, r.y] for r in out.collect()} == want


def test_attributes_equal_brute_force(spark):
    rng = random.Random(7)
    ev = [(f"e{i}", rng.choice("AB"), rng.randint(0, 40), rng.randint(0, 40)) for i in range(60)]
    st = []
    for i in range(120):
        s = rng.randint(-5, 45)
        st.append((f"v{i:03}", rng.choice("AB"), rng.choice("xy"), s, rng.choice([None, s, s + rng.randint(1, 20)]), rng.randint(0, 40), rng.choice([None, rng.randint(0, 50)])))
    want = {}
    for e, ent, at, known in ev:
        for f in "xy":
            c = [(s, o, v) for v, x, g, s, u, o, gone in st if x == ent and g == f and s <= at and (u is None or at < u) and o <= known and (gone is None or gone > known)]
            if c:
                want[e, ent, f] = max(c)[2]
    e = spark.createDataFrame(ev + [(None, "A", 1, 1), ("n", "A", None, 1)], "event string, entity string, at int, known int")
    s = spark.createDataFrame(st + [("q", None, "x", 0, None, 0, None)], "version string, entity string, field string, start int, until int, seen int, gone int")
    got = {(r.event, r.entity, r.field): r.version for r in pointintime.attributes_at_events(e, s).collect()}
    assert got == want
    assert pointintime.attributes_at_events(e.limit(0), s).count() == 0


def test_history_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice("AB"), rng.randint(0, 60), rng.choice("pqr"), rng.choice([None, *range(9)]), f"v{i:03}") for i in range(300)]
    by = defaultdict(dict)
    for k, s, v, o, ver in rows:
        r = (-1 if o is None else o, ver, v)
        by[k][s] = max(by[k].get(s, r), r)
    want = set()
    for k, at in by.items():
        seq = []
        for s in sorted(at):
            if not seq or seq[-1][1] != at[s][2]:
                seq.append((s, at[s][2]))
        want |= {(k, s, seq[i + 1][0] if i + 1 < len(seq) else -1, v) for i, (s, v) in enumerate(seq)}
    df = spark.createDataFrame(rows + [(None, 1, "p", 1, "x"), ("A", None, "p", 1, "x"), ("A", 1, None, 1, "x")], "k string, s int, v string, o int, ver string")
    for n in (1, 7, 16):
        got = history.attribute_history(df, ["k"], "s", "v", ["o", "ver"], snapshots=n)
        assert {(r.k, r.valid_from, r.valid_to, r.v) for r in got.collect()} == want
    assert history.attribute_history(df.limit(0), ["k"], "s", "v", ["o", "ver"]).count() == 0


def test_snapshots_append(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    b = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), (None, 7)], "k string, v int")
    got = {(r.k, r.change, r.v) for r in history.merkle_diff(a, b, ["k"], ["v"]).collect()}
    assert got == {("b", "changed", 3), ("c", "removed", None), ("d", "added", 4), (None, "added", 7)}
    assert history.merkle_diff(a, a, ["k"], ["v"]).count() == 0
    h = history.append_snapshot(a.limit(0).selectExpr("k", "v", "0 valid_from", "0 valid_to"), a, 10, ["k"], ["v"])
    h = history.append_snapshot(h, b, 20, ["k"], ["v"])
    assert {tuple(r) for r in h.collect()} == {("a", 1, 10, -1), ("b", 2, 10, 20), ("c", None, 10, 20), ("b", 3, 20, -1), ("d", 4, 20, -1), (None, 7, 20, -1)}


def test_restated_cells_are_not_read(spark):
    rows = [("A", 0, 1, "p"), ("A", 1, 12, "p"), ("A", 2, 25, "p"), ("A", 3, 31, "q"), ("B", 0, 2, "p"), ("B", 1, 11, "p"), ("B", 1, 12, "r"), ("B", 1, 13, "p"), ("C", 2, 22, "z")]
    df = spark.createDataFrame(rows, "k string, snap int, valid_from int, v string")
    for bits, fanout in ((1, 1), (12, 6)):
        assert {tuple(r) for r in history.changed_cells(df, ["k"], bits, fanout).collect()} == {("A", 0, None), ("A", 3, "p"), ("B", 0, None), ("B", 1, "p"), ("C", 2, None)}


def test_a_node_keeps_what_can_win(spark):
    # One entity with very many states that all hold: per point of knowledge one is left.
    s = spark.range(3000).selectExpr("concat('v', lpad(id, 5, '0')) version", "'A' entity", "'x' field", "cast(id % 50 as int) start", "cast(null as int) until", "cast(id % 7 as int) seen", "cast(null as int) gone")
    e = spark.createDataFrame([("e1", "A", 60, 3), ("e2", "A", 10, 0), ("e3", "A", 60, 9)], "event string, entity string, at int, known int")
    got = {r.event: r.version for r in pointintime.attributes_at_events(e, s).collect()}
    want = {n: max((i % 50, i % 7, f"v{i:05}") for i in range(3000) if i % 50 <= at and i % 7 <= known)[2] for n, _, at, known in [("e1", "A", 60, 3), ("e2", "A", 10, 0), ("e3", "A", 60, 9)]}
    assert got == want
