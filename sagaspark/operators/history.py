"""Full history of changing attributes, kept by comparing snapshots as hash trees.

A snapshot is what stands at a point. Its rows are spread over leaf buckets by key; a leaf's digest is the sum of its
rows' hashes, a branch's the sum of its leaves', so that all trees come from one aggregation. Comparison goes down from
the root and reads rows only of leaves whose digests differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagaspark.session import cut

LEAF_BITS = 12
FANOUT_BITS = 6


def _hash(cols: list[str]):
    # Kept to 56 bits; summed as decimal it cannot overflow.
    return F.shiftrightunsigned(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols)), 8).cast("decimal(38,0)")


def _digest(cols: list[str]):
    return F.sum(_hash(cols))


def _leaf(keys: list[str], leaf_bits: int):
    return F.pmod(F.xxhash64(*keys), F.lit(1 << leaf_bits)).cast("int")


def merkle_changed_leaves(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], leaf_bits: int = LEAF_BITS, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """Leaf buckets (column ``leaf``) in which two snapshots differ, found level by level from the root.

    At most 2**leaf_bits rows, whatever the size of the snapshots. Repeated rows count; nulls are values.
    """
    def leaves(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(_leaf(keys, leaf_bits).alias("leaf")).agg(_digest([*keys, *values]).alias(name))

    at = leaves(before, "b").join(leaves(after, "a"), "leaf", "full").withColumn("b", F.coalesce("b", F.lit(0))).withColumn("a", F.coalesce("a", F.lit(0)))
    return _descend(at, [], leaf_bits, fanout_bits).select("leaf")


def _descend(at: DataFrame, by: list[str], leaf_bits: int, fanout_bits: int) -> DataFrame:
    """Rows of ``at`` (leaf, b, a) below branches that differ on every level."""
    depth = list(range(leaf_bits, 0, -fanout_bits))
    for shift in depth:
        branch = [*by, F.shiftright("leaf", shift).alias("br")]
        differ = at.groupBy(*branch).agg(F.sum("b").alias("b"), F.sum("a").alias("a")).where("b != a").select(*by, "br")
        at = at.withColumn("br", F.shiftright("leaf", shift)).join(differ, [*by, "br"], "left_semi").drop("br")
    return at.where("b != a")


def merkle_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], leaf_bits: int = LEAF_BITS, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """What changed between two snapshots: keys, ``change`` (added, changed, removed) and the new ``values``.

    One row per key is expected in a snapshot; of repeated keys the largest values stand. A null key is a key.
    """
    leaf = _leaf(keys, leaf_bits).alias("leaf")
    touched = merkle_changed_leaves(before, after, keys, values, leaf_bits, fanout_bits)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *values, leaf).join(touched, "leaf", "left_semi").groupBy(*keys).agg(F.max(F.struct(*values)).alias(name))

    b, a = part(before, "b").alias("b"), part(after, "a").alias("a")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}"))
    change = F.when(F.col("b.b").isNull(), "added").when(F.col("a.a").isNull(), "removed").when(~F.col("a.a").eqNullSafe(F.col("b.b")), "changed")
    return b.join(a, same, "full").select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys), change.alias("change"), *(F.col(f"a.a.{v}").alias(v) for v in values)).where("change is not null")


def append_snapshot(history: DataFrame, snapshot: DataFrame, as_of: int, keys: list[str], values: list[str]) -> DataFrame:
    """Bring a history (keys, values, valid_from, valid_to; -1 is open) up to a new full snapshot valid from ``as_of``.

    Changed and removed keys have their open version closed at ``as_of``; added and changed ones get a new open one.
    """
    open_ = history.where("valid_to = -1").select(*keys, *values)
    diff = merkle_diff(open_, snapshot.select(*keys, *values), keys, values)
    ended = diff.where("change != 'added'").select(*keys, F.lit(True).alias("__ended"))
    kept = history.join(ended, keys, "left").withColumn("valid_to", F.when((F.col("valid_to") == -1) & F.col("__ended"), F.lit(as_of)).otherwise(F.col("valid_to"))).drop("__ended")
    fresh = diff.where("change != 'removed'").select(*keys, *values, F.lit(as_of).alias("valid_from"), F.lit(-1).alias("valid_to"))
    return kept.select(*keys, *values, "valid_from", "valid_to").unionByName(fresh)


def attribute_history(versions: DataFrame, keys: list[str], start: str, value: str, order: list[str], snapshots: int = 16, leaf_bits: int = LEAF_BITS, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """Gapless history of an attribute from version rows in any order: keys, valid_from, valid_to (-1 is open), value.

    Of versions with the same start the one with the largest ``order`` (nulls smallest) stands, then the larger value.
    Neighbours with equal values are one period. Rows with a null key, start or value are left out.

    The axis of ``start`` is cut into ``snapshots`` equal spans; snapshot i is what stands at the end of span i. A key's
    versions of one span are a cell. Snapshot i-1 says of a key what stood, span i says of it the values it took: the two
    are compared as hash trees, level by level, and within leaves that differ key by key. Cells that only restate what
    stood are never read further. The versions of the others are held against what stood and appended. A key's cells are
    different groups, so that no task takes a hot key whole.
    """
    rows = versions.dropna(subset=[*keys, start, value])
    low, high = rows.agg(F.min(start), F.max(start)).head()
    width = 1 if low is None else max(1, -(-(int(high) - int(low) + 1) // snapshots))
    snap = F.floor((F.col(start) - F.lit(low or 0)) / F.lit(width)).cast("int")
    rank = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col(value).alias("v"))
    rows = rows.select(*keys, F.col(start).alias("valid_from"), snap.alias("snap"), rank.alias("r"))
    # One exchange on (keys, span) serves the aggregation, the cells and the windows below.
    rows = rows.repartition(*(F.col(k) for k in keys), F.col("snap"))
    rows = cut(rows.groupBy(*keys, "snap", "valid_from").agg(F.max("r").alias("r")).select(*keys, "snap", "valid_from", F.col("r.v").alias("v")))

    changed = changed_cells(rows, keys, leaf_bits, fanout_bits)
    inner = Window.partitionBy(*keys, "snap").orderBy("valid_from")
    news = rows.join(changed, [*keys, "snap"]).withColumn("before", F.coalesce(F.lag("v").over(inner), "stood")).where("before is null or before != v")
    # Within a cell a version ends where the next begins, the last one where the key's next changed cell begins.
    news = news.select(*keys, "snap", "valid_from", "v", F.lead("valid_from").over(inner).alias("to"))
    begins = news.groupBy(*keys, "snap").agg(F.min("valid_from").alias("begin"))
    begins = begins.withColumn("next", F.lead("begin").over(Window.partitionBy(*keys).orderBy("snap"))).select(*keys, "snap", "next")
    kept = news.join(begins, [*keys, "snap"])
    return kept.select(*keys, "valid_from", F.coalesce("to", "next", F.lit(-1)).cast("int").alias("valid_to"), F.col("v").alias(value))


def changed_cells(rows: DataFrame, keys: list[str], leaf_bits: int = LEAF_BITS, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """Cells whose span says anything else of their key than the snapshot before: keys, snap, stood (null for a new key).

    ``rows``: keys, snap, valid_from, v. Keys without a row in a span add the same to both digests and are left out of
    them, so that all trees come from one aggregation over the cells.
    """
    cells = rows.groupBy(*keys, "snap").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max_by("v", "valid_from").alias("last"))
    cells = cells.withColumn("stood", F.lag("last").over(Window.partitionBy(*keys).orderBy("snap"))).withColumn("leaf", _leaf(keys, leaf_bits))
    was = F.when(F.col("stood").isNotNull(), _hash([*keys, "stood", "stood"]))
    trees = cells.groupBy("snap", "leaf").agg(F.coalesce(F.sum(was), F.lit(0)).alias("b"), F.sum(_hash([*keys, "lo", "hi"])).alias("a"))
    touched = _descend(trees, ["snap"], leaf_bits, fanout_bits).select("snap", "leaf")
    # At most snapshots * 2**leaf_bits rows of two ints, whatever the size of the data.
    cells = cells.join(F.broadcast(touched) if leaf_bits <= LEAF_BITS else touched, ["snap", "leaf"], "left_semi")
    return cells.where("stood is null or lo != hi or lo != stood").select(*keys, "snap", "stood")


def state_history(claims: DataFrame, payloads: DataFrame, snapshots: int = 16) -> DataFrame:
    """History of every subject and field: subject_entity_id, field, valid_from, valid_to, value.

    Built from the usable state versions that no retract ever named.
    """
    from sagaspark.operators.pointintime import usable_states

    live = cut(usable_states(claims, payloads).where("not withdrawn").select("entity", "field", "start", "value", "seen", "version"))
    h = attribute_history(live, ["entity", "field"], "start", "value", ["seen", "version"], snapshots)
    return h.select(F.col("entity").alias("subject_entity_id"), "field", F.col("valid_from").cast("int").alias("valid_from"), "valid_to", "value")
