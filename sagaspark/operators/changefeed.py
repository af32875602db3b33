"""Applying a feed of inserts, updates and deletes that arrives repeated and out of order.

An operation is a function from row state to row state. Every one of them has the form
"forget what was before position r, then set these fields", written down as a *patch*::

    (reset position, reset kind, field -> (position, value))

Composing two patches takes the later entry of each component, which is associative, commutative and
idempotent. Any grouping of the feed into chunks therefore gives the same result: repeated deliveries count
once, arrival order is irrelevant, and a hot key is reduced in as many pieces as it has position ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaspark.session import cut


def compose_patches(ops: DataFrame, keys: list[str], position: str, kind: str, fields: list[str], range_width: int = 1024, chunk: Column | None = None) -> DataFrame:
    """Reduce a feed to one patch per key.

    ``position`` is the order of an operation within its key, an integer, or any orderable type if ``chunk`` says which
    range of positions a row belongs to; ``kind`` is one of insert, update, delete.
    An insert sets all ``fields`` (nulls included), an update the non-null ones, a delete forgets all. Operations
    at the same position: delete wins over insert, insert over update; of several updates the larger value stands.
    The first reduction runs over position ranges of ``range_width`` (a hot key becomes many groups), the second
    over the ranges of a key. Rows with a null key, position or kind are no operations and are left out.
    """
    live = ops.where(F.col(position).isNotNull() & F.col(kind).isin("insert", "update", "delete"))
    for k in keys:
        live = live.where(F.col(k).isNotNull())
    pos = F.col(position).cast("long") if chunk is None else F.col(position)
    rank = F.when(F.col(kind) == "delete", 2).when(F.col(kind) == "insert", 1)
    parts = [F.max(F.when(rank.isNotNull(), F.struct(pos.alias("p"), rank.alias("k")))).alias("__reset")]
    for f in fields:
        parts.append(F.max(F.when((F.col(kind) == "update") & F.col(f).isNotNull(), F.struct(pos.alias("p"), F.col(f).alias("v")))).alias(f"__u_{f}"))
        parts.append(F.max(F.when(F.col(kind) == "insert", F.struct(pos.alias("p"), F.col(f).alias("v")))).alias(f"__i_{f}"))
    names = ["__reset", *(f"__{x}_{f}" for f in fields for x in "ui")]
    chunk = F.floor(pos / F.lit(range_width)) if chunk is None else chunk
    parts.append(F.max(pos).alias("__last"))
    chunks = live.groupBy(*keys, chunk.alias("__chunk")).agg(*parts)
    return chunks.groupBy(*keys).agg(*(F.max(n).alias(n) for n in [*names, "__last"]))


def apply_patches(base: DataFrame | None, patches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Apply composed patches to ``base`` (one row per key, or None for an empty table); deleted keys have no row.

    A key that only ever got updates is created by them, as in an upsert feed.
    """
    joined = patches if base is None else patches.join(base.select(*keys, *(F.col(f).alias(f"__b_{f}") for f in fields)), keys, "full")
    reset_at, reset_kind = F.col("__reset.p"), F.col("__reset.k")
    update_after: Column = F.lit(False)
    out = []
    for f in fields:
        later = F.col(f"__u_{f}").isNotNull() & (reset_at.isNull() | (F.col(f"__u_{f}.p") > reset_at))
        update_after = update_after | later
        under = F.lit(None) if base is None else F.when(reset_at.isNull(), F.col(f"__b_{f}"))
        inserted = F.when((reset_kind == 1), F.when(F.col(f"__i_{f}.p") == reset_at, F.col(f"__i_{f}.v")))
        out.append(F.when(later, F.col(f"__u_{f}.v")).otherwise(F.coalesce(inserted, under)).alias(f))
    alive = reset_kind.isNull() | (reset_kind == 1) | update_after
    return joined.where(alive).select(*keys, *out)


def _versions(rows: DataFrame) -> DataFrame:
    """One row per version, the smallest of what its deliveries say, and whether one without ordinal supersedes it (``asked``).

    A delivery without ordinal asks for the version it names as it goes by, so that places are later looked up only there.
    """
    kinds = dict(rows.dtypes)
    own = F.struct("ver", "op", "sup", "ord", F.lit(False).alias("asked"))
    ask = F.struct(F.col("sup").alias("ver"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("op", "sup", "ord")), F.lit(True).alias("asked"))
    sent = rows.select("fact", F.inline(F.when(F.col("ord").isNull() & F.col("sup").isNotNull(), F.array(own, ask)).otherwise(F.array(own))))
    least = (F.min(c).alias(c) for c in ("op", "sup", "ord"))
    return sent.groupBy("fact", "ver").agg(*least, F.max("asked").alias("asked"), F.min("asked").alias("absent")).where("not absent").drop("absent")


def _places(v: DataFrame) -> DataFrame:
    """Adds each version's place: its own ordinal, or that of the version it supersedes, through as many as needed.

    A version whose chain ends in nothing takes no place and sorts before all others.
    """
    known, walk = v.where("ord is not null"), v.where("ord is null").withColumn("ptr", F.col("sup"))
    step = walk.select("fact", F.col("ver").alias("ptr"), F.col("sup").alias("nxt"))
    nested = walk.join(step, ["fact", "ptr"], "left_semi").count()
    for _ in range(math.ceil(math.log2(nested + 1)) if nested else 0):
        walk = cut(walk.join(step, ["fact", "ptr"], "left").select("fact", "ver", "op", "sup", F.coalesce("nxt", "ptr").alias("ptr")))
        step = cut(step.join(step.select("fact", F.col("ptr").alias("nxt"), F.col("nxt").alias("far")), ["fact", "nxt"], "left").select("fact", "ptr", F.coalesce("far", "nxt").alias("nxt")))
    at = known.where("asked").select("fact", F.col("ver").alias("ptr"), F.col("ord").alias("place"))
    found = cut(walk.join(at, ["fact", "ptr"], "left").select("fact", "ver", "op", "sup", "place"))
    placed = known.select("fact", "ver", "op", "sup", F.col("ord").alias("place")).unionByName(found)
    return placed.withColumn("place", F.coalesce(F.col("place").cast("long"), F.lit(-(1 << 40))))


def _marked(v: DataFrame) -> DataFrame:
    """Adds to each version the places from which others supersede it: the first (``low``) and the last (``high``).

    In place of the operation stands its rank: 2 for a retract, 0 for an assert or none, else 1. Versions and
    supersessions go through one exchange.
    """
    rank = F.when(F.col("op") == "retract", 2).when(F.col("op") != "assert", 1).otherwise(0)
    none = F.lit(None)
    own = F.struct("ver", "place", rank.alias("rank"), none.cast("long").alias("over"))
    over = F.struct(F.col("sup").alias("ver"), none.cast("long").alias("place"), none.cast("int").alias("rank"), F.col("place").alias("over"))
    sent = v.select("fact", F.inline(F.when(F.col("sup") != F.col("ver"), F.array(own, over)).otherwise(F.array(own))))
    return sent.groupBy("fact", "ver").agg(F.max("place").alias("place"), F.max("rank").alias("rank"), F.min("over").alias("low"), F.max("over").alias("high")).where("place is not null")


def _superseded_through_others(v: DataFrame) -> DataFrame:
    """Of versions at the same place, those that another one of it supersedes through versions at other places: fact, ver."""
    most = v.groupBy("fact").count().agg(F.max("count")).head()[0] or 0
    # Pointers stop at the first version of the place that they come from.
    node = v.where("sup is not null").select("fact", "place", "ver", F.col("sup").alias("ptr"))
    at = v.select("fact", F.col("ver").alias("ptr"), F.col("place").alias("there"), F.col("sup").alias("on"))
    out = None
    for _ in range(most):
        met = cut(node.join(at, ["fact", "ptr"]).where("ptr != ver"))
        hit = met.where("there = place").select("fact", F.col("ptr").alias("ver"))
        out = hit if out is None else out.unionByName(hit)
        node = met.where("there != place and on is not null").select("fact", "place", "ver", F.col("on").alias("ptr"))
        if not node.limit(1).count():
            break
    return out.distinct() if out is not None else v.select("fact", "ver").limit(0)


def current_versions(claims: DataFrame, fact: str = "fact_id", version: str = "claim_version_id", operation: str = "operation", supersedes: str = "supersedes_version_id", ordinal: str = "observed_ordinal", range_width: int = 64) -> DataFrame:
    """The current version of each fact of a change feed: columns ``fact`` and ``version``.

    Versions follow ``ordinal``; one without takes the place of the version it supersedes; at a place, a version
    comes after those it supersedes, directly or through others. A fact whose last version is a retract has no row.
    Repeated deliveries count once, with the smallest of what they say. Rows with a null fact or version are left out.
    Versions that share a place and have no supersession between them: an assert comes first, then the smaller version
    id. Where versions that supersede one another in a ring hold the last place, none is last and there is no row.

    The feed is read once. Each version becomes an operation on its fact at the position (place, not superseded there,
    not an assert, id): a retract deletes, and so does a version superseded at its place; all others insert. What is
    superseded from a later place can't be last and is left out. The operations are composed to patches over ranges of
    places, these to one patch per fact, and applied to an empty table.
    """
    rows = claims.select(F.col(fact).alias("fact"), F.col(version).alias("ver"), F.col(operation).alias("op"), F.col(supersedes).alias("sup"), F.col(ordinal).alias("ord")).where("fact is not null and ver is not null")
    v = _places(cut(_versions(rows)))
    back = F.coalesce(F.col("low") < F.col("place"), F.lit(False))
    beaten = F.coalesce(F.col("high") == F.col("place"), F.lit(False))
    marked = cut(_marked(v).select("fact", "ver", "place", "rank", beaten.alias("beaten"), back.alias("back"), "high").where("back or high is null or high <= place").drop("high"))
    # Only in a fact where one is superseded from an earlier place does a chain come back to a place it has left.
    odd = marked.where("back").select("fact").distinct()
    if marked.where("back").limit(1).count():
        more = _superseded_through_others(cut(v.join(odd, "fact", "left_semi"))).withColumn("more", F.lit(True))
        marked = marked.join(more, ["fact", "ver"], "left").withColumn("beaten", F.col("beaten") | F.col("more").isNotNull())
    position = F.struct("place", (~F.col("beaten")).alias("alone"), (F.col("rank") > 0).alias("later"), "ver")
    kind = F.when(F.col("beaten") | (F.col("rank") == 2), "delete").otherwise("insert")
    ops = marked.select("fact", position.alias("position"), kind.alias("kind"), "ver")
    patches = compose_patches(ops, ["fact"], "position", "kind", ["ver"], chunk=F.floor(F.col("position.place") / F.lit(range_width)))
    return apply_patches(None, patches, ["fact"], ["ver"]).select(F.col("fact").alias(fact), F.col("ver").alias(version))
