"""Bounded path search over links between events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paths(starts: DataFrame, edges: DataFrame, depth: int = 5, reverse: bool = False) -> DataFrame:
    """Simple paths of up to ``depth`` edges from each start: start, node, hops, confidence (product), path (a>b>c).

    ``starts``: event. ``edges``: source, target, confidence. A node already on the path is not entered again. One
    row for each prefix. The number of steps is fixed, so the plan is a union of joins and needs no iteration.
    """
    e = edges.select("source", "target", F.col("confidence").alias("c"))
    if reverse:
        e = e.select(F.col("target").alias("source"), F.col("source").alias("target"), "c")
    front = starts.select(F.col("event").alias("start"), F.col("event").alias("node"), F.array("event").alias("seen"), F.lit(1.0).alias("confidence"))
    out = None
    for hop in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("source")).where(~F.array_contains("seen", F.col("target")))
        front = step.select("start", F.col("target").alias("node"), F.concat("seen", F.array("target")).alias("seen"), (F.col("confidence") * F.col("c")).alias("confidence"))
        rows = front.select("start", "node", F.lit(hop).alias("hops"), "confidence", F.array_join(F.transform("seen", lambda x: x.cast("string")), "<" if reverse else ">").alias("path"))
        out = rows if out is None else out.unionByName(rows)
    return out


def candidates(events: DataFrame, gap: int = 100) -> DataFrame:
    """Pairs of events that share a participant, the second later by at most ``gap``; same place counts as causes.

    ``events``: fact, who (array), place, ord. One row per pair of facts: the first by (source ord, target ord).
    Time is cut into bands of the gap, so that a participant of very many events meets only two bands at a time.
    """
    x = events.select("fact", "place", "ord", F.explode(F.array_distinct("who")).alias("p")).where("ord is not null")
    a = x.select("p", F.col("fact").alias("source"), F.col("place").alias("pa"), F.col("ord").alias("oa"), F.floor(F.col("ord") / gap).alias("band"))
    b = x.select("p", F.col("fact").alias("target"), F.col("place").alias("pb"), F.col("ord").alias("ob"), F.explode(F.array(F.floor(F.col("ord") / gap), F.floor(F.col("ord") / gap) - 1)).alias("band"))
    m = a.join(b, ["p", "band"]).where(f"ob > oa and ob - oa <= {gap} and source != target")
    same = F.bool_or(F.col("pa") == F.col("pb"))
    g = m.groupBy("source", "target").agg(F.coalesce(same, F.lit(False)).alias("same"), F.min(F.col("ob") - F.col("oa")).alias("gap"))
    return g.select("source", "target", F.when(F.col("same"), "causes").otherwise("enables").alias("relation_type"), F.when(F.col("same"), 0.8).otherwise(0.6).alias("confidence"), "gap")
