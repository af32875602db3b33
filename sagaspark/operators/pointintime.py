"""Attributes as they were known at the time of an event.

A validity interval is cut into dyadic nodes of the time axis (at most two per level); an event falls into one
node of every level. The join is then a plain equi-join on (entity, node) in which every pair that meets is a
true match in time: an event time lies in exactly one node of an interval's decomposition. A node keeps only what can
still win there, so that an entity of very many states meets its events with few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enclosing_nodes(t: Column, low: int, levels: int) -> Column:
    """Heap numbers of the nodes of all levels that hold point ``t``."""
    leaf = F.lit(1 << levels) + t.cast("long") - F.lit(low)
    return F.array(*(F.shiftright(leaf, k) for k in range(levels + 1)))


def covering_nodes(start: Column, end: Column, low: int, levels: int) -> Column:
    """Heap numbers of the disjoint dyadic nodes that make up the half-open range [start, end)."""
    a, b = start.cast("long") - F.lit(low), end.cast("long") - F.lit(low)
    nodes = []
    for k in range(levels + 1):
        lo = F.shiftright(a + F.lit((1 << k) - 1), k)
        hi = F.shiftright(b, k)
        base = F.lit(1 << (levels - k))
        nodes.append(F.when((lo < hi) & (lo % 2 == 1), base + lo))
        nodes.append(F.when((lo < hi) & (hi % 2 == 1), base + hi - 1))
    return F.filter(F.array(*nodes), lambda x: x.isNotNull())


def attributes_at_events(events: DataFrame, states: DataFrame) -> DataFrame:
    """For each event and attribute of its entity, the version that held and was known then.

    ``events``: event, entity, at, known (both int). ``states``: version, entity, field, start (int), until (first
    point at which it no longer holds; null is open), seen (int), gone (the point of knowledge at which it was
    withdrawn; null never). A state is taken if start <= at < until, seen <= known and gone > known. Of several the
    one that starts last, then the one seen last, then the larger version id. Rows with a null in event, entity,
    at, known, version, field, start or seen take no part. Returns event, entity, field, version; no row where
    nothing qualifies. Repeated input rows change nothing. Ids are told apart by 64-bit digests on the way.
    """
    e = events.select("event", "entity", F.col("at").cast("long").alias("at"), F.col("known").cast("long").alias("known")).dropna()
    s = states.select("version", "entity", "field", F.col("start").cast("long").alias("start"), F.col("until").cast("long").alias("until"), F.col("seen").cast("long").alias("seen"), F.col("gone").cast("long").alias("gone"))
    s = s.dropna(subset=["version", "entity", "field", "start", "seen"])
    low, high = e.agg(F.min("at"), F.max("at")).head()
    if low is None:
        return e.join(s, "entity").select("event", "entity", "field", "version").limit(0)
    levels = max(1, (high - low + 1).bit_length())
    # Only the part of an interval that lies among the events' times can match.
    top = F.lit(high + 1)
    s = s.withColumn("start_", F.greatest("start", F.lit(low))).withColumn("end_", F.least(F.coalesce("until", top), top)).where("start_ < end_ and (gone is null or gone > seen)")
    # Digests of ids go through the shuffles; the ids come back at the end.
    s = s.select(F.xxhash64("entity").alias("who"), F.explode(covering_nodes(F.col("start_"), F.col("end_"), low, levels)).alias("node"), "field", "seen", "gone", "start", "version")
    # Of what became known at one point and was withdrawn at one, only the best can win in a node; nor can what is worse
    # than something known no later and never withdrawn. What is left of a node depends on the points of knowledge, not
    # on the number of states. One exchange on (who, node) serves the aggregation, the window and the join.
    s = s.repartition("who", "node").groupBy("who", "node", "field", "seen", "gone").agg(F.max(F.struct("start", "version")).alias("s"))
    s = s.withColumn("s", F.struct("s.start", "seen", "s.version"))
    before = Window.partitionBy("who", "node", "field").orderBy("seen").rangeBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("lasting", F.max(F.when(F.col("gone").isNull(), F.col("s"))).over(before)).where("lasting is null or lasting <= s").drop("lasting")
    ids = e.select(F.xxhash64("event", "entity").alias("id"), "event", "entity", "at", "known")
    points = ids.select("id", F.xxhash64("entity").alias("who"), F.explode(enclosing_nodes(F.col("at"), low, levels)).alias("node"), "known")
    met = points.join(s, ["who", "node"]).where("seen <= known and (gone is null or gone > known)")
    best = met.groupBy("id", "field").agg(F.max("s").alias("s"))
    return best.join(ids.select("id", "event", "entity").distinct(), "id").select("event", "entity", "field", F.col("s.version").alias("version"))


def usable_states(claims: DataFrame, payloads: DataFrame) -> DataFrame:
    """State versions that say something: type state, not a retract, with a start, a value and no target.

    Repeated deliveries give one row. Columns version, start, until, seen, withdrawn (whether any retract names it), gone
    (the least ordinal of one that does), entity, field, value. Both tables are read once.
    """
    is_gone = F.coalesce((F.col("operation") == "retract") & F.col("supersedes_version_id").isNotNull(), F.lit(False))
    is_state = F.coalesce((F.col("claim_type") == "state") & (F.col("operation") != "retract") & F.col("world_valid_from").isNotNull() & F.col("claim_version_id").isNotNull(), F.lit(False))
    until = F.when((F.col("world_valid_kind") == "story_time") & F.col("world_valid_to").isNotNull(), F.col("world_valid_to") + 1)
    c = claims.where(is_state | is_gone).select(
        F.when(is_gone, F.col("supersedes_version_id")).otherwise(F.col("claim_version_id")).alias("version"), is_gone.alias("withdrawn"), F.when(is_gone, F.col("observed_ordinal")).alias("gone"),
        F.when(is_state, F.col("world_valid_from")).alias("start"), F.when(is_state, until).alias("until"), F.when(is_state, F.col("observed_ordinal")).alias("seen"),
    )
    c = c.groupBy("version").agg(F.max("start").alias("start"), F.max("until").alias("until"), F.min("seen").alias("seen"), F.max("withdrawn").alias("withdrawn"), F.min("gone").alias("gone")).where("start is not null")
    p = payloads.where("value is not null and target_entity_id is null and subject_entity_id is not null and field is not null")
    p = p.select(F.col("claim_version_id").alias("version"), F.col("subject_entity_id").alias("entity"), "field", "value")
    return c.join(p, "version").groupBy("version", "entity", "field").agg(*(F.first(x).alias(x) for x in ("start", "until", "seen", "withdrawn", "gone")), F.max("value").alias("value"))


def states_at_events(claims: DataFrame, payloads: DataFrame) -> DataFrame:
    """Event claims with, for each participant, the state versions that held and were known (see attributes_at_events)."""
    states = usable_states(claims, payloads).where("seen is not null")
    ev = claims.where("claim_type = 'event' and operation != 'retract' and world_valid_from is not null and observed_ordinal is not null")
    ev = ev.select(F.col("claim_version_id").alias("event"), F.explode(F.array_distinct("participants")).alias("entity"), F.col("world_valid_from").alias("at"), F.col("observed_ordinal").alias("known")).distinct()
    return attributes_at_events(ev, states)
