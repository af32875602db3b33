"""Queries of the general training-data operators, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaspark.operators import changefeed, history, pointintime
from sagaspark.session import table


def p2_found(spark, d):
    return changefeed.current_versions(table(spark, d, "claims"))


def p2_patches(spark, d):
    """Rebuild each fact's confidence and status from the feed as field-wise patches, in order of arrival."""
    c = table(spark, d, "claims")
    kind = F.when(F.col("operation") == "retract", "delete").when(F.col("operation") == "assert", "insert").otherwise("update")
    ops = c.select("fact_id", "write_seq", kind.alias("kind"), "confidence", "claim_status")
    patches = changefeed.compose_patches(ops, ["fact_id"], "write_seq", "kind", ["confidence", "claim_status"])
    return changefeed.apply_patches(None, patches, ["fact_id"], ["confidence", "claim_status"])


def p3_found(spark, d):
    out = pointintime.states_at_events(table(spark, d, "claims"), table(spark, d, "state_payloads"))
    return out.select(F.col("event").alias("event_version_id"), F.col("entity").alias("entity_id"), "field", F.col("version").alias("state_version_id"))


def p5_found(spark, d):
    return history.state_history(table(spark, d, "claims"), table(spark, d, "state_payloads")).drop("value")


def p5_snapshots(spark, d):
    """Keys whose value differs between the snapshots of the first and of all usable state versions, by hash-tree comparison."""
    s = pointintime.usable_states(table(spark, d, "claims"), table(spark, d, "state_payloads"))
    first = s.groupBy("entity", "field").agg(F.min_by("value", F.struct("start", "version")).alias("value"))
    last = s.groupBy("entity", "field").agg(F.max_by("value", F.struct("start", "version")).alias("value"))
    return history.merkle_diff(first, last, ["entity", "field"], ["value"])


QUERIES = {f.__name__: f for f in (p2_found, p2_patches, p3_found, p5_found, p5_snapshots)}

_USABLE = """
usable as (
  select claim_version_id as v, subject_entity_id as e, field as f, max(value) as val, max(wf) as s, max(wt) as u, min(o) as o
  from (select distinct claim_version_id, world_valid_from as wf, case when world_valid_kind = 'story_time' then world_valid_to end as wt, observed_ordinal as o
        from claims where claim_type = 'state' and operation <> 'retract' and world_valid_from is not null)
  join (select distinct claim_version_id, subject_entity_id, field, value from state_payloads where value is not null and target_entity_id is null and subject_entity_id is not null and field is not null) using (claim_version_id)
  group by 1, 2, 3)
"""

ORACLE = {
    "p2_found": """
with recursive v as (
  select fact_id as f, claim_version_id as v, min(operation) as op, min(supersedes_version_id) as s, min(observed_ordinal) as o from claims where fact_id is not null and claim_version_id is not null group by 1, 2),
up as (
  select f, v, o, s, 0 as hops from v
  union all
  select up.f, up.v, w.o, w.s, up.hops + 1 from up join v w on w.f = up.f and w.v = up.s where up.o is null and up.hops < 200),
placed as (select v.f, v.v, v.op, v.s, coalesce(p.o, -1099511627776) as p from v left join (select f, v, max(o) as o from up group by 1, 2) p on p.f = v.f and p.v = v.v),
lastp as (select f, max(p) as p from placed group by 1),
cand as (select placed.* from placed join lastp using (f, p)),
anc as (
  select f, v, s as a, 1 as hops from cand where s is not null
  union all
  select anc.f, anc.v, w.s, anc.hops + 1 from anc join v w on w.f = anc.f and w.v = anc.a where w.s is not null and anc.hops < 200),
beaten as (select distinct c.f, c.v from cand c join anc on anc.f = c.f and anc.a = c.v and anc.v <> c.v),
won as (select cand.*, row_number() over (partition by f order by (op <> 'assert') desc, v desc) as rn from cand where not exists (select 1 from beaten b where b.f = cand.f and b.v = cand.v))
select f as fact_id, v as claim_version_id from won where rn = 1 and (op is null or op <> 'retract')
""",
    "p2_patches": """
with o as (select fact_id, write_seq, operation, confidence, claim_status from claims where fact_id is not null and write_seq is not null),
r as (select fact_id, max(write_seq) as pos, arg_max(operation, write_seq) as kind from o where operation in ('assert', 'retract') group by 1),
x as (select o.*, r.pos, r.kind from o left join r using (fact_id)),
y as (select fact_id, any_value(kind) as kind,
  max(write_seq) filter (where pos is null or write_seq > pos) as later,
  arg_max(confidence, write_seq) filter (where operation = 'update' and (pos is null or write_seq > pos) and confidence is not null) as uc,
  arg_max(claim_status, write_seq) filter (where operation = 'update' and (pos is null or write_seq > pos) and claim_status is not null) as us,
  any_value(confidence) filter (where write_seq = pos and operation = 'assert') as ic,
  any_value(claim_status) filter (where write_seq = pos and operation = 'assert') as i_s,
  count(*) filter (where operation = 'update' and (pos is null or write_seq > pos) and (confidence is not null or claim_status is not null)) as n
  from x group by 1)
select fact_id, coalesce(uc, ic) as confidence, coalesce(us, i_s) as claim_status from y where kind is null or kind = 'assert' or n > 0
""",
    "p3_found": f"""
with {_USABLE.strip()},
gone as (select supersedes_version_id as v, min(observed_ordinal) as g from claims where operation = 'retract' and supersedes_version_id is not null and observed_ordinal is not null group by 1),
ev as (select distinct claim_version_id as ev, unnest(participants) as e, world_valid_from as t, observed_ordinal as k from claims where claim_type = 'event' and operation <> 'retract' and world_valid_from is not null and observed_ordinal is not null),
m as (select ev.ev, ev.e, u.f, u.v, row_number() over (partition by ev.ev, ev.e, u.f order by u.s desc, u.o desc, u.v desc) as rn
  from ev join usable u on u.e = ev.e and u.s <= ev.t and (u.u is null or u.u >= ev.t) and u.o <= ev.k left join gone on gone.v = u.v where gone.g is null or gone.g > ev.k)
select ev as event_version_id, e as entity_id, f as field, v as state_version_id from m where rn = 1
""",
    "p5_found": f"""
with {_USABLE.strip()},
live as (select * from usable where v not in (select supersedes_version_id from claims where operation = 'retract' and supersedes_version_id is not null)),
one as (select * from (select *, row_number() over (partition by e, f, s order by o desc nulls last, v desc) as rn from live) where rn = 1),
chg as (select * from (select *, lag(val) over (partition by e, f order by s) as b from one) where b is null or b <> val)
select e as subject_entity_id, f as field, s as valid_from, cast(coalesce(lead(s) over (partition by e, f order by s), -1) as integer) as valid_to from chg
""",
    "p5_snapshots": f"""
with {_USABLE.strip()},
a as (select e, f, first(val order by s, v) as x, last(val order by s, v) as y from usable group by 1, 2)
select e as entity, f as field, 'changed' as change, y as value from a where x <> y
""",
}
