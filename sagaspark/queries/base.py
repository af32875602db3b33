"""Model tables drawn from the given ones, as DataFrames and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaspark.plans import temporal as tm
from sagaspark.session import table

CUTOFF, WORLD = 60, 40

RUNS_SQL = "runs as (select run_id, case when right(run_id, 1) < 'a' then 'active' when right(run_id, 1) < 'd' then 'failed' else 'superseded' end as status from (select distinct created_by_run_id as run_id from claims where created_by_run_id is not null))"
VIS_SQL = RUNS_SQL + """,
vis as (select claim_version_id, min(c.write_seq) as write_seq, arg_min(c.fact_id, c.write_seq) as fact_id, arg_min(c.claim_type, c.write_seq) as claim_type, arg_min(c.operation, c.write_seq) as operation,
  arg_min(c.claim_status, c.write_seq) as claim_status, arg_min(struct_pack(v := c.observed_ordinal), c.write_seq).v as observed_ordinal, arg_min(c.world_valid_kind, c.write_seq) as world_valid_kind,
  arg_min(struct_pack(v := c.world_valid_from), c.write_seq).v as world_valid_from, arg_min(struct_pack(v := c.world_valid_to), c.write_seq).v as world_valid_to, arg_min(c.book_id, c.write_seq) as book_id,
  arg_min(struct_pack(v := c.participants), c.write_seq).v as participants, arg_min(struct_pack(v := c.confidence), c.write_seq).v as confidence, arg_min(struct_pack(v := c.supersedes_version_id), c.write_seq).v as supersedes_version_id,
  arg_min(c.created_by_run_id, c.write_seq) as created_by_run_id, arg_min(struct_pack(v := c.observed_chapter_id), c.write_seq).v as observed_chapter_id
  from claims c join runs on runs.run_id = c.created_by_run_id and status = 'active' where claim_version_id is not null group by 1)"""
KNOWN = f"observed_ordinal <= {CUTOFF}"
HELD = f"((world_valid_kind = 'story_time' and world_valid_from <= {WORLD} and (world_valid_to is null or world_valid_to >= {WORLD})) or (world_valid_kind = 'chapter_proxy' and world_valid_from <= {WORLD}))"
PAY_SQL = "pay as (select distinct claim_version_id, field, value, subject_entity_id, target_entity_id from state_payloads)"
RES_SQL = "res as (select canonical_id as mention_id, first_value(canonical_id) over (partition by book_id, lower(canonical_name) order by canonical_id) as canonical_id from entity_records)"


def current_sql(where: str = "true", name: str = "cur", key: str = "fact_id", source: str = "vis") -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by {key} order by write_seq desc) as rn from {source} where {where}) where rn = 1 and operation <> 'retract' and claim_status = 'supported')"


def runs(spark, d):
    last = F.substring("run_id", -1, 1)
    r = table(spark, d, "claims").select(F.col("created_by_run_id").alias("run_id")).where("run_id is not null").distinct()
    return r.withColumn("status", F.when(last < "a", "active").when(last < "d", "failed").otherwise("superseded"))


COLS = ["claim_version_id", "write_seq", "fact_id", "claim_type", "operation", "claim_status", "observed_ordinal", "world_valid_kind", "world_valid_from", "world_valid_to", "book_id", "participants", "confidence", "supersedes_version_id", "created_by_run_id", "observed_chapter_id"]


def vis(spark, d):
    return tm.visible(table(spark, d, "claims").select(*COLS), runs(spark, d))


def pay(spark, d):
    return table(spark, d, "state_payloads").select("claim_version_id", "field", "value", "subject_entity_id", "target_entity_id").distinct()


def resolutions(spark, d):
    """Records of a book with the same name resolve to the first of them."""
    from pyspark.sql import Window

    w = Window.partitionBy("book_id", F.lower("canonical_name")).orderBy("canonical_id")
    return table(spark, d, "entity_records").select(F.col("canonical_id").alias("mention_id"), F.first("canonical_id").over(w).alias("canonical_id"))


class Queries:
    """Collects queries with their SQL."""

    def __init__(self):
        self.QUERIES, self.ORACLE = {}, {}

    def __call__(self, sql: str | None = None):
        def keep(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLE[f.__name__] = sql
            return f

        return keep
