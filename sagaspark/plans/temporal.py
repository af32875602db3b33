"""Reading an append-only log of versions: visibility, the two time axes, and the current version.

Order matters: what restricts knowledge or world time goes before the newest version is picked, what restricts its
operation or status after. If the newest visible version is withdrawn or not supported, there is no current value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(log: DataFrame, runs: DataFrame, version: str = "claim_version_id", run: str = "created_by_run_id", seq: str = "write_seq") -> DataFrame:
    """Versions that some active run delivered, once each, as first delivered by one."""
    seen = log.join(runs.where("status = 'active'").select(F.col("run_id").alias(run)), run, "left_semi").where(F.col(version).isNotNull())
    rest = [c for c in log.columns if c not in (version, seq)]
    return seen.groupBy(version).agg(F.min(seq).alias(seq), F.min_by(F.struct(*rest), seq).alias("r")).select(version, seq, "r.*")


def known_by(cutoff: int | None, ordinal: str = "observed_ordinal") -> Column:
    """Disclosed at or before the cutoff; without a cutoff everything, rows without an ordinal included."""
    return F.lit(True) if cutoff is None else F.coalesce(F.col(ordinal) <= cutoff, F.lit(False))


def held_at(t: int | None) -> Column:
    """True at world time t: a closed interval in story time, from the start on for chapter proxies, never if unknown."""
    if t is None:
        return F.lit(True)
    kind, start, end = F.col("world_valid_kind"), F.col("world_valid_from"), F.col("world_valid_to")
    story = (kind == "story_time") & (start <= t) & (end.isNull() | (end >= t))
    return F.coalesce(story | ((kind == "chapter_proxy") & (start <= t)), F.lit(False))


def newest(df: DataFrame, keys: list[str], order: str = "write_seq") -> DataFrame:
    """Newest row per key. Each task keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def current(df: DataFrame, keys: list[str] = ["fact_id"], cutoff: int | None = None, world: int | None = None, order: str = "write_seq", any_status: bool = False) -> DataFrame:  # noqa: B006
    """Newest version per key among those known and held, if it is neither withdrawn nor unsupported."""
    top = newest(df.where(known_by(cutoff) & held_at(world)), keys, order).where("operation != 'retract'")
    return top if any_status else top.where("claim_status = 'supported'")


def timeline(df: DataFrame, cutoff: int | None = None, world: int | None = None) -> DataFrame:
    """All versions of each fact numbered in write order, withdrawn and unsupported ones included."""
    w = Window.partitionBy("fact_id").orderBy("write_seq")
    return df.where(known_by(cutoff) & held_at(world)).withColumn("version_no", F.row_number().over(w))


def project(df: DataFrame, column: str, resolutions: DataFrame) -> DataFrame:
    """Mentions replaced by what they were resolved to, others kept; ``resolutions``: mention_id, canonical_id."""
    r = resolutions.select(F.col("mention_id").alias(column), F.col("canonical_id").alias("__to"))
    return df.join(r, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def select_evidence(evidence: DataFrame, span: list[str], run: str = "verification_run_id") -> DataFrame:
    """Of each span the rows of the current run; where it has none, those of no run."""
    here = F.max(F.col(run).isNotNull()).over(Window.partitionBy(*span))
    return evidence.withColumn("__here", here).where(F.col(run).isNotNull() | ~F.col("__here")).drop("__here")


def stance_status(evidence: DataFrame, keys: list[str], stance: str = "stance") -> DataFrame:
    """Status of a claim from the set of its evidence's stances."""
    yes, no = F.bool_or(F.col(stance) == "supports"), F.bool_or(F.col(stance) == "refutes")
    s = evidence.groupBy(*keys).agg(F.coalesce(yes, F.lit(False)).alias("y"), F.coalesce(no, F.lit(False)).alias("n"))
    return s.select(*keys, F.when(F.col("y") & F.col("n"), "contested").when(F.col("y"), "supported").when(F.col("n"), "rejected").otherwise("unverified").alias("status"))
