"""Streams: the current view of an append-only log, exactly-once processing by key, and a sliding-window limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_latest(batch: DataFrame, view: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """The view after a micro-batch: the newest row per key of both. Replaying a batch changes nothing."""
    both = batch if view is None else view.unionByName(batch)
    rest = [c for c in batch.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])).alias("r")).select(*keys, "r.*")


def run_view(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Keep the current view of a log under ``path``; each batch writes a new version and the last one is the view."""
    from pathlib import PurePosixPath

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = str(PurePosixPath(path) / f"v{epoch - 1:09}")
        try:
            view = spark.read.parquet(last) if epoch else None
        except Exception:  # noqa: BLE001 - no version before this one
            view = None
        upsert_latest(batch, view, keys, order).write.mode("overwrite").parquet(str(PurePosixPath(path) / f"v{epoch:09}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Rows of a stream without repeats of ``keys`` that arrive ``within`` the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, late: str, size: str, key: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))


def allow(times: list[float], per: float, most: int) -> list[bool]:
    """Which calls a limiter lets through: at most ``most`` in any ``per`` seconds; refused calls don't count."""
    kept: deque[float] = deque()
    out = []
    for t in times:
        while kept and kept[0] <= t - per:
            kept.popleft()
        ok = len(kept) < most
        if ok:
            kept.append(t)
        out.append(ok)
    return out


def rate_limited(calls: DataFrame, key: str, time: str, call: str, per: float = 60.0, most: int = 60) -> DataFrame:
    """``allowed`` for each call of a key, in order of time. Sequential by nature: calls of a key are sorted and streamed
    through one task in batches, with only the last ``most`` times held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, deque()
        for f in frames:
            flags = []
            for k, t in zip(f["k"], f["t"]):
                if k != now:
                    now, kept = k, deque()
                while kept and kept[0] <= t - per:
                    kept.popleft()
                ok = len(kept) < most
                if ok:
                    kept.append(t)
                flags.append(ok)
            yield pd.DataFrame({"k": f["k"], "c": f["c"], "allowed": flags})

    rows = calls.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("u"), F.col(call).alias("c")).withColumn("t", F.col("u") / 1e6).dropna()
    d = dict(rows.dtypes)
    out = rows.repartition("k").sortWithinPartitions("k", "t", "c").mapInPandas(run, f"k {d['k']}, c {d['c']}, allowed boolean")
    return out.withColumnsRenamed({"k": key, "c": call})
