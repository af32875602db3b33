"""One ranking from scores on different scales: percentiles compared by leximin.

Each route's scores become percentiles within the query, so that only their order counts. An item's percentiles are
sorted ascending, 0 for a route that answered without it, and items compared by those arrays from the weakest up: a
single strong route cannot hide a weak one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagaspark.operators.ranks import running_share


def leximin(hits: DataFrame, query: str = "query_id", route: str = "route", item: str = "raw_chunk_id", score: str = "score", lists: DataFrame | None = None, ranks: str = "route_ranks") -> DataFrame:
    """Items of each query with ``score`` (their ascending percentiles) and ``route_ranks`` (1 is best).

    Repeated hits count once with their best score. A hit without a score (null or NaN) says nothing. A route that
    gave a query no score does not count for it. Equal scores share the better percentile. ``lists`` holds stored
    lists (query, item, map of route to rank); they stand in for routes of a query that ``hits`` lacks, by rank.
    Rows with a null query, route or item are left out.
    """
    h = hits.select(F.col(query).alias("q"), F.col(route).alias("r"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    h = h.where("q is not null and r is not null and i is not null and s is not null and not isnan(s)").groupBy("q", "r", "i").agg(F.max("s").alias("s"))
    if lists is not None:
        known = h.select("q", "r").distinct()
        stored = lists.select(F.col(query).alias("q"), F.col(item).alias("i"), F.explode(F.col(ranks)).alias("r", "n")).where("q is not null and r is not null and i is not null and n is not null")
        stored = stored.groupBy("q", "r", "i").agg(F.max(-F.col("n").cast("double")).alias("s"))
        h = h.unionByName(stored.join(known, ["q", "r"], "left_anti"))
    values = h.groupBy("q", "r", "s").agg(F.count("*").alias("n"))
    share = running_share(values, ["q", "r"], "s", "n")
    share = share.select("q", "r", "s", (F.col("upto") / F.col("total")).alias("p"), (F.col("total") - F.col("upto") + 1).cast("int").alias("rank"))
    routes = share.groupBy("q").agg(F.size(F.collect_set("r")).alias("routes"))
    items = h.join(share, ["q", "r", "s"]).groupBy("q", "i").agg(F.array_sort(F.collect_list("p")).alias("p"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "rank")))).alias("m"))
    items = items.join(routes, "q")
    vector = F.concat(F.array_repeat(F.lit(0.0), F.col("routes") - F.size("p")), F.col("p"))
    return items.select(F.col("q").alias(query), F.col("i").alias(item), vector.alias("score"), F.col("m").alias(ranks))


def top_items(ranked: DataFrame, k: int, query: str = "query_id", item: str = "raw_chunk_id", score: str = "score") -> DataFrame:
    """The first ``k`` items of each query with their ``place``; equal vectors go by item id. Each task keeps at most k per query."""
    first = Window.partitionBy(query).orderBy(F.desc(score), F.col(item))
    return ranked.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
