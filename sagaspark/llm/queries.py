"""Queries of the operators on text and scores, with the SQL they are held against where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sagaspark.llm import leakage, names, packing, ranking, skeleton, spam, splitting
from sagaspark.session import table


def p1_found(spark, d):
    return names.linked_pairs(names.linked_records(table(spark, d, "entity_records"), table(spark, d, "alias_claims")))


def p4_found(spark, d):
    out = splitting.split_oversized(table(spark, d, "raw_chunks"), table(spark, d, "chunk_configs"))
    return out.where("oversized").select("raw_chunk_id").distinct()


def p4_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "raw_chunks"), table(spark, d, "chunk_configs")).drop("content")


def p6_found(spark, d):
    parts = [("chapters", ["book_id", "ordinal"], "chapter_id", "title"), ("alias_claims", ["canonical_id"], "claim_version_id", "surface_name"), ("raw_chunks", ["source_chapter_id"], "raw_chunk_id", "content")]
    found = [skeleton.look_alike_pairs(table(spark, d, t), g, k, x).select(F.lit(t).alias("table_name"), "key_a", "key_b") for t, g, k, x in parts]
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def p7_ranking(spark, d):
    ranked = ranking.leximin(table(spark, d, "search_hits"), lists=table(spark, d, "fused_ranks"))
    return ranked.withColumn("score", F.transform("score", lambda x: F.round(x, 6))).withColumn("route_ranks", F.array_join(F.transform(F.array_sort(F.map_entries("route_ranks")), lambda e: F.concat(e.key, F.lit("="), e.value)), ","))


def p7_found(spark, d):
    ranked = ranking.leximin(table(spark, d, "search_hits"), lists=table(spark, d, "fused_ranks"))
    return ranking.top_items(ranked, 5).select("query_id", "raw_chunk_id")


def p8_pack(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_fill(spark, d):
    """Containers, tokens and share of space used of each spec."""
    packed = packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_specs"))
    boxes = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t"))
    spec = table(spark, d, "pack_specs")
    return boxes.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens")).join(spec, "spec_id").select("spec_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used"))


def p8_whole(spark, d):
    """What must come out whole: per spec the documents and characters packed, cut pieces, and containers beyond the capacity."""
    packed = packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_specs"))
    over = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t")).join(F.broadcast(table(spark, d, "pack_specs").dropDuplicates(["spec_id"])), "spec_id").where("t > capacity_tokens").groupBy("spec_id").agg(F.count("*").alias("over"))
    whole = packed.groupBy("spec_id").agg(F.countDistinct("doc_id").alias("documents"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    return whole.join(over, "spec_id", "left").select("spec_id", "documents", "chars", F.coalesce("over", F.lit(0)).alias("over"))


def p4_covered(spark, d):
    """Of each chunk: characters covered by its pieces without a gap, and whether all pieces keep the limit."""
    out = splitting.split_oversized(table(spark, d, "raw_chunks"), table(spark, d, "chunk_configs"))
    cfg = F.broadcast(table(spark, d, "chunk_configs").select("chunking_version", "target_tokens"))
    p = out.join(cfg, "chunking_version").select("raw_chunk_id", "token_start", "token_end", "target_tokens").distinct()
    size = F.col("token_end") - F.col("token_start")
    return p.groupBy("raw_chunk_id").agg((F.max("token_end") - F.min("token_start")).cast("long").alias("covered"), F.bool_and(size <= F.col("target_tokens")).alias("within"))


def p9_found(spark, d):
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark, d):
    return spam.spam_documents(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_pieces, p6_found, p7_found, p7_ranking, p8_pack, p8_fill, p8_whole, p4_covered, p9_found, p10_found)}

_SHARES = """
h as (select query_id as q, route as r, raw_chunk_id as i, max(score) as s from search_hits where score is not null and not isnan(score) and query_id is not null and route is not null and raw_chunk_id is not null group by 1, 2, 3),
p as (select q, r, i, cume_dist() over (partition by q, r order by s) as p, rank() over (partition by q, r order by s desc) as rk from h),
routes as (select q, count(distinct r) as n from h group by 1),
items as (select q, i, list_concat(list_transform(range(any_value(n) - count(*)), lambda x: 0.0), list_sort(list(p.p))) as v, list(r || '=' || rk order by r) as m from p join routes using (q) group by 1, 2)
"""

ORACLE = {
    "p4_found": "select distinct raw_chunk_id from raw_chunks join chunk_configs using (chunking_version) where length(content) > target_tokens",
    "p4_covered": "select raw_chunk_id, max(length(content)) as covered, true as within from raw_chunks join chunk_configs using (chunking_version) where content is not null group by 1",
    "p8_whole": "select spec_id, count(*) as documents, sum(length(text))::bigint as chars, 0 as over from (select distinct spec_id from pack_specs) cross join documents where text is not null group by 1",
    "p7_ranking": f"with {_SHARES.strip()} select q as query_id, i as raw_chunk_id, list_transform(v, lambda x: round(x, 6)) as score, array_to_string(m, ',') as route_ranks from items",
    "p7_found": f"with {_SHARES.strip()} select q as query_id, i as raw_chunk_id from (select *, row_number() over (partition by q order by v desc, i) as rn from items) where rn <= 5",
}
