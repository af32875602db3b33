"""Queries over the claim log: predicates, joins, current versions, graph and time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sagaspark.plans import graph, temporal as tm
from sagaspark.queries.base import CUTOFF, HELD, KNOWN, PAY_SQL, RES_SQL, RUNS_SQL, VIS_SQL, WORLD, Queries, current_sql, pay, resolutions, runs, vis
from sagaspark.session import table

q = Queries()

V = f"with {VIS_SQL}"
COUNT = "count(*) as n"


@q(f"{V} select claim_version_id, fact_id, write_seq, book_id from vis")
def op_b1_visible_claims(spark, d):
    return vis(spark, d).select("claim_version_id", "fact_id", "write_seq", "book_id")


@q(f"{V} select claim_version_id, observed_ordinal from vis where {KNOWN}")
def op_b2_knowledge_cutoff(spark, d):
    return vis(spark, d).where(tm.known_by(CUTOFF)).select("claim_version_id", "observed_ordinal")


@q(f"{V} select claim_version_id, world_valid_kind from vis where {HELD}")
def op_b3_world_time(spark, d):
    return vis(spark, d).where(tm.held_at(WORLD)).select("claim_version_id", "world_valid_kind")


@q(f"{V} select world_valid_kind, count(*) as n_all, count(*) filter (where {HELD}) as n_held from vis group by 1")
def op_b4_unknown_world_guard(spark, d):
    return vis(spark, d).groupBy("world_valid_kind").agg(F.count("*").alias("n_all"), F.count(F.when(tm.held_at(WORLD), 1)).alias("n_held"))


@q(f"{V}, {current_sql()} select fact_id, claim_version_id from cur")
def op_b5_current_facts(spark, d):
    return tm.current(vis(spark, d)).select("fact_id", "claim_version_id")


_SCOPE = "scope as (select book_id, canonical_id as entity from entity_records where importance_score >= 90)"


@q(f"{V}, {PAY_SQL}, {_SCOPE} select distinct vis.claim_version_id from vis join pay using (claim_version_id) where subject_entity_id in (select entity from scope)")
def op_b6_entity_scope(spark, d):
    scope = table(spark, d, "entity_records").where("importance_score >= 90").select(F.col("canonical_id").alias("subject_entity_id"))
    return vis(spark, d).join(pay(spark, d).join(scope, "subject_entity_id", "left_semi").select("claim_version_id"), "claim_version_id", "left_semi").select("claim_version_id")


@q(f"{V}, {current_sql()} select book_id, count(distinct fact_id) as facts, count(*) as n from cur group by 1")
def op_b7_book_isolation(spark, d):
    return tm.current(vis(spark, d)).groupBy("book_id").agg(F.countDistinct("fact_id").alias("facts"), F.count("*").alias("n"))


@q(f"select distinct canonical_id, surface_name from alias_claims where lower(surface_name) like '%falcon%' and observed_ordinal <= {CUTOFF} and operation <> 'retract'")
def op_b8_name_search(spark, d):
    return table(spark, d, "alias_claims").where(F.lower("surface_name").contains("falcon") & tm.known_by(CUTOFF) & (F.col("operation") != "retract")).select("canonical_id", "surface_name").distinct()


@q(f"with {PAY_SQL}, {RES_SQL} select claim_version_id, field, coalesce(res.canonical_id, subject_entity_id) as subject_entity_id from pay left join res on res.mention_id = subject_entity_id")
def op_b9_projection(spark, d):
    return tm.project(pay(spark, d), "subject_entity_id", resolutions(spark, d)).select("claim_version_id", "field", "subject_entity_id")


@q(f"""{V}, {PAY_SQL} select claim_version_id, claim_type, case when field is not null then field || '=' || coalesce(value, '') when len(participants) > 0 then 'who=' || array_to_string(list_sort(list_distinct(participants)), ',') else '{{}}' end as payload
from vis left join pay using (claim_version_id)""")
def op_b10_payload_union(spark, d):
    who = F.concat(F.lit("who="), F.array_join(F.array_sort(F.array_distinct("participants")), ","))
    j = vis(spark, d).join(pay(spark, d), "claim_version_id", "left")
    return j.select("claim_version_id", "claim_type", F.when(F.col("field").isNotNull(), F.concat("field", F.lit("="), F.coalesce("value", F.lit("")))).when(F.size("participants") > 0, who).otherwise("{}").alias("payload"))


_EVID = "ev as (select query_id as claim, raw_chunk_id as span, route, case route when 'fts' then 'supports' when 'vector' then 'supports' when 'structured' then 'refutes' else 'unclear' end as stance, route = 'fts' as direct, case when route in ('fts', 'structured') then 'run_now' end as verification_run_id from search_hits where score is not null group by all)"


def evidence(spark, d):
    s = table(spark, d, "search_hits").where("score is not null").select(F.col("query_id").alias("claim"), F.col("raw_chunk_id").alias("span"), "route").distinct()
    stance = F.when(F.col("route").isin("fts", "vector"), "supports").when(F.col("route") == "structured", "refutes").otherwise("unclear")
    return s.withColumns({"stance": stance, "direct": F.col("route") == "fts", "verification_run_id": F.when(F.col("route").isin("fts", "structured"), F.lit("run_now"))})


_SEL = "sel as (select * from ev where verification_run_id is not null or not exists (select 1 from ev e where e.claim = ev.claim and e.span = ev.span and e.verification_run_id is not null))"


@q(f"with {_EVID}, {_SEL} select claim, span, route from sel")
def op_b11_evidence_selector(spark, d):
    return tm.select_evidence(evidence(spark, d), ["claim", "span"]).select("claim", "span", "route")


_SHOWN = f"shown as (select canonical_id, arg_max(surface_name, struct_pack(a := observed_ordinal, b := claim_version_id)) as shown from alias_claims where observed_ordinal <= {CUTOFF} and operation <> 'retract' and surface_name is not null group by 1)"


def shown(spark, d):
    a = table(spark, d, "alias_claims").where(tm.known_by(CUTOFF) & (F.col("operation") != "retract") & F.col("surface_name").isNotNull())
    return a.groupBy("canonical_id").agg(F.max_by("surface_name", F.struct("observed_ordinal", "claim_version_id")).alias("shown"))


@q(f"with {_SHOWN} select canonical_id, coalesce(shown, canonical_name) as catalog_name, coalesce(shown, canonical_id) as detail_name from entity_records left join shown using (canonical_id)")
def op_b12_name_masking(spark, d):
    return table(spark, d, "entity_records").join(shown(spark, d), "canonical_id", "left").select("canonical_id", F.coalesce("shown", "canonical_name").alias("catalog_name"), F.coalesce("shown", "canonical_id").alias("detail_name"))


_NODES = "nodes as (select * from (select canonical_id, book_id, importance_score, row_number() over (partition by book_id order by importance_score desc nulls last, canonical_id) as rn from entity_records) where rn <= 80)"


def nodes(spark, d, k=80):
    w = Window.partitionBy("book_id").orderBy(F.desc_nulls_last("importance_score"), "canonical_id")
    return table(spark, d, "entity_records").select("canonical_id", "book_id", "importance_score", F.row_number().over(w).alias("rn")).where(F.col("rn") <= k)


@q(f"with {_NODES} select book_id, canonical_id from nodes where importance_score >= 50")
def op_b13_importance_after_limit(spark, d):
    return nodes(spark, d).where("importance_score >= 50").select("book_id", "canonical_id")


_EDGE = "select book_id, fact_id, subject_entity_id as a, target_entity_id as b, value as relation from cur join pay using (claim_version_id) where field = 'stance' and target_entity_id is not null"


def edges(spark, d, **kw):
    p = pay(spark, d).where("field = 'stance' and target_entity_id is not null")
    return tm.current(vis(spark, d), **kw).join(p, "claim_version_id").select("book_id", "fact_id", F.col("subject_entity_id").alias("a"), F.col("target_entity_id").alias("b"), F.col("value").alias("relation"))


@q(f"{V}, {PAY_SQL}, {current_sql()}, {_NODES}, e as ({_EDGE}) select fact_id, a, b from e where a in (select canonical_id from nodes) and b in (select canonical_id from nodes)")
def op_b14_dangling_edges(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).select("fact_id", "a", "b")
    return e.join(n.select(F.col("canonical_id").alias("a")), "a", "left_semi").join(n.select(F.col("canonical_id").alias("b")), "b", "left_semi")


@q("select chapter_id from chapters where char_end - char_start >= 50 and title is not null and not regexp_matches(title, '目录|contents')")
def op_b15_real_chapters(spark, d):
    return table(spark, d, "chapters").where("char_end - char_start >= 50 and title is not null").where(~F.col("title").rlike("目录|contents")).select("chapter_id")


@q(f"with {RUNS_SQL} select status, count(*) as n, count(distinct claim_version_id) as versions from claims join runs on run_id = created_by_run_id group by 1")
def op_c1_claims_runs(spark, d):
    c = table(spark, d, "claims").select(F.col("created_by_run_id").alias("run_id"), "claim_version_id")
    return c.join(runs(spark, d), "run_id").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("claim_version_id").alias("versions"))


@q(f"{V}, {PAY_SQL} select claim_version_id, field, value from vis join pay using (claim_version_id) where claim_type = 'state'")
def op_c2_typed_child(spark, d):
    return vis(spark, d).where("claim_type = 'state'").join(pay(spark, d), "claim_version_id").select("claim_version_id", "field", "value")


@q(f"with {_EVID} select i.item_id, count(span) as n from eval_items i left join ev on ev.claim = i.item_id and ev.verification_run_id = 'run_now' group by 1")
def op_c4_condition_in_join(spark, d):
    e = evidence(spark, d)
    i = table(spark, d, "eval_items").select("item_id")
    return i.join(e, (F.col("claim") == F.col("item_id")) & (F.col("verification_run_id") == "run_now"), "left").groupBy("item_id").agg(F.count("span").alias("n"))


@q("select canonical_id from entity_records e where exists (select 1 from alias_claims a where a.canonical_id = e.canonical_id and a.observed_ordinal <= 60)")
def op_c5_semi(spark, d):
    return table(spark, d, "entity_records").select("canonical_id").join(table(spark, d, "alias_claims").where(tm.known_by(CUTOFF)).select("canonical_id"), "canonical_id", "left_semi")


@q("select distinct claim_version_id from claims c where claim_type = 'state' and not exists (select 1 from state_payloads p where p.claim_version_id = c.claim_version_id)")
def op_c6_anti(spark, d):
    c = table(spark, d, "claims").where("claim_type = 'state'").select("claim_version_id").distinct()
    return c.join(table(spark, d, "state_payloads").select("claim_version_id"), "claim_version_id", "left_anti")


@q(f"with {_SHOWN} select e.canonical_id, shown, (select count(distinct surface_name) from alias_claims a where a.canonical_id = e.canonical_id) as aliases from entity_records e left join shown using (canonical_id)")
def op_c7_scalar_subqueries(spark, d):
    n = table(spark, d, "alias_claims").groupBy("canonical_id").agg(F.countDistinct("surface_name").alias("aliases"))
    return table(spark, d, "entity_records").select("canonical_id").join(shown(spark, d), "canonical_id", "left").join(n, "canonical_id", "left").fillna(0, ["aliases"])


@q(f"{V} select fact_id, claim_version_id from vis v where claim_type = 'event' and write_seq = (select max(write_seq) from vis w where w.fact_id = v.fact_id)")
def op_c8_newest_version(spark, d):
    return tm.newest(vis(spark, d), ["fact_id"]).where("claim_type = 'event'").select("fact_id", "claim_version_id")


@q(f"{V}, {PAY_SQL}, {current_sql()}, {_SCOPE}, e as ({_EDGE}) select fact_id from e where a in (select entity from scope) or b in (select entity from scope)")
def op_c9_either_end(spark, d):
    scope = table(spark, d, "entity_records").where("importance_score >= 90").select(F.col("canonical_id").alias("x"))
    e = edges(spark, d).select("fact_id", F.explode(F.array("a", "b")).alias("x"))
    return e.join(scope, "x", "left_semi").select("fact_id").distinct()


@q(f"{V}, {PAY_SQL}, {current_sql()}, e as ({_EDGE}) select least(a, b) as x, greatest(a, b) as y, count(*) as n, count(distinct relation) as kinds from e group by 1, 2")
def op_c10_endpoint_pairs(spark, d):
    return edges(spark, d).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("n"), F.countDistinct("relation").alias("kinds"))


@q("""with c as (select book_id, ordinal, chapter_id, volume_title, volume_ordinal from chapters where ordinal is not null),
v as (select book_id, volume_ordinal, min(ordinal) as s from c where volume_ordinal is not null group by 1, 2)
select chapter_id, (select max(s) from v where v.book_id = c.book_id and v.s <= c.ordinal) as volume_start from c""")
def op_c12_last_volume_start(spark, d):
    c = table(spark, d, "chapters").where("ordinal is not null")
    w = Window.partitionBy("book_id").orderBy("ordinal")
    starts = c.where("volume_ordinal is not null").groupBy("book_id", "volume_ordinal").agg(F.min("ordinal").alias("s")).select("book_id", F.col("s").alias("ordinal"), F.lit(None).cast("string").alias("chapter_id"), "s")
    both = c.select("book_id", "ordinal", "chapter_id", F.lit(None).cast("int").alias("s")).unionByName(starts)
    return both.withColumn("volume_start", F.max("s").over(w)).where("chapter_id is not null").select("chapter_id", "volume_start")


@q("""with v as (select book_id, volume_ordinal, min(ordinal) as lo, max(ordinal) as hi from chapters where volume_ordinal is not null group by 1, 2)
select book_id, volume_ordinal, count(c.chapter_id) as n from v join chapters c using (book_id) where c.ordinal between lo and hi group by 1, v.volume_ordinal""".replace("select book_id, volume_ordinal, count", "select book_id, v.volume_ordinal as volume_ordinal, count"))
def op_c13_range_membership(spark, d):
    c = table(spark, d, "chapters")
    v = c.where("volume_ordinal is not null").groupBy("book_id", "volume_ordinal").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    return v.join(c.select("book_id", "ordinal", "chapter_id"), "book_id").where("ordinal between lo and hi").groupBy("book_id", "volume_ordinal").agg(F.count("chapter_id").alias("n"))


@q(f"""{V}, o as (select * from (select *, row_number() over (partition by e.org, e.member order by event_id desc) as rn from (select event_id, user_id % 10 as org, user_id as member, event_type from events) e) where rn = 1 and event_type <> 'error')
select org, member from o""".replace(V + ",", "with"))
def op_e3_membership_fold(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("org"), F.col("user_id").alias("member"), "event_type")
    return tm.newest(e, ["org", "member"], "event_id").where("event_type != 'error'").select("org", "member")


@q(f"""with a as (select canonical_id, count(distinct surface_name) as aliases from alias_claims group by 1), m as (select subject_entity_id as canonical_id, count(*) as mentions from state_payloads group by 1)
select canonical_id, rn from (select canonical_id, row_number() over (order by importance_score desc nulls last, coalesce(mentions, 0) desc, coalesce(aliases, 0) desc, canonical_id) as rn from entity_records left join a using (canonical_id) left join m using (canonical_id)) where rn > 20 and rn <= 70""")
def op_f1_catalog_page(spark, d):
    a = table(spark, d, "alias_claims").groupBy("canonical_id").agg(F.countDistinct("surface_name").alias("aliases"))
    m = table(spark, d, "state_payloads").groupBy(F.col("subject_entity_id").alias("canonical_id")).agg(F.count("*").alias("mentions"))
    e = table(spark, d, "entity_records").join(a, "canonical_id", "left").join(m, "canonical_id", "left").fillna(0, ["aliases", "mentions"])
    page = e.orderBy(F.desc_nulls_last("importance_score"), F.desc("mentions"), F.desc("aliases"), "canonical_id").offset(20).limit(50)
    w = Window.orderBy(F.desc_nulls_last("importance_score"), F.desc("mentions"), F.desc("aliases"), "canonical_id")
    return page.select("canonical_id", (F.row_number().over(w) + 20).alias("rn"))


@q(f"{V}, {current_sql()} select claim_version_id, book_id from (select *, row_number() over (partition by book_id order by observed_ordinal nulls first, write_seq) as k from cur where claim_type = 'event') where k <= 30")
def op_f2_event_timeline(spark, d):
    w = Window.partitionBy("book_id").orderBy(F.asc_nulls_first("observed_ordinal"), "write_seq")
    return tm.current(vis(spark, d)).where("claim_type = 'event'").withColumn("k", F.row_number().over(w)).where("k <= 30").select("claim_version_id", "book_id")


@q(f"with {_SHOWN} select * from shown")
def op_f3_latest_alias(spark, d):
    return shown(spark, d)


@q("select canonical_id, surface_name from (select canonical_id, surface_name, row_number() over (partition by canonical_id order by length(surface_name) desc, surface_name) as rn from alias_claims where surface_name is not null) where rn = 1")
def op_f8_longest_name(spark, d):
    w = Window.partitionBy("canonical_id").orderBy(F.length("surface_name").desc(), "surface_name")
    return table(spark, d, "alias_claims").where("surface_name is not null").select("canonical_id", "surface_name", F.row_number().over(w).alias("rn")).where("rn = 1").drop("rn")


@q("select canonical_id, surface_name, claim_version_id from (select *, row_number() over (partition by canonical_id, surface_name order by observed_ordinal nulls last, claim_version_id, created_by_run_id) as rn from alias_claims) where rn = 1")
def op_f9_keep_first(spark, d):
    w = Window.partitionBy("canonical_id", "surface_name").orderBy(F.asc_nulls_last("observed_ordinal"), "claim_version_id", "created_by_run_id")
    return table(spark, d, "alias_claims").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("canonical_id", "surface_name", "claim_version_id")


@q(f"with {PAY_SQL}, {RES_SQL} select canonical_id as entity from res union select subject_entity_id from pay where subject_entity_id not in (select mention_id from res)")
def op_g1_visible_entities(spark, d):
    r = resolutions(spark, d)
    loose = pay(spark, d).select(F.col("subject_entity_id").alias("mention_id")).join(r, "mention_id", "left_anti").select(F.col("mention_id").alias("entity"))
    return r.select(F.col("canonical_id").alias("entity")).union(loose).distinct()


@q("select canonical_id, canonical_name as name from entity_records union select canonical_id, surface_name from alias_claims")
def op_g2_name_sources(spark, d):
    return table(spark, d, "entity_records").select("canonical_id", F.col("canonical_name").alias("name")).union(table(spark, d, "alias_claims").select("canonical_id", "surface_name")).distinct()


@q("""with a as (select distinct canonical_id from alias_claims), s as (select distinct subject_entity_id as canonical_id from state_payloads)
select 'both' as part, count(*) as n from a join s using (canonical_id) union all select 'aliases only', count(*) from a where canonical_id not in (select canonical_id from s) union all select 'states only', count(*) from s where canonical_id not in (select canonical_id from a)""")
def op_g4_set_overlap(spark, d):
    a = table(spark, d, "alias_claims").select("canonical_id").distinct().withColumn("a", F.lit(1))
    s = table(spark, d, "state_payloads").select(F.col("subject_entity_id").alias("canonical_id")).distinct().withColumn("s", F.lit(1))
    part = F.when(F.col("a").isNull(), "states only").when(F.col("s").isNull(), "aliases only").otherwise("both")
    counted = a.join(s, "canonical_id", "full").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([("both",), ("aliases only",), ("states only",)], "part string").join(counted, "part", "left").fillna(0, ["n"])


_LINKS = """ev2 as (select event_id, user_id, ts from events),
links as (select event_id as source, lead(event_id, 1) over w as t1, lead(event_id, 2) over w as t2 from ev2 window w as (partition by user_id order by ts, event_id)),
edges as (select source, t1 as target, 0.5 + (source % 50) / 100.0 as confidence, case when source // 7 % 3 = 0 then 'causes' when source // 7 % 3 = 1 then 'enables' else 'prevents' end as kind from links where t1 is not null
  union all select source, t2, 0.4 + (source % 30) / 100.0, 'enables' from links where t2 is not null and source % 4 = 0),
starts as (select event_id as event from events where event_type = 'error')"""


def event_links(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_id").alias("source"), F.lead("event_id", 1).over(w).alias("t1"), F.lead("event_id", 2).over(w).alias("t2"))
    k = F.floor(F.col("source") / 7) % 3
    one = e.where("t1 is not null").select("source", F.col("t1").alias("target"), (0.5 + (F.col("source") % 50) / 100.0).alias("confidence"), F.when(k == 0, "causes").when(k == 1, "enables").otherwise("prevents").alias("kind"))
    two = e.where("t2 is not null and source % 4 = 0").select("source", F.col("t2").alias("target"), (0.4 + (F.col("source") % 30) / 100.0).alias("confidence"), F.lit("enables").alias("kind"))
    return one.unionByName(two)


def error_events(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("event"))


@q(f"""with recursive {_LINKS},
p as (select event as start, event as node, [event] as seen, 1.0::double as confidence, 0 as hops from starts
 union all select p.start, e.target, list_append(p.seen, e.target), p.confidence * e.confidence, p.hops + 1 from p join edges e on e.source = p.node where e.kind <> 'prevents' and p.hops < 5 and not list_contains(p.seen, e.target))
select start, node, hops, round(confidence, 6) as confidence, array_to_string(seen, '>') as path from p where hops > 0""")
def op_h1_causal_paths(spark, d):
    e = event_links(spark, d).where("kind != 'prevents'")
    return graph.paths(error_events(spark, d), e).withColumn("confidence", F.round("confidence", 6))


@q(f"""with recursive {_LINKS},
p as (select event as start, event as node, [event] as seen, 1.0::double as confidence, 0 as hops from starts
 union all select p.start, e.source, list_append(p.seen, e.source), p.confidence * e.confidence, p.hops + 1 from p join edges e on e.target = p.node where e.kind = 'causes' and p.hops < 5 and not list_contains(p.seen, e.source))
select start, node, hops, round(confidence, 6) as confidence, array_to_string(seen, '<') as path from p where hops > 0""")
def op_h2_causal_results(spark, d):
    e = event_links(spark, d).where("kind = 'causes'")
    return graph.paths(error_events(spark, d), e, reverse=True).withColumn("confidence", F.round("confidence", 6))


@q(f"""with {_LINKS} select e.source, e.target, json_extract_string(a.props, '$.k')::int as k_source, json_extract_string(b.props, '$.k')::int as k_target from edges e join events a on a.event_id = e.source join events b on b.event_id = e.target where e.kind = 'causes'""")
def op_h3_edge_evidence(spark, d):
    ev = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = event_links(spark, d).where("kind = 'causes'")
    return e.join(ev.select(F.col("event_id").alias("source"), F.col("k").alias("k_source")), "source").join(ev.select(F.col("event_id").alias("target"), F.col("k").alias("k_target")), "target").select("source", "target", "k_source", "k_target")


@q(f"{V}, {PAY_SQL}, {current_sql(KNOWN)} select fact_id, subject_entity_id, field, value from cur join pay using (claim_version_id) where claim_type = 'state'")
def op_h4_entity_state(spark, d):
    return tm.current(vis(spark, d), cutoff=CUTOFF).where("claim_type = 'state'").join(pay(spark, d), "claim_version_id").select("fact_id", "subject_entity_id", "field", "value")


@q(f"{V}, {PAY_SQL}, {current_sql()} select subject_entity_id, arg_max(value, write_seq) as value from cur join pay using (claim_version_id) where field = 'location' and value is not null group by 1")
def op_h5_current_state(spark, d):
    return tm.current(vis(spark, d)).join(pay(spark, d).where("field = 'location' and value is not null"), "claim_version_id").groupBy("subject_entity_id").agg(F.max_by("value", "write_seq").alias("value"))


@q(f"{V}, {PAY_SQL}, {current_sql(f'{KNOWN} and {HELD}')} select fact_id, subject_entity_id, field, value from cur join pay using (claim_version_id)")
def op_h6_world_state(spark, d):
    return tm.current(vis(spark, d), cutoff=CUTOFF, world=WORLD).join(pay(spark, d), "claim_version_id").select("fact_id", "subject_entity_id", "field", "value")


@q(f"{V}, {current_sql(HELD)} select fact_id, claim_version_id from cur where claim_type = 'org'")
def op_h7_org_state(spark, d):
    return tm.current(vis(spark, d), world=WORLD).where("claim_type = 'org'").select("fact_id", "claim_version_id")


@q(f"{V}, {PAY_SQL}, {current_sql(KNOWN)}, e as ({_EDGE}) select a as entity, b as other, fact_id, relation from e union select b, a, fact_id, relation from e")
def op_h8_one_hop(spark, d):
    e = edges(spark, d, cutoff=CUTOFF)
    return e.select(F.col("a").alias("entity"), F.col("b").alias("other"), "fact_id", "relation").union(e.select("b", "a", "fact_id", "relation")).distinct()


@q(f"{V}, {PAY_SQL}, {current_sql(f'{KNOWN} and {HELD}')}, e as ({_EDGE}) select distinct least(a, b) as x, greatest(a, b) as y, fact_id from e")
def op_h9_relation_between(spark, d):
    return edges(spark, d, cutoff=CUTOFF, world=WORLD).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "fact_id").distinct()


@q(f"{V} select fact_id, claim_version_id, row_number() over (partition by fact_id order by write_seq) as version_no from vis where claim_type = 'relation'")
def op_h10_relation_evolution(spark, d):
    return tm.timeline(vis(spark, d).where("claim_type = 'relation'")).select("fact_id", "claim_version_id", "version_no")


@q(f"{V}, {PAY_SQL} select distinct e as entity, fact_id from (select unnest([subject_entity_id, target_entity_id]) as e, fact_id from vis join pay using (claim_version_id) where field = 'stance') where e is not null")
def op_h11_relation_facts(spark, d):
    j = vis(spark, d).join(pay(spark, d).where("field = 'stance'"), "claim_version_id")
    return j.select(F.explode(F.array("subject_entity_id", "target_entity_id")).alias("entity"), "fact_id").where("entity is not null").distinct()


@q(f"{V} select fact_id, claim_version_id, operation, row_number() over (partition by fact_id order by write_seq) as version_no from vis where {KNOWN}")
def op_h12_claim_history(spark, d):
    return tm.timeline(vis(spark, d), cutoff=CUTOFF).select("fact_id", "claim_version_id", "operation", "version_no")


@q(f"{V} select claim_version_id from vis where claim_type = 'event' and operation <> 'retract' and claim_status = 'supported' and observed_ordinal = {WORLD} and len(participants) > 0")
def op_h14_world_events(spark, d):
    return vis(spark, d).where(f"claim_type = 'event' and operation != 'retract' and claim_status = 'supported' and observed_ordinal = {WORLD} and size(participants) > 0").select("claim_version_id")


@q(f"{V}, {current_sql(f'{KNOWN} and {HELD}')} select claim_version_id from cur where claim_type = 'event'")
def op_h15_all_events(spark, d):
    return tm.current(vis(spark, d), cutoff=CUTOFF, world=WORLD).where("claim_type = 'event'").select("claim_version_id")


@q(f"{V}, {current_sql(KNOWN)} select distinct unnest(participants) as entity, claim_version_id from cur where claim_type = 'event'")
def op_h16_entity_events(spark, d):
    return tm.current(vis(spark, d), cutoff=CUTOFF).where("claim_type = 'event'").select(F.explode("participants").alias("entity"), "claim_version_id").distinct()


@q(f"{V}, {current_sql()}, p as (select distinct claim_version_id, unnest(participants) as entity from cur where claim_type = 'event') select p.*, canonical_name from p join entity_records on canonical_id = entity")
def op_h17_event_participants(spark, d):
    p = tm.current(vis(spark, d)).where("claim_type = 'event'").select("claim_version_id", F.explode("participants").alias("entity")).distinct()
    return p.join(table(spark, d, "entity_records").select(F.col("canonical_id").alias("entity"), "canonical_name"), "entity")


@q(f"{V}, {current_sql(KNOWN)} select fact_id, claim_version_id from cur where claim_type = 'term_definition'")
def op_h18_term_definition(spark, d):
    return tm.current(vis(spark, d), cutoff=CUTOFF).where("claim_type = 'term_definition'").select("fact_id", "claim_version_id")


@q(f"""{V}, c as (select * from (select *, row_number() over (partition by fact_id, observed_ordinal order by write_seq desc) as rn from vis where observed_ordinal is not null) where rn = 1 and operation <> 'retract' and claim_status = 'supported')
select book_id, observed_ordinal, claim_type, count(*) as n from c group by 1, 2, 3""")
def op_h19_chapter_graph(spark, d):
    c = tm.current(vis(spark, d).where("observed_ordinal is not null"), ["fact_id", "observed_ordinal"])
    return c.groupBy("book_id", "observed_ordinal", "claim_type").agg(F.count("*").alias("n"))


@q(f"""{V}, {PAY_SQL}, {current_sql(KNOWN)}, {_SHOWN}, s as (select subject_entity_id as canonical_id, count(*) as states from cur join pay using (claim_version_id) group by 1),
e as (select canonical_id, count(*) as events from (select distinct unnest(participants) as canonical_id, claim_version_id from cur where claim_type = 'event') group by 1)
select canonical_id, shown, coalesce(states, 0) as states, coalesce(events, 0) as events from entity_records left join shown using (canonical_id) left join s using (canonical_id) left join e using (canonical_id)""")
def op_h20_entity_snapshot(spark, d):
    c = tm.current(vis(spark, d), cutoff=CUTOFF)
    s = c.join(pay(spark, d), "claim_version_id").groupBy(F.col("subject_entity_id").alias("canonical_id")).agg(F.count("*").alias("states"))
    e = c.where("claim_type = 'event'").select(F.explode("participants").alias("canonical_id"), "claim_version_id").distinct().groupBy("canonical_id").agg(F.count("*").alias("events"))
    r = table(spark, d, "entity_records").select("canonical_id")
    return r.join(shown(spark, d), "canonical_id", "left").join(s, "canonical_id", "left").join(e, "canonical_id", "left").fillna(0, ["states", "events"])


@q(f"with {_EVID}, {_SEL} select claim, min(span) as span from sel group by 1")
def op_h21_chapter_citation(spark, d):
    return tm.select_evidence(evidence(spark, d), ["claim", "span"]).groupBy("claim").agg(F.min("span").alias("span"))


@q(f"with {_SHOWN} select canonical_id, coalesce(shown, canonical_id) as display_name from entity_records left join shown using (canonical_id)")
def op_h22_display_name(spark, d):
    return table(spark, d, "entity_records").select("canonical_id").join(shown(spark, d), "canonical_id", "left").select("canonical_id", F.coalesce("shown", "canonical_id").alias("display_name"))


@q("""with a as (select canonical_id, count(distinct surface_name) as aliases from alias_claims group by 1), m as (select subject_entity_id as canonical_id, count(*) as mentions from state_payloads group by 1)
select book_id, canonical_id, coalesce(aliases, 0) as aliases, coalesce(mentions, 0) as mentions from entity_records left join a using (canonical_id) left join m using (canonical_id)""")
def op_h23_entity_catalog(spark, d):
    a = table(spark, d, "alias_claims").groupBy("canonical_id").agg(F.countDistinct("surface_name").alias("aliases"))
    m = table(spark, d, "state_payloads").groupBy(F.col("subject_entity_id").alias("canonical_id")).agg(F.count("*").alias("mentions"))
    return table(spark, d, "entity_records").select("book_id", "canonical_id").join(a, "canonical_id", "left").join(m, "canonical_id", "left").fillna(0, ["aliases", "mentions"])


@q(f"{V}, {PAY_SQL}, {RES_SQL}, {current_sql(KNOWN)}, {_NODES}, e as ({_EDGE}), j as (select fact_id, coalesce(r.canonical_id, a) as a, coalesce(s.canonical_id, b) as b, relation from e left join res r on r.mention_id = a left join res s on s.mention_id = b) select * from j where a in (select canonical_id from nodes) and b in (select canonical_id from nodes)")
def op_h25_graph_data(spark, d):
    r, n = resolutions(spark, d), nodes(spark, d)
    e = edges(spark, d, cutoff=CUTOFF).select("fact_id", "a", "b", "relation")
    e = tm.project(tm.project(e, "a", r), "b", r)
    return e.join(n.select(F.col("canonical_id").alias("a")), "a", "left_semi").join(n.select(F.col("canonical_id").alias("b")), "b", "left_semi").select("fact_id", "a", "b", "relation")


@q("select raw_chunk_id, substring(content, 11, 20) as span_text, sha256(substring(content, 11, 20)) as span_hash from (select distinct raw_chunk_id, content from raw_chunks where content is not null)")
def op_h26_span_text(spark, d):
    c = table(spark, d, "raw_chunks").where("content is not null").select("raw_chunk_id", "content").distinct()
    s = F.substring("content", 11, 20)
    return c.select("raw_chunk_id", s.alias("span_text"), F.sha2(s, 256).alias("span_hash"))


@q(f"{V} select fact_id, arg_max(claim_version_id, write_seq) as claim_version_id from vis group by 1")
def op_h27_current_version(spark, d):
    return vis(spark, d).groupBy("fact_id").agg(F.max_by("claim_version_id", "write_seq").alias("claim_version_id"))


@q("select distinct subject_entity_id as entity, exists (select 1 from entity_records where canonical_id = subject_entity_id) as known from state_payloads where subject_entity_id is not null")
def op_h28_entity_probe(spark, d):
    s = table(spark, d, "state_payloads").select(F.col("subject_entity_id").alias("entity")).where("entity is not null").distinct()
    e = table(spark, d, "entity_records").select(F.col("canonical_id").alias("entity"), F.lit(True).alias("known")).distinct()
    return s.join(e, "entity", "left").fillna(False, ["known"])


QUERIES, ORACLE = q.QUERIES, q.ORACLE
