"""Aggregation, resolution, linking, versioned writes, runs, summaries, evaluation and operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sagaspark.functions import hashing
from sagaspark.plans import graph, temporal as tm
from sagaspark.queries.base import KNOWN, CUTOFF, PAY_SQL, RUNS_SQL, VIS_SQL, Queries, current_sql, pay, runs, vis
from sagaspark.queries.knowledge import _EVID, _SEL, evidence
from sagaspark.session import table

q = Queries()
V = f"with {VIS_SQL}"


@q("select user_id as run, count(*) as calls, coalesce(sum(k) filter (where event_type = 'view'), 0) as input_units, coalesce(sum(k) filter (where event_type = 'click'), 0) as output_units, coalesce(sum(k) filter (where event_type = 'purchase'), 0) as cached_units, coalesce(sum(k) filter (where event_type = 'error'), 0) as retry_units, coalesce(sum(k) filter (where event_type not in ('view', 'click', 'purchase', 'error')), 0) as other_units, coalesce(sum(k) filter (where event_type <> 'error'), 0) as total from (select *, json_extract_string(props, '$.k')::int as k from events) group by 1")
def op_d1_ledger_totals(spark, d):
    """Six sums per run; what was spent on retries is not in the total."""
    k = F.get_json_object("props", "$.k").cast("int")
    part = lambda c: F.coalesce(F.sum(F.when(c, k)), F.lit(0).cast("long"))
    kinds = {"input_units": "view", "output_units": "click", "cached_units": "purchase", "retry_units": "error"}
    other = ~F.col("event_type").isin(*kinds.values())
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("calls"), *(part(F.col("event_type") == t).alias(n) for n, t in kinds.items()), part(other).alias("other_units"), part(F.col("event_type") != "error").alias("total"))


@q("select event_type as stage, count(*) as calls, round(avg(value), 4) as mean_value, round(max(value), 4) as most from events group by 1")
def op_d2_ledger_by_stage(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.max("value"), 4).alias("most"))


@q("select canonical_id, count(distinct name) as names from (select canonical_id, surface_name as name from alias_claims union select canonical_id, canonical_name from entity_records) group by 1")
def op_d3_alias_count(spark, d):
    a = table(spark, d, "alias_claims").select("canonical_id", F.col("surface_name").alias("name"))
    return a.union(table(spark, d, "entity_records").select("canonical_id", "canonical_name")).groupBy("canonical_id").agg(F.countDistinct("name").alias("names"))


@q("select subject_entity_id as entity, count(*) as mentions from state_payloads group by 1")
def op_d4_mention_count(spark, d):
    return table(spark, d, "state_payloads").groupBy(F.col("subject_entity_id").alias("entity")).agg(F.count("*").alias("mentions"))


@q(f"with {RUNS_SQL} select status, count(*) as n from runs group by 1")
def op_d5_status_histogram(spark, d):
    return runs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@q("select claim_type, count(*) as claims, sum(coalesce(json_array_length(to_json(participants)), 0))::bigint as participants from claims group by 1")
def op_d6_length_sums(spark, d):
    """Sums of the lengths of JSON arrays, as drafts keep them."""
    c = table(spark, d, "claims").select("claim_type", F.json_array_length(F.to_json("participants")).alias("n"))
    return c.groupBy("claim_type").agg(F.count("*").alias("claims"), F.sum(F.coalesce("n", F.lit(0)).cast("long")).alias("participants"))


_ISSUES = "select claim_version_id, unnest(list_filter([case when observed_ordinal is null then 'no_ordinal' end, case when world_valid_kind = 'unknown' then 'no_time' end, case when supersedes_version_id is null and operation <> 'assert' then 'no_predecessor' end, case when claim_type = 'event' and coalesce(len(participants), 0) = 0 then 'no_participant' end], lambda x: x is not null)) as code from (select distinct claim_version_id, observed_ordinal, world_valid_kind, supersedes_version_id, operation, claim_type, participants from claims)"


def issues(spark, d):
    c = table(spark, d, "claims").select("claim_version_id", "observed_ordinal", "world_valid_kind", "supersedes_version_id", "operation", "claim_type", "participants").distinct()
    codes = F.array(
        F.when(F.col("observed_ordinal").isNull(), "no_ordinal"), F.when(F.col("world_valid_kind") == "unknown", "no_time"),
        F.when(F.col("supersedes_version_id").isNull() & (F.col("operation") != "assert"), "no_predecessor"), F.when((F.col("claim_type") == "event") & (F.coalesce(F.size("participants"), F.lit(0)) <= 0), "no_participant"),
    )
    return c.select("claim_version_id", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))


@q(f"select code, count(*) as n from ({_ISSUES}) group by 1")
def op_d7_issues_by_code(spark, d):
    return issues(spark, d).groupBy("code").agg(F.count("*").alias("n"))


@q(_ISSUES)
def op_j8_draft_validation(spark, d):
    return issues(spark, d)


@q(f"with {_EVID}, {_SEL} select claim, span, case when bool_or(stance = 'supports') and bool_or(stance = 'refutes') then 'contested' when bool_or(stance = 'supports') then 'supported' when bool_or(stance = 'refutes') then 'rejected' else 'unverified' end as status from sel group by 1, 2")
def op_d8_stance_status(spark, d):
    return tm.stance_status(tm.select_evidence(evidence(spark, d), ["claim", "span"]), ["claim", "span"])


@q(f"with {_EVID}, {_SEL} select claim, span from (select claim, span, row_number() over (partition by claim order by not direct, span, route) as rn from sel where stance = 'supports') where rn = 1")
def op_d9_primary_evidence(spark, d):
    w = Window.partitionBy("claim").orderBy(~F.col("direct"), "span", "route")
    return tm.select_evidence(evidence(spark, d), ["claim", "span"]).where("stance = 'supports'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("claim", "span")


@q("select surface_name, min(observed_ordinal) as first_disclosed from alias_claims group by 1")
def op_d10_first_disclosure(spark, d):
    return table(spark, d, "alias_claims").groupBy("surface_name").agg(F.min("observed_ordinal").alias("first_disclosed"))


@q("select book_id, max(volume_ordinal) as newest, count(distinct volume_ordinal) as versions from chapters group by 1")
def op_d11_newest_grouping(spark, d):
    return table(spark, d, "chapters").groupBy("book_id").agg(F.max("volume_ordinal").alias("newest"), F.countDistinct("volume_ordinal").alias("versions"))


@q("select claim_version_id, count(*) as n from claims group by 1 having count(*) > 1")
def op_d12_duplicates(spark, d):
    return table(spark, d, "claims").groupBy("claim_version_id").agg(F.count("*").alias("n")).where("n > 1")


@q(f"{V}, {current_sql()} select claim_type, count(*) as history, (select count(*) from cur where cur.claim_type = vis.claim_type) as active from vis group by 1")
def op_d13_active_and_history(spark, d):
    v = vis(spark, d)
    a = tm.current(v).groupBy("claim_type").agg(F.count("*").alias("active"))
    return v.groupBy("claim_type").agg(F.count("*").alias("history")).join(a, "claim_type", "left").fillna(0, ["active"])


@q("select route, count(*) as hits, count(distinct query_id) as queries, round(avg(score), 4) as mean_score from search_hits group by 1")
def op_d14_route_statistics(spark, d):
    return table(spark, d, "search_hits").groupBy("route").agg(F.count("*").alias("hits"), F.countDistinct("query_id").alias("queries"), F.round(F.avg("score"), 4).alias("mean_score"))


@q("select e.event_type as stage, round(sum(e.value) * 10000.0 / (select sum(n_chars) from documents), 6) as per_10k_chars from events e group by 1")
def op_d15_usage_per_corpus(spark, d):
    chars = table(spark, d, "documents").agg(F.sum("n_chars").alias("c"))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("v")).crossJoin(F.broadcast(chars)).select("stage", F.round(F.col("v") * 10000.0 / F.col("c"), 6).alias("per_10k_chars"))


@q("select user_id as run, round(sum(case event_type when 'view' then 0.15 when 'purchase' then 0.015 when 'click' then 0.60 else 0 end * json_extract_string(props, '$.k')::int)::double / 1000000, 9) as cost from events group by 1")
def op_d16_nominal_cost(spark, d):
    # Prices in USD per million units of input, cached input and output.
    price = F.when(F.col("event_type") == "view", 0.15).when(F.col("event_type") == "purchase", 0.015).when(F.col("event_type") == "click", 0.60).otherwise(0.0)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.round(F.sum(price * F.get_json_object("props", "$.k").cast("int")) / 1000000, 9).alias("cost"))


@q(f"{V}, {current_sql()} select book_id, observed_ordinal, array_to_string(list(claim_version_id order by claim_version_id), ',') as versions, count(*) as n from cur where observed_ordinal is not null group by 1, 2")
def op_d17_chapter_memory(spark, d):
    c = tm.current(vis(spark, d)).where("observed_ordinal is not null")
    return c.groupBy("book_id", "observed_ordinal").agg(F.array_join(F.array_sort(F.collect_list("claim_version_id")), ",").alias("versions"), F.count("*").alias("n"))


@q("select route, score as p95 from (select route, score, row_number() over (partition by route order by score) - 1 as i, count(*) over (partition by route) as n from search_hits where score is not null) where i = floor(n * 0.95)")
def op_d18_percentile(spark, d):
    # By index int(n * p): ranks by ranges, so that no task sorts a whole route.
    from sagaspark.operators.ranks import running_share

    h = table(spark, d, "search_hits").where("score is not null and not isnan(score)").groupBy("route", "score").agg(F.count("*").alias("c"))
    s = running_share(h, ["route"], "score", "c")
    return s.where("upto - c <= floor(total * 0.95) and upto > floor(total * 0.95)").select("route", F.col("score").alias("p95"))


# ---- entity resolution
@q("select lower(regexp_replace(surface_name, '\\s+', '', 'g')) as surface, count(distinct canonical_id) as records from alias_claims where surface_name is not null group by 1")
def op_k1_surface_normalise(spark, d):
    s = F.lower(F.regexp_replace("surface_name", r"[ \t\n\r\f\x0B]+", ""))
    return table(spark, d, "alias_claims").where("surface_name is not null").groupBy(s.alias("surface")).agg(F.countDistinct("canonical_id").alias("records"))


#: Words for anybody, which name nobody.
GENERIC = "男子 中年男子 少年 少女 青年 老人 长老 掌门 弟子 母亲 父亲 姐姐 哥哥 妹妹 弟弟 众人 围观者 镇上人 同门弟子".split()
_GEN = ", ".join(f"'{g}'" for g in GENERIC)


@q(f"select surface_name, count(distinct canonical_id) as records, case when regexp_replace(surface_name, '[\\s\u3000]+', '', 'g') in ({_GEN}) then 'generic' else 'name' end as reason from alias_claims where surface_name is not null group by surface_name")
def op_k2_generic_names(spark, d):
    """Every disclosed name and whether it names nobody in particular."""
    bare = F.regexp_replace("surface_name", r"[\s\u3000]+", "")
    return table(spark, d, "alias_claims").where("surface_name is not null").groupBy("surface_name").agg(F.countDistinct("canonical_id").alias("records")).withColumn("reason", F.when(bare.isin(GENERIC), "generic").otherwise("name"))


@q("with s as (select surface_name, min(canonical_id) as seed from alias_claims where operation <> 'retract' group by 1) select canonical_id, seed from entity_records join s on surface_name = canonical_name")
def op_k3_seed_alias(spark, d):
    s = table(spark, d, "alias_claims").where("operation != 'retract'").groupBy(F.col("surface_name").alias("canonical_name")).agg(F.min("canonical_id").alias("seed"))
    return table(spark, d, "entity_records").join(s, "canonical_name").select("canonical_id", "seed")


_K4 = """m as (select a.surface_name as s, e.book_id, a.observed_ordinal as o from alias_claims a join entity_records e using (canonical_id) where a.surface_name is not null),
c as (select s, book_id, o, count(*) as n from m group by 1, 2, 3),
g as (select s, book_id, count(o) as chapters, max(case when o is not null then n end) as most, max(o) - min(o) + 1 as span, bool_or(o is null) as open from c group by 1, 2)
select s as surface_name, book_id, case when chapters <= 1 then 'same' when most >= 2 then 'same' when not open and span = chapters then 'same' else 'ambiguous-name-no-continuity' end as verdict from g"""


@q(f"with {_K4}")
def op_k4_continuity(spark, d):
    e = table(spark, d, "entity_records").select("canonical_id", "book_id")
    m = table(spark, d, "alias_claims").where("surface_name is not null").select("canonical_id", "surface_name", F.col("observed_ordinal").alias("o")).join(e, "canonical_id")
    c = m.groupBy("surface_name", "book_id", "o").agg(F.count("*").alias("n"))
    g = c.groupBy("surface_name", "book_id").agg(F.count("o").alias("chapters"), F.max(F.when(F.col("o").isNotNull(), F.col("n"))).alias("most"), (F.max("o") - F.min("o") + 1).alias("span"), F.bool_or(F.col("o").isNull()).alias("open"))
    same = (F.col("chapters") <= 1) | (F.col("most") >= 2) | (~F.col("open") & (F.col("span") == F.col("chapters")))
    return g.select("surface_name", "book_id", F.when(same, "same").otherwise("ambiguous-name-no-continuity").alias("verdict"))


@q("select surface_name, 'ent_' || substring(sha256(arg_min(claim_version_id, struct_pack(o := coalesce(observed_ordinal, 2147483647), v := claim_version_id))), 1, 16) as canonical_id from alias_claims where surface_name is not null group by 1")
def op_k5_anchor_id(spark, d):
    first = F.min_by("claim_version_id", F.struct(F.coalesce("observed_ordinal", F.lit(2147483647)), "claim_version_id"))
    return table(spark, d, "alias_claims").where("surface_name is not null").groupBy("surface_name").agg(F.concat(F.lit("ent_"), F.substring(F.sha2(first, 256), 1, 16)).alias("canonical_id"))


@q(f"with {RUNS_SQL} select surface_name, arg_min(canonical_id, struct_pack(o := observed_ordinal, v := claim_version_id)) as seed from alias_claims join runs on run_id = created_by_run_id and status = 'active' where observed_ordinal is not null and surface_name is not null group by 1")
def op_k6_trusted_seed(spark, d):
    active = runs(spark, d).where("status = 'active'").select(F.col("run_id").alias("created_by_run_id"))
    a = table(spark, d, "alias_claims").join(active, "created_by_run_id", "left_semi").where("observed_ordinal is not null and surface_name is not null")
    return a.groupBy("surface_name").agg(F.min_by("canonical_id", F.struct("observed_ordinal", "claim_version_id")).alias("seed"))


@q("select book_id, lower(canonical_name) as name, min(canonical_id) as kept, count(*) - 1 as merged from entity_records where canonical_name is not null group by 1, 2 having count(*) > 1")
def op_k7_merge_audit(spark, d):
    return table(spark, d, "entity_records").where("canonical_name is not null").groupBy("book_id", F.lower("canonical_name").alias("name")).agg(F.min("canonical_id").alias("kept"), (F.count("*") - 1).alias("merged")).where("merged > 0")


# ---- event linking
_EVT = f"{V}, ev as (select fact_id as f, book_id as place, observed_ordinal as o, participants as who from (select *, row_number() over (partition by fact_id order by write_seq desc) as rn from vis) where rn = 1 and claim_type = 'event' and operation <> 'retract' and claim_status = 'supported' and observed_ordinal is not null and len(participants) > 0), x as (select distinct f, place, o, unnest(who) as p from ev)"


def linkable(spark, d):
    c = tm.current(vis(spark, d)).where("claim_type = 'event' and observed_ordinal is not null and size(participants) > 0")
    return c.select(F.col("fact_id").alias("fact"), F.col("participants").alias("who"), F.col("book_id").alias("place"), F.col("observed_ordinal").alias("ord"))


@q(f"{_EVT} select f as fact, count(distinct p) as participants from x group by 1")
def op_l1_event_load(spark, d):
    return linkable(spark, d).select("fact", F.size(F.array_distinct("who")).cast("long").alias("participants"))


_CAND = f"{_EVT}, m as (select a.f as source, b.f as target, a.place = b.place as same, b.o - a.o as gap from x a join x b using (p) where b.o > a.o and b.o - a.o <= 100 and a.f <> b.f), g as (select source, target, bool_or(same) as same, min(gap) as gap from m group by 1, 2)"


@q(f"{_CAND} select source, target, case when same then 'causes' else 'enables' end as relation_type, case when same then 0.8::double else 0.6::double end as confidence, gap from g")
def op_l2_candidates(spark, d):
    return graph.candidates(linkable(spark, d))


_CUE = "因为|所以|于是|因此|导致|because|so that|therefore|until|as if"


@q(f"""with s as (select raw_chunk_id, unnest(string_split_regex(content, '[。！？!?]+')) as sentence, generate_subscripts(string_split_regex(content, '[。！？!?]+'), 1) as i from (select distinct raw_chunk_id, content from raw_chunks where content is not null))
select raw_chunk_id, min(i) - 1 as sentence from s where regexp_matches(sentence, '{_CUE}') group by 1""")
def op_l4_link_sentence(spark, d):
    c = table(spark, d, "raw_chunks").where("content is not null").select("raw_chunk_id", "content").distinct()
    s = c.select("raw_chunk_id", F.posexplode(F.split("content", "[。！？!?]+")).alias("i", "s"))
    return s.where(F.col("s").rlike(_CUE)).groupBy("raw_chunk_id").agg(F.min("i").cast("long").alias("sentence"))


@q(f"{_CAND} select source, target, greatest(a.o, b.o) as observed_ordinal, 'chapter_proxy' as world_valid_kind from g join ev a on a.f = source join ev b on b.f = target")
def op_l5_link_write(spark, d):
    e = linkable(spark, d)
    c = graph.candidates(e).select("source", "target")
    o = e.select("fact", "ord")
    return c.join(o.withColumnsRenamed({"fact": "source", "ord": "oa"}), "source").join(o.withColumnsRenamed({"fact": "target", "ord": "ob"}), "target").select("source", "target", F.greatest("oa", "ob").alias("observed_ordinal"), F.lit("chapter_proxy").alias("world_valid_kind"))


@q("select claim_version_id, case when bool_or(claim_status = 'supported' and primary_evidence_id is not null and trim(primary_evidence_id) <> '') then 'supported' when bool_or(claim_status = 'supported') then 'unverified' else min(claim_status) end as status from claims where claim_version_id is not null group by 1")
def op_l6_verification_downgrade(spark, d):
    """What is called supported without evidence is unverified."""
    said = F.coalesce(F.col("claim_status") == "supported", F.lit(False))
    shown = said & F.coalesce(F.trim("primary_evidence_id") != "", F.lit(False))
    g = table(spark, d, "claims").where("claim_version_id is not null").groupBy("claim_version_id").agg(F.bool_or(shown).alias("a"), F.bool_or(said).alias("b"), F.min("claim_status").alias("c"))
    return g.select("claim_version_id", F.when(F.col("a"), "supported").when(F.col("b"), "unverified").otherwise(F.col("c")).alias("status"))


# ---- versioned writes
@q("""with f as (select * from (select *, row_number() over (partition by claim_version_id order by write_seq) as rn from claims) where rn = 1),
p as (select fact_id, claim_version_id, operation, lag(claim_version_id) over (partition by fact_id order by write_seq) as supersedes from f)
select fact_id, claim_version_id, supersedes, case when operation <> 'assert' and supersedes is null then 'error' else 'ok' end as verdict from p""")
def op_m1_write_claims(spark, d):
    f = table(spark, d, "claims").groupBy("claim_version_id").agg(F.min_by(F.struct("fact_id", "operation"), "write_seq").alias("r"), F.min("write_seq").alias("write_seq"))
    w = Window.partitionBy("fact_id").orderBy("write_seq")
    p = f.select("r.*", "claim_version_id", "write_seq").withColumn("supersedes", F.lag("claim_version_id").over(w))
    return p.select("fact_id", "claim_version_id", "supersedes", F.when((F.col("operation") != "assert") & F.col("supersedes").isNull(), "error").otherwise("ok").alias("verdict"))


@q("select alias_fact_id, claim_version_id, surface_name from (select *, row_number() over (partition by claim_version_id order by created_at, created_by_run_id, surface_name) as rn from alias_claims) where rn = 1")
def op_m3_write_alias(spark, d):
    first = F.min_by(F.struct("alias_fact_id", "surface_name"), F.struct("created_at", "created_by_run_id", "surface_name"))
    return table(spark, d, "alias_claims").groupBy("claim_version_id").agg(first.alias("r")).select("r.alias_fact_id", "claim_version_id", "r.surface_name")


@q(f"with {RUNS_SQL}, old as (select run_id as r from runs where status = 'superseded') select distinct 'claim' as kind, claim_version_id as id from claims join old on r = created_by_run_id union select 'alias', claim_version_id from alias_claims join old on r = created_by_run_id union select 'entity', canonical_id from entity_records join old on r = created_by_run_id union select 'mention', subject_entity_id from state_payloads where claim_version_id in (select claim_version_id from claims join old on r = created_by_run_id) and subject_entity_id is not null")
def op_m4_membership_copy(spark, d):
    """What a new run takes over from those it replaces: claims, aliases, entities, mentions."""
    r = runs(spark, d).where("status = 'superseded'").select(F.col("run_id").alias("created_by_run_id"))
    part = lambda t, kind, key: table(spark, d, t).join(r, "created_by_run_id", "left_semi").select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    own = part("claims", "claim", "claim_version_id")
    said = table(spark, d, "state_payloads").where("subject_entity_id is not null").join(own.select(F.col("id").alias("claim_version_id")), "claim_version_id", "left_semi").select(F.lit("mention").alias("kind"), F.col("subject_entity_id").alias("id"))
    return own.union(part("alias_claims", "alias", "claim_version_id")).union(part("entity_records", "entity", "canonical_id")).union(said).distinct()


@q("select canonical_id, arg_max(tier, struct_pack(r := created_by_run_id, n := tier)) as tier, max(importance_score) as importance_score from entity_records group by 1")
def op_m5_entity_upsert(spark, d):
    return table(spark, d, "entity_records").groupBy("canonical_id").agg(F.max_by("tier", F.struct("created_by_run_id", "tier")).alias("tier"), F.max("importance_score").alias("importance_score"))


@q("select distinct c.claim_version_id from claims c join chapters h on h.chapter_id = c.observed_chapter_id where h.book_id <> c.book_id")
def op_m6_boundary_guard(spark, d):
    h = table(spark, d, "chapters").select(F.col("chapter_id").alias("observed_chapter_id"), F.col("book_id").alias("b")).distinct()
    return table(spark, d, "claims").join(h, "observed_chapter_id").where("b != book_id").select("claim_version_id").distinct()


# ---- runs
_GATE = """g as (select c.book_id, c.created_by_run_id as run_id, max(c.created_at) as t, count(distinct c.claim_version_id) as claims, avg(case when c.observed_chapter_id is not null then 1.0 else 0 end) >= 0.8 as chapters_done, avg(case when claim_status = 'rejected' then 1.0 else 0 end) <= 0.1 as few_failed,
count(*) filter (where c.observed_chapter_id is not null and h.chapter_id is null) * 10 <= count(*) as keys_hold, count(*) filter (where claim_status = 'supported' and primary_evidence_id is null) = 0 as proven, count(distinct c.claim_version_id) = count(distinct (c.claim_version_id, c.fact_id)) as consistent
from claims c left join (select distinct chapter_id from chapters) h on h.chapter_id = c.observed_chapter_id where c.created_by_run_id is not null group by 1, 2), gate as (select *, chapters_done and few_failed and keys_hold and proven and consistent as ready from g)"""


def gate(spark, d):
    """The five conditions a run must meet before it may become active, per book and run."""
    h = table(spark, d, "chapters").select(F.col("chapter_id").alias("observed_chapter_id"), F.lit(True).alias("held")).distinct()
    c = table(spark, d, "claims").where("created_by_run_id is not null").join(h, "observed_chapter_id", "left")
    share = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    loose = F.count(F.when(F.col("observed_chapter_id").isNotNull() & F.col("held").isNull(), 1))
    unproven = F.count(F.when((F.col("claim_status") == "supported") & F.col("primary_evidence_id").isNull(), 1))
    g = c.groupBy("book_id", F.col("created_by_run_id").alias("run_id")).agg(
        F.max("created_at").alias("t"), F.countDistinct("claim_version_id").alias("claims"), (share(F.col("observed_chapter_id").isNotNull()) >= 0.8).alias("chapters_done"), (share(F.col("claim_status") == "rejected") <= 0.1).alias("few_failed"),
        (loose * 10 <= F.count("*")).alias("keys_hold"), (unproven == 0).alias("proven"), (F.countDistinct("claim_version_id") == F.countDistinct(F.struct("claim_version_id", "fact_id"))).alias("consistent"),
    )
    return g.withColumn("ready", F.col("chapters_done") & F.col("few_failed") & F.col("keys_hold") & F.col("proven") & F.col("consistent"))


@q(f"with {_GATE} select book_id, run_id, claims, chapters_done, few_failed, keys_hold, proven, consistent, ready from gate")
def op_n3_activation_gate(spark, d):
    return gate(spark, d).drop("t")


@q(f"with {_GATE}, r as (select *, row_number() over (partition by book_id, ready order by t desc, run_id) as rn from gate) select book_id, run_id, case when not ready then 'failed' when rn = 1 then 'active' else 'superseded' end as status from r")
def op_n4_activation(spark, d):
    """Of the runs of a book that pass the gate the newest is active and the others superseded; the rest failed."""
    w = Window.partitionBy("book_id", "ready").orderBy(F.desc("t"), "run_id")
    return gate(spark, d).select("book_id", "run_id", F.when(~F.col("ready"), "failed").when(F.row_number().over(w) == 1, "active").otherwise("superseded").alias("status"))


@q("select distinct 'ckp_' || substring(sha256(concat_ws(chr(31), coalesce(book_id, ''), coalesce(observed_chapter_id, ''), coalesce(h.content_hash, ''), coalesce(prompt_version, ''), coalesce(pipeline_version, ''), coalesce(claim_type, ''), 'v1')), 1, 16) as checkpoint_key, h.content_hash is not null as found from claims left join (select chapter_id, min(content_hash) as content_hash from chapters group by 1) h on h.chapter_id = observed_chapter_id")
def op_n5_checkpoint_key(spark, d):
    """Keys of seven fields by which work that is done is found again, and whether the chapter is there to be looked up."""
    h = table(spark, d, "chapters").groupBy(F.col("chapter_id").alias("observed_chapter_id")).agg(F.min("content_hash").alias("content_hash"))
    c = table(spark, d, "claims").join(h, "observed_chapter_id", "left")
    key = hashing.prefixed("ckp", *(F.col(x) for x in ("book_id", "observed_chapter_id", "content_hash", "prompt_version", "pipeline_version", "claim_type")), F.lit("v1"))
    return c.select(key.alias("checkpoint_key"), F.col("content_hash").isNotNull().alias("found")).distinct()


# ---- summaries
@q("select book_id, (rn - 1) // 50 as volume, min(ordinal) as first, max(ordinal) as last, count(*) as chapters from (select book_id, ordinal, row_number() over (partition by book_id order by ordinal) as rn from (select distinct book_id, ordinal from chapters where ordinal is not null)) group by 1, 2")
def op_o1_default_volumes(spark, d):
    c = table(spark, d, "chapters").where("ordinal is not null").select("book_id", "ordinal").distinct()
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("book_id").orderBy("ordinal")))
    return c.groupBy("book_id", F.floor((F.col("rn") - 1) / 50).alias("volume")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("chapters"))


_ISLE = "c as (select book_id, ordinal, min(volume_ordinal) as v from chapters where ordinal is not null group by 1, 2), g as (select *, sum(chg) over (partition by book_id order by ordinal) as island from (select *, case when v is distinct from lag(v) over (partition by book_id order by ordinal) then 1 else 0 end as chg from c))"


@q(f"with {_ISLE} select book_id, island, any_value(v) as volume, min(ordinal) as first, max(ordinal) as last from g group by 1, 2")
def op_o2_source_volumes(spark, d):
    c = table(spark, d, "chapters").where("ordinal is not null").groupBy("book_id", "ordinal").agg(F.min("volume_ordinal").alias("v"))
    w = Window.partitionBy("book_id").orderBy("ordinal")
    fresh = F.when(F.row_number().over(w) == 1, F.col("v").isNotNull()).otherwise(~F.col("v").eqNullSafe(F.lag("v").over(w)))
    c = c.withColumn("chg", fresh.cast("int")).withColumn("island", F.sum("chg").over(w))
    return c.groupBy("book_id", "island").agg(F.first("v").alias("volume"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


@q("select book_id, volume_ordinal, sha256(string_agg(content_hash, ',' order by ordinal, chapter_id)) as version from chapters where content_hash is not null and volume_ordinal is not null group by 1, 2")
def op_o3_grouping_version(spark, d):
    c = table(spark, d, "chapters").where("content_hash is not null and volume_ordinal is not null")
    s = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chapter_id", "content_hash"))), lambda x: x.content_hash)
    return c.groupBy("book_id", "volume_ordinal").agg(F.sha2(F.array_join(s, ","), 256).alias("version"))


_MEM = f"{V}, {current_sql()}, k as (select book_id, observed_ordinal, claim_version_id, claim_type = 'event' as ev, row_number() over (partition by book_id, observed_ordinal, claim_type = 'event' order by claim_version_id) as rn from cur where observed_ordinal is not null)"


@q(f"{_MEM} select book_id, observed_ordinal, string_agg(claim_version_id, '；' order by not ev, claim_version_id) as summary from k where ev or rn <= 8 group by 1, 2")
def op_o4_summary_text(spark, d):
    c = tm.current(vis(spark, d)).where("observed_ordinal is not null").withColumn("other", F.col("claim_type") != "event")
    w = Window.partitionBy("book_id", "observed_ordinal", "other").orderBy("claim_version_id")
    k = c.withColumn("rn", F.row_number().over(w)).where("not other or rn <= 8")
    s = F.transform(F.array_sort(F.collect_list(F.struct("other", "claim_version_id"))), lambda x: x.claim_version_id)
    return k.groupBy("book_id", "observed_ordinal").agg(F.array_join(s, "；").alias("summary"))


@q(f"{V}, {current_sql()}, v as (select book_id, observed_ordinal // 50 as volume, count(*) as n, max(observed_ordinal) as mo from cur where observed_ordinal is not null group by 1, 2) select book_id, string_agg(volume || ':' || n, '；' order by mo) as summary, max(mo) as max_ordinal from v group by 1")
def op_o5_book_reduce(spark, d):
    c = tm.current(vis(spark, d)).where("observed_ordinal is not null")
    v = c.groupBy("book_id", F.floor(F.col("observed_ordinal") / 50).alias("volume")).agg(F.count("*").alias("n"), F.max("observed_ordinal").alias("mo"))
    s = F.transform(F.array_sort(F.collect_list(F.struct("mo", "volume", "n"))), lambda x: F.concat(x.volume.cast("string"), F.lit(":"), x.n.cast("string")))
    return v.groupBy("book_id").agg(F.array_join(s, "；").alias("summary"), F.max("mo").alias("max_ordinal"))


_SUM = "sum(('0x' || substring(sha256(claim_version_id), 1, 12))::bigint)::decimal(38,0)"


@q(f"{V}, {current_sql(name='a')}, {current_sql(KNOWN, name='b')}, x as (select book_id, {_SUM} as s, count(*) as n, count(distinct fact_id) as f, max(observed_ordinal) as o, count(distinct claim_type) as t from a group by 1), y as (select book_id, {_SUM} as s, count(*) as n, count(distinct fact_id) as f, max(observed_ordinal) as o, count(distinct claim_type) as t from b group by 1) select book_id, case when x.s = y.s and x.n = y.n and x.f = y.f and x.o is not distinct from y.o and x.t = y.t then 'reuse' else 'new version' end as verdict from x left join y using (book_id)")
def op_o6_summary_reuse(spark, d):
    """A summary is used again if its claims, their number, facts, last chapter and kinds are those of before. A set of claims is
    told by the sum of their digests, so that no book is collected in one row."""
    v = vis(spark, d)
    digest = F.sum(F.conv(F.substring(F.sha2("claim_version_id", 256), 1, 12), 16, 10).cast("decimal(38,0)"))

    def key(c, name):
        return c.groupBy("book_id").agg(F.struct(digest.alias("s"), F.count("*").alias("n"), F.countDistinct("fact_id").alias("f"), F.max("observed_ordinal").alias("o"), F.countDistinct("claim_type").alias("t")).alias(name))

    j = key(tm.current(v), "x").join(key(tm.current(v, cutoff=CUTOFF), "y"), "book_id", "left")
    return j.select("book_id", F.when(F.col("x").eqNullSafe(F.col("y")), "reuse").otherwise("new version").alias("verdict"))


@q(f"{V}, {current_sql()} select book_id, observed_ordinal // 50 as volume, max(observed_ordinal) as max_ordinal from cur where {KNOWN} group by 1, 2")
def op_o7_plotline(spark, d):
    return tm.current(vis(spark, d)).where(tm.known_by(CUTOFF)).groupBy("book_id", F.floor(F.col("observed_ordinal") / 50).alias("volume")).agg(F.max("observed_ordinal").alias("max_ordinal"))


# ---- evaluation
def prf(tp, predicted, gold):
    p, r = F.when(predicted > 0, tp / predicted).otherwise(0.0), F.when(gold > 0, tp / gold).otherwise(0.0)
    return F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1")


_PRF = "round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1"


@q(f"""with s as (select distinct query_id, raw_chunk_id, 1 as g from search_hits where route = 'structured'), f as (select distinct query_id, raw_chunk_id, 1 as p from search_hits where route = 'fts'),
j as (select query_id, count(g) as gold, count(p) as pred, count(*) filter (where g = 1 and p = 1) as tp from s full join f using (query_id, raw_chunk_id) group by 1), x as (select query_id, case when pred > 0 then tp / pred else 0 end as p, case when gold > 0 then tp / gold else 0 end as r from j) select query_id, {_PRF} from x""")
def op_q1_set_prf(spark, d):
    h = table(spark, d, "search_hits")
    s = h.where("route = 'structured'").select("query_id", "raw_chunk_id").distinct().withColumn("g", F.lit(1))
    f = h.where("route = 'fts'").select("query_id", "raw_chunk_id").distinct().withColumn("p", F.lit(1))
    j = s.join(f, ["query_id", "raw_chunk_id"], "full").groupBy("query_id").agg(F.count("g").alias("gold"), F.count("p").alias("pred"), F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"))
    return j.select("query_id", *prf(F.col("tp"), F.col("pred"), F.col("gold")))


@q(f"""with e as (select book_id, lower(canonical_name) as g, lower(split_part(canonical_name, ' ', 1)) || coalesce(tier, '') as p from entity_records where canonical_name is not null),
n as (select (select sum(n * (n - 1) // 2) from (select count(*) as n from e group by book_id, g)) as gold, (select sum(n * (n - 1) // 2) from (select count(*) as n from e group by book_id, p)) as pred, (select sum(n * (n - 1) // 2) from (select count(*) as n from e group by book_id, g, p)) as tp),
x as (select case when pred > 0 then tp / pred else 0 end as p, case when gold > 0 then tp / gold else 0 end as r from n) select {_PRF} from x""")
def op_q2_merge_pairs(spark, d):
    """Pair F1 of grouping records by first word and tier against grouping them by name. Pairs are counted, not listed."""
    e = table(spark, d, "entity_records").where("canonical_name is not null").select("book_id", F.lower("canonical_name").alias("g"), F.concat(F.lower(F.split_part("canonical_name", F.lit(" "), F.lit(1))), F.coalesce("tier", F.lit(""))).alias("p"))
    pairs = lambda name, *by: e.groupBy("book_id", *by).count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias(name))
    n = pairs("gold", "g").join(F.broadcast(pairs("pred", "p"))).join(F.broadcast(pairs("tp", "g", "p")))
    return n.select(*prf(F.col("tp"), F.col("pred"), F.col("gold")))


@q(f"with t as (select field, regexp_replace(value, '\\s+', '', 'g') as v, regexp_replace(raw_value, '\\s+|\\?', '', 'g') as w from state_payloads), n as (select field, count(v) as pred, count(w) as gold, count(*) filter (where v = w) as tp from t group by 1), x as (select field, case when pred > 0 then tp / pred else 0 end as p, case when gold > 0 then tp / gold else 0 end as r from n) select field, {_PRF} from x")
def op_q3_fact_match(spark, d):
    """Precision, recall and F1 of stated values against the wording they come from, blanks apart, per field."""
    t = table(spark, d, "state_payloads").select("field", F.regexp_replace("value", r"\s+", "").alias("v"), F.regexp_replace("raw_value", r"\s+|\?", "").alias("w"))
    n = t.groupBy("field").agg(F.count("v").alias("pred"), F.count("w").alias("gold"), F.count(F.when(F.col("v") == F.col("w"), 1)).alias("tp"))
    return n.select("field", *prf(F.col("tp"), F.col("pred"), F.col("gold")))


@q("select count(*) as chunks, count(*) filter (where sha256(content) = content_hash) as reproduced from (select distinct raw_chunk_id, content, content_hash from raw_chunks)")
def op_q4_hash_reproduction(spark, d):
    c = table(spark, d, "raw_chunks").select("raw_chunk_id", "content", "content_hash").distinct()
    return c.agg(F.count("*").alias("chunks"), F.count(F.when(F.sha2("content", 256) == F.col("content_hash"), 1)).alias("reproduced"))


@q("""with g as (select distinct query_id, raw_chunk_id from search_hits where route = 'structured' and score is not null), a as (select distinct query_id, raw_chunk_id from fused_ranks), j as (select g.query_id, bool_or(a.query_id is not null) as ok from g left join a on a.query_id = g.query_id and a.raw_chunk_id = g.raw_chunk_id group by 1)
select count(*) as questions, count(*) filter (where ok) as answered, round(count(*) filter (where ok) / count(*), 4) as accuracy from j""")
def op_q5_question_accuracy(spark, d):
    """Share of questions answered from the right place; a question without an answer is a miss."""
    g = table(spark, d, "search_hits").where("route = 'structured' and score is not null").select("query_id", "raw_chunk_id").distinct()
    a = table(spark, d, "fused_ranks").select("query_id", "raw_chunk_id", F.lit(True).alias("hit")).distinct()
    j = g.join(a, ["query_id", "raw_chunk_id"], "left").groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("ok"))
    n = F.count(F.when(F.col("ok"), 1))
    return j.agg(F.count("*").alias("questions"), n.alias("answered"), F.round(n / F.count("*"), 4).alias("accuracy"))


@q(f"{_CAND}, gold as (select a.f as source, b.f as target from x a join x b using (p) where b.o > a.o group by 1, 2 having count(distinct p) >= 2) select relation_type, count(*) as edges, round(avg(case when gold.source is not null then 1.0 else 0.0 end), 4) as precision from (select source, target, case when same then 'causes' else 'enables' end as relation_type from g) left join gold using (source, target) group by 1")
def op_q6_edge_precision(spark, d):
    """Share of the proposed links of each type that are true ones: here those whose events share two participants or more."""
    e = linkable(spark, d)
    x = e.select("fact", "ord", F.explode(F.array_distinct("who")).alias("p"))
    c = graph.candidates(e).select("source", "target", "relation_type")
    both = c.join(x.select(F.col("fact").alias("source"), "p"), "source").join(x.select(F.col("fact").alias("target"), "p"), ["target", "p"]).groupBy("source", "target").agg(F.countDistinct("p").alias("shared"))
    return c.join(both, ["source", "target"]).groupBy("relation_type").agg(F.count("*").alias("edges"), F.round(F.avg(F.when(F.col("shared") >= 2, 1.0).otherwise(0.0)), 4).alias("precision"))


# ---- streams and operations
@q("select raw_chunk_id from (select distinct raw_chunk_id, content, content_hash, token_count from raw_chunks) where sha256(content) is distinct from content_hash or length(content) is distinct from token_count")
def op_t3_reproduction(spark, d):
    c = table(spark, d, "raw_chunks").select("raw_chunk_id", "content", "content_hash", "token_count").distinct()
    return c.where(~F.sha2("content", 256).eqNullSafe(F.col("content_hash")) | ~F.length("content").eqNullSafe(F.col("token_count"))).select("raw_chunk_id")


@q("select 'payload without claim' as violation, count(*) as n from state_payloads where claim_version_id not in (select claim_version_id from claims where claim_version_id is not null) union all select 'alias without entity', count(*) from alias_claims where canonical_id not in (select canonical_id from entity_records) union all select 'chunk without chapter', count(*) from raw_chunks where source_chapter_id not in (select chapter_id from chapters)")
def op_t4_integrity(spark, d):
    def orphans(child, key, parent, pkey, name):
        k = table(spark, d, parent).select(F.col(pkey).alias(key))
        return table(spark, d, child).where(F.col(key).isNotNull()).join(k, key, "left_anti").agg(F.lit(name).alias("violation"), F.count("*").alias("n"))

    a = orphans("state_payloads", "claim_version_id", "claims", "claim_version_id", "payload without claim")
    return a.unionByName(orphans("alias_claims", "canonical_id", "entity_records", "canonical_id", "alias without entity")).unionByName(orphans("raw_chunks", "source_chapter_id", "chapters", "chapter_id", "chunk without chapter"))


@q(f"with {RUNS_SQL} select book_id, count(*) as deliveries, count(distinct claim_version_id) as versions, count(distinct fact_id) as facts, count(distinct created_by_run_id) filter (where status = 'failed') as failed_runs, count(distinct created_by_run_id) filter (where status = 'failed') > 0 as warn from claims join runs on run_id = created_by_run_id group by 1")
def op_t1_inspect_books(spark, d):
    c = table(spark, d, "claims").join(runs(spark, d).withColumnRenamed("run_id", "created_by_run_id"), "created_by_run_id")
    failed = F.countDistinct(F.when(F.col("status") == "failed", F.col("created_by_run_id")))
    return c.groupBy("book_id").agg(F.count("*").alias("deliveries"), F.countDistinct("claim_version_id").alias("versions"), F.countDistinct("fact_id").alias("facts"), failed.alias("failed_runs")).withColumn("warn", F.col("failed_runs") > 0)


@q("select distinct 'fact_' || substring(sha256('event' || chr(31) || claim_type || chr(31) || array_to_string(list_sort(list_distinct(coalesce(participants, []))), ',') || chr(31) || '' ), 1, 16) as fact_id from claims where claim_type = 'event'".replace("'event' || chr(31) || claim_type", "'event' || chr(31) || 'event'"))
def op_x3_event_fact_ids(spark, d):
    ids = hashing.event_fact_id(F.col("claim_type"), F.col("participants"), F.lit(""))
    return table(spark, d, "claims").where("claim_type = 'event'").select(ids.alias("fact_id")).distinct()


@q("select distinct claim_version_id, 'ver_' || substring(sha256(coalesce(fact_id, '') || chr(31) || coalesce(operation, '') || chr(31) || 'v1'), 1, 16) as derived from claims")
def op_x4_version_ids(spark, d):
    return table(spark, d, "claims").select("claim_version_id", hashing.prefixed("ver", F.col("fact_id"), F.col("operation"), F.lit("v1")).alias("derived")).distinct()


@q(f"with {_EVID} select claim, count(*) as n from ev group by 1")
def op_x7_claim_evidence(spark, d):
    return evidence(spark, d).groupBy("claim").agg(F.count("*").alias("n"))


@q("select created_by_run_id as run_id, epoch_us(min(created_at)) as started, epoch_us(max(created_at)) as finished, count(*) as done from claims group by 1")
def op_x12_run_lifecycle(spark, d):
    return table(spark, d, "claims").groupBy(F.col("created_by_run_id").alias("run_id")).agg(F.unix_micros(F.min("created_at")).alias("started"), F.unix_micros(F.max("created_at")).alias("finished"), F.count("*").alias("done"))


@q("select book_id, volume_title, count(*) as chapters, min(ordinal) as first from chapters group by 1, 2")
def op_x25_volume_bookkeeping(spark, d):
    return table(spark, d, "chapters").groupBy("book_id", "volume_title").agg(F.count("*").alias("chapters"), F.min("ordinal").alias("first"))


QUERIES, ORACLE = q.QUERIES, q.ORACLE
