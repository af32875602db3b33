"""Evidence: segments, quotations, anchors, spans and the ids written down with them; also joins and orders on their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sagaspark.functions import evidence as ev
from sagaspark.functions import hashing
from sagaspark.plans import temporal as tm
from sagaspark.queries.base import CUTOFF, KNOWN, VIS_SQL, Queries, current_sql, pay, vis
from sagaspark.session import table

q = Queries()
V = f"with {VIS_SQL}"
_P = r"[\s，。！？、；：“”‘’（）《》,.!?;:''\"()\-—…]+"
_BARE = "regexp_replace({}, '" + _P + "', '', 'g')"


# ---- anchors and where they are
_NAMES = "nm as (select canonical_id, min(canonical_name) as name from entity_records where canonical_name is not null group by 1)"
_ANCHORS = f"""{_NAMES}, st as (select distinct p.claim_version_id as v, subject_entity_id as s, target_entity_id as t, raw_value, value from state_payloads p),
an as (select v, s.name as anchor, 1 as source, true as hard from st join nm s on s.canonical_id = st.s union all select v, t.name, 2, true from st join nm t on t.canonical_id = st.t
 union all select v, trim(raw_value), 3, true from st where length(raw_value) >= 2 union all select v, trim(value), 4, false from st where length(value) >= 2
 union all select distinct c.claim_version_id, nm.name, 5, true from (select claim_version_id, unnest(participants) as who from claims where claim_type = 'event') c join nm on nm.canonical_id = c.who),
anchors as (select v as claim_version_id, anchor, min(source) as source, bool_or(hard) filter (where true) as hard from (select *, min(source) over (partition by v, anchor) as first from an where trim(anchor) <> '') where source = first group by 1, 2)"""


def anchors(spark, d):
    """What must (hard) or may be read in a claim's evidence, each text once by its first source: names of its subject (1) and
    target (2), its raw value (3), its value (4, soft), names of an event's participants (5)."""
    n = table(spark, d, "entity_records").where("canonical_name is not null").groupBy("canonical_id").agg(F.min("canonical_name").alias("anchor"))
    st = table(spark, d, "state_payloads").select(F.col("claim_version_id").alias("v"), F.col("subject_entity_id").alias("s"), F.col("target_entity_id").alias("t"), "raw_value", "value").distinct()
    who = table(spark, d, "claims").where("claim_type = 'event'").select(F.col("claim_version_id").alias("v"), F.explode("participants").alias("canonical_id")).distinct()
    named = lambda rows, k, source: rows.join(n, F.col("canonical_id") == F.col(k)) if k != "canonical_id" else rows.join(n, k)
    parts = [named(st, "s", 1).select("v", "anchor", F.lit(1).alias("source"), F.lit(True).alias("hard")), named(st, "t", 2).select("v", "anchor", F.lit(2), F.lit(True))]
    parts += [st.where("length(raw_value) >= 2").select("v", F.trim("raw_value"), F.lit(3), F.lit(True)), st.where("length(value) >= 2").select("v", F.trim("value"), F.lit(4), F.lit(False))]
    parts.append(named(who, "canonical_id", 5).select("v", "anchor", F.lit(5), F.lit(True)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("trim(anchor) != ''").groupBy(F.col("v").alias("claim_version_id"), "anchor").agg(F.min(F.struct("source", "hard")).alias("r")).select("claim_version_id", "anchor", "r.source", "r.hard")


@q(f"with {_ANCHORS} select claim_version_id, anchor, source, hard from anchors")
def op_j11_anchors(spark, d):
    return anchors(spark, d)


_SEEN = f"""{_ANCHORS}, obs as (select distinct claim_version_id, observed_chapter_id as ch from claims where observed_chapter_id is not null), ck as (select distinct raw_chunk_id, source_chapter_id as ch, content from raw_chunks where content is not null),
met as (select claim_version_id, raw_chunk_id, anchor, hard, strpos({_BARE.format('content')}, {_BARE.format('anchor')}) as place from anchors join obs using (claim_version_id) join ck using (ch) where {_BARE.format('anchor')} <> '')"""


def claim_chunks(spark, d):
    """The texts a claim may be read in: those of the chapter that it was observed in."""
    at = table(spark, d, "claims").where("observed_chapter_id is not null").select("claim_version_id", F.col("observed_chapter_id").alias("source_chapter_id")).distinct()
    ck = table(spark, d, "raw_chunks").where("content is not null").select("raw_chunk_id", "source_chapter_id", "content").distinct()
    return at.join(ck, "source_chapter_id")


@q(f"with {_SEEN} select claim_version_id, raw_chunk_id, anchor, place from met where place > 0")
def op_j12_tolerant_find(spark, d):
    """First place of each anchor in the texts of its claim's chapter, counted without blanks and punctuation."""
    m = claim_chunks(spark, d).join(anchors(spark, d), "claim_version_id").where(ev.bare(F.col("anchor")) != "")
    return m.select("claim_version_id", "raw_chunk_id", "anchor", F.instr(ev.bare(F.col("content")), ev.bare(F.col("anchor"))).cast("long").alias("place")).where("place > 0")


def claim_spans(spark, d):
    a = anchors(spark, d).groupBy("claim_version_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source"), F.col("anchor").alias("text"), "hard"))).alias("anchors"))
    a = a.withColumn("anchors", F.transform("anchors", lambda x: F.struct(x.text.alias("text"), x.hard.alias("hard"))))
    return ev.best_spans(claim_chunks(spark, d).join(a, "claim_version_id"), ["claim_version_id", "raw_chunk_id"], "content", "anchors")


@q()
def op_j13_span_candidates(spark, d):
    """Best span of each claim over the texts of its chapter."""
    w = Window.partitionBy("claim_version_id").orderBy(F.desc("score"), "raw_chunk_id")
    return claim_spans(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("score", F.round("score", 6))


@q(f"""with {_SEEN}, h as (select claim_version_id, raw_chunk_id, bool_and(place > 0) filter (where hard) as firm, bool_or(place > 0) as hit from met group by 1, 2)
select claim_version_id, bool_or(coalesce(firm, true) and hit) as literal from h group by 1""")
def op_j14_all_hard_anchors(spark, d):
    """Whether one text of the chapter holds all hard anchors of a claim word for word."""
    m = claim_chunks(spark, d).join(anchors(spark, d), "claim_version_id").where(ev.bare(F.col("anchor")) != "")
    hit = F.contains(ev.bare(F.col("content")), ev.bare(F.col("anchor")))
    h = m.groupBy("claim_version_id", "raw_chunk_id").agg(F.bool_and(F.when(F.col("hard"), hit)).alias("firm"), F.bool_or(hit).alias("some"))
    return h.groupBy("claim_version_id").agg(F.bool_or(F.coalesce("firm", F.lit(True)) & F.col("some")).alias("literal"))


@q(f"""with {_SEEN}, cl as (select distinct claim_version_id, observed_chapter_id as ch from claims), hit as (select claim_version_id, ch, bool_or(place > 0) as seen from met join (select raw_chunk_id, any_value(source_chapter_id) as ch from raw_chunks group by 1) using (raw_chunk_id) group by 1, 2), held as (select distinct source_chapter_id as ch from raw_chunks where content is not null)
select cl.claim_version_id, cl.ch as chapter_id, case when held.ch is null then 'ref_missing' when coalesce(seen, false) then 'aligned' else 'no_span_found' end as result from cl left join held on held.ch = cl.ch left join hit on hit.claim_version_id = cl.claim_version_id and hit.ch = cl.ch""")
def op_j15_evidence_or_error(spark, d):
    cl = table(spark, d, "claims").select("claim_version_id", F.col("observed_chapter_id").alias("chapter_id")).distinct()
    held = table(spark, d, "raw_chunks").where("content is not null").select(F.col("source_chapter_id").alias("chapter_id"), F.lit(True).alias("held")).distinct()
    m = claim_chunks(spark, d).join(anchors(spark, d), "claim_version_id").where(ev.bare(F.col("anchor")) != "")
    hit = m.groupBy("claim_version_id", F.col("source_chapter_id").alias("chapter_id")).agg(F.bool_or(F.contains(ev.bare(F.col("content")), ev.bare(F.col("anchor")))).alias("some"))
    x = cl.join(held, "chapter_id", "left").join(hit, ["claim_version_id", "chapter_id"], "left")
    return x.select("claim_version_id", "chapter_id", F.when(F.col("held").isNull(), "ref_missing").when(F.col("some"), "aligned").otherwise("no_span_found").alias("result"))


@q(f"""with obs as (select distinct claim_version_id, observed_chapter_id as ch from claims where observed_chapter_id is not null), ck as (select distinct source_chapter_id as ch, content from raw_chunks where content is not null), p as (select distinct claim_version_id, raw_value from state_payloads where raw_value is not null),
m as (select claim_version_id, raw_value, bool_or(contains({_BARE.format('content')}, {_BARE.format('raw_value')})) as hit from p join obs using (claim_version_id) join ck using (ch) group by 1, 2)
select claim_version_id, raw_value, case when hit then 'kept' when length({_BARE.format('raw_value')}) < 2 then 'dropped' else 'warned' end as verdict from m""")
def op_j9_literal_quote(spark, d):
    p = table(spark, d, "state_payloads").where("raw_value is not null").select("claim_version_id", "raw_value").distinct()
    b = ev.bare(F.col("raw_value"))
    m = claim_chunks(spark, d).join(p, "claim_version_id").groupBy("claim_version_id", "raw_value").agg(F.bool_or(F.contains(ev.bare(F.col("content")), b)).alias("hit"))
    return m.select("claim_version_id", "raw_value", F.when(F.col("hit"), "kept").when(F.length(b) < 2, "dropped").otherwise("warned").alias("verdict"))


@q(f"""with ck as (select distinct raw_chunk_id, source_chapter_id as ch, char_start, {_BARE.format('content')} as body from raw_chunks where content is not null and char_start is not null), a as (select distinct {_BARE.format('value')} as mention from state_payloads where length({_BARE.format('value')}) >= 2),
m as (select mention, ch, strpos(body, mention) as place, char_start, raw_chunk_id from a join ck on contains(body, mention))
select mention, ch as chapter_id, arg_min(raw_chunk_id, struct_pack(a := char_start, b := place, c := raw_chunk_id)) as raw_chunk_id, arg_min(place, struct_pack(a := char_start, b := place, c := raw_chunk_id)) as place from m group by 1, 2""")
def op_j18_mention_locate(spark, d):
    """First place of each mention in each chapter, counted without blanks and punctuation. Mentions and texts meet by the
    mention's first two characters, not each with each."""
    a = table(spark, d, "state_payloads").select(ev.bare(F.col("value")).alias("mention")).where("length(mention) >= 2").distinct().withColumn("k", F.substring("mention", 1, 2))
    ck = table(spark, d, "raw_chunks").where("content is not null and char_start is not null").select("raw_chunk_id", F.col("source_chapter_id").alias("chapter_id"), "char_start", ev.bare(F.col("content")).alias("body")).distinct()
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("body") - 1), lambda p: F.substring(F.col("body"), p, F.lit(2))))
    keys = ck.where("length(body) >= 2").select("raw_chunk_id", "chapter_id", "char_start", F.explode(pairs).alias("k")).join(a, "k").select("raw_chunk_id", "chapter_id", "char_start", "mention")
    m = keys.join(ck, ["raw_chunk_id", "chapter_id", "char_start"]).withColumn("place", F.instr("body", F.col("mention")).cast("long")).where("place > 0")
    return m.groupBy("mention", "chapter_id").agg(F.min(F.struct("char_start", "place", "raw_chunk_id")).alias("r")).select("mention", "chapter_id", "r.raw_chunk_id", "r.place")


# ---- segments
@q()
def op_j5_segments(spark, d):
    """Whole texts in segments of at most 300 characters, sentences kept where they fit."""
    return ev.segment_table(table(spark, d, "documents"), "doc_id", "text", 300).drop("content_hash")


@q()
def op_j6_manifest(spark, d):
    s = ev.segment_table(table(spark, d, "documents"), "doc_id", "text", 300)
    return s.select("doc_id", F.concat(F.lit("seg_"), F.col("no")).alias("segment_id"), F.col("char_start").alias("char_offset"), "content_hash")


@q("select raw_chunk_id, case when token_start is not null and token_start % 40 + 10 <= length(content) then substring(content, token_start % 40 + 1, 10) end as slice, not coalesce(token_start % 40 + 10 <= length(content), false) as out_of_bounds from (select distinct raw_chunk_id, token_start, content from raw_chunks)")
def op_j3_bounded_slice(spark, d):
    c = table(spark, d, "raw_chunks").select("raw_chunk_id", "token_start", "content").distinct()
    at = F.col("token_start") % 40
    ok = F.coalesce(at + 10 <= F.length("content"), F.lit(False))
    return c.select("raw_chunk_id", F.when(ok, F.substring(F.col("content"), at + 1, F.lit(10))).alias("slice"), (~ok).alias("out_of_bounds"))


@q("select raw_chunk_id, content_hash, content_hash = sha256(content) as verified, lead(token_start) over (partition by source_chapter_id, chunking_version order by token_start, raw_chunk_id) as next_start from (select distinct raw_chunk_id, source_chapter_id, chunking_version, token_start, content, content_hash from raw_chunks)")
def op_j10_verified_refs(spark, d):
    c = table(spark, d, "raw_chunks").select("raw_chunk_id", "source_chapter_id", "chunking_version", "token_start", "content", "content_hash").distinct()
    w = Window.partitionBy("source_chapter_id", "chunking_version").orderBy(F.asc_nulls_last("token_start"), "raw_chunk_id")
    return c.select("raw_chunk_id", "content_hash", (F.col("content_hash") == F.sha2("content", 256)).alias("verified"), F.lead("token_start").over(w).alias("next_start"))


# ---- mentions and participants
@q("select distinct p.claim_version_id, p.subject_entity_id, case when e.canonical_id is null then 'sf_' || substring(sha256(p.subject_entity_id), 1, 16) else c.ch || ':' || p.subject_entity_id end as mention_id from state_payloads p join (select claim_version_id, min(observed_chapter_id) as ch from claims group by 1) c using (claim_version_id) left join (select distinct canonical_id from entity_records) e on e.canonical_id = p.subject_entity_id where p.subject_entity_id is not null")
def op_j16_mention_names(spark, d):
    """References within a chapter get its name before them; what refers to no known mention gets one made from its text."""
    c = table(spark, d, "claims").groupBy("claim_version_id").agg(F.min("observed_chapter_id").alias("ch"))
    e = table(spark, d, "entity_records").select(F.col("canonical_id").alias("subject_entity_id"), F.lit(True).alias("known")).distinct()
    p = table(spark, d, "state_payloads").where("subject_entity_id is not null").select("claim_version_id", "subject_entity_id").join(c, "claim_version_id").join(e, "subject_entity_id", "left")
    made = F.concat(F.lit("sf_"), F.substring(F.sha2("subject_entity_id", 256), 1, 16))
    return p.select("claim_version_id", "subject_entity_id", F.when(F.col("known").isNull(), made).otherwise(F.concat("ch", F.lit(":"), "subject_entity_id")).alias("mention_id")).distinct()


@q("""with e as (select *, row_number() over (partition by user_id, event_type order by event_id) as nth, coalesce(json_extract_string(props, '$.k')::int, 1) as seq from events), k as (select user_id, event_type, count(*) as n from e group by 1, 2)
select a.event_id, b.event_id as matched from e a join k using (user_id, event_type) join e b on b.user_id = a.user_id and b.event_type = a.event_type and b.nth = case when a.seq between 1 and n then a.seq else 1 end""")
def op_j17_nth_of_type(spark, d):
    """An event that says which of its type it is meets that one, or else the first of its type."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(1)).alias("seq"))
    w = Window.partitionBy("user_id", "event_type")
    e = e.withColumn("nth", F.row_number().over(w.orderBy("event_id"))).withColumn("n", F.count("*").over(w))
    want = e.select("event_id", "user_id", "event_type", F.when(F.col("seq").between(F.lit(1), F.col("n")), F.col("seq")).otherwise(1).cast("int").alias("nth"))
    return want.join(e.select("user_id", "event_type", "nth", F.col("event_id").alias("matched")), ["user_id", "event_type", "nth"]).select("event_id", "matched")


# ---- ids
_FIELDS = "'{' || concat_ws(',', case when field is not null then '\"field\":\"' || field || '\"' end, case when subject_entity_id is not null then '\"subject_entity_id\":\"' || subject_entity_id || '\"' end, case when target_entity_id is not null then '\"target_entity_id\":\"' || target_entity_id || '\"' end) || '}'"


@q(f"select distinct subject_entity_id, field, target_entity_id, 'fact_' || substring(sha256('state' || chr(31) || sha256({_FIELDS})), 1, 16) as fact_id from state_payloads")
def op_x2_semantic_fact_id(spark, d):
    """Ids from the fields that are there, in order of their names; values play no role."""
    p = table(spark, d, "state_payloads").select("subject_entity_id", "field", "target_entity_id").distinct()
    return p.withColumn("fact_id", hashing.semantic_fact_id("state", field=F.col("field"), subject_entity_id=F.col("subject_entity_id"), target_entity_id=F.col("target_entity_id")))


@q("select chunking_version, sha256('{\"min_tokens\":' || min_tokens || ',\"overlap_ratio\":' || overlap_ratio || ',\"schema\":\"v1\",\"target_tokens\":' || target_tokens || ',\"tokenizer\":\"' || tokenizer_id || '\"}') as version_hash from chunk_configs")
def op_i2_chunking_version(spark, d):
    """Hash of a configuration: fields in order of their names, no blanks."""
    text = F.format_string('{"min_tokens":%s,"overlap_ratio":%s,"schema":"v1","target_tokens":%s,"tokenizer":"%s"}', *(F.col(c).cast("string") for c in ("min_tokens", "overlap_ratio", "target_tokens", "tokenizer_id")))
    return table(spark, d, "chunk_configs").select("chunking_version", F.sha2(text, 256).alias("version_hash"))


@q("select distinct claim_version_id, 'draft_' || substring(sha256(concat_ws(chr(31), coalesce(book_id, ''), coalesce(observed_chapter_id, ''), coalesce(prompt_version, ''), coalesce(pipeline_version, ''))), 1, 16) as draft_id from claims")
def op_x5_draft_id(spark, d):
    """A draft's id depends on content and versions, not on the run."""
    return table(spark, d, "claims").select("claim_version_id", hashing.prefixed("draft", *(F.col(c) for c in ("book_id", "observed_chapter_id", "prompt_version", "pipeline_version"))).alias("draft_id")).distinct()


@q("select doc_id, list_transform(range(0, 8), lambda i: round((((('0x' || substring(sha256(text), 1 + 2 * i, 2))::int + i * 7) % 251) - 125) / 125.0::double, 6)) as raw from documents where text is not null")
def op_i11_fake_embedding(spark, d):
    """Numbers from the bytes of a text's hash, before they are scaled to length one."""
    byte = lambda i: F.conv(F.substring(F.sha2("text", 256), 1 + 2 * i, 2), 16, 10).cast("int")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array(*(F.round(((byte(i) + i * 7) % 251 - 125) / F.lit(125.0), 6) for i in range(8))).alias("raw"))


# ---- joins, windows and orders on their own
@q("select c.claim_version_id, h.title from (select distinct claim_version_id, observed_chapter_id from claims) c left join (select chapter_id, min(title) as title from chapters group by 1) h on h.chapter_id = c.observed_chapter_id")
def op_c3_left_outer(spark, d):
    h = table(spark, d, "chapters").groupBy(F.col("chapter_id").alias("observed_chapter_id")).agg(F.min("title").alias("title"))
    return table(spark, d, "claims").select("claim_version_id", "observed_chapter_id").distinct().join(h, "observed_chapter_id", "left").select("claim_version_id", "title")


_EV = "select event_id, user_id, cast(epoch(ts) as bigint) as t, event_type from events"


@q(f"with e as ({_EV}) select a.event_id as earlier, b.event_id as later from e a join e b on a.user_id = b.user_id and b.t > a.t and b.t - a.t <= 3600")
def op_c11_band_self_join(spark, d):
    """Pairs of a user's events at most an hour apart; time is cut into bands, so that a busy user is many keys."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    band = F.floor(F.col("t") / 3600)
    a = e.select("user_id", F.col("event_id").alias("earlier"), F.col("t").alias("ta"), band.alias("band"))
    b = e.select("user_id", F.col("event_id").alias("later"), F.col("t").alias("tb"), F.explode(F.array(band, band - 1)).alias("band"))
    return a.join(b, ["user_id", "band"]).where("tb > ta and tb - ta <= 3600").select("earlier", "later")


@q("with recursive c as (select distinct claim_version_id as v, supersedes_version_id as s from claims where supersedes_version_id is not null), w as (select v, s as root, 1 as hops from c union all select w.v, c.s, w.hops + 1 from w join c on c.v = w.root where hops < 4) select v as claim_version_id, root as ancestor, min(hops) as hops from w group by 1, 2")
def op_c14_ancestors(spark, d):
    """Versions up to four supersessions back: the recursive join with a fixed depth, as a union of joins."""
    c = table(spark, d, "claims").where("supersedes_version_id is not null").select(F.col("claim_version_id").alias("v"), F.col("supersedes_version_id").alias("s")).distinct()
    walk = c.select("v", F.col("s").alias("root"), F.lit(1).alias("hops"))
    out = walk
    for n in range(2, 5):
        walk = walk.join(c.select(F.col("v").alias("root"), F.col("s").alias("up")), "root").select("v", F.col("up").alias("root"), F.lit(n).alias("hops"))
        out = out.unionByName(walk)
    return out.groupBy(F.col("v").alias("claim_version_id"), F.col("root").alias("ancestor")).agg(F.min("hops").alias("hops"))


_KNOWN_NAMES = f"names as (select distinct surface_name as name from alias_claims where operation <> 'retract' and observed_ordinal <= {CUTOFF} and length(surface_name) >= 2 union select distinct canonical_name from entity_records where length(canonical_name) >= 2)"


def names_in_questions(spark, d):
    """Names told by the cutoff that questions hold: item_id, name. A name is looked up by its first two characters, so that
    names and questions meet by a key and not each with each."""
    a = table(spark, d, "alias_claims").where((F.col("operation") != "retract") & tm.known_by(CUTOFF)).select(F.col("surface_name").alias("name"))
    n = a.union(table(spark, d, "entity_records").select("canonical_name")).where("length(name) >= 2").distinct().withColumn("k", F.substring("name", 1, 2))
    i = table(spark, d, "eval_items").where("length(text) >= 2").select("item_id", "text")
    k = i.select("item_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda p: F.substring(F.col("text"), p, F.lit(2))))).alias("k"))
    return k.join(n, "k").where(F.contains("text", "name")).select("item_id", "name")


@q(f"with {_KNOWN_NAMES} select item_id, name from eval_items join names on contains(text, name)")
def op_c15_containment_join(spark, d):
    return names_in_questions(spark, d)


@q(f"{V} select fact_id, claim_version_id from (select *, row_number() over (partition by fact_id order by write_seq desc) as rn from vis) where rn = 1")
def op_e1_newest_of_fact(spark, d):
    return tm.newest(vis(spark, d).select("fact_id", "claim_version_id", "write_seq"), ["fact_id"]).select("fact_id", "claim_version_id")


@q("select fact_id, claim_version_id from (select *, row_number() over (partition by fact_id order by write_seq desc) as rn from claims where claim_type = 'event') where rn = 1 and operation <> 'retract'")
def op_e2_newest_without_view(spark, d):
    return tm.newest(table(spark, d, "claims").where("claim_type = 'event'").select("fact_id", "claim_version_id", "operation", "write_seq"), ["fact_id"]).where("operation != 'retract'").select("fact_id", "claim_version_id")


@q("select raw_chunk_id, source_chapter_id from (select raw_chunk_id, source_chapter_id, row_number() over (partition by source_chapter_id order by token_start nulls last, raw_chunk_id) as rn from (select distinct raw_chunk_id, source_chapter_id, token_start from raw_chunks)) where rn between 2 and 3")
def op_f7_source_page(spark, d):
    """The second page of each chapter's sources, of two each; a page is never larger than a hundred."""
    size, page = min(100, 2), 2
    w = Window.partitionBy("source_chapter_id").orderBy(F.asc_nulls_last("token_start"), "raw_chunk_id")
    c = table(spark, d, "raw_chunks").select("raw_chunk_id", "source_chapter_id", "token_start").distinct().withColumn("rn", F.row_number().over(w))
    return c.where(F.col("rn").between((page - 1) * size, (page - 1) * size + size - 1)).select("raw_chunk_id", "source_chapter_id")


@q(f"""with f as (select query_id as qid, raw_chunk_id as item, score from (select query_id, raw_chunk_id, max(score) as score from search_hits where route = 'vector' and score is not null group by 1, 2)), o as (select raw_chunk_id as item, min(observed_ordinal) as o from raw_chunks group by 1)
select qid as query_id, item as raw_chunk_id, rank from (select qid, item, row_number() over (partition by qid order by score desc, item) as rank from f join o using (item) where o <= {CUTOFF}) where rank <= 8""")
def op_i14_cutoff_before_top(spark, d):
    """What is not yet known goes before the best are taken, so that no window has to be widened."""
    o = table(spark, d, "raw_chunks").groupBy("raw_chunk_id").agg(F.min("observed_ordinal").alias("observed_ordinal")).where(tm.known_by(CUTOFF))
    h = table(spark, d, "search_hits").where("route = 'vector' and score is not null").groupBy("query_id", "raw_chunk_id").agg(F.max("score").alias("score")).join(o, "raw_chunk_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "raw_chunk_id")
    return h.select("query_id", "raw_chunk_id", F.row_number().over(w).alias("rank")).where("rank <= 8")


_CUTS = "cuts as (select unnest([20, 60, 200]) as cutoff)"


@q(f"""with {_CUTS}, o as (select raw_chunk_id, min(observed_ordinal) as o from raw_chunks where observed_ordinal is not null group by 1), h as (select query_id, raw_chunk_id, max(score) as score from search_hits where score is not null group by 1, 2),
a as (select query_id, cutoff, raw_chunk_id, o, row_number() over (partition by query_id, cutoff order by score desc, raw_chunk_id) as rank from h join o using (raw_chunk_id) join cuts on o <= cutoff)
select query_id, cutoff, count(*) as sources, max(o) as latest, count(*) filter (where o > cutoff) as leaks from a where rank <= 8 group by 1, 2""")
def op_t2_leaks_per_cutoff(spark, d):
    """The sources an answer would use at each cutoff, and how many of them say what is only told later."""
    o = table(spark, d, "raw_chunks").where("observed_ordinal is not null").groupBy("raw_chunk_id").agg(F.min("observed_ordinal").alias("o"))
    h = table(spark, d, "search_hits").where("score is not null and not isnan(score)").groupBy("query_id", "raw_chunk_id").agg(F.max("score").alias("score")).join(o, "raw_chunk_id")
    out = None
    for c in (20, 60, 200):
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "raw_chunk_id")
        a = h.where(F.col("o") <= c).withColumn("rank", F.row_number().over(w)).where("rank <= 8").groupBy("query_id").agg(F.lit(c).alias("cutoff"), F.count("*").alias("sources"), F.max("o").alias("latest"), F.count(F.when(F.col("o") > c, 1)).alias("leaks"))
        out = a if out is None else out.unionByName(a)
    return out


# ---- membership, detail, writes, runs
_FOLD = "select book_id, coalesce(target_entity_id, '') as org, subject_entity_id as member, value, operation, claim_status, write_seq from vis join pay using (claim_version_id) where field in ('stance', 'identity') and subject_entity_id is not null"
_PAY = "pay as (select distinct claim_version_id, field, value, subject_entity_id, target_entity_id from state_payloads)"


@q(f"{V}, {_PAY}, f as ({_FOLD} and {KNOWN}), r as (select *, row_number() over (partition by org, member order by write_seq desc, value desc nulls last) as rn from f) select org, member, value as role from r where rn = 1 and operation <> 'retract' and claim_status = 'supported' and coalesce(value, '') not in ('leave', 'dissolve', 'sworn against', 'exile')")
def op_h13_membership_fold(spark, d):
    """Newest word on each (group, member), across facts; members whose newest word ends the membership are dropped."""
    p = pay(spark, d).where("field in ('stance', 'identity') and subject_entity_id is not null")
    f = vis(spark, d).where(tm.known_by(CUTOFF)).join(p, "claim_version_id").withColumn("org", F.coalesce("target_entity_id", F.lit("")))
    best = f.groupBy("org", F.col("subject_entity_id").alias("member")).agg(F.max(F.struct("write_seq", "value", "operation", "claim_status")).alias("r"))
    return best.where("r.operation != 'retract' and r.claim_status = 'supported' and coalesce(r.value, '') not in ('leave', 'dissolve', 'sworn against', 'exile')").select("org", "member", F.col("r.value").alias("role"))


@q(f"""{V}, {_PAY}, {current_sql(KNOWN)}, al as (select canonical_id, count(distinct surface_name) as aliases from alias_claims where operation <> 'retract' and {KNOWN} group by 1), fa as (select subject_entity_id as canonical_id, count(distinct fact_id) as facts, max(observed_ordinal) as latest from cur join pay using (claim_version_id) group by 1)
select e.canonical_id, case when coalesce(aliases, 0) + coalesce(facts, 0) > 0 then 'ok' else 'not_visible' end as status, coalesce(aliases, 0) as aliases, coalesce(facts, 0) as facts, latest from (select distinct canonical_id from entity_records) e left join al using (canonical_id) left join fa using (canonical_id)""")
def op_h24_entity_detail(spark, d):
    """What can be said of each entity at the cutoff; one of which nothing is told yet is not visible."""
    al = table(spark, d, "alias_claims").where((F.col("operation") != "retract") & tm.known_by(CUTOFF)).groupBy("canonical_id").agg(F.countDistinct("surface_name").alias("aliases"))
    fa = tm.current(vis(spark, d), cutoff=CUTOFF).join(pay(spark, d), "claim_version_id").groupBy(F.col("subject_entity_id").alias("canonical_id")).agg(F.countDistinct("fact_id").alias("facts"), F.max("observed_ordinal").alias("latest"))
    e = table(spark, d, "entity_records").select("canonical_id").distinct().join(al, "canonical_id", "left").join(fa, "canonical_id", "left").fillna(0, ["aliases", "facts"])
    return e.select("canonical_id", F.when(F.col("aliases") + F.col("facts") > 0, "ok").otherwise("not_visible").alias("status"), "aliases", "facts", "latest")


@q("""with e as (select event_id, user_id, value, lead(event_id) over (partition by user_id order by ts, event_id) as target from events), l as (select 'link_' || substring(sha256(event_id || chr(31) || 'causes' || chr(31) || target), 1, 16) as link_id, event_id as source, target, value from e where target is not null),
old as (select link_id, 'ev_' || source as evidence from l where source % 2 = 0)
select l.link_id, source, target, old.link_id is null as inserted, coalesce('ev_' || case when value > 50 then source end, old.evidence) as primary_evidence from l left join old using (link_id)""")
def op_m2_write_event_link(spark, d):
    """Links are written once; writing one again only refreshes its first evidence, and only where there is some."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("target", F.lead("event_id").over(w)).where("target is not null")
    new = e.select(hashing.prefixed("link", F.col("event_id"), F.lit("causes"), F.col("target")).alias("link_id"), F.col("event_id").alias("source"), "target", F.when(F.col("value") > 50, F.concat(F.lit("ev_"), "event_id")).alias("found"))
    old = new.where("source % 2 = 0").select("link_id", F.concat(F.lit("ev_"), "source").alias("evidence"))
    return new.join(old, "link_id", "left").select("link_id", "source", "target", F.col("evidence").isNull().alias("inserted"), F.coalesce("found", "evidence").alias("primary_evidence"))


_STEP = "case event_type when 'view' then 'running' when 'click' then 'ready' when 'purchase' then 'active' else 'failed' end"


@q(f"""with e as (select user_id as run, event_id, {_STEP} as to_status, lag({_STEP}, 1, 'pending') over (partition by user_id order by ts, event_id) as from_status from events)
select run, event_id, from_status, to_status, (from_status, to_status) in (('pending', 'running'), ('running', 'ready'), ('ready', 'active'), ('running', 'failed'), ('ready', 'failed')) as applied from e""")
def op_n1_compare_and_set(spark, d):
    """Status changes of runs: one is applied if the run has the status it starts from and the step is one of a run's life."""
    to = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "purchase", "active").otherwise("failed")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("to_status", to).withColumn("from_status", F.lag("to_status", 1, "pending").over(w))
    step = F.concat_ws(">", "from_status", "to_status")
    return e.select(F.col("user_id").alias("run"), "event_id", "from_status", "to_status", step.isin("pending>running", "running>ready", "ready>active", "running>failed", "ready>failed").alias("applied"))


_GATE = "case run % 3 when 0 then 'llm-map' when 1 then 'production-map' else 'golden-replay' end"


@q(f"""with r as (select user_id as run, avg(value) as base, avg(case when event_id % 2 = 0 then value end) as half, count(*) as n, count(*) filter (where event_type = 'error') as bad from events group by 1),
g as (select run, {_GATE} as mode, bad = 0 as validated, 1.0::double as before, 1.0 - abs(coalesce(half, 0) - base) / (base * 20 + 1) as after, 1.0 - n / (n + 7.0::double) as saving from r)
select run, validated and mode in ('llm-map', 'production-map') and before - after <= 0.02 and saving >= 0.1 as enabled, case when not validated then 'validation' when mode not in ('llm-map', 'production-map') then 'extraction_mode' when before - after > 0.02 then 'recall' when saving < 0.1 then 'cost' end as reason from g""")
def op_p4_decision_gate(spark, d):
    """Whether the shorter text may stand for the whole: hard conditions first, then what recall and cost it has."""
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.avg("value").alias("base"), F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("half"), F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("bad"))
    mode = F.when(F.col("run") % 3 == 0, "llm-map").when(F.col("run") % 3 == 1, "production-map").otherwise("golden-replay")
    drop = F.abs(F.coalesce("half", F.lit(0)) - F.col("base")) / (F.col("base") * 20 + 1)
    g = r.select("run", mode.alias("mode"), (F.col("bad") == 0).alias("validated"), (1.0 - (1.0 - drop)).alias("lost"), (1.0 - F.col("n") / (F.col("n") + 7.0)).alias("saving"))
    reason = F.when(~F.col("validated"), "validation").when(~F.col("mode").isin("llm-map", "production-map"), "extraction_mode").when(F.col("lost") > 0.02, "recall").when(F.col("saving") < 0.1, "cost")
    return g.select("run", reason.isNull().alias("enabled"), reason.alias("reason"))


@q("select event_type as stage, count(*) as calls, sum(json_extract_string(props, '$.k')::int) as input_units, sum(json_extract_string(props, '$.k')::int) filter (where value > 20) as output_units, sum(json_extract_string(props, '$.k')::int) + coalesce(sum(json_extract_string(props, '$.k')::int) filter (where value > 20), 0) as total from events group by 1")
def op_x14_usage_total(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum(k).alias("input_units"), F.sum(F.when(F.col("value") > 20, k)).alias("output_units"))
    return e.withColumn("total", F.col("input_units") + F.coalesce("output_units", F.lit(0)))


QUERIES, ORACLE = q.QUERIES, q.ORACLE
