"""Sources, retrieval, evidence, compression, question routing and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sagaspark.functions import text as tx
from sagaspark.plans import retrieval as rt
from sagaspark.queries import evidence
from sagaspark.queries.base import Queries
from sagaspark.sources import books
from sagaspark.streaming import views
from sagaspark.session import table

q = Queries()
DOCS = "docs as (select doc_id, text from documents where text is not null)"


def docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


@q()
def op_a3_html_text(spark, d):
    return docs(spark, d).where(F.col("text").contains("<")).select("doc_id", F.length(tx.html_to_text("text")).alias("n"))


@q()
def op_a4_chapter_split(spark, d):
    return books.split_chapters(docs(spark, d), "doc_id", "text")


@q("select chapter_id, max(volume_title) over (partition by book_id, volume_ordinal) as volume from chapters")
def op_a5_volume_titles(spark, d):
    return table(spark, d, "chapters").select("chapter_id", F.max("volume_title").over(Window.partitionBy("book_id", "volume_ordinal")).alias("volume"))


_TOC = "l as (select doc_id, unnest(string_split(text, chr(10))) as line from docs), f as (select doc_id, count(*) filter (where trim(line) <> '') as n, count(*) filter (where length(line) <= 40 and regexp_matches(line, '^(第.{1,9}[章回]|Chapter )')) as t from l group by 1)"


@q(f"with {DOCS}, {_TOC} select doc_id, n, t from f where n >= 3 and t / n >= 0.6")
def op_a6_toc_pages(spark, d):
    lines = F.split("text", "\n")
    n = F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long")
    t = F.size(F.filter(lines, lambda x: (F.length(x) <= 40) & x.rlike("^(第.{1,9}[章回]|Chapter )"))).cast("long")
    return docs(spark, d).select("doc_id", n.alias("n"), t.alias("t")).where("n >= 3 and t / n >= 0.6")


@q("select book_id, ordinal, chapter_id from (select *, row_number() over (partition by book_id, ordinal order by chapter_id) as rn from chapters) where rn = 1 and not (book_id, coalesce(ordinal, -1)) in (select (book_id, coalesce(ordinal, -1)) from chapters where volume_ordinal = 0)")
def op_a7_import_new(spark, d):
    c = table(spark, d, "chapters")
    return books.new_rows(c, c.where("volume_ordinal = 0"), ["book_id", "ordinal"], "chapter_id").select("book_id", "ordinal", "chapter_id")


@q("select event_type, count(*) as n, sum(json_extract_string(props, '$.k')::int) as total from events group by 1")
def op_a8_staged_json(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@q("select 'claims' as name, count(*) as n from claims union all select 'chapters', count(*) from chapters union all select 'documents', count(*) from documents union all select 'raw_chunks', count(*) from raw_chunks")
def op_a12_snapshot_counts(spark, d):
    out = None
    for t in ("claims", "chapters", "documents", "raw_chunks"):
        one = table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@q("select chapter_id, book_id, ordinal from chapters")
def op_a16_list_chapters(spark, d):
    return table(spark, d, "chapters").select("chapter_id", "book_id", "ordinal")


@q("select doc_id, substring(text, 6, 30) as slice from documents where text is not null")
def op_a17_text_slice(spark, d):
    return docs(spark, d).select("doc_id", F.substring("text", 6, 30).alias("slice"))


@q(f"with {DOCS}, s as (select doc_id, length(text) as n, unnest(generate_series(0, cast(greatest(0, ceil((length(text) - 300) / 255.0)) as bigint) * 255, 255)) as w_start from docs) select doc_id, w_start, least(w_start + 300, n) as w_end from s")
def op_i1_token_windows(spark, d):
    return rt.windows(docs(spark, d).select("doc_id", F.length("text").alias("n")), F.col("n"), 300, 0.15).select("doc_id", "w_start", "w_end")


#: Terms in SQL: runs of Han characters are set apart by blanks, then each gives its pairs, any other run itself.
_T = r"flatten(list_transform(regexp_extract_all(regexp_replace(lower({}), '(\p{{Han}}+)', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: case when regexp_matches(w, '^\p{{Han}}{{2}}') then list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) else [w] end))"
_NFC = "nfc_normalize(replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10)))"
_ASK = f"asked as (select doc_id as qid, {_NFC.format('qt')} as qt from (select doc_id, trim(coalesce(case when trim(title) <> '' then title end, regexp_extract(text, '([^。！？!?\\n]+[。！？!?\\n]*)', 1))) as qt from documents where doc_id % 100 = 0) where qt <> '')"
_NDOCS = f"nd as (select doc_id, {_NFC.format('text')} as text from documents where text is not null)"


def _asked(spark, d):
    """The stated query set: the title, or without one the first sentence, of every row whose id is divisible by 100."""
    x = table(spark, d, "documents").where("doc_id % 100 = 0")
    title = F.when(F.trim("title") != "", F.col("title"))
    return x.select(F.col("doc_id").alias("qid"), tx.normalise(F.trim(F.coalesce(title, F.get(tx.sentences(F.col("text")), F.lit(0))))).alias("qt")).where("qt != ''")


def _normal_docs(spark, d):
    return docs(spark, d).select("doc_id", tx.normalise("text").alias("text"))


@q(f"with {_NDOCS} select doc_id, array_to_string({_T.format('text')}, ' ') as segmented from nd")
def op_i4_segmented_text(spark, d):
    """The column that full text is searched in: words of all scripts, pairs of Han characters."""
    return _normal_docs(spark, d).select("doc_id", F.array_join(rt.terms(F.col("text")), " ").alias("segmented"))


@q(f"select item_id, len({_T.format(_NFC.format('text'))}) as terms, len(list_distinct({_T.format(_NFC.format('text'))})) as different from eval_items where text is not null")
def op_i5_query_terms(spark, d):
    w = rt.terms(tx.normalise("text"))
    return table(spark, d, "eval_items").where("text is not null").select("item_id", F.size(w).cast("long").alias("terms"), F.size(F.array_distinct(w)).cast("long").alias("different"))


_BM = f"""{_NDOCS}, {_ASK}, w as (select doc_id, {_T.format('text')} as ws from nd), st as (select count(*) as n, avg(len(ws)) as avgdl from w),
t as (select doc_id, len(ws) as dl, unnest(ws) as term from w), p as (select term, doc_id, any_value(dl) as dl, count(*) as tf from t group by 1, 2),
qs as (select distinct qid, unnest({_T.format('qt')}) as term from asked), need as (select qid, count(*) as need from qs group by 1),
h as (select * from p join qs using (term)), df as (select qid, term, count(*) as df from h group by 1, 2),
sc as (select qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score, count(*) as got from h join df using (qid, term) cross join st group by 1, 2)"""


def full_text(spark, d):
    """Every hundredth row against all rows, in all scripts: qid, doc_id, score of documents that hold all terms."""
    x = _normal_docs(spark, d).select("doc_id", rt.terms(F.col("text")).alias("ws"))
    stats = x.agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("avgdl"))
    qs = _asked(spark, d).select("qid", F.explode(rt.terms(F.col("qt"))).alias("term")).distinct()
    # Only the terms asked for are shuffled, each with its document's whole length.
    tf = x.select("doc_id", F.size("ws").alias("dl"), F.explode("ws").alias("term")).join(qs.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    return rt.bm25(tf, stats, qs, "doc_id")


@q(f"with {_BM} select qid, doc_id, rank from (select qid, doc_id, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as rank from sc join need using (qid) where got = need) where rank <= 20")
def op_i6_full_text(spark, d):
    s = full_text(spark, d).withColumn("score", F.round("score", 6))
    return rt.top(s, ["qid"], [F.desc("score"), "doc_id"], 20).select("qid", "doc_id", "rank")


@q(f"with {_NDOCS}, {_ASK} select qid, doc_id from nd join asked on contains(lower(text), lower(qt))")
def op_i7_substring_search(spark, d):
    """Every hundredth row's text in all rows. A text is looked up by the rarest of its runs of three characters, so that
    texts and questions meet by a key; then the whole is compared."""
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(F.col(c), i, F.lit(3))))
    qs = _asked(spark, d).select("qid", F.lower("qt").alias("qt"))
    x = _normal_docs(spark, d).select("doc_id", F.lower("text").alias("text"))
    mine = qs.select("qid", "qt", F.explode(runs("qt")).alias("k"))
    seen = x.select("doc_id", F.explode(runs("text")).alias("k")).join(mine.select("k").distinct(), "k", "left_semi")
    held = seen.groupBy("k").agg(F.count("*").alias("n"))
    # What is shorter than a run has itself for a key, which only texts as short have: it is compared with all texts.
    key = mine.where("length(qt) >= 3").join(held, "k").groupBy("qid", "qt").agg(F.min_by("k", F.struct("n", "k")).alias("k"))
    long_ = seen.join(key, "k").join(x, "doc_id").where(F.contains("text", "qt")).select("qid", "doc_id")
    short = x.join(qs.where("length(qt) < 3"), F.contains("text", "qt")).select("qid", "doc_id")
    return long_.unionByName(short)


@q("select query_id, raw_chunk_id, row_number() over (partition by query_id order by grp, raw_chunk_id) as pos from (select query_id, raw_chunk_id, min(case route when 'fts' then 0 else 1 end) as grp from search_hits where route in ('fts', 'trigram') group by 1, 2)")
def op_i8_candidate_merge(spark, d):
    h = table(spark, d, "search_hits").where("route in ('fts', 'trigram')").groupBy("query_id", "raw_chunk_id").agg(F.min(F.when(F.col("route") == "fts", 0).otherwise(1)).alias("grp"))
    return h.select("query_id", "raw_chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("grp", "raw_chunk_id")).alias("pos"))


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@q(f"with s as (select a.vec_id as query, b.vec_id as item, round({_COS}, 6) as score from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and a.label = b.label) select query, item, rank from (select *, row_number() over (partition by query order by score desc, item) as rank from s) where rank <= 10")
def op_i9_vector_top(spark, d):
    # The query set is every hundredth vector, held against all vectors of its label, which stands for the book.
    e = table(spark, d, "embeddings")
    a = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("x"), "label")
    s = e.join(a, "label").where("query != vec_id").select("query", F.col("vec_id").alias("item"), F.round(rt.cosine(F.col("x"), F.col("embedding")), 6).alias("score"))
    return rt.top(s, ["query"], [F.desc("score"), "item"], 10).select("query", "item", "rank")


_RANKED = "l as (select query_id, route, raw_chunk_id, row_number() over (partition by query_id, route order by score desc, raw_chunk_id) as r from (select query_id, route, raw_chunk_id, max(score) as score from search_hits where score is not null group by 1, 2, 3))"


def ranked(spark, d):
    h = table(spark, d, "search_hits").where("score is not null and not isnan(score)").groupBy("query_id", "route", "raw_chunk_id").agg(F.max("score").alias("score"))
    return h.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "route").orderBy(F.desc("score"), "raw_chunk_id")))


@q(f"with {_RANKED} select query_id, raw_chunk_id, round(sum(1.0 / (60 + r)), 8) as score from l group by 1, 2")
def op_i12_rrf(spark, d):
    return rt.rrf(ranked(spark, d), "query_id", "raw_chunk_id", "r").withColumn("score", F.round("score", 8))


@q(f"with {_RANKED}, f as (select query_id, raw_chunk_id, round(sum(1.0 / (60 + r)), 8) as score from l where r <= 32 group by 1, 2) select query_id, raw_chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, raw_chunk_id) as rank from f) where rank <= 8")
def op_i13_hybrid(spark, d):
    f = rt.rrf(ranked(spark, d).where("r <= 32"), "query_id", "raw_chunk_id", "r").withColumn("score", F.round("score", 8))
    return rt.top(f, ["query_id"], [F.desc("score"), "raw_chunk_id"], 8).select("query_id", "raw_chunk_id", "rank")


@q("select distinct query_id, h.raw_chunk_id, source_chapter_id, observed_ordinal from search_hits h join (select distinct raw_chunk_id, source_chapter_id, observed_ordinal from raw_chunks) using (raw_chunk_id)".replace("h.raw_chunk_id", "raw_chunk_id"))
def op_i15_hydrate(spark, d):
    c = table(spark, d, "raw_chunks").select("raw_chunk_id", "source_chapter_id", "observed_ordinal").distinct()
    return table(spark, d, "search_hits").select("query_id", "raw_chunk_id").distinct().join(c, "raw_chunk_id").select("query_id", "raw_chunk_id", "source_chapter_id", "observed_ordinal")


@q("select label, count(*) as n, count(*) filter (where len(embedding) = 64) as right_size from embeddings group by 1")
def op_i16_dimension_check(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.size("embedding") == 64, 1)).alias("right_size"))


@q("select source_chapter_id, count(distinct chunking_version) as versions, max(chunking_version) as active from raw_chunks group by 1")
def op_i17_index_switch(spark, d):
    return table(spark, d, "raw_chunks").groupBy("source_chapter_id").agg(F.countDistinct("chunking_version").alias("versions"), F.max("chunking_version").alias("active"))


@q("select doc_id, nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as text from documents where text is not null")
def op_j1_normalise(spark, d):
    return docs(spark, d).select("doc_id", tx.normalise("text").alias("text"))


@q("select doc_id, sha256(text) as content_hash from documents where text is not null")
def op_j2_content_hash(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"))


@q("select doc_id, len(regexp_extract_all(text, '[^。！？!?\\n]+[。！？!?\\n]*')) as sentences from documents where text is not null")
def op_j4_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"))


@q("select raw_chunk_id, token_start, lead(token_start) over (partition by source_chapter_id, chunking_version order by token_start, raw_chunk_id) as next_start from (select distinct raw_chunk_id, source_chapter_id, chunking_version, token_start from raw_chunks)")
def op_j10_ref_mapping(spark, d):
    c = table(spark, d, "raw_chunks").select("raw_chunk_id", "source_chapter_id", "chunking_version", "token_start").distinct()
    w = Window.partitionBy("source_chapter_id", "chunking_version").orderBy("token_start", "raw_chunk_id")
    return c.select("raw_chunk_id", "token_start", F.lead("token_start").over(w).alias("next_start"))


_LIT = "l as (select claim_version_id, value is not null and raw_value is not null and contains(regexp_replace(raw_value, '[\\s?!.,]+', '', 'g'), regexp_replace(value, '[\\s?!.,]+', '', 'g')) as ok, field from state_payloads)"


@q(f"with {_LIT} select field, count(*) as n, count(*) filter (where ok) as literal from l group by 1")
def op_j14_literal_verifier(spark, d):
    bare = lambda c: F.regexp_replace(c, r"[\s?!.,]+", "")
    ok = F.col("value").isNotNull() & F.col("raw_value").isNotNull() & bare("raw_value").contains(bare("value"))
    return table(spark, d, "state_payloads").groupBy("field").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("literal"))


@q("select distinct c.claim_version_id, case when h.chapter_id is null then 'ref_missing' else 'aligned' end as result from claims c left join chapters h on h.chapter_id = c.observed_chapter_id".replace("c.claim_version_id,", "claim_version_id,"))
def op_j15_align(spark, d):
    h = table(spark, d, "chapters").select(F.col("chapter_id").alias("observed_chapter_id"), F.lit(True).alias("found")).distinct()
    return table(spark, d, "claims").join(h, "observed_chapter_id", "left").select("claim_version_id", F.when(F.col("found"), "aligned").otherwise("ref_missing").alias("result")).distinct()


#: Numbers and times that a shortened text must keep.
NUMBER = "[0-9０-９零〇一二两三四五六七八九十百千万亿]+"
TIME = "[0-9]{1,4}年|[0-9]{1,2}月|[0-9]{1,2}日|[0-9]{1,2}时|[0-9]{1,2}刻|[零一二三四五六七八九十百]+年|[上下]午|清晨|黄昏|深夜|拂晓"
_CHUNKS = "ch as (select distinct raw_chunk_id, content from raw_chunks where content is not null)"
_KEEP = f"""{_CHUNKS}, num as (select distinct unnest(regexp_extract_all(content, '{NUMBER}')) as term from ch), tim as (select distinct unnest(regexp_extract_all(content, '{TIME}')) as term from ch),
bi as (select unnest(list_transform(range(1, length(content)), lambda i: substring(content, i, 2))) as term from ch where length(content) > 1),
fr as (select term from (select term, row_number() over (order by count(*) desc, term) as rn from bi where regexp_matches(term, '[一-鿿]') and not regexp_full_match(term, '{NUMBER}') group by 1 having count(*) >= 3) where rn <= 100),
keep as (select 'number' as kind, term from num where length(term) <= 12 union all select 'time', term from tim union all select 'frequent', term from fr union all select 'name', term from (select canonical_name as term from entity_records union select trim(surface_name, ' ') from alias_claims) where length(term) >= 2)"""


def chunk_texts(spark, d):
    return table(spark, d, "raw_chunks").where("content is not null").select("raw_chunk_id", "content").distinct()


def frequent_pairs(spark, d):
    """The hundred most frequent pairs of neighbouring characters with a Han character in them, over all texts."""
    c = chunk_texts(spark, d).where("length(content) > 1")
    b = c.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("content") - 1), lambda i: F.substring(F.col("content"), i, F.lit(2)))).alias("term"))
    n = b.where(F.col("term").rlike("[一-鿿]") & ~F.col("term").rlike(f"^(?:{NUMBER})$")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 3")
    return n.orderBy(F.desc("n"), "term").limit(100).select("term")


@q(f"with {_KEEP} select kind, term from keep")
def op_p1_keep_dictionary(spark, d):
    """What must be kept word for word: names, numbers, times, frequent pairs."""
    c = chunk_texts(spark, d)
    found = lambda kind, p: c.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(0))).alias("term")).distinct()
    names = table(spark, d, "entity_records").select(F.lit("name").alias("kind"), F.col("canonical_name").alias("term")).union(table(spark, d, "alias_claims").select(F.lit("name"), F.trim("surface_name"))).where("length(term) >= 2").distinct()
    return found("number", NUMBER).where("length(term) <= 12").union(found("time", TIME)).union(frequent_pairs(spark, d).select(F.lit("frequent"), "term")).union(names)


_SEG = f"{_KEEP}, f as (select list(term) as fs from fr), s as (select raw_chunk_id, unnest(list_filter(string_split(content, chr(10) || chr(10)), lambda x: trim(x) <> '')) as seg from ch), k as (select raw_chunk_id, seg, regexp_matches(seg, '{NUMBER}') or regexp_matches(seg, '{TIME}') or len(list_filter(fs, lambda x: contains(seg, x))) > 0 or exists (select 1 from keep where kind = 'name' and contains(seg, keep.term)) as kept from s cross join f)"


def kept_segments(spark, d):
    """Paragraphs of all texts and whether they hold anything that must be kept. Names meet paragraphs by their first two
    characters; the frequent pairs are at most a hundred and go along as one row."""
    s = chunk_texts(spark, d).select("raw_chunk_id", F.explode(F.filter(F.split("content", "\n\n"), lambda x: F.regexp_replace(x, "^ +| +$", "") != "")).alias("seg")).withColumn("id", F.xxhash64("raw_chunk_id", "seg"))
    few = F.broadcast(frequent_pairs(spark, d).agg(F.collect_list("term").alias("fs")))
    s = s.join(few).withColumn("plain", F.col("seg").rlike(NUMBER) | F.col("seg").rlike(TIME) | F.exists("fs", lambda x: F.contains(F.col("seg"), x))).drop("fs")
    names = table(spark, d, "entity_records").select(F.col("canonical_name").alias("term")).union(table(spark, d, "alias_claims").select(F.trim("surface_name"))).where("length(term) >= 2").distinct().withColumn("k", F.substring("term", 1, 2))
    rest = s.where("not plain and length(seg) >= 2").select("id", "seg").distinct()
    pairs = rest.select("id", "seg", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("seg") - 1), lambda i: F.substring(F.col("seg"), i, F.lit(2))))).alias("k"))
    named = pairs.join(names, "k").where(F.contains("seg", "term")).select("id", F.lit(True).alias("named")).distinct()
    return s.join(named, "id", "left").select("raw_chunk_id", "seg", (F.col("plain") | F.coalesce("named", F.lit(False))).alias("kept"))


@q(f"with {_SEG} select raw_chunk_id, count(*) as segments, count(*) filter (where kept) as kept from k group by 1")
def op_p2_keep_drop(spark, d):
    return kept_segments(spark, d).groupBy("raw_chunk_id").agg(F.count("*").alias("segments"), F.count(F.when(F.col("kept"), 1)).alias("kept"))


_COVER = "case when len(list_distinct(regexp_extract_all(seg, '{p}'))) = 0 then 1.0 else len(list_filter(list_distinct(regexp_extract_all(seg, '{p}')), lambda t: contains(short, t))) / len(list_distinct(regexp_extract_all(seg, '{p}')))::double end"


@q(f"with {_SEG}, o as (select raw_chunk_id, seg, kept, substring(seg, 1, (length(seg) * 4) // 5) as short from k), c as (select *, {_COVER.format(p=NUMBER)} as numbers, {_COVER.format(p=TIME)} as times from o where kept) select raw_chunk_id, count(*) as segments, count(*) filter (where numbers < 0.9 or times < 0.9) as restored, round(avg(numbers), 6) as number_coverage, count(*) filter (where numbers < 0.9 or times < 0.9) = 0 as passed from c group by 1")
def op_p3_post_validation(spark, d):
    """Shortened paragraphs (here: their first four fifths) against the originals: each must hold nine tenths of the numbers and
    of the times, or the original comes back."""
    def cover(p):
        all_ = F.array_distinct(F.regexp_extract_all("seg", F.lit(p), F.lit(0)))
        return F.when(F.size(all_) == 0, 1.0).otherwise(F.size(F.filter(all_, lambda t: F.contains(F.col("short"), t))) / F.size(all_))

    o = kept_segments(spark, d).where("kept").withColumn("short", F.expr("substring(seg, 1, (length(seg) * 4) div 5)"))
    c = o.select("raw_chunk_id", cover(NUMBER).alias("numbers"), cover(TIME).alias("times"))
    bad = F.count(F.when((F.col("numbers") < 0.9) | (F.col("times") < 0.9), 1))
    return c.groupBy("raw_chunk_id").agg(F.count("*").alias("segments"), bad.alias("restored"), F.round(F.avg("numbers"), 6).alias("number_coverage"), (bad == 0).alias("passed"))


@q(f"with {_SEG} select raw_chunk_id, round(sum(case when kept then length(seg) else 0 end)::double / sum(length(seg)), 6) as retention, 'cmp_' || substring(sha256(string_agg(case when kept then sha256(seg) else '' end, '' order by seg)), 1, 16) as version from k group by 1")
def op_p5_retention(spark, d):
    """Share of each text that is kept, and a version from what is kept."""
    s = kept_segments(spark, d)
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.when(F.col("kept"), F.sha2("seg", 256)).otherwise("").alias("h")))), lambda x: x.h), "")
    return s.groupBy("raw_chunk_id").agg(F.round(F.sum(F.when(F.col("kept"), F.length("seg")).otherwise(0)) / F.sum(F.length("seg")), 6).alias("retention"), F.concat(F.lit("cmp_"), F.substring(F.sha2(kept, 256), 1, 16)).alias("version"))


@q("select item_id, trim(regexp_replace(translate(text, '，。？！：；', ',.?!:;'), '\\s+', ' ', 'g')) as question from eval_items")
def op_r1_normalise_query(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.trim(F.regexp_replace(F.translate("text", "，。？！：；", ",.?!:;"), r"\s+", " ")).alias("question"))


#: Kinds of question and their keywords, in order; the first keyword found decides.
RULES = [
    ("plotline", "主线 概要 总结 概述 总体 梗概 全书讲了 剧情走向"), ("raw_detail", "原文 原话 怎么说 写道 说了什么 那句话"), ("chapter_graph", "第 章发生 章讲了 这章 本章 那一章 章剧情 哪一章 第几章"),
    ("term_definition", "什么是 术语 含义 意思 解释 何为 名词"), ("causal_chain", "为什么 导致 因为 所以 结果 起因 缘由 因果 引发"), ("relation_evolution", "如何变化 演变 变化过程 从什么 变成 什么时候开始"),
    ("org_membership", "势力 宗门 家族 加入 成员 组织 派系 招收"), ("relation", "关系 师徒 夫妻 父子 母子 父女 母女 兄弟 姐妹 恋人 敌人 盟友 同门 主仆 宿敌 门下"),
    ("entity_state", "修为 境界 实力 状态 身份 真名 在哪 位置 拥有 活着 是谁 目前 现在"), ("raw_detail", "细节 具体 内容"),
]
_CASE = " ".join(f"when regexp_matches(text, '{w.replace(' ', '|')}') then '{t}'" for t, w in RULES)
_ASKED_ALL = "asked as (select 'item ' || item_id as id, text from eval_items where text is not null union all select 'chapter ' || chapter_id, title from chapters where title is not null)"


@q(f"with {_ASKED_ALL} select id, case {_CASE} else 'raw_detail' end as query_type, case {_CASE} else '' end = '' as fallback from asked")
def op_r2_route(spark, d):
    """Kind of each question, by the first rule that has one of its keywords in it."""
    i = table(spark, d, "eval_items").where("text is not null").select(F.concat(F.lit("item "), "item_id").alias("id"), "text")
    x = i.union(table(spark, d, "chapters").where("title is not null").select(F.concat(F.lit("chapter "), "chapter_id"), "title"))
    c = None
    for kind, keywords in RULES:
        hit = F.col("text").rlike(keywords.replace(" ", "|"))
        c = F.when(hit, kind) if c is None else c.when(hit, kind)
    return x.select("id", F.coalesce(c, F.lit("raw_detail")).alias("query_type"), c.isNull().alias("fallback"))


@q(f"with {evidence._KNOWN_NAMES} select item_id, arg_max(name, struct_pack(l := length(name), n := name)) as name, count(*) as names from eval_items join names on contains(text, name) group by 1")
def op_r3_entity_in_question(spark, d):
    """The longest name told by the cutoff that a question holds."""
    n = evidence.names_in_questions(spark, d)
    return n.groupBy("item_id").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"), F.count("*").alias("names"))


@q()
def op_r4_chapter_number(spark, d):
    return table(spark, d, "chapters").select("chapter_id", tx.chapter_number_of("title").alias("number"))


@q("select book_id, sha256(string_agg(r, ',' order by r)) as signature from (select distinct book_id, created_by_run_id as r from claims where created_by_run_id is not null) group by 1")
def op_r6_state_signature(spark, d):
    r = table(spark, d, "claims").where("created_by_run_id is not null").select("book_id", F.col("created_by_run_id").alias("r")).distinct()
    return r.groupBy("book_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), ","), 256).alias("signature"))


@q(f"with {_RANKED} select query_id, string_agg(raw_chunk_id, ';' order by r) as answer, sha256(string_agg(raw_chunk_id, ';' order by r)) as context_hash from l where route = 'fts' and r <= 5 group by 1")
def op_r7_answer(spark, d):
    top = ranked(spark, d).where("route = 'fts' and r <= 5").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "raw_chunk_id"))), lambda x: x.raw_chunk_id), ";").alias("answer"))
    return top.withColumn("context_hash", F.sha2("answer", 256))


@q()
def op_s1_rate_limiter(spark, d):
    return views.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", per=3600.0, most=1)


@q("select user_id, event_type, max(event_id) as event_id from events group by 1, 2")
def op_s5_current_view(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    half = e.where("event_id % 2 = 0")
    view = views.upsert_latest(half, None, ["user_id", "event_type"], "event_id")
    return views.upsert_latest(e, view, ["user_id", "event_type"], "event_id")


QUERIES, ORACLE = q.QUERIES, q.ORACLE
