"""Queries over texts: lines, passages, titles, tags, links, tokens and generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import outline
from quillspark.queries.fixtures import fixture, table
from quillspark.queries.registry import query


def _notes(spark, d):
    return fixture(spark, d, "fx_notes")


_TAG = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1-\\2', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))"


@query()
def outline_lines(spark, d):
    return outline.outline_lines(_notes(spark, d))


@query(f"with w as (select distinct word from (select unnest(string_split(text, ' ')) as word from documents)) select word, {_TAG.format('word')} as tag from w")
def normalize_tag(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()
    return words.select("word", T.normalize_tag(F.col("word")).alias("tag"))


@query("select record_id, list_sort([lang, 'mixed-case', 'alpha', 'beta-2']) as tags from fx_notes join fx_texts using (record_id)")
def extract_tags(spark, d):
    return _notes(spark, d).select("record_id", T.extract_tags(F.col("text")).alias("tags"))


@query("select record_id, tag from (select record_id, unnest([lang, 'mixed-case', 'alpha', 'beta-2']) as tag from fx_texts)")
def tag_union(spark, d):
    text = F.col("text")
    of_heads = F.transform(F.flatten(F.transform(T.lines(text), T.heading_tags)), T.normalize_tag)
    return _notes(spark, d).select("record_id", F.explode(F.array_union(T.extract_tags(text), of_heads)).alias("tag"))


@query("select record_id, concat('Note ', doc_id) as title from fx_notes union all select message_id, '' from fx_messages")
def title_of(spark, d):
    notes = _notes(spark, d).select("record_id", T.title_of(F.lit("note"), F.col("text")).alias("title"))
    mail = fixture(spark, d, "fx_messages").select("message_id", T.title_of(F.lit("mail-message"), F.col("raw")).alias("title"))
    return notes.union(mail)


@query("select record_id, concat('Note ', doc_id) as short_title from fx_notes")
def short_title(spark, d):
    notes = _notes(spark, d)
    return outline.short_title(outline.outline_lines(notes), notes.select("record_id", T.title_of(F.lit("note"), F.col("text")).alias("title")))


@query("select record_id, tag, case when tag = 'en' then 'session-transcript' else 'note' end as kind from fx_tags")
def kind_for_tags(spark, d):
    tags = fixture(spark, d, "fx_tags")
    return tags.select("record_id", "tag", T.kind_for_tags(F.array(F.when(F.col("tag") == "en", "conversation").otherwise(F.col("tag")))).alias("kind"))


@query("select record_id, name_slug from fx_records")
def name_slug(spark, d):
    return _notes(spark, d).select("record_id", T.name_slug(F.col("text")).alias("name_slug"))


@query("""select record_id, 'record' as target_kind, concat('doc-', (doc_id * 7 + 3) % 300) as target, null as description, cast(strlen(text[:strpos(text, '[[id:') - 1]) as bigint) as span_start,
  cast(strlen(concat('[[id:doc-', (doc_id * 7 + 3) % 300, ']]')) as bigint) as span_len from fx_notes
  union all select record_id, 'name', concat('slug-', (doc_id * 11) % 400), 'words', strlen(text[:strpos(text, '[[slug-') - 1]), strlen(concat('[[slug-', (doc_id * 11) % 400, '][words]]')) from fx_notes
  union all select record_id, 'url', 'https://example.invalid/', null, strlen(text[:strpos(text, '[[https') - 1]), strlen('[[https://example.invalid/]]') from fx_notes""")
def extract_links(spark, d):
    got = outline.extract_links(_notes(spark, d))
    return got.withColumn("span_start", F.col("span_start").cast("long")).withColumn("span_len", F.col("span_len").cast("long"))


@query("""with c as (select record_id, text, strlen(text[:strpos(text, '* First') - 1]) as a, strlen(text[:strpos(text, chr(10) || '* Second')]) as b, strlen(text) as n from fx_notes)
  select record_id, 'section' as level, a::bigint as span_start, (b - a)::bigint as span_len, text[strpos(text, '* First'):strpos(text, chr(10) || '* Second')] as body from c
  union all select record_id, 'section', b::bigint, (n - b)::bigint, text[strpos(text, chr(10) || '* Second') + 1:] from c""")
def passages(spark, d):
    return outline.passages(_notes(spark, d).withColumn("kind", F.lit("note"))).withColumn("span_start", F.col("span_start").cast("long")).withColumn("span_len", F.col("span_len").cast("long"))


@query()
def chunk_spans(spark, d):
    docs = fixture(spark, d, "fx_texts")
    return outline.chunk_spans(docs.select("record_id", F.lit(0).alias("span_start"), F.col("text").alias("body")), 1500)


@query()
def chunk_document(spark, d):
    rows = fixture(spark, d, "fx_texts").select("record_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "unit"))
    return outline.chunk_document(rows.withColumn("title", F.col("record_id")), 2000)


@query("select record_id, sha256(concat('stream/3', chr(10), regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'))) as stream_hash from fx_notes")
def normalize_stream(spark, d):
    return _notes(spark, d).select("record_id", F.sha2(T.normalize_stream(F.lit("note"), F.col("text")), 256).alias("stream_hash"))


@query("select record_id, stream_hash from fx_records")
def content_hash(spark, d):
    return fixture(spark, d, "fx_texts").select("record_id", T.content_hash(F.col("text")).alias("stream_hash"))


@query("""select record_id, regexp_replace(concat('before', chr(10), string_agg(line, chr(10) order by no), chr(10), 'see words and https://example.invalid/'), '\\[\\[id:([^\\]]*)\\]\\]', 'id:\\1') as body from (
    select record_id, no, line from (select t.record_id, unnest(string_split(concat(t.text, chr(10), '[[id:doc-', (t.doc_id * 7 + 3) % 300, ']]'), chr(10))) as line, generate_subscripts(string_split(concat(t.text, chr(10), 'x'), chr(10)), 1) as no from fx_texts t)
    where trim(line) <> '' and not regexp_matches(line, '^\\s*-{5,}\\s*$') and not regexp_matches(line, '^\\*+ ') and not regexp_matches(lower(line), '^#\\+\\w+:') and not regexp_matches(lower(line), '^\\s*(scheduled|deadline|closed):') and not regexp_matches(line, '^\\s*#\\s'))
  group by record_id""")
def body_text(spark, d):
    return outline.body_text(_notes(spark, d), prose=True)


@query("select message_id, sender as from_value, case when (string_split(raw, chr(10)))[2] = 'List-Id: x' then 'x' else '' end as list_id, case when (string_split(raw, chr(10)))[2] = 'X-Note: a' then 'a List-Id: folded' else '' end as note from fx_messages")
def header_value(spark, d):
    raw = F.col("raw")
    return fixture(spark, d, "fx_messages").select("message_id", T.header_value(raw, "from").alias("from_value"), T.header_value(raw, "list-id").alias("list_id"), T.header_value(raw, "x-note").alias("note"))


@query("select message_id, case when (string_split(raw, chr(10)))[2] = 'List-Id: x' then 'list-id' end as signal from fx_messages")
def classify_bulk(spark, d):
    return fixture(spark, d, "fx_messages").select("message_id", T.classify_bulk(F.col("raw")).alias("signal"))


@query("select message_id, case when in_reply_to = '' then '' else in_reply_to end as parent, concat('<', sender, '>') as sender_id from fx_messages")
def bracket_id(spark, d):
    m = fixture(spark, d, "fx_messages")
    return m.select("message_id", T.bracket_id(F.col("in_reply_to")).alias("parent"), T.bracket_id(F.col("sender")).alias("sender_id"))


@query("""select question_id, term_no - 1 as term_no, term from (select item_id as question_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) as term,
  generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), 1) as term_no from benchmark)""")
def query_terms(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.posexplode(T.query_terms(F.col("text"))).alias("term_no", "term")).withColumn("term_no", F.col("term_no").cast("long"))


@query("select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as tokens from documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query()
def rewrite_template(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("What is my "), F.split("text", " ")[0], F.lit(" and how do I read "), F.split("text", " ")[1], F.lit("??")).alias("q"))
    return q.select("item_id", T.rewrite_template(F.col("q")).alias("statement"))


@query("select doc_id, trim(regexp_replace(replace(text, '\"', ''), '\\s+', ' ', 'g')) as clean, trim(text, ' ') as plain from documents")
def clean_completion(spark, d):
    docs = table(spark, d, "documents")
    raw = F.concat(F.lit('<think>skip "this"</think> Rewritten: "'), F.col("text"), F.lit('"'))
    return docs.select("doc_id", T.clean_completion(raw).alias("clean"), T.strip_thinking(F.concat(F.lit("<THINK>a</think>"), F.col("text"), F.lit("<think>never ends"))).alias("plain"))


@query("select doc_id, trim(text, ' ') as plain from documents")
def strip_thinking(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.strip_thinking(F.concat(F.lit("<THINK>a</think>"), F.col("text"), F.lit("<think>never ends"))).alias("plain"))


@query("""with w as (select doc_id as id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') as w from documents),
  g as (select id, unnest([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) as g from w where len(w) >= 36),
  c as (select id, g, count(*) as n from g group by 1, 2), s as (select id, max(n) / sum(n) as share from c group by 1)
  select w.id, coalesce(s.share > 0.25, false) as degenerate from w left join s using (id)""")
def is_degenerate(spark, d):
    return outline.is_degenerate(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("""select doc_id as id, 'questions' as form, no - 1 as no, piece from (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as no from (
    select doc_id, list_filter([trim(regexp_replace(x, '^\\s*(?:[-*+]|\\d+[.)])\\s+', ''), ' ') for x in string_split(text, chr(10))], lambda x: x <> '') as p from documents))
  union all select doc_id, 'summary', 0, trim(text, ' ') from documents""")
def split_generated(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    listed = docs.select("id", F.lit("questions").alias("form"), F.regexp_replace("text", r"(?m)^(?=\S)", "- ").alias("text"))
    got = outline.split_generated(listed.union(docs.select("id", F.lit("summary"), "text")))
    return got.withColumn("no", F.col("no").cast("long"))


@query("select doc_id, concat(' * ', text) as escaped, concat(' #+x: ', lang) as keyword from documents where text not like '%' || chr(10) || '*%' and text not like '%' || chr(10) || '#+%'")
def escape_markup(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.escape_markup(F.concat(F.lit("* "), F.col("text"))).alias("escaped"), T.escape_markup(F.concat(F.lit("#+x: "), F.col("lang"))).alias("keyword"))


@query("select record_id, concat(corpus, '/', record_id) as page, concat('[[', corpus, '/', record_id, '|', translate(title, '|[]', ''), ']]') as link from fx_records")
def page_name(spark, d):
    r = fixture(spark, d, "fx_records")
    page = T.page_name(F.col("corpus"), F.col("record_id"))
    return r.select("record_id", page.alias("page"), T.wikilink(page, F.col("title")).alias("link"))


@query("""select record_id, case when substring(title from 1) is not null then left(concat(title, chr(10), coalesce(p, '')), 500) end as summary from (
    select record_id, 'T' as title, 'before' as p from fx_notes)""")
def summary_body(spark, d):
    rows = outline.outline_lines(_notes(spark, d)).withColumn("title", F.lit("T"))
    return outline.summary_body(rows)


@query("""select record_id, text[strpos(text, '* First'):strpos(text, chr(10) || '* Second')] || chr(10) || text[strpos(text, chr(10) || '* Second') + 1:] as text from fx_notes""")
def record_text(spark, d):
    return outline.record_text(outline.passages(_notes(spark, d).withColumn("kind", F.lit("note"))))


@query("select record_id, left(text, 2000) as shown, text as stripped from fx_texts")
def shown(spark, d):
    docs = fixture(spark, d, "fx_texts")
    drawer = F.concat(F.lit(":PROPERTIES:\n:ID: x\n:END:\n"), F.col("text"))
    return docs.select("record_id", T.shown(F.col("text")).alias("shown"), T.strip_drawer(drawer).alias("stripped"))


@query("""select record_id, concat(':PROPERTIES:', chr(10), ':ID: ', record_id, chr(10), case when project is not null then concat(':PROJECT: ', project, chr(10)) else '' end, ':END:', chr(10), title) as text,
  case when project is not null then concat('{"project":"', project, '"}') end as provenance from fx_records""")
def add_drawer(spark, d):
    r = fixture(spark, d, "fx_records")
    return r.select("record_id", T.add_drawer(F.col("title"), {"ID": F.col("record_id"), "PROJECT": F.col("project")}).alias("text"), T.provenance_json({"project": F.col("project")}).alias("provenance"))


@query("""select record_id, case when project is null and context is null then '' else chr(10) || 'provenance:' || chr(10) || '  ' || concat_ws(chr(10) || '  ', 'project: ' || project, 'context: ' || context, 'domains: ' || concat_ws(', ', project, context)) || chr(10) end as block
  from fx_records""")
def provenance_text(spark, d):
    r = fixture(spark, d, "fx_records")
    return r.select("record_id", T.provenance_text({"project": F.col("project"), "context": F.col("context"), "domains": F.concat_ws(", ", "project", "context"), "model": F.lit(None).cast("string")}).alias("block"))


@query("""select r.record_id, '#+title: ' || title || chr(10) || chr(10) || '* ' || title || chr(10) || ':PROPERTIES:' || chr(10) || ':ID: ' || r.record_id || chr(10) || ':END:' || chr(10) || chr(10) || coalesce(j.joined, '') || chr(10) as document
  from fx_records r left join (select record_id, string_agg(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by no) as joined from (select record_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from fx_texts)
    where regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' group by 1) j using (record_id)""")
def assemble_document(spark, d):
    passages = fixture(spark, d, "fx_texts").select("record_id", F.posexplode(F.split("text", "\n")).alias("span_start", "body"))
    return outline.assemble_document(passages, fixture(spark, d, "fx_records"))


@query("select record_id, project, project is null or trim(project) <> '' as valid, strpos(title || chr(10), chr(10)) = 0 as multi_valid from fx_records")
def validate_provenance(spark, d):
    r = fixture(spark, d, "fx_records")
    return r.select("record_id", "project", T.valid_provenance(F.col("project")).alias("valid"), T.valid_provenance(F.concat("title", F.lit("\n"))).alias("multi_valid"))


@query("""select vec_id, cast(case when vec_id % 2 = 0 then 0.4 else -1.0 end as double) as floor, concat(case when vec_id % 2 = 0 then '' else 'search_query: ' end, record_id) as prefixed from fx_vectors""")
def model_floor(spark, d):
    v = fixture(spark, d, "fx_vectors")
    model = F.when(F.col("vec_id") % 2 == 0, "Qwen3-Embedding-0.6b").otherwise("nomic-embed-text")
    return v.select("vec_id", T.model_floor(model).alias("floor"), T.model_prefix(model, F.col("record_id"), "query").alias("prefixed"))


@query("""select record_id, strftime(to_timestamp(created_s) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as iso, created_s as back, null::bigint as bad from fx_records""")
def epoch_to_iso(spark, d):
    r = fixture(spark, d, "fx_records")
    iso = T.epoch_to_iso(F.col("created_s"))
    return r.select("record_id", iso.alias("iso"), F.unix_timestamp(T.parse_time(iso)).alias("back"), F.unix_timestamp(T.parse_time(F.lit("not a time"))).alias("bad"))


@query("select event_id, case event_type when 'click' then 'database' when 'view' then 'transport' else 'tool' end as kind from events")
def classify_error(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_type") == "click", "Database is LOCKED").when(F.col("event_type") == "view", "connection refused").otherwise("bad argument")
    return e.select("event_id", T.classify_error(text).alias("kind"))


@query("select record_id, concat(':PROPERTIES:', chr(10), ':ID: new-', record_id, chr(10), ':END:', chr(10), ':ID: stays', chr(10), title) as text from fx_records")
def synthesize_submission(spark, d):
    r = fixture(spark, d, "fx_records")
    text = F.concat(F.lit(":PROPERTIES:\n:ID: old\n:END:\n:ID: stays\n"), F.col("title"))
    return r.select("record_id", T.synthesize_submission(text, F.concat(F.lit("new-"), F.col("record_id"))).alias("text"))


@query("select record_id, sha256(replace(text, ':MixedCase:', ':')) as h from fx_notes")
def strip_tags(spark, d):
    notes = fixture(spark, d, "fx_notes")
    return notes.select("record_id", F.sha2(T.strip_tags(F.col("text"), ["mixed-case", "absent"]), 256).alias("h"))


@query()
def place_tags(spark, d):
    n = _notes(spark, d)
    placed = T.place_tags(F.col("text"), F.array(F.lit("added")))
    changed = T.rewrite_tags(placed, lambda t: F.when(t == "MixedCase", "").otherwise(t))
    return n.select("record_id", F.substring_index(changed, "\n* First", 1).alias("head"))


@query("select record_id, coalesce(b, total) as byte_end, a as byte_start from (select record_id, total, a, lead(a) over (partition by record_id order by a) as b from (select record_id, strlen(text) as total, unnest([strlen(text[:strpos(text, '* First') - 1]), strlen(text[:strpos(text, chr(10) || '* Second')])]) as a from fx_notes))")
def span_end(spark, d):
    n = _notes(spark, d)
    heads = outline.outline_lines(n).where("class = 'heading' and heading_level = 1").join(n.select("record_id", F.octet_length("text").alias("total")), "record_id")
    return outline.span_end(heads).select("record_id", F.col("byte_start").cast("long").alias("byte_start"), F.col("byte_end").cast("long").alias("byte_end"))


@query()
def block_state(spark, d):
    return outline.outline_lines(_notes(spark, d)).select("record_id", "line_no", "in_block")


@query("""select record_id, no - 1 as line_no, coalesce(sum(strlen(line) + 1) over (partition by record_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint as byte_start from (
  select record_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from fx_texts)""")
def byte_offsets(spark, d):
    rows = fixture(spark, d, "fx_texts").select("record_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return outline.byte_offsets(rows).select("record_id", F.col("line_no").cast("long").alias("line_no"), F.col("byte_start").cast("long").alias("byte_start"))
