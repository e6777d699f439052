"""Queries of table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import durable as D
from quillspark.operators import maintenance as M
from quillspark.operators import outline
from quillspark.plans.staging import shared_dir
from quillspark.plans.versions import Versions
from quillspark.queries.fixtures import fixture, table
from quillspark.queries.registry import query


def _old(spark, d):
    return fixture(spark, d, "fx_records")


def _new(spark, d):
    return fixture(spark, d, "fx_new_records")


@query("""select coalesce(n.record_id, r.record_id) as record_id, coalesce(n.stream_hash, r.stream_hash) as stream_hash, coalesce(n.title, r.title) as title, r.created_s, coalesce(n.updated_s, r.updated_s) as updated_s,
  n.record_id is not null and r.record_id is not null as superseded, r.project from fx_records r full outer join fx_new_records n using (record_id)""")
def upsert_records(spark, d):
    return M.upsert_records(_old(spark, d), _new(spark, d)).select("record_id", "stream_hash", "title", "created_s", "updated_s", "superseded", "project")


def _store(spark, **tables):
    """A folder of versioned tables dealt by record."""
    store = Versions(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
    with store.change() as c:
        for name, df in tables.items():
            c.put(name, df, "record_id", 16)
    return store


@query("""select coalesce(n.record_id, r.record_id) as record_id, coalesce(n.stream_hash, r.stream_hash) as stream_hash, coalesce(n.title, r.title) as title, r.created_s, coalesce(n.updated_s, r.updated_s) as updated_s, r.project
  from fx_records r full outer join fx_new_records n using (record_id)""")
def put_records(spark, d):
    """The same, written to the stored records."""
    store = _store(spark, records=_old(spark, d))
    D.put_records(store, _new(spark, d))
    return store.read("records").select("record_id", "stream_hash", "title", "created_s", "updated_s", "project")


_GONE = "record_id in (select concat('doc-', doc_id) from documents where doc_id % 9 = 0)"


@query(f"select 'links' as tbl, record_id from fx_links where not {_GONE} union all select 'tags', record_id from fx_tags where not {_GONE} union all select 'records', record_id from fx_records where not {_GONE}")
def forget(spark, d):
    ids = table(spark, d, "documents").where("doc_id % 9 = 0").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"))
    got = M.forget(ids, links=fixture(spark, d, "fx_links"), tags=fixture(spark, d, "fx_tags"), records=_old(spark, d))
    part = lambda n: got[n].select(F.lit(n).alias("tbl"), "record_id")
    return part("links").union(part("tags")).union(part("records"))


def _spans(spark, d):
    v = fixture(spark, d, "fx_vectors")
    p = v.groupBy("record_id").agg((F.max("span_start") / 2).cast("long").alias("half")).select("record_id", F.lit(0).cast("long").alias("span_start"), F.col("half").alias("span_len"))
    return v, p


_HALF = "p as (select record_id, 0 as s, (max(span_start) // 2) as n from fx_vectors group by 1)"


@query(f"with {_HALF} select distinct v.record_id, v.span_start, v.span_len from fx_vectors v join p using (record_id) where v.span_start + v.span_len <= n")
def embedded_spans(spark, d):
    return M.embedded_spans(*_spans(spark, d))


@query(f"with {_HALF} select v.vec_id from fx_vectors v join p using (record_id) where v.span_start + v.span_len > n")
def orphan_vectors(spark, d):
    return M.orphan_vectors(*_spans(spark, d)).select("vec_id")


_SURVEY = """sv as (select coalesce(n.record_id, r.record_id) as record_id, case when r.record_id is null then 'missing' when n.record_id is null then 'orphaned' when n.stream_hash <> r.stream_hash then 'stale' else 'ok' end as status
  from fx_new_records n full outer join fx_records r using (record_id))"""


@query(f"with {_SURVEY} select * from sv")
def survey(spark, d):
    return M.survey(_new(spark, d), _old(spark, d))


@query(f"with {_SURVEY} select count_if(status = 'missing') as missing, count_if(status = 'stale') as stale, count_if(status = 'orphaned') as orphaned, count_if(status = 'ok') as ok, count_if(status <> 'ok') = 0 as clean from sv")
def survey_report(spark, d):
    return M.survey_report(M.survey(_new(spark, d), _old(spark, d)))


@query(f"with {_SURVEY} select record_id from sv where status in ('missing', 'stale')")
def repairable(spark, d):
    return M.repairable(M.survey(_new(spark, d), _old(spark, d)))


@query("select record_id, case when doc_id % 3 = 0 then 'identical' when doc_id % 3 = 1 then 'version' else 'content' end as status from fx_texts")
def deep_survey(spark, d):
    t = fixture(spark, d, "fx_texts").withColumn("kind", F.lit("note"))
    now = T.normalize_stream(F.lit("note"), F.col("text"))
    stream = F.when(F.col("doc_id") % 3 == 0, now).when(F.col("doc_id") % 3 == 1, F.regexp_replace(now, r"\Astream/3", "stream/2")).otherwise(F.concat(now, F.lit("!")))
    return M.deep_survey(t, t.select("record_id", stream.alias("stream")))


@query("select distinct record_id from fx_new_records where record_id not in (select record_id from fx_records)")
def missing_ids(spark, d):
    return M.missing_ids(_new(spark, d), _old(spark, d))


def _chunks(spark, d):
    t = fixture(spark, d, "fx_texts")
    c = outline.chunk_spans(t.select("record_id", F.lit(0).alias("span_start"), F.col("text").alias("body")), 1500)
    body = F.substring(F.encode("text", "UTF-8"), F.col("span_start").cast("int") + 1, F.col("span_len").cast("int")).cast("string")
    rows = c.join(t.select("record_id", "stream_hash", "text"), "record_id").select("stream_hash", "span_start", "span_len", body.alias("body")).dropDuplicates(["stream_hash", "span_start", "span_len"])
    have = rows.where("span_start = 0").select("stream_hash", "span_start", "span_len", F.lit("m").alias("model"))
    return rows, have


@query()
def spans_to_embed(spark, d):
    return M.spans_to_embed(*_chunks(spark, d), "m").select("stream_hash", "span_start", "span_len")


@query()
def embed_missing(spark, d):
    """Into stored vectors, slice by slice; the rows it added."""
    rows, have = _chunks(spark, d)
    store = Versions(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
    with store.change() as c:
        c.put("vectors", have.select("stream_hash", "span_start", "span_len", F.array().cast("array<float>").alias("vector"), "model"))
    D.embed_missing(store, rows, "m", M.hashing_embedder(), slices=4)
    return store.read("vectors").where("size(vector) > 0")


def _artifacts(spark, d):
    return fixture(spark, d, "fx_texts").where("doc_id % 4 = 0").select("stream_hash", F.lit("g1").alias("generator"), F.when(F.col("doc_id") % 8 == 0, "p1").otherwise("p2").alias("prompt"), F.concat(F.lit("about "), F.col("lang")).alias("artifact"))


_HAVE = "h as (select distinct stream_hash from fx_texts where doc_id % 8 = 0)"


@query(f"with {_HAVE}, asked as (select record_id from fx_texts where doc_id % 2 = 0 union all select 'doc-none') select a.record_id, t.stream_hash, case when t.record_id is null then 'unknown' when h.stream_hash is not null then 'reused' else 'to_generate' end as status from asked a left join fx_texts t using (record_id) left join h using (stream_hash)")
def artifacts_to_generate(spark, d):
    ids = fixture(spark, d, "fx_texts").where("doc_id % 2 = 0").select("record_id").union(spark.createDataFrame([("doc-none",)], "record_id string"))
    return M.artifacts_to_generate(_old(spark, d), _artifacts(spark, d), "g1", "p1", ids)


@query(f"with {_HAVE} select stream_hash, concat('len ', length(left(any_value(text), 6000))) as artifact from fx_texts where stream_hash not in (select stream_hash from h) group by stream_hash")
def generate_missing(spark, d):
    def generator(batches):
        for pdf in batches:
            yield pdf.assign(artifact=[f" len {len(t)} " for t in pdf.text])[["stream_hash", "artifact"]]

    store = Versions(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
    with store.change() as c:
        c.put("artifacts", _artifacts(spark, d))
    plan = lambda have: M.artifacts_to_generate(_old(spark, d), have, "g1", "p1")
    D.generate_missing(store, plan, fixture(spark, d, "fx_texts"), generator, "g1", "p1", slices=4)
    return store.read("artifacts").where("artifact like 'len %'").select("stream_hash", "artifact")


@query("select r.record_id, 'g1' as generator, case when t.doc_id % 8 = 0 then 'p1' else 'p2' end as prompt, concat('about ', t.lang) as artifact from fx_records r join fx_texts t using (stream_hash) where t.doc_id % 4 = 0")
def generated_for(spark, d):
    return M.generated_for(_old(spark, d), _artifacts(spark, d))


@query("select r.record_id, r.stream_hash as expected_hash, coalesce(n.stream_hash, '') as current_hash from fx_records r left join fx_new_records n using (record_id) where r.stream_hash <> coalesce(n.stream_hash, '')")
def drift(spark, d):
    return M.drift(_old(spark, d).select("record_id", F.col("stream_hash").alias("expected_hash")), _new(spark, d))


@query("select record_id as page, case when doc_id % 10 = 0 then 'written' when doc_id % 7 = 0 then 'hand_edited' when doc_id % 11 = 0 then 'orphaned' when doc_id % 3 = 0 then 'refreshed' else 'unchanged' end as status from fx_texts")
def page_status(spark, d):
    t = fixture(spark, d, "fx_texts")
    i = F.col("doc_id")
    rendered = t.where((i % 10 == 0) | (i % 11 != 0) | (i % 7 == 0)).select(F.col("record_id").alias("page"), F.col("text").alias("body"))
    was = F.when(i % 3 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    existing = t.where(i % 10 != 0).select(F.col("record_id").alias("page"), F.when(i % 7 == 0, F.lit("edited")).otherwise(was).alias("body"), F.sha2(was, 256).alias("marker"))
    return M.page_status(rendered, existing)


def _diff(spark, d):
    t = fixture(spark, d, "fx_texts")
    i = F.col("doc_id")
    rendered = t.select("record_id", F.concat("text", F.lit(" \n")).alias("text"), F.when(i % 2 == 0, F.col("source")).alias("project"), "source")
    stored = t.where(i % 6 != 0).select("record_id", F.when(i % 5 == 0, F.lit("other")).otherwise(F.col("text")).alias("text"), F.when(i % 4 == 0, F.lit("elsewhere")).otherwise(F.col("source")).alias("project"))
    return M.import_diff(rendered, stored).join(rendered.select("record_id", "source"), "record_id")


_DIFF = "df as (select record_id, source, case when doc_id % 6 = 0 then 'create' when doc_id % 5 = 0 or doc_id % 4 = 0 then 'update' else 'skip' end as action from fx_texts)"


@query(f"with {_DIFF} select record_id, action, source from df")
def import_diff(spark, d):
    return _diff(spark, d)


@query(f"with {_DIFF} select source, count_if(action = 'create') as \"create\", count_if(action = 'update') as \"update\", count_if(action = 'skip') as \"skip\", count_if(action = 'empty') as \"empty\", count_if(action = 'failed') as \"failed\" from df group by 1")
def import_report(spark, d):
    return M.import_report(_diff(spark, d))


@query("select record_id, tag from fx_tags union select concat('doc-', doc_id), 'toxic' from documents where doc_id % 5 = 0")
def add_tags(spark, d):
    ids = table(spark, d, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"))
    return M.add_tags(fixture(spark, d, "fx_tags"), ids, ["Toxic"])


@query("select record_id, tag from fx_tags where not (tag = 'en' and record_id in (select concat('doc-', doc_id) from documents where doc_id % 5 = 0))")
def remove_tags(spark, d):
    ids = table(spark, d, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"))
    return M.remove_tags(fixture(spark, d, "fx_tags"), ids, ["EN"])


@query("select distinct record_id, case when tag = 'fr' then 'en' else tag end as tag from fx_tags")
def merge_tag(spark, d):
    return M.merge_tag(fixture(spark, d, "fx_tags"), "fr", "en")


def _derive(docs):
    return {"titles": docs.select("record_id", F.concat(F.col("stream_hash"), F.lit("#"), F.col("title")).alias("title"))}


def _built(spark, d, what):
    old, new = _old(spark, d), _new(spark, d)
    surveyed = M.survey(new, old)
    store = _store(spark, titles=old.select("record_id", F.lit("old").alias("title")))
    if what == "rebuild":
        D.rebuild_tables(store, new, _derive, M.repairable(surveyed))
    else:
        D.repair_tables(store, surveyed, new, _derive)
    return store.read("titles")


_BUILT = "select sv.record_id, case when status in ('missing', 'stale') then n.stream_hash || '#' || n.title else 'old' end as title from sv left join fx_new_records n using (record_id)"


@query(f"with {_SURVEY} {_BUILT}")
def rebuild(spark, d):
    return _built(spark, d, "rebuild")


@query(f"with {_SURVEY} {_BUILT} where status <> 'orphaned'")
def repair(spark, d):
    return _built(spark, d, "repair")


@query("select doc_id as id, '/home/' || lang || '/x' as cwd, case when doc_id % 3 = 0 then source when lang = 'en' then 'english' else 'any' end as project from documents")
def merge_submission_defaults(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/home/"), F.col("lang"), F.lit("/x")).alias("cwd"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("project"))
    return M.merge_submission_defaults(s, spark.createDataFrame([("/home", "any"), ("/home/en", "english")], "dir string, project string"))


@query("select record_id, left(coalesce(case when doc_id % 4 = 0 then 'cached ' || lang end, case when trim(title) <> '' then trim(title, ' ') end, record_id), 80) as title from fx_records join fx_texts using (record_id)")
def title_cache(spark, d):
    cached = fixture(spark, d, "fx_texts").where("doc_id % 4 = 0").select("record_id", F.concat(F.lit("cached "), F.col("lang")).alias("title"))
    return M.title_cache(_old(spark, d), cached)
