"""Queries of reading and writing records, mail folders, vectors, dumps and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import links as L
from quillspark.operators import outline
from quillspark.queries.fixtures import fixture
from quillspark.queries.registry import query
from quillspark.sources import records as S


def _stamp(col):
    return F.date_format(F.timestamp_seconds(col), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _headed(spark, d):
    r = fixture(spark, d, "fx_records")
    tags = fixture(spark, d, "fx_tags").groupBy("record_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    r = r.join(tags, "record_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return r.select(
        F.col("record_id").alias("id"), "corpus", "kind", _stamp("created_s").alias("created"), _stamp("updated_s").alias("updated"), F.lit("import").alias("source"), F.col("stream_hash").alias("raw"), F.col("stream_hash").alias("stream"),
        F.lit("3").alias("normalizer"), "project", "context", "tags",
    )


_STAMP = "strftime(to_timestamp({}) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ')"


@query("select record_id as id, kind, stream_hash as stream, project, coalesce((select list_sort(list(distinct tag)) from fx_tags t where t.record_id = r.record_id), []) as tags from fx_records r where record_id not in (select concat('doc-', doc_id) from documents where doc_id % 8 = 0)")
def load_records(spark, d):
    """Headers written as text and parsed again; every eighth is broken in some way and rejected."""
    h = _headed(spark, d)
    n = F.substring("id", 5, 20).cast("long")
    broken = F.when(n % 24 == 0, F.regexp_replace("text", "kb-record/2", "kb-record/9")).when(n % 24 == 8, F.regexp_replace("text", "(?m)^kind: .*$", "kind: other")).otherwise(F.regexp_replace("text", "(?m)^stream: .*$", "stream: short"))
    texts = h.select("id", S.header_text(h).alias("text")).select(F.col("id").alias("path"), F.when(n % 8 == 0, broken).otherwise(F.col("text")).alias("text"))
    return S.parse_headers(texts)[0].select("id", "kind", "stream", "project", "tags")


@query(f"""select concat('kb-record/2', chr(10), 'id: ', record_id, chr(10), 'corpus: ', corpus, chr(10), 'kind: ', kind, chr(10), 'created: ', {_STAMP.format('created_s')}, chr(10), 'updated: ', {_STAMP.format('updated_s')}, chr(10), 'source: import', chr(10),
  'raw: ', stream_hash, chr(10), 'stream: ', stream_hash, chr(10), 'normalizer: 3', case when project is not null then concat(chr(10), 'project: ', project) else '' end, chr(10), 'context: ', context,
  coalesce((select concat(chr(10), string_agg(concat('tag: ', tag), chr(10) order by tag)) from (select distinct tag from fx_tags t where t.record_id = r.record_id)), '')) as header from fx_records r""")
def write_headers(spark, d):
    h = _headed(spark, d)
    return h.select(S.header_text(h).alias("header"))


def _nodes(spark, d):
    t = fixture(spark, d, "fx_texts")
    return t.select(F.col("record_id").alias("id"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("2024-01-02T00:00:00Z").alias("updated_at"), F.array(F.when(F.col("doc_id") % 3 == 0, "conversation").otherwise(F.col("lang"))).alias("tags"), F.concat(F.lit("#+title: "), "lang").alias("org"))


_JSON = """concat('{"id":"', record_id, '","created_at":"2024-01-01T00:00:00Z","updated_at":"2024-01-02T00:00:00Z","tags":["', case when doc_id % 3 = 0 then 'conversation' else lang end, '"],"org":"#+title: ', lang, '"}')"""


@query(f"select {_JSON} as value from fx_texts")
def export_jsonl(spark, d):
    return S.export_jsonl(_nodes(spark, d))[0]


@query(f"select count(*) as nodes, sum(strlen({_JSON}) + 1)::bigint as bytes from fx_texts")
def export_report(spark, d):
    return S.export_jsonl(_nodes(spark, d))[1]


@query("select record_id as id, case when doc_id % 3 = 0 then 'session-transcript' else 'note' end as kind, sha256(concat('stream/3', chr(10), '#+title: ', lang)) as stream_hash, lang as title from fx_texts")
def import_jsonl(spark, d):
    lines = S.export_jsonl(_nodes(spark, d))[0]
    return S.import_jsonl(lines.union(lines.limit(5)).union(spark.createDataFrame([(" ",)], "value string")))


@query("select vec_id, 64 as dims from embeddings where vec_id % 9 <> 0")
def load_packed_vectors(spark, d):
    """Vectors packed to bytes and read back; every ninth blob is cut short."""
    @F.pandas_udf("binary")
    def pack(v):
        import numpy as np

        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    v = fixture(spark, d, "fx_vectors").select("vec_id", pack("embedding").alias("blob"))
    cut = v.select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.substring("blob", 1, 7)).otherwise(F.col("blob")).alias("blob"))
    return S.load_packed_vectors(cut).select("vec_id", F.size("vector").alias("dims"))


@query("select concat('links', chr(9), record_id, chr(9), span_start, chr(9), target, chr(9), target_kind) as line from fx_links union all select concat('tags', chr(9), record_id, chr(9), tag) from fx_tags")
def dump_tables(spark, d):
    return S.dump_tables(links=fixture(spark, d, "fx_links"), tags=fixture(spark, d, "fx_tags"))


@query("""with n as (select n.record_id, r.title, n.text, 'doc-' || ((n.doc_id * 7 + 3) % 300) as to_id, 'slug-' || ((n.doc_id * 11) % 400) as to_slug from fx_notes n join fx_records r using (record_id)),
  s as (select name_slug, min(record_id) as by_slug from fx_records where name_slug is not null group by 1),
  j as (select n.*, i.record_id as by_id, s.by_slug from n left join fx_records i on i.record_id = n.to_id left join s on s.name_slug = n.to_slug)
  select 'notes/' || record_id as page, '---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || replace(replace(replace(text, '[[id:' || to_id || ']]', case when by_id is null then to_id else '[[notes/' || to_id || '|' || to_id || ']]' end),
    '[[' || to_slug || '][words]]', case when by_slug is null then 'words' else '[[notes/' || by_slug || '|words]]' end), '[[https://example.invalid/]]', '[https://example.invalid/](https://example.invalid/)') as body,
    list_filter([case when by_id is null then to_id end, case when by_slug is null then to_slug end], lambda x: x is not null) as unresolved from j""")
def project_pages(spark, d):
    notes = fixture(spark, d, "fx_notes")
    r = fixture(spark, d, "fx_records").select("record_id", "corpus", "title", "name_slug").join(notes.select("record_id", "text"), "record_id")
    resolved = L.resolve_links(outline.extract_links(notes), r)
    return S.project_pages(r, resolved)


def _maildir(spark, d):
    """The mail fixture as the files of a mail directory: path and content, a row a message."""
    m = fixture(spark, d, "fx_messages")
    raw = F.when(F.col("epoch") % 11 == 0, F.col("raw")).otherwise(F.concat(F.lit("Message-ID: "), "message_id", F.lit("\n"), "raw"))
    content = F.concat(raw, F.lit("\n\n"))
    sub = F.when(F.col("epoch") % 2 == 0, "cur").otherwise("new")
    name = F.concat_ws("-", F.col("epoch").cast("string"), F.left(F.sha2(content, 256), F.lit(16)))
    return m.select(F.concat(F.lit("/mail/"), "folder", F.lit("/"), sub, F.lit("/"), name, F.lit(":2,")).alias("path"), F.encode(content, "UTF-8").alias("content"))


@query()
def scan_maildir(spark, d):
    return S.scan_maildir(_maildir(spark, d))[0].select("folder", "message_id", "content_hash")


@query()
def resolve_mail(spark, d):
    catalogue, _ = S.scan_maildir(_maildir(spark, d))
    later = catalogue.where("folder <> 'Junk'").withColumn("path", F.when(F.col("folder") == "Archive", F.concat("path", F.lit("S"))).otherwise(F.col("path")))
    ids = catalogue.select("message_id").union(spark.createDataFrame([("<none@example.invalid>",)], "message_id string"))
    return S.resolve_mail(ids, catalogue, later).select("message_id", "status")
