"""Queries over the corpus as it stands: tags, projects, links, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import corpus, links
from quillspark.plans.staging import staged
from quillspark.queries.fixtures import fixture
from quillspark.queries.registry import query


def _two(spark, d):
    return fixture(spark, d, "fx_links"), fixture(spark, d, "fx_records")


_RESOLVED = """resolved as (select l.*, case when target_kind in ('record', 'name') then coalesce(i.record_id, n.least) end as resolved from fx_links l
  left join fx_records i on i.record_id = l.target left join (select name_slug, min(record_id) as least from fx_records where name_slug is not null group by 1) n on n.name_slug = l.target)"""


@query(f"with {_RESOLVED} select * from resolved")
def resolve_links(spark, d):
    return links.resolve_links(*_two(spark, d))


@query("select distinct record_id, target from fx_links where target_kind = 'name' and target not in (select record_id from fx_records) and target not in (select name_slug from fx_records where name_slug is not null)")
def broken_links(spark, d):
    return links.broken_links(*_two(spark, d))


@query("select distinct record_id, target from fx_links where record_id = 'doc-2' and target_kind = 'name' and target not in (select record_id from fx_records) and target not in (select name_slug from fx_records where name_slug is not null)")
def unresolved_names(spark, d):
    return links.unresolved_names(*_two(spark, d), "doc-2")


@query("select record_id, title from fx_records r where not exists (select 1 from fx_links l where l.target = r.record_id or l.target = r.name_slug)")
def orphans(spark, d):
    return links.orphans(*_two(spark, d))


@query("select r.record_id, count(*) as in_degree from fx_records r join (select distinct * from fx_links) l on l.target = r.record_id or l.target = r.name_slug group by 1 order by 2 desc, 1 limit 20")
def hubs(spark, d):
    return links.hubs(*_two(spark, d))


@query(f"""with {_RESOLVED}, s as (select * from fx_records where title is not null and record_id in ('doc-1', 'doc-3', 'doc-10', 'doc-24'))
  select s.record_id as seed, 'out' as direction, coalesce(l.resolved, l.target) as other, t.title, l.span_start from s join resolved l on l.record_id = s.record_id left join fx_records t on t.record_id = coalesce(l.resolved, l.target)
  union all select s.record_id, 'in', l.record_id, t.title, l.span_start from s join resolved l on l.resolved = s.record_id left join fx_records t on t.record_id = l.record_id""")
def neighborhood(spark, d):
    li, r = _two(spark, d)
    return links.neighborhood(li, r, r.where(F.col("record_id").isin("doc-1", "doc-3", "doc-10", "doc-24")).select("record_id"))


@query(f"""with {_RESOLVED}, s as (select record_id as seed from fx_records where record_id like '%5')
  select s.seed, coalesce((select list([l.resolved, coalesce(r.title, '')] order by l.span_start, l.resolved) from resolved l left join fx_records r on r.record_id = l.resolved where l.record_id = s.seed and l.resolved is not null), []) as links_to,
    coalesce((select list([l.record_id, coalesce(r.title, '')] order by l.record_id) from resolved l left join fx_records r using (record_id) where l.resolved = s.seed), []) as linked_from from s""")
def context(spark, d):
    li, r = _two(spark, d)
    asked = r.where("record_id like '%5'").select("record_id").union(spark.createDataFrame([("doc-none",)], "record_id string"))
    pairs = lambda c: F.transform(c, lambda x: F.array(x["id"], x["title"])).alias(c)
    return links.context(li, r, asked).select("seed", pairs("links_to"), pairs("linked_from"))


@query(f"""with recursive {_RESOLVED}, e as (select record_id as u, resolved as v from resolved where resolved is not null union select resolved, record_id from resolved where resolved is not null),
  walk(seed, record_id, distance) as (select record_id, record_id, 0 from fx_records union select w.seed, e.v, w.distance + 1 from walk w join e on e.u = w.record_id where w.distance < 2)
  select seed, record_id, min(distance) as distance from walk group by 1, 2""")
def link_distance_all(spark, d):
    """Every record as a seed."""
    li, r = _two(spark, d)
    return links.link_distance(li, r, r.select("record_id"), 2)


@query(f"""with recursive {_RESOLVED}, e as (select record_id as u, resolved as v from resolved where resolved is not null union select resolved, record_id from resolved where resolved is not null),
  walk(seed, record_id, distance) as (select record_id, record_id, 0 from fx_records where record_id in ('doc-0', 'doc-7') union select w.seed, e.v, w.distance + 1 from walk w join e on e.u = w.record_id where w.distance < 3)
  select seed, record_id, min(distance) as distance from walk group by 1, 2""")
def link_distance(spark, d):
    li, r = _two(spark, d)
    return links.link_distance(li, r, r.where(F.col("record_id").isin("doc-0", "doc-7")).select("record_id"), 3)


@query("""with recursive n as (select conv_id as conv, turn::varchar as node, case when turn > 0 then (turn - 1)::varchar end as parent, max(turn) over (partition by conv_id)::varchar as current from conversations),
  up(conv, node, up) as (select conv, node, 0 from n where node = current union select n.conv, n.parent, u.up + 1 from up u join n on n.conv = u.conv and n.node = u.node where n.parent is not null)
  select conv, node, (max(up) over (partition by conv) - up)::bigint as depth from up""")
def surviving_branch(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = c.join(last, "conv_id")
    nodes = c.select(F.col("conv_id").alias("conv"), F.col("turn").cast("string").alias("node"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), F.col("last").cast("string").alias("current"))
    side = nodes.where("node = current").select("conv", F.lit("side").alias("node"), F.lit("0").alias("parent"), "current")
    return links.surviving_branch(nodes.union(side))


@query("select tag, count(*) as uses from fx_tags group by tag order by 2 desc, 1")
def tag_counts(spark, d):
    return corpus.tag_counts(fixture(spark, d, "fx_tags"))


@query("select project, count(*) as records, max(updated_s) as newest from fx_records group by project")
def project_counts(spark, d):
    return corpus.project_counts(fixture(spark, d, "fx_records"))


@query("""select corpus, count(distinct r.record_id) as records, count(distinct v.record_id) as with_vector, count(v.vec_id) as chunks
  from fx_records r left join fx_vectors v using (record_id) group by corpus""")
def corpus_counts(spark, d):
    return corpus.corpus_counts(fixture(spark, d, "fx_records"), fixture(spark, d, "fx_vectors"))


@query("""select (select count(*) from fx_records) as records, (select count(*) * 2 from fx_notes) as passages, (select count(*) from fx_links) as links, (select count(*) from fx_vectors where vec_id % 50 = 0) as dropped_vectors""")
def rebuild_report(spark, d):
    from quillspark.operators import outline

    notes = fixture(spark, d, "fx_notes").withColumn("kind", F.lit("note"))
    dropped = fixture(spark, d, "fx_vectors").where("vec_id % 50 = 0")
    return corpus.rebuild_report(fixture(spark, d, "fx_records"), staged(outline.passages(notes)), fixture(spark, d, "fx_links"), dropped)


@query("select record_id, updated_s from fx_records order by updated_s desc, record_id limit 50")
def recent(spark, d):
    return corpus.recent(fixture(spark, d, "fx_records"), "notes", 50).select("record_id", "updated_s")


@query("select record_id from fx_records where record_id > 'doc-3' order by record_id limit 25")
def enumerate_page(spark, d):
    return corpus.enumerate_page(fixture(spark, d, "fx_records"), "doc-3", 25).select("record_id")


@query("""select 'all' as listing, record_id, title from fx_records union all select 'transcripts', record_id, title from fx_records where kind = 'session-transcript'
  union all select 'toxic', record_id, title from fx_records where record_id in (select record_id from fx_tags where tag = 'toxic')""")
def list_records(spark, d):
    r, t = fixture(spark, d, "fx_records"), fixture(spark, d, "fx_tags")
    show = lambda name, df: df.select(F.lit(name).alias("listing"), "record_id", "title")
    return show("all", corpus.list_records(r, "notes")).union(show("transcripts", corpus.records_of_kind(r, "session-transcript"))).union(show("toxic", corpus.records_tagged(r, t, "Toxic")))


@query("select record_id, title, coalesce((select list_sort(list(distinct t.tag)) from fx_tags t where t.record_id = r.record_id), []) as tags from fx_records r")
def all_nodes(spark, d):
    return corpus.all_nodes(fixture(spark, d, "fx_records"), fixture(spark, d, "fx_tags"))


@query("select record_id, vec_id, span_start from fx_records join fx_vectors using (record_id) where corpus = 'notes'")
def passages_in(spark, d):
    return corpus.passages_in(fixture(spark, d, "fx_records"), fixture(spark, d, "fx_vectors"), "notes").select("record_id", "vec_id", "span_start")


@query("""with asked as (select concat('doc-', doc_id) as record_id from documents where doc_id % 10 = 0 union all select 'doc-none')
  select a.record_id, case when r.record_id is null then 'not_found' else 'found' end as status, r.title, coalesce((select list_sort(list(t.tag)) from fx_tags t where t.record_id = a.record_id and r.record_id is not null), []) as tags,
  case when r.project is not null then concat('{"project":"', r.project, '"}') end as provenance from asked a left join fx_records r using (record_id)""")
def get_records(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 10 = 0").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"))
    asked = docs.union(spark.createDataFrame([("doc-none",)], "record_id string"))
    return corpus.get_records(asked, fixture(spark, d, "fx_records"), fixture(spark, d, "fx_tags"))


@query("select record_id, updated_s from fx_records order by updated_s desc, record_id limit 30 offset 10")
def newest_first_nodes(spark, d):
    return corpus.newest_first_nodes(fixture(spark, d, "fx_records"), 30, 10).select("record_id", "updated_s")


@query("""select 'recent' as section, record_id as name, updated_s::varchar as value from (select * from fx_records order by updated_s desc, record_id limit 50)
  union all select 'hub', record_id, n::varchar from (select r.record_id, count(*) as n from fx_records r join (select distinct * from fx_links) l on l.target = r.record_id or l.target = r.name_slug group by 1 order by 2 desc, 1 limit 20)
  union all select 'orphan', record_id, title from fx_records r where not exists (select 1 from fx_links l where l.target = r.record_id or l.target = r.name_slug)
  union all select 'tag', tag, count(*)::varchar from fx_tags group by tag""")
def corpus_audit(spark, d):
    li, r = _two(spark, d)
    return corpus.corpus_audit(r, li, fixture(spark, d, "fx_tags"))


@query("select corpus, record_id from fx_records union all select 'mail', message_id from fx_messages")
def union_corpora(spark, d):
    mail = fixture(spark, d, "fx_messages").select(F.col("message_id").alias("record_id"), F.lit("mail").alias("corpus"), "folder")
    return corpus.union_corpora(fixture(spark, d, "fx_records"), mail).select("corpus", "record_id")


@query("select record_id, case corpus when 'notes' then 'copy' else 'unregistered' end as storage from fx_records union all select message_id, 'unregistered' from fx_messages")
def storage_of(spark, d):
    mail = fixture(spark, d, "fx_messages").select(F.col("message_id").alias("record_id"), F.lit("odd").alias("corpus"))
    both = corpus.union_corpora(fixture(spark, d, "fx_records"), mail)
    return corpus.storage_of(both, {"notes": "copy", "mail": "reference"}).select("record_id", "storage")


@query("select record_id, project from fx_records where corpus = 'notes' and context = 'en'")
def scope_filter(spark, d):
    return corpus.scope_filter(fixture(spark, d, "fx_records"), corpus="notes", context="en").select("record_id", "project")
