"""Queries over mail."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import mail as M
from quillspark.operators import maintenance
from quillspark.queries.fixtures import fixture
from quillspark.queries.registry import query

def _no_refs():
    return F.array().cast("array<string>")


def _m(spark, d):
    return fixture(spark, d, "fx_messages")


@query()
def parse_messages(spark, d):
    files = _m(spark, d).select(F.col("message_id").alias("locator"), F.concat(F.lit("Message-ID: "), F.col("message_id"), F.lit("\nDate: Mon, 01 Jan 2024 00:00:00 +0000\nSubject: =?utf-8?q?caf=C3=A9?=\n"), F.col("raw")).cast("binary").alias("content"))
    return M.parse_messages(files)


@query("select message_id, concat('From: ', sender, chr(10), 'Message-ID: ', message_id, chr(10), chr(10), body) as rendered from fx_messages")
def render_message(spark, d):
    m = _m(spark, d).withColumn("from", F.col("sender")).withColumn("to", F.lit(" "))
    return m.select("message_id", M.render_message(m).alias("rendered"))


@query("select message_id from fx_messages where folder in ('Inbox', 'Archive')")
def increment_scope(spark, d):
    return M.increment_scope(_m(spark, d)).select("message_id")


_SEL = """bk as (select message_id, folder, (string_split(raw, chr(10)))[2] = 'List-Id: x' as bulk from fx_messages), tr as (select message_id from fx_messages where epoch % 7 = 0 union all select '<gone@example.invalid>'),
  se as (select coalesce(b.message_id, t.message_id) as message_id, case when b.folder is null then 'missing' when b.folder = 'Junk' and t.message_id is null then 'out_of_scope' when not b.bulk and b.folder <> 'Junk' then 'selected' when t.message_id is not null then 'override' else 'excluded' end as status from bk b full outer join tr t using (message_id))"""


def _parts(spark, d):
    m = M.bulk(_m(spark, d))
    truth = m.where("epoch % 7 = 0").select("message_id").union(spark.createDataFrame([("<gone@example.invalid>",)], "message_id string"))
    return m.select("message_id", "folder", "bulk"), truth


@query(f"with {_SEL} select * from se")
def select_mail(spark, d):
    return M.select_mail(*_parts(spark, d))


@query(f"with {_SEL} select count_if(status <> 'missing') as catalogued, count_if(status in ('selected', 'override')) as selected, count_if(status = 'excluded') as excluded, count_if(status = 'missing') as missing, (select count(*) from tr) as ground_truth, (select count(*) from fx_records r left join fx_new_records n using (record_id) where r.stream_hash <> coalesce(n.stream_hash, '')) as drifted from se")
def mail_scope(spark, d):
    old = fixture(spark, d, "fx_records").select("record_id", F.col("stream_hash").alias("expected_hash"))
    return M.mail_scope(*_parts(spark, d), maintenance.drift(old, fixture(spark, d, "fx_new_records")))


@query("select m.message_id as u, m.in_reply_to as v from fx_messages m join fx_messages p on p.message_id = m.in_reply_to")
def thread_edges(spark, d):
    return M.thread_edges(_m(spark, d).withColumn("refs", _no_refs()))


_TH = """e as (select m.message_id as u, m.in_reply_to as v from fx_messages m join fx_messages p on p.message_id = m.in_reply_to), e2 as (select u, v from e union select v, u from e),
  rc(node, other) as (select u, u from e2 union select r.node, e2.v from rc r join e2 on e2.u = r.other), th as (select node as message_id, min(other) as thread_id from rc group by 1)"""


@query(f"with recursive {_TH} select * from th")
def threads(spark, d):
    return M.threads(_m(spark, d).withColumn("refs", _no_refs()))


def _members(spark, d):
    m = _m(spark, d)
    return M.threads(m.withColumn("refs", _no_refs())).join(m.select("message_id", "epoch", "sender", "body"), "message_id")


@query(f"with recursive {_TH} select thread_id, message_id, row_number() over w as position, first(message_id) over w as root from th join fx_messages using (message_id) window w as (partition by thread_id order by epoch, message_id)")
def thread_order(spark, d):
    return M.thread_order(_members(spark, d)).select("thread_id", "message_id", F.col("position").cast("long").alias("position"), "root")


@query(f"with recursive {_TH} select thread_id, first(message_id order by epoch, message_id) as root, count(*) as n, string_agg(concat('From ', sender, chr(10), body), chr(10) order by epoch, message_id) as text from th join fx_messages using (message_id) group by 1")
def thread_records(spark, d):
    return M.thread_records(_members(spark, d))


@query("select distinct message_id from (select unnest([message_id, in_reply_to]) as message_id from fx_messages where sender = 'assistant') where message_id <> ''")
def joined_threads(spark, d):
    return M.joined_threads(_m(spark, d).withColumn("refs", _no_refs()), F.col("sender") == "assistant")


@query("select message_id from fx_messages where sender <> 'assistant' and (string_split(raw, chr(10)))[2] = 'List-Id: x' and message_id in (select unnest([message_id, in_reply_to]) from fx_messages where sender = 'assistant')")
def disputed_bulk(spark, d):
    return M.disputed_bulk(M.bulk(_m(spark, d)).withColumn("refs", _no_refs()), F.col("sender") == "assistant")


_SAMPLE = """sa as (select message_id, epoch % 5 as year, md5(message_id || ':7') as key, row_number() over (partition by epoch % 5 order by md5(message_id || ':7'), message_id) as r from fx_messages),
  pk as (select message_id, year from sa order by r > 40 // (select count(distinct year) from sa), key, message_id limit 40)"""


def _sample(spark, d):
    return M.stratified_sample(_m(spark, d).select("message_id", (F.col("epoch") % 5).alias("year")), 40, 7)


@query(f"with {_SAMPLE} select * from pk")
def stratified_sample(spark, d):
    return _sample(spark, d)


@query(f"with {_SAMPLE} select concat('{{\"seed\":7,\"total\":', (select count(*) from fx_messages), ',\"sample\":[', string_agg('\"' || message_id || '\"', ',' order by message_id), ']}}') as report from pk")
def write_sample(spark, d):
    return M.write_sample(_sample(spark, d), _m(spark, d).count(), 7)


@query()
def rebuild_mail(spark, d):
    """Catalogue, selection, parsed messages, threads and their records, one row per record written."""
    from quillspark.operators.mail import parse_messages as parse

    m = M.bulk(_m(spark, d))
    chosen = M.select_mail(m.select("message_id", "folder", "bulk"), m.where("epoch % 7 = 0").select("message_id")).where("status in ('selected', 'override')")
    kept = m.join(chosen, "message_id", "left_semi")
    parsed = parse(kept.select(F.col("message_id").alias("locator"), F.col("raw").cast("binary").alias("content")))
    single = parsed.join(kept.select(F.col("message_id").alias("locator"), "epoch", "in_reply_to").withColumnRenamed("epoch", "at").withColumnRenamed("in_reply_to", "parent"), "locator")
    rows = single.select(F.col("locator").alias("message_id"), F.col("at").alias("epoch"), F.col("from").alias("sender"), F.col("body"), F.col("parent").alias("in_reply_to"), _no_refs().alias("refs"))
    records = M.thread_records(M.threads(rows).join(rows.select("message_id", "epoch", "sender", "body"), "message_id"))
    return records.select(F.col("thread_id").alias("record_id"), F.lit("mail-thread").alias("kind"), "text").union(rows.select("message_id", F.lit("mail-message"), "body"))
