"""Queries of the ingest stream, over a queue of files made from documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators.maintenance import hashing_embedder
from quillspark.plans.staging import shared_dir
from quillspark.plans.versions import Versions
from quillspark.queries.fixtures import fixture, table
from quillspark.queries.registry import query
from quillspark.streaming import ingest as I


def _submissions(spark, d):
    """One submission per document, of which some are repeated later, blank or of bad provenance."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    row = docs.select(
        F.when(i % 19 == 0, "").otherwise(F.concat(F.lit("doc-"), i)).alias("id"), F.lit("kb").alias("corpus"), F.when(i % 23 == 0, " ").otherwise(F.col("text")).alias("document"), i.alias("accepted"),
        F.struct(F.col("source").alias("project"), F.when(i % 29 == 0, "guess").otherwise("explicit").alias("project_source"), F.lit("s").alias("session"), F.lit("/w").alias("cwd")).alias("provenance"), F.lit(None).cast("string").alias("_corrupt"),
    )
    again = row.where("accepted % 10 = 1").withColumn("document", F.concat(F.lit("again "), F.col("document"))).withColumn("accepted", F.col("accepted") + 1_000_000)
    return row.union(again)


_BAD = "case when doc_id % 19 = 0 then 'blank id' when doc_id % 23 = 0 and not again then 'no document' when doc_id % 29 = 0 then 'provenance' end"
_SUB = f"""sb as (select *, {_BAD} as reason from (select doc_id, case when doc_id % 19 = 0 then '' else 'doc-' || doc_id end as id, text, doc_id as accepted, false as again from documents
  union all select doc_id, case when doc_id % 19 = 0 then '' else 'doc-' || doc_id end, 'again ' || case when doc_id % 23 = 0 then ' ' else text end, doc_id + 1000000, true from documents where doc_id % 10 = 1))"""


@query(f"with {_SUB} select id, accepted, reason from sb where reason is not null")
def split_dead_letters(spark, d):
    return I.split_dead_letters(_submissions(spark, d))[1]


_LAST = f"{_SUB}, lw as (select id, text, accepted from sb where reason is null qualify row_number() over (partition by id order by accepted desc) = 1)"


@query(f"with {_LAST} select id, accepted from lw")
def latest_wins(spark, d):
    return I.latest_wins(I.split_dead_letters(_submissions(spark, d))[0]).select("id", "accepted")


@query(f"with {_LAST} select id, accepted from lw where accepted >= 1000000")
def skip_unchanged(spark, d):
    last = I.latest_wins(I.split_dead_letters(_submissions(spark, d))[0])
    return I.skip_unchanged(last, fixture(spark, d, "fx_records")).select("id", "accepted")


@query(f"with {_SUB} select count(*) as depth, 5000000 - min(accepted) as oldest_age, (select count(*) from sb where reason is not null) as dead from sb")
def queue_status(spark, d):
    s = _submissions(spark, d)
    return I.queue_status(s, I.split_dead_letters(s)[1], 5_000_000)


def _base(spark, d):
    return fixture(spark, d, "fx_records").select("record_id", "stream_hash", "title", "created_s", "updated_s")


def _run(spark, d, **more):
    path = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    _submissions(spark, d).drop("_corrupt").select(F.to_json(F.struct("id", "corpus", "document", "accepted", "provenance")).alias("value")).union(spark.createDataFrame([("{broken",), ("also broken",)], "value string")).write.text(f"{path}/in")
    return I.Ingest(Versions(spark, f"{path}/tables"), _base(spark, d), **more).run(f"{path}/in", f"{path}/checkpoint")


@query(f"with {_LAST} select r.record_id, case when l.accepted >= 1000000 then l.accepted else r.updated_s end as updated_s from fx_records r left join lw l on l.id = r.record_id")
def ingest_stream(spark, d):
    return _run(spark, d).records.select("record_id", "updated_s")


@query(f"with {_SUB} select reason, count(*) as n from sb where reason is not null group by 1 union all select 'malformed', 2")
def queue_dead_letters(spark, d):
    return _run(spark, d).dead.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"with {_SUB} select count(*) + 2 as depth, (select count(*) from sb where reason is not null) + 2 as dead from sb")
def queue_gauge(spark, d):
    return _run(spark, d).gauges.agg(F.sum("depth").alias("depth"), F.sum("dead").alias("dead"))


@query(f"with {_LAST} select distinct sha256(case when accepted >= 1000000 then 'again ' || d.text else d.text end) as stream_hash from lw join documents d on 'doc-' || d.doc_id = lw.id where not (accepted >= 1000000 and d.doc_id % 23 = 0) union select sha256('again  ') from lw join documents d on 'doc-' || d.doc_id = lw.id where accepted >= 1000000 and d.doc_id % 23 = 0")
def incremental_embed(spark, d):
    return _run(spark, d, embedder=hashing_embedder()).vectors.select("stream_hash")


@query(f"with {_LAST} select r.record_id, case when l.accepted >= 1000000 then l.accepted else r.updated_s end as updated_s from fx_records r left join lw l on l.id = r.record_id")
def idempotent_batches(spark, d):
    """The same batch three times, twice under the same number and each time by another process: the records are those of one."""
    store = Versions(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
    for number in (0, 0, 1):
        I.Ingest(store, _base(spark, d))(_submissions(spark, d), number)
    return store.read("records").select("record_id", "updated_s")
