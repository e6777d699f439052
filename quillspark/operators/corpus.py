"""Listings, counts and reports over the records of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import links as L


def scope_filter(rows: DataFrame, corpus: str | None = None, project: str | None = None, context: str | None = None) -> DataFrame:
    """Only the conditions that are given, so all of them reach the scan."""
    for name, value in (("corpus", corpus), ("project", project), ("context", context)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "tag")


def project_counts(records: DataFrame) -> DataFrame:
    """Records and newest update per project; records without one are a row of their own."""
    return records.groupBy("project").agg(F.count("*").alias("records"), F.max("updated_s").alias("newest"))


def corpus_counts(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per corpus: records, records with a vector, vectors.  Vectors are counted per record before the join."""
    per = vectors.groupBy("record_id").agg(F.count("*").alias("n"))
    rows = records.join(per, "record_id", "left")
    return rows.groupBy("corpus").agg(F.countDistinct("record_id").alias("records"), F.countDistinct(F.when(F.col("n") > 0, F.col("record_id"))).alias("with_vector"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def rebuild_report(records: DataFrame, passages: DataFrame, links: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row of counts over the written tables."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(records, "records")
    for df, name in ((passages, "passages"), (links, "links"), (dropped, "dropped_vectors")):
        out = out.join(count(df, name), how="cross")  # one row with one row
    return out


def recent(records: DataFrame, corpus: str, n: int) -> DataFrame:
    return records.where(F.col("corpus") == corpus).orderBy(F.desc("updated_s"), "record_id").limit(n)


def enumerate_page(records: DataFrame, after: str | None, limit: int) -> DataFrame:
    """The page of ids behind a cursor; a cursor that is no record starts anew."""
    if after is not None and not records.where(F.col("record_id") == after).isEmpty():
        records = records.where(F.col("record_id") > after)
    return records.orderBy("record_id").limit(limit)


def list_records(records: DataFrame, corpus: str | None = None) -> DataFrame:
    return scope_filter(records, corpus=corpus).orderBy("record_id")


def records_of_kind(records: DataFrame, kind: str) -> DataFrame:
    return records.where(F.col("kind") == kind).orderBy("record_id")


def records_tagged(records: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return records.join(tags.where(F.col("tag") == T.normalize_tag(F.lit(tag))).select("record_id"), "record_id", "left_semi").orderBy("record_id")


def all_nodes(records: DataFrame, tags: DataFrame) -> DataFrame:
    """record_id, title, tags of every record, tags in order; the listing of a whole corpus."""
    own = tags.groupBy("record_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return records.select("record_id", "title").join(own, "record_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).orderBy("record_id")


def passages_in(records: DataFrame, passages: DataFrame, corpus: str) -> DataFrame:
    return records.where(F.col("corpus") == corpus).select("record_id").join(passages, "record_id").orderBy("record_id", "span_start")


def newest_first_nodes(records: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return records.orderBy(F.desc("updated_s"), "record_id").offset(offset).limit(limit)


def get_records(ids: DataFrame, records: DataFrame, tags: DataFrame) -> DataFrame:
    """ids(record_id) -> record_id, status, title, tags, provenance; unknown ids are named."""
    own = tags.join(ids, "record_id", "left_semi").groupBy("record_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    found = records.select("record_id", "title", "project", F.lit("found").alias("status"))
    rows = ids.join(found, "record_id", "left").join(own, "record_id", "left")
    return rows.select(
        "record_id", F.coalesce("status", F.lit("not_found")).alias("status"), "title",
        F.when(F.col("status").isNotNull(), F.col("tags")).otherwise(F.lit(None)).alias("t"), T.provenance_json({"project": F.col("project")}).alias("provenance"),
    ).select("record_id", "status", "title", F.coalesce("t", F.array().cast("array<string>")).alias("tags"), "provenance")


def union_corpora(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def storage_of(records: DataFrame, policies: dict[str, str]) -> DataFrame:
    """The storage policy of each record's corpus; the policies are a handful of literals, not a table."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in policies.items() for x in kv]), F.col("corpus"))
    return records.withColumn("storage", F.coalesce(found, F.lit("unregistered")))


def corpus_audit(records: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """section, name, value: recent records, hubs, orphans and tag counts in one report."""
    part = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(value).cast("string").alias("value"))
    out = part(records.orderBy(F.desc("updated_s"), "record_id").limit(50), "recent", "record_id", "updated_s")
    out = out.union(part(L.hubs(links, records, 20), "hub", "record_id", "in_degree"))
    out = out.union(part(L.orphans(links, records), "orphan", "record_id", "title"))
    return out.union(part(tag_counts(tags), "tag", "tag", "uses"))
