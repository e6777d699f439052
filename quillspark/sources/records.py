"""Record headers, JSON lines, packed vectors, mail folders, pages and dumps: reading and writing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T

#: Fixed: header keys that must be there, in this order, and those that may follow.
REQUIRED = ("id", "corpus", "kind", "created", "updated", "source", "raw", "stream", "normalizer")
OPTIONAL = ("project", "project-source", "remote", "context", "harness", "model", "session", "cwd")
REPEATED = ("tag", "domain")
_ID, _HASH, _TIME = r"^[A-Za-z0-9][A-Za-z0-9._:@<>-]*$", r"^[0-9a-f]{64}$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"


def parse_headers(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """headers(path, text) -> good(id, ..., tags, domains), rejected(path, reason).

    The first line is kb-record/1 or /2, `key: value` lines follow; required keys stand first and in order; of single
    keys the first value counts; a version 1 header has no provenance.
    """
    lines = F.filter(T.lines(F.col("text")), lambda x: x != "")
    rows = headers.select("path", lines[0].alias("head"), F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.struct(F.split(x, ": ", 2)[0].alias("k"), F.coalesce(F.try_element_at(F.split(x, ": ", 2), F.lit(2)), F.lit("")).alias("v"))).alias("kv"))
    first = lambda key: F.try_element_at(F.transform(F.filter("kv", lambda x: x["k"] == key), lambda x: x["v"]), F.lit(1))
    every = lambda key: F.array_sort(F.array_distinct(F.transform(F.filter("kv", lambda x: x["k"] == key), lambda x: x["v"])))
    names = {k: k.replace("-", "_") for k in (*REQUIRED, *OPTIONAL)}
    v2 = F.col("head") == "kb-record/2"
    cells = [first(k).alias(n) if k in REQUIRED else F.when(v2, first(k)).alias(n) for k, n in names.items()]
    rows = rows.select("path", "head", "kv", *cells, every("tag").alias("tags"), F.when(v2, every("domain")).otherwise(F.array().cast("array<string>")).alias("domains"))
    order = F.transform(F.slice("kv", 1, len(REQUIRED)), lambda x: x["k"])
    reason = (
        F.when(~F.col("head").isin("kb-record/1", "kb-record/2"), "version").when(order != F.array(*map(F.lit, REQUIRED)), "keys").when(~F.col("id").rlike(_ID), "id")
        .when(~F.col("kind").isin(*T.KINDS), "kind").when(~F.col("created").rlike(_TIME) | T.parse_time(F.col("created")).isNull() | ~F.col("updated").rlike(_TIME), "time").when(~F.col("stream").rlike(_HASH) | ~F.col("raw").rlike(_HASH), "hash")
        .when(F.exists("tags", lambda t: t != T.normalize_tag(t)), "tag")
    )
    rows = rows.withColumn("reason", F.when(F.col("head").isNull(), "version").otherwise(reason))
    return rows.where("reason is null").drop("path", "head", "kv", "reason"), rows.where("reason is not null").select("path", "reason")


def load_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.option("wholetext", True).text(path)
    return parse_headers(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def header_text(records: DataFrame) -> Column:
    """One header: required fields in order, given optional ones, tags and domains."""
    have = set(records.columns)
    one = lambda k: F.concat(F.lit(f"{k}: "), F.col(k.replace("-", "_")))
    many = lambda k, c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda t: F.concat(F.lit(f"{k}: "), t)), "\n"))
    rows = [one(k) for k in REQUIRED] + [one(k) for k in OPTIONAL if k.replace("-", "_") in have]
    return F.concat_ws("\n", F.lit("kb-record/2"), *rows, many("tag", "tags"), *([many("domain", "domains")] if "domains" in have else []))


def write_headers(records: DataFrame, path: str) -> None:
    records.select(header_text(records).alias("value")).write.option("lineSep", "\n\n").text(path)


def export_jsonl(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, created_at, updated_at, tags, org) -> lines, and a report of how many nodes and bytes."""
    lines = nodes.select(F.to_json(F.struct("id", "created_at", "updated_at", "tags", "org")).alias("value"))
    return lines, lines.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))


def import_jsonl(lines: DataFrame) -> DataFrame:
    """lines(value) -> id, kind, stream_hash, title; blank lines are skipped, an id counts once."""
    rows = lines.where("trim(value) <> ''").select(F.from_json("value", "id string, created_at string, updated_at string, tags array<string>, org string").alias("n")).select("n.*").where("id is not null")
    latest = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("org"))
    rows = rows.withColumn("r", F.row_number().over(latest)).where("r = 1")
    kind = T.kind_for_tags(F.col("tags"))
    return rows.select("id", kind.alias("kind"), F.sha2(T.normalize_stream(kind, F.col("org")), 256).alias("stream_hash"), T.title_of(kind, F.col("org")).alias("title"))


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below a mail directory; Hadoop's local file system cannot open names with a colon, such mail has to come as rows."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def scan_maildir(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, content) in <folder>/{cur,new}, a message each -> catalogue (folder, locator, content_hash, message_id, path), and how many have no id."""
    name = F.regexp_extract("path", r"/([^/]+)/(?:cur|new)/([^/]+)$", 2)
    rows = files.where(F.col("path").rlike(r"/(cur|new)/[^/]+$")).select(
        F.regexp_extract("path", r"/([^/]+)/(?:cur|new)/[^/]+$", 1).alias("folder"), F.split(name, ":2,", 2)[0].alias("locator"), F.sha2("content", 256).alias("content_hash"),
        F.coalesce(F.regexp_extract(T.header_value(F.decode("content", "UTF-8"), "message-id"), r"<[^<>\s]+>", 0), F.lit("")).alias("message_id"), "path",
    )
    last = Window.partitionBy("message_id").orderBy(F.desc("folder"), F.desc("path"))
    catalogue = rows.where("message_id <> ''").withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
    return catalogue, rows.agg(F.count_if(F.col("message_id") == "").alias("unidentified"))


def resolve_mail(ids: DataFrame, catalogue: DataFrame, scan: DataFrame) -> DataFrame:
    """ids(message_id) -> message_id, path, status: found, moved to another path, vanished or not_found."""
    now = scan.select("folder", "locator", F.col("path").alias("now"))
    rows = ids.join(catalogue, "message_id", "left").join(now, ["folder", "locator"], "left")
    status = F.when(F.col("content_hash").isNull(), "not_found").when(F.col("now").isNull(), "vanished").when(F.col("now") != F.col("path"), "moved").otherwise("found")
    return rows.select("message_id", F.coalesce("now", "path").alias("path"), status.alias("status"))


def load_packed_vectors(rows: DataFrame) -> DataFrame:
    """rows(..., blob) of packed little-endian floats -> vector; blobs of another length are left out."""
    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        import numpy as np

        return blobs.map(lambda b: np.frombuffer(bytes(b), "<f4"))

    return rows.where("octet_length(blob) % 4 = 0").withColumn("vector", unpack("blob")).drop("blob")


def dump_tables(**tables: DataFrame) -> DataFrame:
    """Every row of every table as one tab-separated line, nulls spelled, sorted: equal dumps are equal tables."""
    out = None
    for name, t in sorted(tables.items()):
        cells = [F.coalesce(F.to_json(c) if t.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string"), F.lit("NULL")) for c in sorted(t.columns)]
        rows = t.select(F.concat_ws("\t", F.lit(name), *cells).alias("line"))
        out = rows if out is None else out.union(rows)
    return out.orderBy("line")


def project_pages(records: DataFrame, links: DataFrame) -> DataFrame:
    """records(record_id, corpus, title, text), resolved links(record_id, target_kind, target, description, resolved, span_start, span_len) -> page, body, unresolved.

    Every link is replaced where it stands, by its byte span: a record with a page becomes a wikilink, an address stays one, all else
    becomes the words shown.  unresolved lists the targets of the last kind in order of place, those within the document left out.
    Spans that overlap an earlier one, or leave the text, are passed over.
    """
    pages = records.select("record_id", T.page_name(F.col("corpus"), F.col("record_id")).alias("page"), "title", "text")
    to = pages.select(F.col("record_id").alias("resolved"), F.col("page").alias("to_page"))
    within = F.col("target").startswith("#") | F.col("target").startswith("mailto:") | F.col("target").contains("://")
    kind = F.when(within, "url").otherwise(F.col("target_kind"))
    marked = links.join(to, "resolved", "left").select(
        "record_id", F.struct(F.col("span_start").cast("int").alias("at"), (F.col("span_start") + F.col("span_len")).cast("int").alias("end"), T.link_markup(kind, F.col("target"), F.coalesce("description", "target"), F.col("to_page")).alias("mark"),
        F.when(F.col("to_page").isNull() & (kind != "url"), F.col("target")).alias("open")).alias("x"),
    )
    per = marked.groupBy("record_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = pages.join(per, "record_id", "left").select("page", "title", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("xs", F.array().cast(per.schema["xs"].dataType)).alias("xs"))
    return rows.select("page", F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), F.coalesce("title", F.lit(""))), F.lit("---"), T.spliced(F.col("text"), F.col("xs"))).alias("body"), F.filter(F.transform("xs", lambda x: x["open"]), lambda t: t.isNotNull()).alias("unresolved"))
