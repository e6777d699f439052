"""Keeping derived tables in step with their source: diffs, upserts, sweeps and missing-only work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T


def upsert_records(base: DataFrame, updates: DataFrame, mode: str = "put") -> DataFrame:
    """base replaced by updates of the same id; created stays that of the old row, and what an update leaves null.

    mode create drops updates of ids already held, mode update those of ids not held.
    superseded tells which rows took the place of another.
    """
    old = base.select("record_id", *[F.col(c).alias(f"old_{c}") for c in base.columns if c != "record_id"], F.lit(True).alias("held"))
    rows = updates.join(old, "record_id", "left")
    if mode == "create":
        rows = rows.where("held is null")
    elif mode == "update":
        rows = rows.where("held")
    own = set(updates.columns)
    cells = [F.coalesce(f"old_{c}", c).alias(c) if c == "created_s" and c in own else F.coalesce(c, f"old_{c}").alias(c) if c in own else F.col(f"old_{c}").alias(c) for c in base.columns if c != "record_id"]
    new = rows.select("record_id", *cells, F.coalesce("held", F.lit(False)).alias("superseded"))
    kept = base.join(new.select("record_id"), "record_id", "left_anti").withColumn("superseded", F.lit(False))
    return kept.unionByName(new)


def forget(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of these records; vectors are not among them and wait for a sweep."""
    return {name: t.join(ids.select("record_id"), "record_id", "left_anti") for name, t in tables.items()}


#: Bytes of a stream that one task sweeps, as a power of two.
SWEPT = 16


def spans_inside(vectors: DataFrame, passages: DataFrame) -> DataFrame:
    """Vector spans that lie in a passage of their record, once each.

    A span lies in one if, of the passages that start no later, one reaches as far: starts are swept in order with the furthest
    reach so far.  A record is cut into stretches, each begun with the reach of those before, so a long record is many tasks, and
    work is linear in spans and passages.
    """
    p = passages.where("span_start is not null and span_len is not null").select("record_id", F.col("span_start").cast("long").alias("at"), (F.col("span_start") + F.col("span_len")).cast("long").alias("reach"), F.lit(None).cast("long").alias("len"))
    s = vectors.where("span_start is not null and span_len is not null").select("record_id", F.col("span_start").cast("long").alias("at"), F.lit(None).cast("long").alias("reach"), F.col("span_len").cast("long").alias("len")).distinct()
    rows = p.unionByName(s).withColumn("stretch", F.shiftright("at", SWEPT))
    earlier = Window.partitionBy("record_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("record_id", "stretch").agg(F.max("reach").alias("furthest")).select("record_id", "stretch", F.max("furthest").over(earlier).alias("carried"))
    # at one place passages come first
    so_far = Window.partitionBy("record_id", "stretch").orderBy("at", F.col("len").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("own", F.max("reach").over(so_far)).join(carried, ["record_id", "stretch"])
    inside = F.greatest("own", "carried") >= F.col("at") + F.col("len")
    return swept.where(F.col("len").isNotNull() & F.coalesce(inside, F.lit(False))).select("record_id", F.col("at").alias("span_start"), F.col("len").alias("span_len"))


def embedded_spans(vectors: DataFrame, passages: DataFrame) -> DataFrame:
    """Vector spans that lie in a passage of their stream, once each; vectors themselves stay out of the sweep."""
    return spans_inside(vectors, passages)


def orphan_vectors(vectors: DataFrame, passages: DataFrame) -> DataFrame:
    """Vectors that no passage of their record contains."""
    return vectors.join(spans_inside(vectors, passages), ["record_id", "span_start", "span_len"], "left_anti")


def survey(store: DataFrame, index: DataFrame) -> DataFrame:
    """store and index (record_id, stream_hash) -> record_id, status: missing, stale, orphaned or ok."""
    rows = store.select("record_id", F.col("stream_hash").alias("s")).join(index.select("record_id", F.col("stream_hash").alias("i")), "record_id", "full_outer")
    status = F.when(F.col("i").isNull(), "missing").when(F.col("s").isNull(), "orphaned").when(F.col("s") != F.col("i"), "stale").otherwise("ok")
    return rows.select("record_id", status.alias("status"))


def survey_report(surveyed: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    got = surveyed.agg(n("missing"), n("stale"), n("orphaned"), n("ok"))
    return got.withColumn("clean", F.expr("missing + stale + orphaned = 0"))


def repairable(surveyed: DataFrame) -> DataFrame:
    return surveyed.where("status in ('missing', 'stale')").select("record_id").distinct()


def deep_survey(raw: DataFrame, streams: DataFrame) -> DataFrame:
    """raw(record_id, kind, text) normalized again and compared with streams(record_id, stream): identical, version or content."""
    rows = raw.select("record_id", T.normalize_stream(F.col("kind"), F.col("text")).alias("now")).join(streams, "record_id")
    tail = lambda c: F.regexp_replace(c, r"(?s)\A[^\n]*\n", "")
    return rows.select("record_id", F.when(F.col("now") == F.col("stream"), "identical").when(tail("now") == tail("stream"), "version").otherwise("content").alias("status"))


def missing_ids(local: DataFrame, served: DataFrame) -> DataFrame:
    return local.select("record_id").distinct().join(served.select("record_id"), "record_id", "left_anti").orderBy("record_id")


def spans_to_embed(spans: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """spans(stream_hash, span_start, span_len, ...) without a stored vector for the model."""
    have = vectors.where(F.col("model") == model).select("stream_hash", "span_start", "span_len")
    return spans.join(have, ["stream_hash", "span_start", "span_len"], "left_anti")


def embed_missing(spans: DataFrame, vectors: DataFrame, model: str, embedder: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Vectors for the missing spans; embedder maps frames (stream_hash, span_start, span_len, body) to the same keys with a vector."""
    todo = spans_to_embed(spans, vectors, model).select("stream_hash", "span_start", "span_len", "body")
    return todo.mapInPandas(embedder, "stream_hash string, span_start long, span_len long, vector array<float>").withColumn("model", F.lit(model))


def hashing_embedder(dims: int = 16) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A deterministic embedder for tests: counts of hashed words, normalised."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import numpy as np

        for pdf in batches:
            out = []
            for body in pdf.body:
                v = np.zeros(dims, np.float32)
                for w in (body or "").lower().split():
                    v[zlib.crc32(w.encode()) % dims] += 1
                out.append((v / max(1e-9, float(np.linalg.norm(v)))).tolist())
            yield pdf[["stream_hash", "span_start", "span_len"]].assign(vector=out)

    return embed


def artifacts_to_generate(records: DataFrame, artifacts: DataFrame, generator: str, prompt: str, ids: DataFrame | None = None) -> DataFrame:
    """record_id, stream_hash, status: to_generate, reused, or unknown for an asked id that is no record."""
    have = artifacts.where((F.col("generator") == generator) & (F.col("prompt") == prompt)).select("stream_hash", F.lit(True).alias("have")).distinct()
    rows = records.select("record_id", "stream_hash")
    if ids is not None:
        rows = ids.select("record_id").join(rows, "record_id", "left")
    rows = rows.join(have, "stream_hash", "left")
    return rows.select("record_id", "stream_hash", F.when(F.col("stream_hash").isNull(), "unknown").when(F.col("have"), "reused").otherwise("to_generate").alias("status"))


def generate_missing(plan: DataFrame, texts: DataFrame, generator: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], chars: int = 6000) -> DataFrame:
    """stream_hash, artifact for what the plan lacks, once per stream; generator maps (stream_hash, text) to (stream_hash, artifact); blank ones are refused."""
    todo = plan.where("status = 'to_generate'").select("record_id", "stream_hash").join(texts.select("record_id", F.left("text", F.lit(chars)).alias("text")), "record_id")
    todo = todo.groupBy("stream_hash").agg(F.min_by("text", "record_id").alias("text"))
    made = todo.mapInPandas(generator, "stream_hash string, artifact string")
    return made.select("stream_hash", F.trim("artifact").alias("artifact")).where("artifact <> ''")


def generated_for(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every record with the artifacts of its stream."""
    return records.select("record_id", "stream_hash").join(artifacts, "stream_hash").select("record_id", "generator", "prompt", "artifact")


def drift(expected: DataFrame, current: DataFrame) -> DataFrame:
    """expected(record_id, expected_hash) whose current hash differs; '' where there is none."""
    rows = expected.join(current.select("record_id", F.col("stream_hash").alias("now")), "record_id", "left")
    return rows.select("record_id", "expected_hash", F.coalesce("now", F.lit("")).alias("current_hash")).where("expected_hash <> current_hash")


def page_status(rendered: DataFrame, existing: DataFrame) -> DataFrame:
    """rendered(page, body), existing(page, body, marker: hash of the body as it was written) -> page, status."""
    e = existing.select("page", F.col("body").alias("e_body"), "marker")
    rows = rendered.join(e, "page", "full_outer")
    touched = F.sha2("e_body", 256) != F.col("marker")
    status = F.when(F.col("e_body").isNull(), "written").when(touched, "hand_edited").when(F.col("body").isNull(), "orphaned").when(F.col("body") == F.col("e_body"), "unchanged").otherwise("refreshed")
    return rows.select("page", status.alias("status"))


def import_diff(rendered: DataFrame, stored: DataFrame) -> DataFrame:
    """rendered(record_id, text, project), stored -> record_id, action: create, update or skip; trailing space and unknown provenance do not count."""
    s = stored.select("record_id", F.col("text").alias("s_text"), F.col("project").alias("s_project"))
    rows = rendered.join(s, "record_id", "left")
    same = (F.regexp_replace("text", r"\s+$", "") == F.regexp_replace("s_text", r"\s+$", "")) & (F.col("project").isNull() | F.col("project").eqNullSafe(F.col("s_project")))
    return rows.select("record_id", F.when(F.col("s_text").isNull(), "create").when(same, "skip").otherwise("update").alias("action"))


def import_report(diff: DataFrame) -> DataFrame:
    """diff(source, action) -> counts of every action per source."""
    return diff.groupBy("source").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("create", "update", "skip", "empty", "failed")])


def add_tags(tags: DataFrame, ids: DataFrame, new: list[str]) -> DataFrame:
    """Only the rows that change something: ids without the tag yet."""
    if not [t for t in new if t.strip()]:
        raise ValueError("no tag given")
    wanted = ids.select("record_id", F.explode(F.array(*[T.normalize_tag(F.lit(t)) for t in new])).alias("tag")).where("tag <> ''").distinct()
    return tags.unionByName(wanted.join(tags, ["record_id", "tag"], "left_anti"))


def remove_tags(tags: DataFrame, ids: DataFrame, gone: list[str]) -> DataFrame:
    if not [t for t in gone if t.strip()]:
        raise ValueError("no tag given")
    which = ids.select("record_id", F.explode(F.array(*[T.normalize_tag(F.lit(t)) for t in gone])).alias("tag"))
    return tags.join(which, ["record_id", "tag"], "left_anti")


def merge_tag(tags: DataFrame, old: str, new: str) -> DataFrame:
    """Every record's `old` becomes `new`, once."""
    if not old.strip() or not new.strip() or old == new:
        raise ValueError("two different tags are needed")
    return tags.withColumn("tag", F.when(F.col("tag") == T.normalize_tag(F.lit(old)), T.normalize_tag(F.lit(new))).otherwise(F.col("tag"))).distinct()


def rebuild(docs: DataFrame, old: dict[str, DataFrame], derive: Callable[[DataFrame], dict[str, DataFrame]], ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Derived tables from docs: all of them, or with ids only theirs, beside the old rows of other records."""
    if ids is None:
        return derive(docs)
    new = derive(docs.join(ids.select("record_id"), "record_id", "left_semi"))
    kept = forget(ids, **{k: old[k] for k in new})
    return {k: kept[k].unionByName(v) for k, v in new.items()}


def repair(surveyed: DataFrame, docs: DataFrame, old: dict[str, DataFrame], derive: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Missing and stale records derived anew, orphaned ones forgotten."""
    built = rebuild(docs, old, derive, repairable(surveyed))
    return forget(surveyed.where("status = 'orphaned'"), **built)


def merge_submission_defaults(submissions: DataFrame, projects: DataFrame) -> DataFrame:
    """project: what the submission says, else what its working directory resolves to; the longest known parent directory wins."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("cwd", "/"))), lambda i: F.array_join(F.slice(F.split("cwd", "/"), 1, i), "/"))
    paths = submissions.where("cwd is not null").select("id", F.explode(up).alias("dir")).join(projects.withColumnRenamed("project", "found"), "dir")
    best = paths.groupBy("id").agg(F.max_by("found", F.length("dir")).alias("found"))
    return submissions.join(best, "id", "left").withColumn("project", F.coalesce("project", "found")).drop("found")


def title_cache(records: DataFrame, cached: DataFrame) -> DataFrame:
    """record_id, title: cached, else derived, else the id."""
    rows = records.join(cached.select("record_id", F.col("title").alias("known")), "record_id", "left")
    return rows.select("record_id", T.fallback_title(F.col("known"), F.col("title"), F.col("record_id")).alias("title"))
