"""Maintenance that writes: upserts, rebuilds, repairs, embedding and generation into versioned tables.

Each is one version of a ``Versions`` folder (embedding and generation: one a slice), so readers
see the tables before or after and a failure leaves what was there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import maintenance as M
from quillspark.plans.staging import Scratch
from quillspark.plans.versions import Change, Versions

Derive = Callable[[DataFrame], dict[str, DataFrame]]
Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def put_records(store: Versions, updates: DataFrame, mode: str = "put", table: str = "records") -> int:
    """``upsert_records`` into the stored table; only buckets of the updates are read and written.  Returns the new version."""
    with store.change() as c:
        touched = c.touched(table, updates)
        c.replace(table, M.upsert_records(c.held(table, touched), updates, mode).drop("superseded"), touched)
    return c.state["version"]


def _dropped(c: Change, name: str, ids: DataFrame, new: DataFrame | None = None) -> None:
    """The rows of ids out of a table, and new ones of the same ids in."""
    touched = c.touched(name, ids)
    kept = M.forget(ids, rows=c.held(name, touched))["rows"]
    c.replace(name, kept if new is None else kept.unionByName(new), touched)


def forget_records(store: Versions, ids: DataFrame, tables: list[str]) -> int:
    """Records out of all these tables at once; vectors wait for a sweep."""
    with store.change() as c:
        for name in tables:
            _dropped(c, name, ids)
    return c.state["version"]


def rebuild_tables(store: Versions, docs: DataFrame, derive: Derive, ids: DataFrame | None = None, key: str = "record_id", buckets: int = 64, sweep: Callable[[Change, DataFrame], None] | None = None) -> int:
    """What derive makes of docs: whole tables, or with ids their rows only; all tables change at once.  sweep follows a rebuild of ids."""
    with store.change() as c:
        if ids is None:
            for name, df in derive(docs).items():
                c.put(name, df, key, buckets)
        else:
            for name, df in derive(docs.join(ids.select(key), key, "left_semi")).items():
                _dropped(c, name, ids, df)
            if sweep is not None:
                sweep(c, ids)
    return c.state["version"]


def repair_tables(store: Versions, surveyed: DataFrame, docs: DataFrame, derive: Derive) -> int:
    """Missing and stale records derived anew and orphaned ones forgotten, in one version."""
    with Scratch() as scratch, store.change() as c:
        found = scratch(surveyed.where("status <> 'ok'").select("record_id", "status"))
        ids = found.select("record_id").distinct()
        for name, df in derive(docs.join(M.repairable(found), "record_id", "left_semi")).items():
            _dropped(c, name, ids, df)
    return c.state["version"]


def _sliced(store: Versions, job: str, todo: Callable[[], DataFrame], key: str, slices: int, work: Callable[[Change, DataFrame], None]) -> None:
    """work over the rows of todo, slice by slice, each committed with its number.

    todo is asked for and written once; a run that failed goes on with it behind the last slice committed.
    """
    table = f"{job}.todo"
    if not store.has(table) or store.done(job) < 0:
        with store.change() as c:
            c.put(table, todo(), key, slices)
            c.done(job, 0)
    for i in range(store.done(job), slices):
        with store.change() as c:
            if str(i) in c.state["tables"][table]["parts"]:
                work(c, c.held(table, [i]))
            c.done(job, i + 1 if i + 1 < slices else -1)


def embed_missing(store: Versions, spans: DataFrame, model: str, embedder: Batches, slices: int = 16, table: str = "vectors") -> None:
    """``M.embed_missing`` into the stored vectors, committed as produced; a failed run is resumed and asks for no vector twice."""

    def todo() -> DataFrame:
        have = store.read(table) if store.has(table) else spans.select("stream_hash", "span_start", "span_len", F.lit(model).alias("model")).limit(0)
        return M.spans_to_embed(spans, have, model).select("stream_hash", "span_start", "span_len", "body")

    def work(c: Change, part: DataFrame) -> None:
        made = part.mapInPandas(embedder, "stream_hash string, span_start long, span_len long, vector array<float>")
        c.append(table, made.withColumn("model", F.lit(model)))

    _sliced(store, f"{table}.{model}", todo, "stream_hash", slices, work)


def generate_missing(store: Versions, plan: Callable[[DataFrame | None], DataFrame], texts: DataFrame, generator: Batches, name: str, prompt: str, chars: int = 6000, slices: int = 16, table: str = "artifacts") -> None:
    """``M.generate_missing`` into the stored artifacts, committed as produced; blank ones go to `<table>.refused`.

    plan(stored artifacts, None before the first) -> record_id, stream_hash, status.
    """

    def todo() -> DataFrame:
        asked = plan(store.read(table) if store.has(table) else None).where("status = 'to_generate'").select("record_id", "stream_hash")
        rows = asked.join(texts.select("record_id", F.left("text", F.lit(chars)).alias("text")), "record_id")
        return rows.groupBy("stream_hash").agg(F.min_by("text", "record_id").alias("text"))

    def work(c: Change, part: DataFrame) -> None:
        with Scratch() as scratch:
            made = scratch(part.mapInPandas(generator, "stream_hash string, artifact string").select("stream_hash", F.lit(name).alias("generator"), F.lit(prompt).alias("prompt"), F.trim("artifact").alias("artifact")))
            c.append(table, made.where("artifact <> ''"))
            c.append(f"{table}.refused", made.where("artifact is null or artifact = ''").drop("artifact"))

    _sliced(store, f"{table}.{name}.{prompt}", todo, "stream_hash", slices, work)
