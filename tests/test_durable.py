"""Versioned tables, and the maintenance and ingest that write to them: failures, restarts, and what a change touches."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import durable, maintenance, retrieval
from quillspark.plans.versions import MANY, Conflict, Versions
from quillspark.streaming.ingest import Ingest


def _rows(spark, n, of="old"):
    return spark.range(n).select(F.concat(F.lit("r"), "id").alias("record_id"), F.lit(of).alias("title"))


def _titles(df):
    return {r.record_id: r.title for r in df.collect()}


def test_readers_see_one_version_and_failures_leave_it(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t")
    assert store.state()["version"] == 0 and not store.has("records") and store.vacuum() == 0
    with store.change() as c:
        c.put("records", _rows(spark, 20), "record_id", 8)
        c.put("names", _rows(spark, 3))
    before, seen = store.state(), store.read("records")
    with pytest.raises(ZeroDivisionError), store.change() as c:
        c.put("records", _rows(spark, 5, "new"), "record_id", 8)
        c.append("names", _rows(spark, 1))
        1 / 0
    assert store.state() == before and _titles(store.read("records")) == {f"r{i}": "old" for i in range(20)}
    durable.put_records(store, _rows(spark, 1, "new"))
    # who reads the old version goes on with it; only one bucket is another
    assert _titles(seen) == {f"r{i}": "old" for i in range(20)} and _titles(store.read("records"))["r0"] == "new"
    now = store.state()["tables"]["records"]["parts"]
    assert sum(now[b] != p for b, p in before["tables"]["records"]["parts"].items()) == 1 and now.keys() == before["tables"]["records"]["parts"].keys()
    assert store.read("records", 1).where("title = 'new'").count() == 0
    # what the failed change wrote goes, what two versions name stays
    assert store.vacuum() > 0 and store.read("records").count() == 20 and store.read("names").count() == 3
    assert store.vacuum(1) > 0 and store.read("records").count() == 20


def test_of_two_writers_one_is_told(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t")
    with store.change() as c:
        c.put("records", _rows(spark, 4), "record_id", 2)
    with pytest.raises(Conflict), store.change() as late:
        late.put("records", _rows(spark, 1, "late"), "record_id", 2)
        durable.put_records(store, _rows(spark, 1, "first"))
    assert _titles(store.read("records")) == {"r0": "first", "r1": "old", "r2": "old", "r3": "old"}


def test_growing_tables_are_gathered(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t")
    with store.change() as c:
        c.put("log", spark.range(0))
        c.state["tables"]["log"]["parts"] *= MANY
    with store.change() as c:
        c.append("log", spark.range(3))
    assert len(store.state()["tables"]["log"]["parts"]) == 1 and store.read("log").count() == 3


def test_rebuilds_forget_and_empty_buckets(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t")
    derive = lambda docs: {"titles": docs.select("record_id", "title"), "words": docs.select("record_id", F.explode(F.split("title", " ")).alias("word"))}
    durable.rebuild_tables(store, _rows(spark, 6, "a b"), derive, buckets=4)
    assert store.read("words").count() == 12 and store.state()["version"] == 1
    swept = []
    durable.rebuild_tables(store, _rows(spark, 2, "c"), derive, ids=_rows(spark, 3).select("record_id"), sweep=lambda c, ids: swept.append(ids.count()))
    assert _titles(store.read("titles")) == {"r0": "c", "r1": "c", "r3": "a b", "r4": "a b", "r5": "a b"} and swept == [3] and store.read("words").count() == 8
    durable.forget_records(store, _rows(spark, 6).select("record_id"), ["titles", "words"])
    assert store.read("titles").count() == 0 and store.read("words").count() == 0 and store.read("titles").columns == ["record_id", "title"]


def _spans(spark, n):
    return spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("stream_hash"), F.lit(0).cast("long").alias("span_start"), F.lit(1).cast("long").alias("span_len"), F.col("id").cast("string").alias("body"))


def test_embedding_goes_on_where_it_failed(spark, tmp_path):
    store, log = Versions(spark, f"file://{tmp_path}/t"), tmp_path / "asked"
    log.mkdir()

    def embedder(fails):
        def run(batches):
            for pdf in batches:
                for body in pdf.body:
                    if fails and (log / body).exists() is False and len(os.listdir(log)) >= 12:
                        raise RuntimeError("endpoint down")
                    (log / f"{body}.{len(os.listdir(log))}").touch()
                yield pdf[["stream_hash", "span_start", "span_len"]].assign(vector=[[1.0]] * len(pdf))

        return run

    with pytest.raises(Exception, match="endpoint down"):
        durable.embed_missing(store, _spans(spark, 40), "m", embedder(True), slices=8)
    kept = {r.stream_hash for r in store.read("vectors").collect()}
    done = store.done("vectors.m")
    assert kept and 0 < done < 8
    first = {p.name.split(".")[0] for p in log.iterdir()}
    asked_of_kept = {b for b in first if spark.range(1).select(F.sha2(F.lit(b), 256)).first()[0] in kept}
    for p in log.iterdir():
        p.unlink()
    durable.embed_missing(store, _spans(spark, 40), "m", embedder(False), slices=8)
    again = {p.name.split(".")[0] for p in log.iterdir()}
    assert store.read("vectors").count() == 40 == store.read("vectors").select("stream_hash").distinct().count()
    assert asked_of_kept and not asked_of_kept & again and store.done("vectors.m") == -1
    # nothing is missing now; new spans are
    for p in log.iterdir():
        p.unlink()
    durable.embed_missing(store, _spans(spark, 43), "m", embedder(False), slices=8)
    assert {p.name.split(".")[0] for p in log.iterdir()} == {"40", "41", "42"}


def test_generation_keeps_refused_ones_apart(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t")
    records = _spans(spark, 12).select(F.col("body").alias("record_id"), "stream_hash", F.col("body").alias("text"))

    def generator(batches):
        for pdf in batches:
            yield pdf.assign(artifact=["  " if int(t) % 3 == 0 else f" about {t} " for t in pdf.text])[["stream_hash", "artifact"]]

    none = spark.createDataFrame([], "stream_hash string, generator string, prompt string, artifact string")
    plan = lambda have: maintenance.artifacts_to_generate(records, none if have is None else have, "g", "p")
    durable.generate_missing(store, plan, records, generator, "g", "p", slices=3)
    assert sorted(r.artifact for r in store.read("artifacts").collect()) == sorted(f"about {i}" for i in range(12) if i % 3)
    assert store.read("artifacts.refused").count() == 4


# --- ingest


def _post(path, name, *submissions):
    path.mkdir(parents=True, exist_ok=True)
    file = path / f"{name}.json"
    file.write_text("".join(s if isinstance(s, str) else json.dumps({"corpus": "kb", "provenance": None} | s) for s in submissions))
    os.utime(file, (1_700_000_000 + int(name),) * 2)  # files are taken by their time


def _base(spark):
    return spark.createDataFrame([("a", "old", "A", 1, 1), ("z", "old", "Z", 1, 1)], "record_id string, stream_hash string, title string, created_s long, updated_s long")


def _queue(path):
    _post(path, "1", {"id": "a", "document": "#+title: one\nx", "accepted": 5})
    _post(path, "2", {"id": "b", "document": "two", "accepted": 6})
    _post(path, "3", {"id": "b", "document": "two again", "accepted": 7})
    _post(path, "4", "{broken")
    _post(path, "5", {"id": "c", "document": " ", "accepted": 8})


def _now(store):
    return sorted(map(tuple, store.read("records").collect())), sorted((r.id or "", r.reason) for r in store.read("dead").collect()), store.read("gauges").agg(F.sum("depth")).first()[0]


def test_ingest_that_fails_after_its_commit_loses_and_repeats_nothing(spark, tmp_path):
    _queue(tmp_path / "in")
    whole = Versions(spark, f"file://{tmp_path}/whole")
    Ingest(whole, _base(spark)).run(f"file://{tmp_path}/in", f"file://{tmp_path}/c1", files=1)
    want = _now(whole)
    assert len(want[0]) == 3 and len(want[1]) == 2 and want[2] == 5

    store = Versions(spark, f"file://{tmp_path}/broken")
    for fails in (0, 2, 3, None):  # each a new process's state: only what is written is known

        class Dies(Ingest):
            def __call__(self, batch, batch_id):
                super().__call__(batch, batch_id)
                if batch_id == fails:  # noqa: B023
                    raise RuntimeError("lost before the checkpoint")

        try:
            Dies(store, _base(spark)).run(f"file://{tmp_path}/in", f"file://{tmp_path}/c2", files=1)
        except Exception as e:
            assert "lost before the checkpoint" in str(e)
    assert _now(store) == want
    # later submissions meet the records as they are, not as they were at first
    _post(tmp_path / "in", "6", {"id": "z", "document": "last", "accepted": 9})
    Ingest(store, _base(spark)).run(f"file://{tmp_path}/in", f"file://{tmp_path}/c2")
    assert {r.record_id: r.updated_s for r in store.read("records").collect()} == {"a": 5, "b": 7, "z": 9}


def test_batch_of_known_texts_touches_no_bucket(spark, tmp_path):
    _post(tmp_path / "in", "1", {"id": "b", "document": "two", "accepted": 6})
    store = Versions(spark, f"file://{tmp_path}/t")
    run = lambda: Ingest(store, _base(spark)).run(f"file://{tmp_path}/in", f"file://{tmp_path}/c")
    run()
    before = store.state()["tables"]["records"]
    _post(tmp_path / "in", "2", {"id": "b", "document": "two", "accepted": 7})
    run()
    assert store.state()["tables"]["records"] == before and store.read("gauges").count() == 2


_SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from quillspark.plans.versions import Versions
from quillspark.streaming.ingest import Ingest
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
class Killed(Ingest):
    def __call__(self, batch, batch_id):
        super().__call__(batch, batch_id)
        if batch_id == {at}:
            os.kill(spark._jvm.java.lang.ProcessHandle.current().pid(), 9)
            os._exit(9)
base = spark.createDataFrame([("a", "old", "A", 1, 1), ("z", "old", "Z", 1, 1)], "record_id string, stream_hash string, title string, created_s long, updated_s long")
Killed(Versions(spark, "file://{path}/t"), base).run("file://{path}/in", "file://{path}/c", files=1)
"""


def test_killed_process_is_followed_by_a_new_one(spark, tmp_path):
    _queue(tmp_path / "in")
    root = str(Path(__file__).resolve().parent.parent)
    for at, code in ((1, 9), (None, 0)):
        done = subprocess.run([sys.executable, "-c", _SCRIPT.format(root=root, at=at, path=tmp_path)], capture_output=True, text=True, timeout=150)
        assert (done.returncode == 0) == (code == 0), done.stderr[-2000:]
    whole = Versions(spark, f"file://{tmp_path}/whole")
    Ingest(whole, _base(spark)).run(f"file://{tmp_path}/in", f"file://{tmp_path}/c1", files=1)
    assert _now(Versions(spark, f"file://{tmp_path}/t")) == _now(whole)


# --- the text index


def test_stored_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    rows = [("a", 0, "The cat sat."), ("a", 1, "cats and dogs"), ("b", 0, "a dog"), ("c", 0, "..."), ("d", 0, "Über die Katze")]
    passages = spark.createDataFrame(rows, "record_id string, passage_id int, body string")
    index = retrieval.text_index(passages)
    assert index.stats.first().n == 5 and {r.term: r.passages for r in index.dictionary.collect()}["cat"] == 1
    store = Versions(spark, f"file://{tmp_path}/t")
    retrieval.write_index(store, index, 16)
    asked = spark.createDataFrame([(1, "cat"), (2, "dog a"), (3, "  "), (4, "absent cat"), (5, "über"), (6, "cat cat")], "query_id int, query string")
    want = sorted(map(tuple, retrieval.search_lexical(asked, passages).collect()))
    assert sorted((q, r) for q, r, *_ in want) == [(1, "a"), (2, "a"), (2, "b"), (5, "d"), (6, "a")]
    read = retrieval.read_index(store, asked)
    assert sorted(map(tuple, retrieval.search_lexical(asked, read).collect())) == want
    assert len(read.postings.inputFiles()) < len(retrieval.read_index(store).postings.inputFiles())
    assert retrieval.search_lexical(asked.where("false"), passages).count() == 0 and retrieval.search_lexical(asked, passages.where("false")).count() == 0
