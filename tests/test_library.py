"""The library's queries against DuckDB, and properties of single operators on inline rows."""

from __future__ import annotations

import math
import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation, links, maintenance, outline, retrieval, transcripts
from quillspark.plans.graph import connected_components
from quillspark.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        return
    cols = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [list(want.columns).index(c) for c in cols]
    assert sorted((repr(tuple(_plain(r[c]) for c in cols)) for r in rows)) == sorted(repr(tuple(_plain(x[i]) for i in at)) for x in want.fetchall())


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[201] == 200
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tags_by_case_and_marks(spark):
    rows = spark.createDataFrame([("silentCritic",), ("HTTPServer",), ("CI/CD",), ("CICD",), ("--a  b--",)], "t string")
    assert [r[0] for r in rows.select(T.normalize_tag(F.col("t"))).collect()] == ["silent-critic", "http-server", "ci-cd", "cicd", "a-b"]


def test_strip_tags_in_any_spelling(spark):
    rows = spark.createDataFrame([("#+FILETAGS: :aB:c:\n* x :a-b:",), ("t\n#+filetags: :a-b:\nu",), ("no tags",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.strip_tags(F.col("t"), ["a-b"])).collect()] == ["#+filetags: :c:\n* x :a-b:", "t\nu", "no tags", "", None]


def test_rerank_moves_only_the_window(spark):
    hits = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcde")], "query_id int, record_id string, rank int")
    scores = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9), (1, "c", 0.5)], "query_id int, record_id string, score double")
    got = retrieval.rerank_window(hits, scores, 3).orderBy("rank").collect()
    assert [r.record_id for r in got] == ["b", "c", "a", "d", "e"]


def test_pooling_orders(spark):
    v = spark.createDataFrame([("long", 1, [0.9, 0.1]), ("long", 2, [0.1, 0.9]), ("long", 3, [0.1, 0.9]), ("short", 4, [0.8, 0.2])], "record_id string, vec_id int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, qvec array<double>")
    order = lambda pooling: [r.record_id for r in retrieval.search_dense(q, v, pooling).orderBy("rank").collect()]
    assert order("max") == ["long", "short"] and order("mean_top3") == ["short", "long"] and order("length_norm") == ["short", "long"]


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([1.0], [1.0, 0.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0]


def test_blocks_of_scores_equal_every_pair(spark):
    vectors = [("a", 1, [1.0, 0.0]), ("a", 2, [3.0, 4.0]), ("b", 3, [0.0, 0.0]), ("b", 4, [1.0]), ("c", 5, None), ("c", 6, [1.0, None]), ("d", 7, []), ("a", 1, [1.0, 0.0])]
    v = spark.createDataFrame(vectors, "record_id string, vec_id int, embedding array<float>")
    q = spark.createDataFrame([("x", [0.6, 0.8]), ("y", [2.0]), ("z", None), ("x", [0.6, 0.8])], "query_id string, qvec array<float>")
    want = sorted((a.query_id, b[0], b[1], round(c, 6)) for a in q.collect() for b in vectors for c in [_cos(a.qvec, b[2])])
    for blocks in ((512, 4096), (1, 2)):
        got = retrieval.dense_scores(q, v, *blocks)
        assert sorted((r.query_id, r.record_id, r.vec_id, round(r.similarity, 6)) for r in got.collect()) == want
    assert retrieval.dense_scores(q, v.where("false")).count() == 0 and retrieval.dense_scores(q.where("false"), v).count() == 0


def test_scores_of_vectors_without_records(spark):
    v = spark.createDataFrame([(1, [2.0, 0.0]), (2, [-1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, qvec array<double>")
    got = retrieval.dense_scores(q, v)
    assert got.columns == ["query_id", "vec_id", "similarity"]
    assert {r.vec_id: round(r.similarity, 3) for r in got.collect()} == {1: 1.0, 2: -0.707, 3: 0.0, 4: 0.0, 5: 0.0}


def test_scores_of_a_block_in_parts():
    qs = [[1.0, 2.0], [3.0], None, [0.0, 0.0], [2.0, -1.0], [5.0], [math.nan, 1.0]]
    vs = [[1.0, 0.0], [2.0], [0.5, 0.25], None, [1.0, None]]
    q = pa.array([[{"query_id": i, "qvec": x} for i, x in enumerate(qs)]], pa.list_(pa.struct([("query_id", pa.int64()), ("qvec", pa.list_(pa.float64()))])))
    v = pa.array([[{"vec_id": i, "embedding": x} for i, x in enumerate(vs)]], pa.list_(pa.struct([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])))
    block, kinds = pa.RecordBatch.from_arrays([q, v], ["q_rows", "v_rows"]), [("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())]
    want = [(i, j, repr(round(_cos(a, b), 4))) for i, a in enumerate(qs) for j, b in enumerate(vs)]
    for rows_out in (1, 10, 1 << 18):
        got = pa.Table.from_batches(retrieval._block_cosines([block], kinds, 4, rows_out)).to_pylist()
        assert [(r["query_id"], r["vec_id"], repr(r["similarity"])) for r in got] == want


def test_cosine_meets_every_vector(spark, duck):
    vectors = dict(duck.sql("select vec_id, embedding from embeddings").fetchall())
    rows = QUERIES["cosine"](spark, SF).collect()
    got = {(r.query_id, r.vec_id): r.similarity for r in rows}
    assert len(rows) == len(got) and got.keys() == {(a, b) for a in vectors if a % 20 == 0 for b in vectors}
    assert all(abs(c - _cos(vectors[a], vectors[b])) < 1e-6 for (a, b), c in got.items())


def _cos(a, b):
    if a is None or b is None or None in a + b or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_chunks_cover_the_text_and_keep_characters():
    raw = ("é🙂 line\n" * 200).encode()
    spans = outline._cut(raw, 97)
    assert b"".join(raw[a : a + n] for a, n in spans) == raw and all(n <= 97 for _, n in spans)
    for a, n in spans:
        raw[a : a + n].decode()
    assert outline._cut(b"", 10) == [(0, 0)] and outline._cut(b"abc", 0) == [(0, 3)]


def test_streams_normalize_once(spark):
    text = spark.createDataFrame([("* A  :x:  \n\n\n\nb\r\n",)], "t string")
    once = text.select(F.regexp_replace(T.normalize_stream(F.lit("note"), F.col("t")), r"\Astream/3\n", "").alias("t"))
    twice = once.select(F.regexp_replace(T.normalize_stream(F.lit("note"), F.col("t")), r"\Astream/3\n", "").alias("t"))
    assert once.first() == twice.first()


def test_branches_survive_cycles(spark):
    nodes = spark.createDataFrame([("c", "a", "b", "a"), ("c", "b", "a", "a")], "conv string, node string, parent string, current string")
    assert links.surviving_branch(nodes).count() == 2


def test_programmatic_sessions_and_upserts(spark):
    rows = spark.createDataFrame([("s1", "sdk"), ("s2", "cli"), ("s3", None)], "session string, e string").select("session", F.struct(F.col("e").alias("entrypoint")).alias("r"))
    assert sorted(r.session for r in transcripts.drop_programmatic(rows).collect()) == ["s2", "s3"]
    base = spark.createDataFrame([("a", "old", 1)], "record_id string, title string, created_s long")
    new = spark.createDataFrame([("a", "new", 9), ("b", "b", 9)], "record_id string, title string, created_s long")
    got = {r.record_id: (r.title, r.created_s, r.superseded) for r in maintenance.upsert_records(base, new).collect()}
    assert got == {"a": ("new", 1, True), "b": ("b", 9, False)}
    assert maintenance.upsert_records(base, new, "create").count() == 2


def test_empty_latency_cells(spark):
    rows = spark.createDataFrame([("x", None)], "cell string, latency_ms double")
    r = evaluation.latency_stats(rows, "cell").first()
    assert r.n == 0 and r.p50 is None


def test_plans_push_down_and_never_compare_all_with_all(spark):
    records = spark.read.parquet(f"{SF}/documents.parquet").select(F.concat(F.lit("doc-"), "doc_id").alias("record_id"), F.col("source").alias("name_slug"))
    edges = records.select("record_id", F.lit("name").alias("target_kind"), F.col("name_slug").alias("target"), F.lit(0).alias("span_start"))
    plan = links.resolve_links(edges, records)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
