"""Recall, reciprocal rank, latency and usage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.plans.staging import staged


def load_questions(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """raw(question_id, query, population, expect array<struct<node_id, title_regex, corpus>>) -> questions, expectations, rejected.

    The corpus of an expectation is kb unless given; one without id and pattern makes its question invalid.
    """
    bad = F.exists("expect", lambda x: x["node_id"].isNull() & x["title_regex"].isNull()) | F.col("query").isNull() | (F.trim("query") == "")
    good, rejected = raw.where(~F.coalesce(bad, F.lit(True))), raw.where(F.coalesce(bad, F.lit(True)))
    expectations = good.select("question_id", F.explode("expect").alias("x")).select("question_id", "x.node_id", "x.title_regex", F.coalesce("x.corpus", F.lit("kb")).alias("corpus"))
    return good.select("question_id", "query", "population"), expectations, rejected.select("question_id")


def corpus_questions(expectations: DataFrame) -> DataFrame:
    """question_id, corpus: the one corpus of its expectations, or mixed."""
    every = expectations.groupBy("question_id").agg(F.min("corpus").alias("lo"), F.max("corpus").alias("hi"))
    return every.select("question_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("corpus"))


def match_expectations(hits: DataFrame, expectations: DataFrame) -> DataFrame:
    """hits(question_id, corpus, record_id, title, rank, similarity) that an expectation of their question and corpus answers."""
    e = expectations.withColumnRenamed("node_id", "want")
    same = F.col("record_id") == F.col("want")
    found = F.coalesce(same, F.lit(False)) | F.coalesce(F.expr("regexp_like(title, title_regex)"), F.lit(False))
    return hits.join(e, ["question_id", "corpus"]).where(found).select(*hits.columns).distinct()


def score_questions(questions: DataFrame, hits: DataFrame, matches: DataFrame, limit: int) -> DataFrame:
    """Per question: best rank, its record and similarity, the highest similarity, number of candidates, saturation."""
    best = matches.groupBy("question_id").agg(F.min("rank").alias("best_rank"), F.min_by("record_id", "rank").alias("hit_id"), F.min_by("similarity", "rank").alias("hit_similarity"))
    seen = hits.groupBy("question_id").agg(F.count("*").alias("candidates"), F.max("similarity").alias("max_similarity"))
    rows = questions.join(best, "question_id", "left").join(seen, "question_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return rows.withColumn("saturated", F.col("candidates") >= limit)


def _measures() -> list[Column]:
    at = lambda k: F.avg(F.coalesce(F.col("best_rank") <= k, F.lit(False)).cast("double"))
    return [
        F.count("*").alias("questions"), at(5).alias("recall_5"), at(10).alias("recall_10"), F.avg(F.coalesce(1 / F.col("best_rank"), F.lit(0.0))).alias("mrr"),
        F.avg("candidates").alias("mean_candidates"), F.percentile("candidates", 0.5).alias("median_candidates"), F.min("candidates").alias("min_candidates"), F.max("candidates").alias("max_candidates"),
        F.count_if("saturated").alias("saturated"), F.avg("hit_similarity").alias("mean_hit_similarity"), F.count_if(F.col("best_rank").isNull()).alias("misses"),
    ]


def eval_aggregate(scored: DataFrame) -> DataFrame:
    return scored.agg(*_measures())


def eval_breakdown(scored: DataFrame) -> DataFrame:
    """All questions, per corpus and per population, in one pass over grouping sets."""
    return scored.groupingSets([[], ["corpus"], ["population"]], "corpus", "population").agg(*_measures())


def signal_contributions(trace: DataFrame, expected: DataFrame) -> DataFrame:
    """trace(question_id, stage, record_id, rank), expected(question_id, record_id) -> per question and signal: candidates and the expected rank."""
    rows = trace.join(expected.withColumn("wanted", F.lit(True)), ["question_id", "record_id"], "left")
    return rows.groupBy("question_id", "stage").agg(F.count("*").alias("candidates"), F.min(F.when(F.col("wanted"), F.col("rank"))).alias("expected_rank"))


def verify_expected(expected: DataFrame, records: DataFrame) -> DataFrame:
    return expected.join(records.select("record_id"), "record_id", "left_anti")


def expected_ids(expectations: DataFrame) -> DataFrame:
    """Distinct expected ids in the order in which they are first asked for."""
    return expectations.groupBy("record_id").agg(F.min("question_id").alias("first")).orderBy("first", "record_id")


def percentiles(values: DataFrame, by: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """by -> p: the values at these shares, interpolated between neighbours, for cells with a value.

    Equal values of a cell become one row with a count; these rows are dealt out by ranges of (cell, value), and a row's places are
    the counts of the ranges before it and of the rows before it in its range.  So no task holds a cell, and what a cell gives is
    the two rows around each share.
    """
    cell = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    counts = values.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c")).withColumn("_cell", cell)
    parts = staged(counts.repartitionByRange("_cell", column).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_cell", "_part").agg(F.sum("c").alias("size"))
    before = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("n", F.sum("size").over(Window.partitionBy("_cell")))
    upto = Window.partitionBy("_cell", "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.join(sizes.drop("size"), ["_cell", "_part"]).withColumn("upto", F.col("before") + F.sum("c").over(upto))
    at = lambda place: F.max(F.when((place >= F.col("upto") - F.col("c")) & (place < F.col("upto")), F.col(column)))
    place = {q: F.lit(q) * (F.col("n") - 1) for q in shares}
    ends = [x for i, q in enumerate(shares) for x in (at(F.floor(place[q])).alias(f"lo_{i}"), at(F.ceil(place[q])).alias(f"hi_{i}"))]
    got = placed.groupBy("_cell").agg(F.max("n").alias("n"), *[F.min(c).alias(c) for c in by], *ends)
    part = lambda q: place[q] - F.floor(place[q])
    return got.select("_cell", F.array(*[F.col(f"lo_{i}") + (F.col(f"hi_{i}") - F.col(f"lo_{i}")) * part(q) for i, q in enumerate(shares)]).alias("p"))


def latency_stats(outcomes: DataFrame, *by: str) -> DataFrame:
    """by -> n, p50, p95, max_ms, mean_ms; a cell without a value has n 0 and nulls."""
    got = outcomes.groupBy(*by).agg(F.count("latency_ms").alias("n"), F.max("latency_ms").alias("max_ms"), F.avg("latency_ms").alias("mean_ms"))
    got = got.withColumn("_cell", F.to_json(F.struct(*by), {"ignoreNullFields": "false"})).join(percentiles(outcomes, by, "latency_ms", (0.5, 0.95)), "_cell", "left")
    return got.select(*by, "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "max_ms", "mean_ms")


def verdict(outcomes: DataFrame, ratio: float = 2.0, dense_ms: float = 300.0) -> DataFrame:
    """Per client count: is the worst loaded p95 at most `ratio` times the idle p95, and the idle p95 under the limit?"""
    cells = latency_stats(outcomes, "condition", "clients")
    rows = cells.groupBy("clients").agg(F.max(F.when(F.col("condition") == "idle", F.col("p95"))).alias("idle_p95"), F.max(F.when(F.col("condition") != "idle", F.col("p95"))).alias("loaded_p95"))
    return rows.select("clients", "idle_p95", "loaded_p95", (F.col("loaded_p95") <= ratio * F.col("idle_p95")).alias("load_ok"), (F.col("idle_p95") < dense_ms).alias("dense_ok"))


def verdict_tests(outcomes: DataFrame, writers: DataFrame, stages: DataFrame, ratio: float = 2.0, dense_ms: float = 300.0) -> DataFrame:
    """test, value, threshold, passed: the four tests of a bench.

    outcomes(variant, condition, clients, latency_ms, error_kind), writers(started, completed), stages(variant, stage, latency_ms).
    No database error; every writer that started finished; the worst loaded p95 of a variant and client count at most `ratio` times
    its idle p95; the worst p95 of a dense stage of the backend under `dense_ms`.  A ratio or p95 that is not there does not pass.
    """
    cells = latency_stats(outcomes, "variant", "condition", "clients")
    pairs = cells.groupBy("variant", "clients").agg(F.max(F.when(F.col("condition") == "idle", F.col("p95"))).alias("idle"), F.max(F.when(F.col("condition") != "idle", F.col("p95"))).alias("loaded"))
    dense = latency_stats(stages.where("variant = 'backend' and stage like '%dense%'"), "variant", "stage")
    row = lambda name, value, limit, passed: F.struct(F.lit(name).alias("test"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"))
    n = F.col("value")
    return (
        outcomes.agg(F.count_if(F.col("error_kind") == "database").alias("value")).select(row("no_database_errors", n, 0, n == 0).alias("x"))
        .unionByName(writers.agg(F.count_if(F.col("started") & ~F.coalesce("completed", F.lit(False))).alias("value")).select(row("writers_completed", n, 0, n == 0).alias("x")))
        .unionByName(pairs.where("idle > 0 and loaded is not null").agg(F.max(F.col("loaded") / F.col("idle")).alias("value")).select(row("loaded_p95_within_ratio", n, ratio, n <= ratio).alias("x")))
        .unionByName(dense.agg(F.max("p95").alias("value")).select(row("dense_p95_below_threshold", n, dense_ms, n < dense_ms).alias("x")))
        .select("x.*")
    )


def cells(spark, variants: list[str], conditions: list[str], clients: list[int], passes: int) -> DataFrame:
    """Every combination of a bench, numbered in order; four short lists of names, not tables."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    for name, values in (("condition", conditions), ("clients", clients), ("pass", list(range(1, passes + 1)))):
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return one


def stride_sample(ids: DataFrame, size: int, seed: int) -> DataFrame:
    """ids[(seed * 7919 + i * 104729) mod n] for i below size, ids being sorted.  Fixed values: the two strides."""
    # positions in sorted order without one task for all: ranges are numbered by how many ids stand in those before
    parts = staged(ids.select("record_id").repartitionByRange("record_id").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("record_id"))
    ordered = parts.join(sizes, "part").select("record_id", (F.col("before") + within - 1).alias("pos"))
    n = ordered.count()
    if not n:
        return ids.sparkSession.createDataFrame([], "i int, record_id string")
    wanted = ids.sparkSession.range(size).select(F.col("id").cast("int").alias("i"), ((seed * 7919 + F.col("id") * 104729) % n).alias("pos"))
    return ordered.join(F.broadcast(wanted), "pos").select("i", "record_id")


def session_flags(events: DataFrame) -> DataFrame:
    """events(session, seq, read, write, mention, cwd) -> per session, whether any; mention stays null where no event can tell."""
    return events.groupBy("session").agg(F.bool_or("read").alias("read"), F.bool_or("write").alias("write"), F.bool_or("mention").alias("mention"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("seq"))).alias("cwd"))


def usage_counts(sessions: DataFrame) -> DataFrame:
    """sessions(source, project, read, write, mention) -> counts per source, and per source and project."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return sessions.groupingSets([["source"], ["source", "project"]], "source", "project").agg(
        F.grouping("project").alias("all_projects"), F.count("*").alias("sessions"), F.count_if(flag("read")).alias("with_read"), F.count_if(flag("write")).alias("with_write"), F.count_if(flag("read") & flag("mention")).alias("read_mentioned")
    )


def evaluate(questions: DataFrame, expectations: DataFrame, search, sweeps: list[dict], limit: int = 100) -> DataFrame:
    """One row of measures per set of parameters; search(questions, **parameters) -> hits."""
    out = None
    for i, given in enumerate(sweeps):
        hits = search(questions, **given)
        scored = score_questions(questions, hits, match_expectations(hits, expectations), limit)
        row = eval_aggregate(scored).withColumn("sweep", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out
