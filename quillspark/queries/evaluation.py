"""Queries of measurement: question sets, recall, latency, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation as V
from quillspark.operators import retrieval as R
from quillspark.plans.staging import staged
from quillspark.queries.fixtures import fixture, table
from quillspark.queries.registry import query
from quillspark.queries.retrieval import _LEX, _passages, _vectors

_CALL = "case when conv_id % 3 = 0 and turn = 0 then concat(text, ' ; kb get x && my-kb put y ; kb search z') when conv_id % 5 = 0 then concat(text, ' kb put q <system-reminder> kb get r </system-reminder>') else text end"


def _raw(spark, d):
    q = fixture(spark, d, "fx_questions").groupBy("question_id").agg(F.first("query").alias("query"), F.collect_list("expected").alias("ids"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    rows = b.join(q.drop("query"), "question_id", "left")
    none = F.array(F.struct(F.when(F.col("question_id") % 7 != 0, "absent").alias("node_id"), F.lit(None).cast("string").alias("title_regex"), F.lit("other").alias("corpus")))
    expect = F.when(F.col("ids").isNotNull(), F.transform("ids", lambda i: F.struct(i.alias("node_id"), F.lit(None).cast("string").alias("title_regex"), F.lit(None).cast("string").alias("corpus")))).otherwise(none)
    return rows.select("question_id", "query", F.when(F.col("question_id") % 2 == 0, "even").otherwise("odd").alias("population"), expect.alias("expect"))


_EXPECT = """x as (select question_id, expected as node_id, 'kb' as corpus from fx_questions union all
  select item_id, 'absent', 'other' from benchmark where item_id % 7 <> 0 and item_id not in (select question_id from fx_questions)),
  qs as (select item_id as question_id, text as query, case when item_id % 2 = 0 then 'even' else 'odd' end as population from benchmark where item_id in (select question_id from x))"""
# hits: the texts that hold a question's expected documents' first words, ranked by id; a plain stand-in for a search
_HITS = """hits as (select b.item_id as question_id, 'kb' as corpus, r.record_id, r.title, row_number() over (partition by b.item_id order by d.doc_id) as rank, 1.0 / (1 + d.doc_id % 10) as similarity
  from benchmark b join documents d on d.doc_id % 20 = b.item_id % 20 or strpos(d.text, substring(split_part(b.text, chr(10), 1), 1, 60)) > 0 join fx_records r on r.record_id = concat('doc-', d.doc_id)
  qualify row_number() over (partition by b.item_id order by d.doc_id) <= 30)"""


def _hits(spark, d):
    b, docs, r = table(spark, d, "benchmark"), table(spark, d, "documents"), fixture(spark, d, "fx_records").select("record_id", "title")
    near = b.select("item_id", (F.col("item_id") % 20).alias("k")).join(docs.select("doc_id", (F.col("doc_id") % 20).alias("k")), "k").select("item_id", "doc_id")
    hold = fixture(spark, d, "fx_questions").select(F.col("question_id").alias("item_id"), F.substring("expected", 5, 20).cast("long").alias("doc_id"))
    pairs = near.union(hold).distinct().withColumn("record_id", F.concat(F.lit("doc-"), F.col("doc_id"))).join(r, "record_id")
    ranked = R.signal_rank(pairs.select(F.col("item_id").alias("query_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("record_id"), F.lit(0.0).alias("score"), "doc_id", "title"), 30)
    return ranked.select(F.col("query_id").alias("question_id"), F.lit("kb").alias("corpus"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"), "title", F.col("rank").cast("long").alias("rank"), (1.0 / (1 + F.col("doc_id") % 10)).alias("similarity"))


@query(f"with {_EXPECT} select question_id, node_id, corpus, null as title_regex from x")
def load_questions(spark, d):
    return V.load_questions(_raw(spark, d))[1]


@query(f"with {_EXPECT} select question_id, case when min(corpus) = max(corpus) then min(corpus) else 'mixed' end as corpus from x group by 1")
def corpus_questions(spark, d):
    return V.corpus_questions(V.load_questions(_raw(spark, d))[1])


@query(f"with {_EXPECT}, {_HITS} select distinct h.question_id, h.corpus, h.record_id, h.title, h.rank, h.similarity::double as similarity from hits h join x on x.question_id = h.question_id and x.corpus = h.corpus and x.node_id = h.record_id")
def match_expectations_ranked(spark, d):
    return V.match_expectations(_hits(spark, d), V.load_questions(_raw(spark, d))[1])


_SCORED = f"""{_EXPECT}, {_HITS}, m as (select distinct h.* from hits h join x on x.question_id = h.question_id and x.corpus = h.corpus and x.node_id = h.record_id),
  sq as (select q.question_id, q.population, b.best_rank, b.hit_id, b.hit_similarity, coalesce(s.candidates, 0) as candidates, s.max_similarity, coalesce(s.candidates, 0) >= 30 as saturated from qs q
    left join (select question_id, min(rank) as best_rank, arg_min(record_id, rank) as hit_id, arg_min(similarity, rank) as hit_similarity from m group by 1) b using (question_id)
    left join (select question_id, count(*) as candidates, max(similarity) as max_similarity from hits group by 1) s using (question_id))"""
_MEASURES = """count(*) as questions, avg((coalesce(best_rank <= 5, false))::int) as recall_5, avg((coalesce(best_rank <= 10, false))::int) as recall_10, round(avg(coalesce(1.0 / best_rank, 0)), 6) as mrr,
  round(avg(candidates), 6) as mean_candidates, median(candidates) as median_candidates, min(candidates) as min_candidates, max(candidates) as max_candidates, count_if(saturated) as saturated, round(avg(hit_similarity), 6) as mean_hit_similarity, count_if(best_rank is null) as misses"""


def _scored(spark, d):
    questions, expect, _ = V.load_questions(_raw(spark, d))
    hits = _hits(spark, d)
    return V.score_questions(questions, hits, V.match_expectations(hits, expect), 30)


def _rounded(df):
    for c in ("recall_5", "recall_10", "mrr", "mean_candidates", "mean_hit_similarity"):
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(f"with {_SCORED} select question_id, population, best_rank, hit_id, hit_similarity::double as hit_similarity, candidates, max_similarity::double as max_similarity, saturated from sq")
def score_questions_ranked(spark, d):
    return _scored(spark, d).drop("query")


@query(f"with {_SCORED} select {_MEASURES} from sq")
def eval_aggregate_ranked(spark, d):
    return _rounded(V.eval_aggregate(_scored(spark, d)))


@query(f"with {_SCORED}, c as (select question_id, case when min(corpus) = max(corpus) then min(corpus) else 'mixed' end as corpus from x group by 1) select corpus, population, {_MEASURES} from sq join c using (question_id) group by grouping sets ((), (corpus), (population))")
def eval_breakdown_ranked(spark, d):
    return _rounded(V.eval_breakdown(_scored(spark, d).join(V.corpus_questions(V.load_questions(_raw(spark, d))[1]), "question_id")))


@query(f"with {_SCORED} select 0 as sweep, {_MEASURES} from sq union all select 1 as sweep, {_MEASURES} from (select * replace (case when best_rank <= 8 then best_rank end as best_rank, case when best_rank <= 8 then hit_similarity end as hit_similarity, least(candidates, 8) as candidates, false as saturated) from sq)")
def evaluate_ranked(spark, d):
    questions, expect, _ = V.load_questions(_raw(spark, d))

    def search(asked, most):
        return _hits(spark, d).where(F.col("rank") <= most)

    return _rounded(V.evaluate(questions, expect, search, [{"most": 30}, {"most": 8}], limit=30))


@query(f"with {_EXPECT}, {_HITS}, t as (select *, case when rank % 2 = 0 then 'lexical' else 'dense' end as stage from hits) select t.question_id, stage, count(*) as candidates, min(case when q.expected is not null then rank end) as expected_rank from t left join fx_questions q on q.question_id = t.question_id and q.expected = t.record_id group by 1, 2")
def signal_contributions_ranked(spark, d):
    trace = _hits(spark, d).withColumn("stage", F.when(F.col("rank") % 2 == 0, "lexical").otherwise("dense"))
    return V.signal_contributions(trace, fixture(spark, d, "fx_questions").select("question_id", F.col("expected").alias("record_id")))


# The queries above rank a stand-in, as their SQL does.  Those below search: every question in whole words over all passages and vectors.

LIMIT = 100
SWEEPS = [{"pooling": p, "floor": f} for p in R.POOLINGS for f in (None, 0.1, 0.4)]


class _Search:
    """search_hybrid for one set of questions and many sets of parameters: the text is ranked once, each pooling is scored once.

    A question's lines are asked each in whole words; a record's score is that of the line that finds it best.
    """

    def __init__(self, spark, d, questions):
        # the tables hold no vectors of questions: the vector of a question's number stands for it, as in search_hybrid
        self.vectors = _vectors(spark, d)
        self.qvecs = self.vectors.join(questions, F.col("vec_id") == F.col("question_id"), "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
        self.titles = fixture(spark, d, "fx_records").select("record_id", "title")
        lines = questions.select("question_id", F.posexplode(F.split("query", "\n")).alias("no", "query")).select((F.col("question_id") + 1_000_000 * F.col("no")).alias("query_id"), "query")
        found = R.best_passage(R.score_passages(R.blank_query(lines), R.text_index(_passages(spark, d))))
        best = found.groupBy((F.col("query_id") % 1_000_000).alias("query_id"), "record_id").agg(F.max("score").alias("score"))
        self.lexical = staged(R.signal_rank(best))
        self.pooled = {}

    def dense(self, pooling, floor):
        if pooling not in self.pooled:
            self.pooled[pooling] = staged(R.pooled(self.qvecs, self.vectors, pooling, LIMIT))
        return R.vector_candidates(R.similarity_floor(self.pooled[pooling], floor), LIMIT)

    def __call__(self, asked, pooling, floor):
        hits = R.fuse(self.lexical, self.dense(pooling, floor), self.titles, LIMIT).join(asked.select(F.col("question_id").alias("query_id")), "query_id", "left_semi")
        # staged: the plan of a sweep would hold every search many times
        return staged(hits.select(F.col("query_id").alias("question_id"), F.lit("kb").alias("corpus"), "record_id", "title", F.col("rank").cast("long").alias("rank"), "similarity"))


def _sweep_sql(name, pooling, floor):
    """The hits of one sweep, as the common table expressions <name>_d, <name>_f and <name>."""
    at_least = "" if floor is None else f"where score >= {floor}"
    return f"""{name}_d as (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from p_{pooling} {at_least} qualify rank <= {LIMIT}),
  {name}_f as (select query_id, record_id, sum(1.0 / (60 + rank)) as score from (select query_id, record_id, rank from qlex union all select query_id, record_id, rank from {name}_d) group by all),
  {name} as (select f.query_id as question_id, 'kb' as corpus, f.record_id, r.title, f.rank, g.score as similarity from (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from {name}_f qualify rank <= {LIMIT}) f
    left join {name}_d g using (query_id, record_id) left join fx_records r using (record_id) where f.query_id in (select question_id from qs))"""


def _scored_sql(name):
    return f"""m_{name} as (select distinct h.* from {name} h join x on x.question_id = h.question_id and x.corpus = h.corpus and x.node_id = h.record_id),
  s_{name} as (select q.question_id, q.population, b.best_rank, b.hit_id, b.hit_similarity, coalesce(c.candidates, 0) as candidates, c.max_similarity, coalesce(c.candidates, 0) >= {LIMIT} as saturated from qs q
    left join (select question_id, min(rank) as best_rank, arg_min(record_id, rank) as hit_id, arg_min(similarity, rank) as hit_similarity from (select *, rank as r from m_{name}) group by 1) b using (question_id)
    left join (select question_id, count(*) as candidates, max(similarity) as max_similarity from {name} group by 1) c using (question_id))"""


_SEARCHED = f"""{_EXPECT}, {_LEX}, ql as (select query_id % 1000000 as query_id, record_id, max(score) as score from lexp group by all),
  qlex as (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from ql where query_id in (select question_id from qs)),
  dq as (select e.vec_id as query_id, v.record_id, v.vec_id, list_cosine_similarity(e.embedding::double[], v.embedding::double[]) as similarity from embeddings e join fx_vectors v on e.vec_id in (select question_id from qs)),
  p_max as (select query_id, record_id, max(similarity) as score from dq group by all),
  p_mean_top3 as (select query_id, record_id, avg(similarity) as score from (select *, row_number() over (partition by query_id, record_id order by similarity desc, vec_id) as r from dq) where r <= 3 group by all),
  ln_e as (select *, row_number() over (partition by query_id order by similarity, record_id, vec_id) as i, count(*) over (partition by query_id) as n from dq),
  ln_b as (select query_id, record_id, max(similarity) as best, count(*) as draws from dq group by all),
  ln_x as (select e.query_id, l.draws, sum(e.similarity * (pow(i / n, l.draws) - pow((i - 1) / n, l.draws))) as expected from ln_e e join (select distinct query_id, draws from ln_b) l using (query_id) group by all),
  p_length_norm as (select query_id, record_id, best - expected as score from ln_b join ln_x using (query_id, draws)),
  {_sweep_sql("hits", "mean_top3", 0.1)}"""
_FOUND = f"{_SEARCHED}, {_scored_sql('hits')}"


def _asked(spark, d):
    questions, expect, _ = V.load_questions(_raw(spark, d))
    return staged(questions), staged(expect)


def _searched(spark, d):
    """Questions, expectations, and the hits of one search at the middle floor."""
    questions, expect = _asked(spark, d)
    return questions, expect, _Search(spark, d, questions)(questions, "mean_top3", 0.1)


def _scored_searched(spark, d):
    questions, expect, hits = _searched(spark, d)
    return V.score_questions(questions, hits, V.match_expectations(hits, expect), LIMIT)


@query(f"with {_FOUND} select question_id, corpus, record_id, title, rank, round(similarity, 6) as similarity from m_hits")
def match_expectations(spark, d):
    _, expect, hits = _searched(spark, d)
    return V.match_expectations(hits, expect).withColumn("similarity", F.round("similarity", 6))


@query(f"with {_FOUND} select question_id, population, best_rank, hit_id, round(hit_similarity, 6) as hit_similarity, candidates, round(max_similarity, 6) as max_similarity, saturated from s_hits")
def score_questions(spark, d):
    return _scored_searched(spark, d).drop("query").withColumn("hit_similarity", F.round("hit_similarity", 6)).withColumn("max_similarity", F.round("max_similarity", 6))


@query(f"with {_FOUND} select {_MEASURES} from s_hits")
def eval_aggregate(spark, d):
    return _rounded(V.eval_aggregate(_scored_searched(spark, d)))


@query(f"with {_FOUND}, c as (select question_id, case when min(corpus) = max(corpus) then min(corpus) else 'mixed' end as corpus from x group by 1) select corpus, population, {_MEASURES} from s_hits join c using (question_id) group by grouping sets ((), (corpus), (population))")
def eval_breakdown(spark, d):
    questions, expect, hits = _searched(spark, d)
    scored = V.score_questions(questions, hits, V.match_expectations(hits, expect), LIMIT)
    return _rounded(V.eval_breakdown(scored.join(V.corpus_questions(expect), "question_id")))


_EVERY = ", ".join(f"{_sweep_sql(f'w{i}', s['pooling'], s['floor'])}, {_scored_sql(f'w{i}')}" for i, s in enumerate(SWEEPS))


@query(f"with {_SEARCHED}, {_EVERY} " + " union all ".join(f"select {i} as sweep, '{s['pooling']}' as pooling, {s['floor'] if s['floor'] is not None else 'null'}::double as floor, {_MEASURES} from s_w{i}" for i, s in enumerate(SWEEPS)))
def evaluate(spark, d):
    """A row of measures for every pooling and floor."""
    questions, expect = _asked(spark, d)
    measured = _rounded(V.evaluate(questions, expect, _Search(spark, d, questions), SWEEPS, LIMIT))
    given = spark.createDataFrame([(i, s["pooling"], s["floor"]) for i, s in enumerate(SWEEPS)], "sweep int, pooling string, floor double")
    return measured.join(F.broadcast(given), "sweep")  # a row each sweep


@query(f"""with {_SEARCHED}, t as (select query_id as question_id, 'lexical' as stage, record_id, rank from qlex union all select query_id, 'dense', record_id, rank from hits_d
    union all select query_id, 'fused', record_id, row_number() over (partition by query_id order by score desc, record_id) from hits_f)
  select t.question_id, stage, count(*) as candidates, min(case when q.expected is not null then rank end) as expected_rank from t left join fx_questions q on q.question_id = t.question_id and q.expected = t.record_id group by 1, 2""")
def signal_contributions(spark, d):
    search = _Search(spark, d, _asked(spark, d)[0])
    dense = search.dense("mean_top3", 0.1)
    trace = R.trace({"lexical": search.lexical, "dense": dense}, R.rrf([search.lexical, dense])).withColumnRenamed("query_id", "question_id")
    return V.signal_contributions(trace, fixture(spark, d, "fx_questions").select("question_id", F.col("expected").alias("record_id"))).withColumn("expected_rank", F.col("expected_rank").cast("long"))


@query(f"with {_EXPECT} select node_id as record_id, question_id from x where node_id not in (select record_id from fx_records)")
def verify_expected(spark, d):
    e = V.load_questions(_raw(spark, d))[1].select(F.col("node_id").alias("record_id"), "question_id")
    return V.verify_expected(e, fixture(spark, d, "fx_records"))


@query("select expected as record_id, min(question_id) as first from fx_questions group by 1")
def expected_ids(spark, d):
    return V.expected_ids(fixture(spark, d, "fx_questions").select("question_id", F.col("expected").alias("record_id")))


_LAT = "count(*) as n, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95, max(latency_ms) as max_ms, round(avg(latency_ms), 6) as mean_ms"


@query(f"select condition, clients, {_LAT} from fx_outcomes group by 1, 2")
def latency_stats(spark, d):
    got = V.latency_stats(fixture(spark, d, "fx_outcomes"), "condition", "clients")
    return got.select("condition", "clients", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "max_ms", F.round("mean_ms", 6).alias("mean_ms"))


@query("""with c as (select condition, clients, quantile_cont(latency_ms, 0.95) as p95 from fx_outcomes group by 1, 2), r as (select clients, max(p95) filter (condition = 'idle') as idle_p95, max(p95) filter (condition <> 'idle') as loaded_p95 from c group by 1)
  select clients, round(idle_p95, 6) as idle_p95, round(loaded_p95, 6) as loaded_p95, loaded_p95 <= 2 * idle_p95 as load_ok, idle_p95 < 300 as dense_ok from r""")
def verdict(spark, d):
    return V.verdict(fixture(spark, d, "fx_outcomes")).withColumn("idle_p95", F.round("idle_p95", 6)).withColumn("loaded_p95", F.round("loaded_p95", 6))


_O = "o as (select *, case when event_id % 2 = 0 then 'backend' else 'cli' end as variant from fx_outcomes)"


@query(f"""with {_O}, c as (select variant, condition, clients, quantile_cont(latency_ms, 0.95) as p95 from o group by all),
  r as (select variant, clients, max(p95) filter (condition = 'idle') as idle, max(p95) filter (condition <> 'idle') as loaded from c group by all), w as (select max(loaded / idle) as worst from r),
  e as (select count(*) filter (event_id % 97 = 0)::double as n from o), u as (select count(distinct (condition, clients)) filter (condition = 'reindex' and clients = 8)::double as n from o),
  s as (select max(p95) as p95 from (select quantile_cont(latency_ms / 2, 0.95) as p95 from o where variant = 'backend' group by condition))
  select 'no_database_errors' as test, n as value, 0.0::double as threshold, n = 0 as passed from e union all select 'writers_completed', n, 0.0, n = 0 from u
  union all select 'loaded_p95_within_ratio', round(worst, 6), 2.0, worst <= 2 from w union all select 'dense_p95_below_threshold', round(p95, 6), 300.0, p95 < 300 from s""")
def verdict_tests(spark, d):
    o = fixture(spark, d, "fx_outcomes").withColumn("variant", F.when(F.col("event_id") % 2 == 0, "backend").otherwise("cli")).withColumn("error_kind", F.when(F.col("event_id") % 97 == 0, "database"))
    writers = o.select("condition", "clients").distinct().select((F.col("condition") != "idle").alias("started"), F.expr("not (clients = 8 and condition = 'reindex')").alias("completed"))
    stages = o.select("variant", F.concat(F.lit("dense "), "condition").alias("stage"), (F.col("latency_ms") / 2).alias("latency_ms")).union(o.select("variant", F.lit("render"), F.col("latency_ms") * 1000))
    return V.verdict_tests(o, writers, stages).withColumn("value", F.round("value", 6))


@query("""select v.variant, c.condition, n.clients, p.pass, count(o.event_id) as n from (values ('a'), ('b')) v(variant), (values ('idle'), ('ingest'), ('reindex')) c(condition), (values (1), (4), (8)) n(clients), (values (1), (2)) p(pass)
  left join fx_outcomes o on o.condition = c.condition and o.clients = n.clients group by all""")
def cells(spark, d):
    c = V.cells(spark, ["a", "b"], ["idle", "ingest", "reindex"], [1, 4, 8], 2)
    n = fixture(spark, d, "fx_outcomes").groupBy("condition", "clients").agg(F.count("event_id").alias("n"))
    return c.join(n, ["condition", "clients"], "left").withColumn("n", F.coalesce("n", F.lit(0))).select("variant", "condition", "clients", "pass", "n")


@query("with o as (select record_id, row_number() over (order by record_id) - 1 as pos, count(*) over () as n from fx_records) select i.i, o.record_id from (select unnest(range(40))::int as i) i join o on o.pos = (3 * 7919 + i.i * 104729) % o.n")
def stride_sample(spark, d):
    return V.stride_sample(fixture(spark, d, "fx_records"), 40, 3)


def _usage(spark, d):
    c = spark.sql(f"select conv_id, turn, role, {_CALL} as t from {{c}}", c=table(spark, d, "conversations"))
    return c.select("conv_id", "turn", "role", "t", T.usage_calls(T.without_reminders(F.col("t")), "kb", ("get", "search", "put")).alias("calls"), T.mentions(F.col("t"), "kb").alias("mention"))


_CALLS = "case when conv_id % 3 = 0 and turn = 0 then ['get', 'search'] when conv_id % 5 = 0 then ['put'] else [] end"


@query(f"select conv_id, turn, {_CALLS}::varchar[] as calls, len({_CALLS}) > 0 as mention from conversations")
def usage_calls(spark, d):
    return _usage(spark, d).select("conv_id", "turn", "calls", "mention")


@query(f"select conv_id, turn, len({_CALLS}) > 0 as mention from conversations")
def mentions(spark, d):
    return _usage(spark, d).select("conv_id", "turn", "mention")


def _flags(spark, d):
    u = _usage(spark, d)
    events = u.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.arrays_overlap("calls", F.array(F.lit("get"), F.lit("search"))).alias("read"), F.array_contains("calls", "put").alias("write"), F.when(F.col("conv_id") % 4 != 1, F.col("mention")).alias("mention"), F.when(F.col("turn") > 0, F.col("role")).alias("cwd"))
    return V.session_flags(events)


_FLAGS = f"""f as (select conv_id as session, bool_or(list_has_any({_CALLS}, ['get', 'search'])) as read, bool_or(list_contains({_CALLS}, 'put')) as write,
  bool_or(case when conv_id % 4 <> 1 then len({_CALLS}) > 0 end) as mention, arg_min(case when turn > 0 then role end, case when turn > 0 then turn end) as cwd from conversations group by 1)"""


@query(f"with {_FLAGS} select * from f")
def session_flags(spark, d):
    return _flags(spark, d)


@query(f"""with {_FLAGS} select 'src' || (session % 2) as source, coalesce(cwd, '-') as project, grouping(coalesce(cwd, '-'))::int as all_projects, count(*) as sessions, count_if(read) as with_read, count_if(write) as with_write, count_if(read and mention) as read_mentioned
  from f group by grouping sets (('src' || (session % 2)), ('src' || (session % 2), coalesce(cwd, '-')))""")
def usage_counts(spark, d):
    f = _flags(spark, d).select(F.concat(F.lit("src"), F.col("session") % 2).alias("source"), F.coalesce("cwd", F.lit("-")).alias("project"), "read", "write", "mention")
    return V.usage_counts(f).withColumn("all_projects", F.col("all_projects").cast("int"))
