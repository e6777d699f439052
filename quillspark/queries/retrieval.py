"""Queries of full-text, dense and fused search."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import retrieval as R
from quillspark.plans.staging import shared_dir, staged
from quillspark.plans.versions import Versions
from quillspark.queries.fixtures import fixture, table
from quillspark.queries.registry import query


def _passages(spark, d):
    rows = fixture(spark, d, "fx_texts").select("record_id", F.posexplode(T.lines(F.col("text"))).alias("passage_id", "body"))
    return rows.where("trim(body) <> ''")


def _queries(spark, d):
    """Every line of every benchmark text, in whole words."""
    lines = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("no", "query"))
    return lines.select((F.col("item_id") + 1_000_000 * F.col("no")).alias("query_id"), "query")


def _index(spark, d):
    return R.text_index(_passages(spark, d))


def _vectors(spark, d):
    return fixture(spark, d, "fx_vectors")


def _qvecs(spark, d):
    return _vectors(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


_LEX = """p as (select record_id, no as passage_id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') as t from (
    select record_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from fx_texts) where trim(body) <> ''),
  st as (select count(*) as n, avg(len(t)) as avgdl from p),
  q as (select query_id, list_filter(flatten([regexp_extract_all(lower(w), '[\\p{L}\\p{N}]+') for w in string_split(line, ' ')]), lambda x: x <> '') as terms from (
    select item_id + 1000000 * (no - 1) as query_id, line from (select item_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from benchmark))),
  qt as (select query_id, unnest(terms) as term, generate_subscripts(terms, 1) as term_no from q),
  tk as (select record_id, passage_id, len(t) as dl, unnest(t) as tok from p),
  vt as (select term, tok from (select distinct term from qt) join (select distinct tok from tk) on starts_with(tok, term)),
  h as (select query_id, term_no, record_id, passage_id, dl, count(*) as tf from qt join vt using (term) join tk using (tok) group by all),
  dfs as (select query_id, term_no, count(*) as df from h group by all),
  sc as (select query_id, record_id, passage_id, count(*) as found, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score
    from h join dfs using (query_id, term_no) cross join st group by all),
  lexp as (select sc.* exclude (found) from sc join (select query_id, count(*) as need from qt group by 1) using (query_id) where found = need),
  lex as (select query_id, record_id, score, row_number() over (partition by query_id order by score desc, record_id) as rank from (select query_id, record_id, max(score) as score from lexp group by all))"""
_DENSE = """qv as (select vec_id as query_id, embedding::double[] as qvec from embeddings where vec_id % 20 = 0),
  ds as (select query_id, record_id, vec_id, list_cosine_similarity(qvec, embedding::double[]) as similarity from fx_vectors, qv),
  top3 as (select query_id, record_id, avg(similarity) as score from (select *, row_number() over (partition by query_id, record_id order by similarity desc, vec_id) as r from ds) where r <= 3 group by all),
  den as (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from top3 where score >= 0.1)"""


@query(f"with {_LEX} select query_id, record_id, passage_id, round(score, 6) as score from lexp")
def bm25(spark, d):
    return R.score_passages(_queries(spark, d), _index(spark, d)).withColumn("score", F.round("score", 6)).withColumn("passage_id", F.col("passage_id").cast("long"))


@query(f"with {_LEX} select n, round(avgdl, 6) as avgdl from st")
def term_stats(spark, d):
    return R.term_stats(_index(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"with {_LEX} select h.query_id, term_no - 1 as term_no, h.record_id, h.passage_id, tf, df from h join dfs using (query_id, term_no) join lexp using (query_id, record_id, passage_id)")
def lexical_join(spark, d):
    hits = R.lexical_join(_queries(spark, d), _index(spark, d))
    return hits.select("query_id", F.col("term_no").cast("long").alias("term_no"), "record_id", F.col("passage_id").cast("long").alias("passage_id"), "tf", "df")


@query(f"with {_LEX} select tok as term, count(distinct (record_id, passage_id)) as passages from tk group by 1")
def term_dictionary(spark, d):
    return _index(spark, d).dictionary


@query(f"with {_LEX} select query_id, record_id, round(max(score), 6) as score from lexp group by all")
def best_passage(spark, d):
    return R.best_passage(R.score_passages(_queries(spark, d), _index(spark, d))).withColumn("score", F.round("score", 6))


@query(f"with {_LEX} select query_id, record_id, round(score, 6) as score, rank from lex where rank <= 20")
def search_lexical(spark, d):
    got = R.search_lexical(_queries(spark, d), _passages(spark, d), 20)
    return got.select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_LEX} select query_id, record_id, round(score, 6) as score, rank from lex where rank <= 20")
def search_lexical_stored(spark, d):
    """The same from a written index, of which only the buckets of the questions' terms are read."""
    store = Versions(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
    R.write_index(store, _index(spark, d))
    got = R.search_lexical(_queries(spark, d), R.read_index(store, _queries(spark, d)), 20)
    return got.select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("select item_id as query_id from benchmark where item_id % 2 = 0 and len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) > 0")
def blank_query(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.lit(" \x01 ")).alias("query"))
    return R.blank_query(q).select("query_id")


@query("""with p as (select record_id, no - 1 as passage_id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') as t from (
    select record_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as no from fx_texts))
  select record_id, passage_id from p where list_contains(t, 'the') and list_has_any(t, ['of', 'is']) and not list_has_any(t, ['worthless']) and contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') and len(list_filter(t, lambda x: starts_with(x, 'th'))) > 0""")
def match_terms(spark, d):
    got = R.match_terms(_passages(spark, d), every=("the",), some=("of", "is"), none=("worthless",), phrase=("of", "the"), prefix=("th",))
    return got.select("record_id", F.col("passage_id").cast("long").alias("passage_id"))


@query(f"with {_DENSE} select query_id, vec_id, round(similarity, 6) as similarity from ds")
def cosine(spark, d):
    """Every vector of the query set with every vector."""
    return R.dense_scores(_qvecs(spark, d), _vectors(spark, d).select("vec_id", "embedding"), digits=6)


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_next(spark, d):
    """Every vector with the next one, by the column function."""
    v = table(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(f"with {_DENSE} select query_id, vec_id, round(similarity, 6) as similarity from ds")
def dense_scores(spark, d):
    """All pairs of the query set, as the length-normalised pooling needs them."""
    return R.dense_scores(_qvecs(spark, d), _vectors(spark, d)).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("select vec_id, r.record_id, r.stream_hash from embeddings e join documents d on d.doc_id = e.vec_id % 37 join fx_records r on r.stream_hash = sha256(d.text)")
def dense_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("stream_hash"))
    v = table(spark, d, "embeddings").join(docs, F.col("vec_id") % 37 == F.col("doc_id")).select("vec_id", "stream_hash")
    return R.dense_join(v, fixture(spark, d, "fx_records")).select("vec_id", "record_id", "stream_hash")


#: Every record of a query, where the pooled scores are the result.
_ALL = 1 << 30


@query(f"with {_DENSE} select query_id, record_id, round(max(similarity), 6) as score from ds group by all")
def pool_max(spark, d):
    return R.pooled(_qvecs(spark, d), _vectors(spark, d), "max", _ALL).withColumn("score", F.round("score", 6))


@query(f"with {_DENSE} select query_id, record_id, round(score, 6) as score from top3")
def pool_mean_top3(spark, d):
    return R.pooled(_qvecs(spark, d), _vectors(spark, d), "mean_top3", _ALL).withColumn("score", F.round("score", 6))


@query(f"""with {_DENSE}, e as (select *, row_number() over (partition by query_id order by similarity, record_id, vec_id) as i, count(*) over (partition by query_id) as n from ds),
  b as (select query_id, record_id, max(similarity) as best, count(*) as draws from ds group by all),
  x as (select e.query_id, l.draws, sum(e.similarity * (pow(i / n, l.draws) - pow((i - 1) / n, l.draws))) as expected from e join (select distinct query_id, draws from b) l using (query_id) group by all)
  select query_id, record_id, round(best - expected, 6) as score from b join x using (query_id, draws)""")
def pool_length_norm(spark, d):
    return R.pooled(_qvecs(spark, d), _vectors(spark, d), "length_norm", _ALL).withColumn("score", F.round("score", 6))


@query(f"with {_DENSE} select query_id, record_id, round(score, 6) as score from top3 where score >= 0.15")
def similarity_floor(spark, d):
    return R.similarity_floor(R.pooled(_qvecs(spark, d), _vectors(spark, d), "mean_top3", _ALL), 0.15).withColumn("score", F.round("score", 6))


@query(f"with {_DENSE} select query_id, record_id, rank from (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from top3) where rank <= 15")
def vector_candidates(spark, d):
    got = R.vector_candidates(R.pooled(_qvecs(spark, d), _vectors(spark, d), "mean_top3", 15), 15)
    return got.select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {_DENSE} select query_id, record_id, round(score, 6) as score, rank from den where rank <= 10")
def search_dense(spark, d):
    got = R.search_dense(_qvecs(spark, d), _vectors(spark, d), floor=0.1, limit=10)
    return got.select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FUSED = f"""{_LEX}, {_DENSE}, fu as (select query_id, record_id, sum(1.0 / (60 + rank)) as score from (select query_id, record_id, rank from lex union all select query_id, record_id, rank from den where rank <= 100) group by all),
  fused as (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from fu)"""


@query(f"with {_FUSED} select f.query_id, f.rank, f.record_id, round(f.score, 6) as score, round(den.score, 6) as similarity, coalesce(r.title, '') as title from fused f left join (select * from den where rank <= 100) den using (query_id, record_id) left join fx_records r using (record_id) where f.rank <= 10")
def search_hybrid(spark, d):
    got = R.search_hybrid(_queries(spark, d), _passages(spark, d), _vectors(spark, d), fixture(spark, d, "fx_records"), _qvecs(spark, d), limit=10, floor=0.1)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "record_id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), "title")


_THIRD = "th as (select item_id as query_id, concat('doc-', doc_id) as record_id, row_number() over (partition by item_id order by 1.0 / (1 + doc_id) desc, concat('doc-', doc_id)) as rank from benchmark join documents on doc_id % 50 = item_id % 50)"


def _by_number(spark, d):
    """A signal from outside: records whose number ends as the query's, earlier ones first."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("k"))
    return lambda queries: queries.select("query_id", (F.col("query_id") % 50).alias("k")).where("query_id < 1000000").join(docs, "k").select("query_id", F.concat(F.lit("doc-"), "doc_id").alias("record_id"), (1.0 / (1 + F.col("doc_id"))).alias("score"))


@query(f"""with {_LEX}, {_DENSE}, {_THIRD}, fu as (select query_id, record_id, sum(1.0 / (60 + rank)) as score from (select query_id, record_id, rank from lex union all
    select query_id, record_id, rank from den where rank <= 100 and query_id in (select query_id from q) union all select query_id, record_id, rank from th) group by all)
  select f.query_id, f.record_id, round(f.score, 6) as score, f.rank, round(den.score, 6) as similarity, coalesce(r.title, '') as title from (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from fu qualify rank <= 10) f
  left join (select * from den where rank <= 100) den using (query_id, record_id) left join fx_records r using (record_id)""")
def search_signals(spark, d):
    """Full text, vectors and a signal from outside, as a list."""
    signals = {"lexical": R.lexical_signal(_index(spark, d)), "dense": R.dense_signal(_vectors(spark, d), _qvecs(spark, d), floor=0.1), "number": _by_number(spark, d)}
    got = R.search_signals(_queries(spark, d), signals, fixture(spark, d, "fx_records"), 10, "dense")
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "record_id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), "title")


@query("""with l as (select item_id + 1000000 * (no - 1) as query_id, line from (select item_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from benchmark))
  select query_id, case when query_id % 5 in (0, 1) then null else 'about ' || trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') end as query, case query_id % 5 when 0 then 'empty' when 1 then 'loop' end as reason from l where query_id % 1000000 < 1000000""")
def rewrite_queries(spark, d):
    """A rewriter that comes back empty for some and loops for others: those are refused."""

    def rewriter(text: pd.Series) -> pd.Series:
        number = text.str.extract(r"^(\d+) ", expand=False).astype(int) % 5
        return pd.Series(["<think>no</think>" if n == 0 else "so it goes " * 20 if n == 1 else f'Answer: "about {t.split(" ", 1)[1]}"' for n, t in zip(number, text)])

    asked = _queries(spark, d).select("query_id", F.concat("query_id", F.lit(" "), "query").alias("query"))
    good, refused = R.rewrite_queries(asked, rewriter)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(refused.withColumn("query", F.lit(None).cast("string")), allowMissingColumns=True)


def _similar(spark, d):
    return R.search_dense(_qvecs(spark, d), _vectors(spark, d), floor=0.1)


def _signals(spark, d):
    return R.search_lexical(_queries(spark, d), _passages(spark, d)), _similar(spark, d)


@query(f"with {_FUSED} select query_id, record_id, round(score, 6) as score, rank from fused")
def rrf(spark, d):
    return R.rrf(list(_signals(spark, d))).select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_LEX} select query_id, record_id, rank from lex where rank <= 3")
def signal_rank(spark, d):
    got = R.signal_rank(R.best_passage(R.score_passages(_queries(spark, d), _index(spark, d))))
    return R.search_limit(got, 3).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {_FUSED} select query_id, record_id, rank from fused where rank <= 5")
def search_limit(spark, d):
    return R.search_limit(R.rrf(list(_signals(spark, d))), 5).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_DENSE}, h as (select query_id, record_id, rank, case when rank % 3 <> 0 then (rank * 7 % 11)::double end as new from den)
  select query_id, record_id, row_number() over (partition by query_id order by rank > 10, case when rank <= 10 then coalesce(-new, 'inf'::double) end, rank) as rank from h""")
def rerank_window(spark, d):
    hits = _similar(spark, d).select("query_id", "record_id", "rank")
    scores = hits.where("rank % 3 <> 0").select("query_id", "record_id", (F.col("rank") * 7 % 11).cast("double").alias("score"))
    return R.rerank_window(hits, scores, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {_DENSE}, h as (select query_id, record_id, rank, length(left(t.text, 2000))::double as new from den left join fx_texts t using (record_id))
  select query_id, record_id, row_number() over (partition by query_id order by rank > 5, case when rank <= 5 then -new end, rank) as rank from h""")
def rerank(spark, d):
    def scorer(query: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype(float)

    hits = _similar(spark, d).select("query_id", "record_id", "rank")
    q = _qvecs(spark, d).select("query_id", F.lit("any").alias("query"))
    return R.rerank(hits, q, fixture(spark, d, "fx_texts"), scorer, top_k=5).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_FUSED} select 'fused' as stage, query_id, rank, record_id, round(score, 6) as score from fused union all select 'lexical', query_id, rank, record_id, round(score, 6) from lex
  union all select 'dense', query_id, rank, record_id, round(score, 6) from den where rank <= 100""")
def trace(spark, d):
    lex, den = _signals(spark, d)
    return R.trace({"lexical": lex, "dense": den, "mail": None}, R.rrf([lex, den])).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("""with s as (select item_id as query_id, unnest(['lexical', 'dense']) as signal, unnest([true, false]) as own from benchmark), e as (select *, (signal = 'dense' and query_id % 3 = 0) or (signal = 'lexical' and query_id % 6 = 0) as bad from s)
  select query_id, list_sort(coalesce(list(signal) filter (bad), [])) as failed, bool_or(bad and own) or bool_and(bad) as fatal from e group by 1""")
def notes(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    s = b.crossJoin(spark.createDataFrame([("lexical", True), ("dense", False)], "signal string, own boolean"))
    bad = ((F.col("signal") == "dense") & (F.col("query_id") % 3 == 0)) | ((F.col("signal") == "lexical") & (F.col("query_id") % 6 == 0))
    return R.notes(s.withColumn("error", F.when(bad, "down")))


@query(f"with {_DENSE} select query_id, record_id, rank <= 4 as inside from den where rank <= 100")
def window_contains_answer(spark, d):
    return _similar(spark, d).select("query_id", "record_id", R.window_contains_answer(F.col("rank"), 4).alias("inside"))


@query(f"""with {_DENSE}, m as (select distinct record_id from fx_records where context = 'en') select query_id, record_id, row_number() over (partition by query_id order by rank, record_id) as rank
  from den join m using (record_id) where rank <= 40 qualify row_number() over (partition by query_id order by rank, record_id) <= 4""")
def membership_filter(spark, d):
    members = fixture(spark, d, "fx_records").where("context = 'en'")
    got = R.membership_filter(_similar(spark, d), members, 4)
    return got.select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


@query("""select b.record_id, a.vec_id as mine, b.vec_id as other, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
  from fx_vectors a join fx_vectors b on a.record_id = 'doc-5' and b.record_id <> 'doc-5'""")
def similarity_pairs(spark, d):
    return R.similarity_pairs(_vectors(spark, d), "doc-5").withColumn("similarity", F.round("similarity", 6))


@query("""select b.record_id, round(max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as score
  from fx_vectors a join fx_vectors b on a.record_id = 'doc-5' and b.record_id <> 'doc-5' group by 1 order by max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) desc, 1 limit 10""")
def similar(spark, d):
    return R.similar(_vectors(spark, d), "doc-5", 10).withColumn("score", F.round("score", 6))


@query("""with b as (select a.record_id as query_id, b.record_id, max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as score
    from (select * from fx_vectors where vec_id % 20 = 0) s join fx_vectors a on a.record_id = s.record_id join fx_vectors b on b.record_id <> a.record_id group by all)
  select query_id, record_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, record_id) as rank from b qualify rank <= 10""")
def similar_all(spark, d):
    """For every record that has a vector of the query set: all its vectors against all vectors."""
    v = _vectors(spark, d)
    got = R.similar_all(v, v.where("vec_id % 20 = 0").select("record_id").distinct(), 10)
    return got.select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""with x as (select record_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from fx_vectors), s as (select record_id, pos, sum(v) as v from x group by all),
  n as (select record_id, sqrt(sum(v * v)) as norm from s group by 1) select record_id, count(*) as dims, round(sum(v / norm), 3) as total, (select count(*) from fx_vectors f where f.record_id = s.record_id) as n from s join n using (record_id) group by 1""")
def centroid(spark, d):
    c = R.centroid(_vectors(spark, d))
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return c.select("record_id", F.size("centroid").cast("long").alias("dims"), F.round(total, 3).alias("total"), "n")


@query("""with l as (select record_id, max(span_start) as last from fx_vectors group by 1) select record_id, span_start from fx_vectors
  union all select record_id, last + row_number() over (partition by record_id order by vec_id) from fx_vectors join l using (record_id) where vec_id % 10 = 0""")
def augment_vectors(spark, d):
    v = _vectors(spark, d)
    more = v.where("vec_id % 10 = 0").select("record_id", F.col("vec_id").alias("text_no"), "embedding")
    return R.augment_vectors(v, more).select("record_id", "span_start")


@query(f"""with {_LEX.replace('from fx_texts', "from (select message_id as record_id, body as text from fx_messages) fx_mail")}
  select query_id, record_id, row_number() over (partition by query_id order by rank, record_id) as rank from lex join (select message_id as record_id from fx_messages where folder <> 'Junk') using (record_id)
  where rank <= 50 qualify row_number() over (partition by query_id order by rank, record_id) <= 5""")
def search_mail(spark, d):
    mail = fixture(spark, d, "fx_messages").select(F.col("message_id").alias("record_id"), "folder", F.posexplode(T.lines(F.col("body"))).alias("passage_id", "body")).where("trim(body) <> ''")
    mail = staged(mail)
    hits = R.search_lexical(_queries(spark, d), mail, 50)
    return R.membership_filter(hits, mail.where("folder <> 'Junk'").select("record_id").distinct(), 5).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))
