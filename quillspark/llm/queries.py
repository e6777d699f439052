"""The queries op1 to op13: thin callers of the operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import audit, bitslice, bpe, egojoin, hardneg, mixing, packing, quality, secrets, setsketch, toxicity, urlfilter, wordpiece


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op3_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op4_ego_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), share=1.5, most_epochs=2, weights=(3, 1, 2))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op8_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(_table(spark, sf_dir, "documents")))


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op11_residue_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(_table(spark, sf_dir, "embeddings"), every=50, positives=5, negatives=3, low=50, high=95, scale=256.0, noisy=7, labels=10)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_ALL = (
    op1_subsequence_toxicity, op2_subword_quality, op3_bitslice_topk, op4_ego_near_vectors, op5_bpe_automaton,
    op6_weighted_mix, op7_url_filter, op8_longest_match_counts, op9_secret_battery, op10_setsketch_near_dedup,
    op11_residue_hard_negatives, op12_filter_audit, op13_window_packing,
)
QUERIES = {f.__name__: f for f in _ALL}

_TOPK = """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings where embedding is not null and len(embedding) > 0
), scored as (
  select a.vec_id as query_id, b.vec_id as vec_id, cast(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]) as bigint) as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""

_NEAR_VECTORS = """
with recursive v as (
  select vec_id, label, [cast(x as double) for x in embedding] as e
  from embeddings where embedding is not null and label is not null
), links as (
  select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, to_node) as (
  select vec_id, vec_id from embeddings union select r.node, l.w from reach r join links l on l.u = r.to_node
), least as (select node, min(to_node) as component_id from reach group by node),
counted as (select u, count(*) as n from links group by u)
select e.vec_id, cast(coalesce(c.n, 0) as bigint) as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l on l.node = e.vec_id left join counted c on c.u = e.vec_id
"""

_MIX = r"""
with d as (
  select doc_id, source, size, coalesce(greatest(0.05, plain * plain * plain * plain * case when word between 2.5 and 12 then 1.0::double else 0.5::double end), 1.0) as quality,
    (cast('0x' || substr(md5('mix' || cast(doc_id as varchar)), 1, 12) as bigint) + 0.5) / 281474976710656.0 as u
  from (
    select *, length(translate(text, '0123456789*%$&#|<>=+/\@^~_{}[]()', ''))::double / greatest(length(text), 1) as plain,
      length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::double / greatest(size, 1) as word
    from (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents)
  )
), keyed as (select doc_id, source, size, -ln(u) / quality as key from d),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select source, source_size, 2.0 * source_size as cap,
    [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight from s
), f as (select *, cap / weight as fill, sum(source_size) over () * 1.5 as total from w),
l as (
  select *, (total - coalesce(sum(cap) over (order by fill, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by fill, source rows between current row and unbounded following) as lv from f
), m as (select *, max(case when lv <= fill then lv end) over () as level from l),
t as (select source, source_size, least(cap, coalesce(level * weight, cap)) as target from m),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
c as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as before
  from keyed k join e on k.source is not distinct from e.source
)
select doc_id, size::bigint as size, source_size, target,
  (least(epochs + case when before + size / 2.0 <= rest then 1 else 0 end, 2) * size)::bigint as taken from c
"""

_NEAR_DOCS = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents
), s as (
  select doc_id, unnest(case when len(t) = 0 then [] when len(t) < 4 then [array_to_string(t, ' ')]
    else list_distinct([array_to_string(t[i:i+3], ' ') for i in range(1, len(t) - 2)]) end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
b as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
half as (select u, v from b join n x on x.doc_id = b.u join n y on y.doc_id = b.v where 100 * c >= 80 * (x.n + y.n - c)),
links as (select u, v from half union all select v, u from half),
reach(node, other) as (select doc_id, doc_id from documents union select r.node, l.v from reach r join links l on l.u = r.other),
least as (select node, min(other) as component_id from reach group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d join least l on l.node = d.doc_id left join n on n.doc_id = d.doc_id
"""

_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings where embedding is not null and len(embedding) > 0 and label is not null
), scored as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), pos as (
  select a, b as positive_id, score as positive_score from scored where same qualify row_number() over (partition by a order by score desc, b) <= 5
)
select p.a as anchor_id, p.positive_id, cast(row_number() over (partition by p.a, p.positive_id order by n.score desc, n.b) as integer) as rank, n.b as negative_id, p.positive_score, n.score as negative_score
from pos p join scored n on n.a = p.a and not n.same and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify rank <= 3
"""

_AUDIT = r"""
with recursive d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [
    len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)] as bad
  from d left join l using (doc_id)
), s as (select part, good, toxic, list_filter(list_transform([1, 2, 3, 4, 5], lambda i: case when bad[i] then 'ABCDE'[i] end), lambda c: c is not null) as fails from f),
o(filter_order) as (
  select '' union all select filter_order || c from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as c) where not contains(filter_order, c)
), r as (
  select part, filter_order, step, good, toxic, fails, 'x' as one, filter_order[step] as own, list_contains(fails, filter_order[step]) as fail,
    len(list_filter(fails, lambda c: contains(filter_order[1:step - 1], c))) > 0 as late
  from s, (select filter_order from o where length(filter_order) = 5), (select unnest([1, 2, 3, 4, 5]) as step)
)
select part, filter_order, cast(step as integer) as step, count(*) filter (not fail and not late) as kept, count(*) filter (fail and not late) as removed,
  count(*) filter (fail and late) as redundant, count(*) filter (fail and len(fails) = 1) as unique_fails,
  count(*) filter (fail and not late and good = 1) as good_lost, count(*) filter (fail and not late and toxic = 1) as toxic_lost,
  cast(sum(sum(case when fail and not late then 1 else 0 end)) over (partition by part, own) as bigint) as shapley
from r group by part, filter_order, step, own
"""

ORACLE_SQL: dict[str, str] = {
    "op11_residue_hard_negatives": _NEGATIVES, "op12_filter_audit": _AUDIT,
    "op3_bitslice_topk": _TOPK, "op4_ego_near_vectors": _NEAR_VECTORS, "op6_weighted_mix": _MIX, "op10_setsketch_near_dedup": _NEAR_DOCS,
}
