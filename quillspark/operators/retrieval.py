"""Full-text, dense and fused ranking of many queries at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import outline
from quillspark.plans.staging import staged
from quillspark.plans.versions import Change, Versions

K1, B = 1.2, 0.75


class TextIndex(NamedTuple):
    """Of some passages: their words (record_id, passage_id, t), postings (term, record_id, passage_id), the dictionary (term, passages) and one row of statistics (n, avgdl)."""

    words: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame


def text_index(passages: DataFrame) -> TextIndex:
    """passages(record_id, passage_id, body), tokenised once; postings are read off the words where they are asked for."""
    words = staged(passages.select("record_id", "passage_id", T.tokens(F.col("body")).alias("t")))
    posted = words.select("record_id", "passage_id", F.explode(F.array_distinct("t")).alias("term"))
    dictionary = staged(posted.groupBy("term").agg(F.count("*").alias("passages")))
    return TextIndex(words, posted, dictionary, words.agg(F.count("*").alias("n"), F.avg(F.size("t").cast("double")).alias("avgdl")))


def write_index(store: Versions, index: TextIndex, buckets: int = 64) -> None:
    """The index as tables of a folder, postings and dictionary dealt by term, as one version."""
    with store.change() as c:
        c.put("words", index.words, "record_id", buckets)
        c.put("postings", index.postings, "term", buckets)
        c.put("dictionary", index.dictionary, "term", buckets)
        c.put("text_stats", index.stats)


def read_index(store: Versions, queries: DataFrame | None = None) -> TextIndex:
    """The stored index; with queries, only the buckets of postings that their terms can need."""
    dictionary, postings = store.read("dictionary"), store.read("postings")
    if queries is not None:
        seen = Change(store)
        found = staged(expanded(terms_of(queries).select(F.col("term").alias("prefix")).distinct(), dictionary))
        postings = seen.held("postings", seen.touched("postings", found))
    return TextIndex(store.read("words"), postings, dictionary, store.read("text_stats"))


def term_stats(index: TextIndex) -> DataFrame:
    """One row: how many passages there are, and their mean length in tokens, over all text-indexed passages."""
    return index.stats


def terms_of(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) -> query_id, term_no, term: the last token of each word is a prefix; blank queries have no rows."""
    words = F.transform(T.query_terms(F.col("query")), T.tokens)
    return queries.select("query_id", F.posexplode(F.filter(F.flatten(words), lambda t: t != "")).alias("term_no", "term"))


def blank_query(queries: DataFrame) -> DataFrame:
    """Queries that have something to look for."""
    return queries.where(F.size(T.query_terms(F.col("query"))) > 0)


def expanded(prefixes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """prefix, term: the words of the dictionary that a prefix opens.

    Every word is cut at the lengths that occur among the prefixes, a few numbers, and joined on the whole prefix; it is the distinct
    words that are cut, not the text.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]
    if not lengths:
        return prefixes.select("prefix", F.col("prefix").alias("term")).limit(0)
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("term"))
    cut = dictionary.select("term", F.explode(F.transform(fitting, lambda n: F.substr("term", F.lit(1), n))).alias("prefix"))
    return prefixes.join(cut, "prefix").select("prefix", "term")


#: Terms of queries up to which they are sent to every task.
_FEW = 200_000


def _meets(t: pa.Array, by: dict[int, dict[str, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of words and the prefixes, by length, that one of their words opens with: the places of both, each pair once; every distinct word is cut once."""
    borders = t.offsets.to_numpy()
    words = t.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
    found = [[i for k, of in by.items() if (i := of.get(w[:k])) is not None and len(w) >= k] for w in words.dictionary.to_pylist()]
    ids, held = np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64)
    code = words.indices.to_numpy()
    several = held[code]
    row = np.repeat(np.repeat(np.arange(len(t)), np.diff(borders)), several)
    at = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several) + np.repeat((np.cumsum(held) - held)[code], several)
    return np.divmod(np.unique(row * n + ids[at]), n) if len(at) else (at, at)


def _by_length(prefixes: list[str]) -> dict[int, dict[str, int]]:
    by: dict[int, dict[str, int]] = {}
    for i, x in enumerate(prefixes):
        by.setdefault(len(x), {})[x] = i
    return by


def _batch_counts(batches, prefixes: list[str]):
    """How many lists of words each prefix has met."""
    by, names = _by_length(prefixes), pa.array(prefixes, pa.string())
    for batch in batches:
        df = np.bincount(_meets(batch.column(0), by, max(1, len(prefixes)))[1], minlength=len(prefixes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([names, pa.array(df)], names=["prefix", "df"]).filter(pa.array(df > 0))


def _batch_asked(batches, prefixes: list[str], asked: list[tuple[int, list[int]]], ids: list, kinds: list, together: int = 1 << 16):
    """A row for each list of words and query of which it meets every prefix; asked: by query its rarest prefix, with which it begins, and all."""
    by, n, schema = _by_length(prefixes), max(1, len(prefixes)), pa.schema(kinds)
    order = np.argsort([r for r, _ in asked], kind="stable")
    of_prefix = np.bincount([r for r, _ in asked], minlength=n)
    first = np.cumsum(of_prefix) - of_prefix
    size, flat = np.array([len(x) for _, x in asked], np.int64), np.array([i for _, x in asked for i in x], np.int64)
    begin = np.cumsum(size) - size
    for batch in batches:
        row, prefix = _meets(batch.column(batch.schema.get_field_index("t")), by, n)
        keys, several = row * n + prefix, of_prefix[prefix]
        at = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several) + np.repeat(first[prefix], several)
        rows, queries = np.repeat(row, several), order[at]
        for lo in range(0, len(rows), together):
            r, q = rows[lo : lo + together], queries[lo : lo + together]
            m = size[q]
            starts = np.cumsum(m) - m
            wanted = np.repeat(r * n, m) + flat[np.arange(m.sum()) - np.repeat(starts, m) + np.repeat(begin[q], m)]
            whole = np.logical_and.reduceat(keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted, starts)
            part = batch.take(pa.array(r[whole]))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((*part.columns, pa.array([ids[i] for i in q[whole]], schema[-1].type)), schema)], schema=schema)


def _whole(words: DataFrame, asked: DataFrame) -> DataFrame:
    """words with each query of asked(query_id, of, prefix) whose prefixes they all hold; the queries' terms are at most _FEW and go to every task, so no words are shuffled."""
    rows = asked.select("query_id", "prefix", "of.prefix").toDF("query_id", "rarest", "every").collect()
    prefixes = sorted({x for r in rows for x in r.every})
    number = {x: i for i, x in enumerate(prefixes)}
    out = StructType([*words.schema, asked.schema["query_id"]])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in out]
    given = {"prefixes": prefixes, "asked": [(number[r.rarest], [number[x] for x in r.every]) for r in rows], "ids": [r.query_id for r in rows], "kinds": kinds}
    return words.mapInArrow(partial(_batch_asked, **given), out).join(F.broadcast(asked.select("query_id", "of")), "query_id")


def _counts(words: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, df: how many of the words' rows hold a word that a prefix opens; prefixes as few as in `_whole`."""
    few = sorted(r[0] for r in prefixes.collect())
    return words.select("t").mapInArrow(partial(_batch_counts, prefixes=few), "prefix string, df long").groupBy("prefix").agg(F.sum("df").alias("df"))


def lexical_join(queries: DataFrame, index: TextIndex) -> DataFrame:
    """query_id, term_no, record_id, passage_id, tf, df, dl: every term of a query in every passage that holds all of them; tf and df count what a prefix matches.

    A query starts from the passages of the term that the dictionary knows to be rarest, and only in those its other terms are looked
    for, among their words.  Passages are counted for the terms of queries that found some, where a prefix has several words.  Both
    read the words where they lie, or with more than _FEW terms the postings.
    """
    terms = staged(terms_of(queries).withColumnRenamed("term", "prefix"))
    few = terms.count() <= _FEW
    found = staged(expanded(terms.select("prefix").distinct(), index.dictionary).join(index.dictionary, "term"))
    most = found.groupBy("prefix").agg(F.sum("passages").alias("most"), F.count("*").alias("words"))
    asked = terms.join(most, "prefix", "left").groupBy("query_id").agg(
        F.collect_list(F.struct("term_no", "prefix")).alias("of"), F.min(F.struct("most", "prefix")).alias("rarest"), F.bool_and(F.col("most").isNotNull()).alias("known"),
    ).where("known")
    asked = staged(asked.select("query_id", "of", F.col("rarest.prefix").alias("prefix")))
    if few:
        rows = _whole(index.words, asked)
    else:
        start = asked.select("query_id", "prefix").join(found.select("prefix", "term"), "prefix").join(index.postings, "term").select("query_id", "record_id", "passage_id").distinct()
        rows = start.join(index.words, ["record_id", "passage_id"]).join(asked.select("query_id", "of"), "query_id")
    counted = F.transform("of", lambda x: F.struct(x["term_no"].alias("term_no"), x["prefix"].alias("prefix"), F.size(F.filter("t", lambda w: w.startswith(x["prefix"]))).cast("long").alias("tf")))
    rows = rows.select("query_id", "record_id", "passage_id", F.size("t").alias("dl"), counted.alias("of")).where(F.forall("of", lambda x: x["tf"] > 0))
    hits = staged(rows.select("query_id", "record_id", "passage_id", "dl", F.inline("of")))
    needed = most.join(hits.select("prefix").distinct(), "prefix", "left_semi")
    several = needed.where("words > 1").select("prefix")
    if few:
        held = _counts(index.words, several)
    else:
        words = found.join(several, "prefix", "left_semi").select("prefix", "term")
        held = index.postings.join(words, "term").select("prefix", "record_id", "passage_id").distinct().groupBy("prefix").agg(F.count("*").alias("df"))
    df = held.unionByName(needed.where("words = 1").select("prefix", F.col("most").alias("df")))
    return hits.join(df, "prefix").select("query_id", "term_no", "record_id", "passage_id", "tf", "df", "dl")


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def score_passages(queries: DataFrame, index: TextIndex) -> DataFrame:
    """query_id, record_id, passage_id, score of the passages that hold every term of a query."""
    rows = lexical_join(queries, index).join(F.broadcast(index.stats))  # one row
    rows = rows.withColumn("s", bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")))
    # rounded, so that equal passages have equal scores in whatever order their terms were summed
    return rows.groupBy("query_id", "record_id", "passage_id").agg(F.round(F.sum("s"), 9).alias("score"))


def best_passage(scored: DataFrame) -> DataFrame:
    """A record's score is that of its best passage."""
    return scored.groupBy("query_id", "record_id").agg(F.max("score").alias("score"))


def signal_rank(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """1-based rank per query, by score, then id; Spark cuts to the limit before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= limit) if limit is not None else out


def search_limit(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def search_lexical(queries: DataFrame, passages: DataFrame | TextIndex, limit: int | None = None) -> DataFrame:
    """Ranked records by their best passage; passages are indexed first, an index is used as it is."""
    index = passages if isinstance(passages, TextIndex) else text_index(passages)
    return signal_rank(best_passage(score_passages(blank_query(queries), index)), limit)


def match_terms(passages: DataFrame, every: tuple = (), some: tuple = (), none: tuple = (), phrase: tuple = (), prefix: tuple = ()) -> DataFrame:
    """Passages whose tokens have all of `every`, one of `some`, none of `none`, the phrase in a row and a token with each prefix."""
    t = F.col("t")
    rows = passages.withColumn("t", T.tokens(F.col("body")))
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    for w in every:
        rows = rows.where(F.array_contains(t, w))
    if some:
        rows = rows.where(F.arrays_overlap(t, lits(some)))
    if none:
        rows = rows.where(~F.arrays_overlap(t, lits(none)))
    if phrase:
        n = len(phrase)
        rows = rows.where(F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.slice(t, i, n) == lits(phrase)))
    for p in prefix:
        rows = rows.where(F.exists(t, _opens_with(p)))
    return rows.drop("t")


def _opens_with(p: str):
    return lambda x: x.startswith(p)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without a norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def dense_join(vectors: DataFrame, records: DataFrame) -> DataFrame:
    """Vectors with every record that has their stream."""
    return vectors.join(records.select("record_id", "stream_hash"), "stream_hash")


def _in_blocks(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """The rows packed into about `size` a block, dealt by a hash of all their columns, and how many blocks there are."""
    n = max(1, -(-rows.count() // size))
    packed = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int").alias(name)).agg(F.collect_list(F.struct(*rows.columns)).alias(f"{name}_rows"))
    return packed, n


def _matrix(column: pa.Array) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """By length: the places of the vectors of that length and the vectors; those null or with null components are in none."""
    borders, flat = column.offsets.to_numpy(), column.values
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    if flat.null_count:
        nulls = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
        whole = whole & (nulls[borders[1:]] == nulls[borders[:-1]])
    lengths, flat = np.diff(borders), flat.to_numpy(zero_copy_only=False)
    sized = {}
    for n in np.unique(lengths[whole]).tolist():
        at = np.flatnonzero(whole & (lengths == n))
        every = len(at) == len(lengths)
        rows = flat[borders[0] : borders[-1]].reshape(-1, n) if every and n else flat[borders[at][:, None] + np.arange(n)]
        sized[n] = at, rows.astype(np.float64)
    return sized, len(column)


def _block_cosines(batches, kinds: list, digits: int | None, rows_out: int = 1 << 18):
    """Every query of a block with every vector of a block, some queries at a time, so that what is computed stays in a core's cache.

    Summed pair by pair, so equal vectors get equal similarities wherever they stand.
    """
    schema = pa.schema(kinds)
    kept = list(schema)[1:-1]
    for batch in batches:
        for i in range(batch.num_rows):
            q, v = (batch.column(batch.schema.get_field_index(c))[i].values for c in ("q_rows", "v_rows"))
            (qs, n_q), (vs, n_v) = _matrix(q.field("qvec")), _matrix(v.field("embedding"))
            norms = {n: [np.sqrt(np.einsum("ik,ik->i", m, m)) for m in (qs[n][1], vs[n][1])] for n in qs.keys() & vs.keys()}
            step = max(1, rows_out // n_v)
            for lo in range(0, n_q, step):
                part = np.zeros((min(step, n_q - lo), n_v))
                for n, (of_x, of_y) in norms.items():
                    (at_q, x), (at_v, y) = qs[n], vs[n]
                    own = slice(*np.searchsorted(at_q, (lo, lo + step)))
                    norm = of_x[own, None] * of_y
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cos = np.einsum("ik,jk->ij", x[own], y) / norm
                    cos[norm == 0] = 0.0
                    part[np.ix_(at_q[own] - lo, at_v)] = cos
                if digits is not None:
                    part = np.copysign(np.floor(np.abs(part) * 10.0**digits + 0.5), part) / 10.0**digits
                of_q, of_v = (pa.array(x.ravel()) for x in np.indices(part.shape))
                columns = [q.field("query_id").slice(lo, step).take(of_q), *(v.field(f.name).take(of_v) for f in kept), pa.array(part.ravel())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def dense_scores(queries: DataFrame, vectors: DataFrame, query_block: int = 512, vector_block: int = 4096, digits: int | None = None) -> DataFrame:
    """queries(query_id, qvec), vectors(record_id, vec_id, embedding, ...) -> query_id, record_id, vec_id, similarity; vectors may be without record_id.

    The cosine of every query with every vector, 0 where lengths differ, a norm is 0 or a vector or component is null.  Both sides are
    packed into blocks and each pair of blocks is one row of an equi-join, so nothing is broadcast by hint and no task holds more than blocks.
    All pairs are rows here, for what is defined on all of them; ``dense_best`` keeps the best ones only.  With `digits` similarities are
    rounded to so many, halves away from 0; a column expression takes far longer over so many rows.
    """
    q, _ = _in_blocks(queries.select("query_id", "qvec"), "q", query_block)
    own = [c for c in ("record_id", "vec_id") if c in vectors.columns]
    v, n = _in_blocks(vectors.select(*own, "embedding"), "v", vector_block)
    out = StructType([queries.schema["query_id"], *(vectors.schema[c] for c in own), StructField("similarity", DoubleType())])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in out]
    return _pairs(q, v, n).mapInArrow(partial(_block_cosines, kinds=kinds, digits=digits), out)


def _pair_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, each summed alike wherever it stands: equal vectors get equal similarities."""
    norm = np.sqrt(np.einsum("ik,ik->i", x, x)) * np.sqrt(np.einsum("ik,ik->i", y, y))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm == 0, 0.0, np.einsum("ik,ik->i", x, y) / norm)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ik,ik->i", x, x))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _close(dims: int) -> float:
    """Single-precision products of unit vectors and sums pair by pair in double precision differ by less than this."""
    return 1.2e-7 * (dims + 8)


def _exact(of_q: np.ndarray, of_v: np.ndarray, qs: dict, vs: dict, n_q: int, n_v: int, together: int = 1 << 15) -> np.ndarray:
    """The similarities of these pairs, summed pair by pair, some at a time."""
    out = np.zeros(len(of_q))
    for dims in qs.keys() & vs.keys():
        to_q, to_v = np.full(n_q, -1), np.full(n_v, -1)
        to_q[qs[dims][0]], to_v[vs[dims][0]] = np.arange(len(qs[dims][0])), np.arange(len(vs[dims][0]))
        for lo in range(0, len(of_q), together):
            a, b = to_q[of_q[lo : lo + together]], to_v[of_v[lo : lo + together]]
            both = np.flatnonzero((a >= 0) & (b >= 0))
            out[lo + both] = _pair_cosines(qs[dims][1][a[both]], vs[dims][1][b[both]])
    return out


def _products(lo: int, hi: int, n_v: int, q_units: dict, v_units: dict, kind: type) -> np.ndarray:
    """The similarities of queries lo to hi with all vectors of a block, by a matrix product for each length."""
    out = None
    for n in q_units.keys() & v_units.keys():
        (at_q, x), (at_v, y) = q_units[n], v_units[n]
        own = slice(*np.searchsorted(at_q, (lo, hi)))
        part = x[own] @ y.T
        if part.shape == (hi - lo, n_v):
            return part
        out = np.zeros((hi - lo, n_v), kind) if out is None else out
        out[np.ix_(at_q[own] - lo, at_v)] = part
    return np.zeros((hi - lo, n_v), kind) if out is None else out


def _units(of: dict, kind: type) -> dict:
    return {n: (at, _unit(x).astype(kind)) for n, (at, x) in of.items()}


def _block_best(batches, kinds: list, top: int, limit: int, together: int = 1 << 20):
    """The records of a block that can be among the `limit` best of a query of a block, with their best similarities; of open records all.

    Similarities come from a matrix product.  A record's vectors fall into `top` pieces, whose maxima tell what its best ones reach at
    least; only pairs that reach that are summed pair by pair.  Equal query ids of a block are one query.
    """
    schema = pa.schema(kinds)
    for batch in batches:
        for i in range(batch.num_rows):
            q, v = (batch.column(batch.schema.get_field_index(c))[i].values for c in ("q_rows", "v_rows"))
            q = q.take(pc.sort_indices(q.field("query_id")))
            v = v.take(pc.sort_indices(pa.table({"r": v.field("record_id"), "v": v.field("vec_id")}), sort_keys=[("r", "ascending"), ("v", "ascending")]))
            (qs, n_q), (vs, n_v) = _matrix(q.field("qvec")), _matrix(v.field("embedding"))
            query, record = (x.dictionary_encode(null_encoding="encode").indices.to_numpy() for x in (q.field("query_id"), v.field("record_id")))
            starts = np.flatnonzero(np.append(True, record[1:] != record[:-1]))
            sizes, opened = np.diff(np.append(starts, n_v)), v.field("open").to_numpy(zero_copy_only=False)[starts]
            record = np.repeat(np.arange(len(starts)), sizes)
            # where a record's pieces begin, and where the pieces of each record do
            split = np.minimum(sizes, top)
            pieces_at = np.cumsum(split) - split
            nth = np.arange(split.sum()) - np.repeat(pieces_at, split)
            pieces = np.repeat(starts, split) + np.repeat(sizes, split) * nth // np.repeat(split, split)
            close = 2 * _close(max([0, *(qs.keys() & vs.keys())]))
            with np.errstate(all="ignore"):
                plain = all(np.isfinite(np.einsum("ik,ik->i", x, x)).all() for side in (qs, vs) for _, x in side.values())
            q_units, v_units = _units(qs, np.float32), _units(vs, np.float32)
            step = max(1, together // n_v)
            for lo in range(0, n_q, step):
                hi = min(lo + step, n_q)
                similar = _products(lo, hi, n_v, q_units, v_units, np.float32)
                begins = np.flatnonzero(np.append(True, query[lo + 1 : hi] != query[lo : hi - 1]))
                rows = np.diff(np.append(begins, hi - lo))
                most = similar if len(pieces) == n_v else np.maximum.reduceat(similar, pieces, axis=1)
                most = most if len(begins) == hi - lo else np.maximum.reduceat(most, begins, axis=0)
                least = most if top == 1 else np.minimum.reduceat(most, pieces_at, axis=1)
                # fewer vectors than `top`, which several rows of a query meet: all pairs count
                all_of = (sizes < top)[None, :] & (rows > 1)[:, None]
                least = np.where(all_of, -np.inf, least) if all_of.any() else least
                if limit < len(starts):
                    mean = np.where(all_of | opened[None, :], -np.inf, np.add.reduceat(most, pieces_at, axis=1) / split)
                    upper = np.maximum.reduceat(most, pieces_at, axis=1)
                    reach = np.partition(mean, len(starts) - limit, axis=1)[:, len(starts) - limit, None] - close
                    least = np.where((upper >= reach) | opened[None, :], least, np.inf)
                if not plain:  # numbers without a finite norm: nothing is known before
                    least = np.full(least.shape, -np.inf)
                least = np.repeat(least - close, rows, axis=0) if len(begins) < hi - lo else least - close
                of_q, of_v = np.nonzero(similar >= (least if len(starts) == n_v else np.repeat(least, sizes, axis=1)))
                if not len(of_q):
                    continue
                exact = _exact(lo + of_q, of_v, qs, vs, n_q, n_v)
                group = np.repeat(np.arange(len(begins)), rows)[of_q]
                key = group * len(starts) + record[of_v]
                order = np.lexsort((of_v, np.where(np.isnan(exact), -np.inf, -exact), key))
                key, exact = key[order], exact[order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                held = np.diff(np.append(at, len(key)))
                kept = np.arange(len(key)) - np.repeat(at, held) < top
                exact, key, n = exact[kept], key[at], np.minimum(held, top)
                if limit < len(starts):
                    score = np.add.reduceat(exact, np.cumsum(n) - n) / n
                    fits = _within(key // len(starts), score, opened[key % len(starts)], limit)
                    exact, key, n = exact[np.repeat(fits, n)], key[fits], n[fits]
                borders, of_r = pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), key % len(starts)
                columns = [q.field("query_id").take(pa.array(lo + begins[key // len(starts)])), v.field("record_id").take(pa.array(starts[of_r])), pa.ListArray.from_arrays(borders, pa.array(exact)), pa.array(opened[of_r])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _within(group: np.ndarray, score: np.ndarray, opened: np.ndarray, limit: int) -> np.ndarray:
    """Which are open, or of the others of their group among the `limit` best, with all that tie with the last."""
    fits = opened.copy()
    own = np.flatnonzero(~opened)
    own = own[np.lexsort((np.where(np.isnan(score[own]), -np.inf, -score[own]), group[own]))]
    at = np.flatnonzero(np.append(True, group[own][1:] != group[own][:-1])) if len(own) else own
    size = np.diff(np.append(at, len(own)))
    last = score[own][at + np.minimum(size, limit) - 1]
    fits[own] = ~(score[own] < np.repeat(last, size))
    return fits


def _dealt(rows: DataFrame, key: str, name: str, size: int) -> tuple[DataFrame, int, bool]:
    """Rows packed into blocks of about `size`, how many blocks, and whether a key is repeated.

    A key's rows are dealt into one block; keys of more than a quarter of a block are open: their rows are dealt over all blocks.
    """
    held = staged(rows.groupBy(key).agg(F.count("*").alias("held")))
    count, most = held.agg(F.sum("held"), F.max("held")).first()
    n = max(1, -(-(count or 0) // size))
    sizes = held.where(F.col("held") > size // 4).select(F.col(key).alias("of"), F.lit(True).alias("open"))
    all_of = rows.join(sizes, F.col(key).eqNullSafe(F.col("of")), "left").withColumn("open", F.coalesce("open", F.lit(False))).drop("of")
    by = F.when(F.col("open"), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(key))
    packed = all_of.groupBy(F.pmod(by, F.lit(n)).cast("int").alias(name)).agg(F.collect_list(F.struct(*all_of.columns)).alias(f"{name}_rows"))
    return packed, n, (most or 0) > 1


def _pairs(q: DataFrame, v: DataFrame, n: int) -> DataFrame:
    """Every block of queries with every one of the n blocks of vectors; merged, since Spark takes the blocks for smaller than they are once repeated, and would broadcast them."""
    return q.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).hint("merge").join(v, "v").select("q_rows", "v_rows")


def dense_best(queries: DataFrame, vectors: DataFrame, top: int, limit: int, query_block: int = 2048, vector_block: int = 16384) -> DataFrame:
    """query_id, record_id, score: the mean of a record's best `top` similarities, for at least the `limit` best records of every query.

    A record's vectors are dealt into one block, which gives the best records of the block alone; records of more than a quarter of
    a block are open: their vectors are dealt over all blocks, each gives their best similarities there, and these are merged.  So
    rows are at most queries x blocks x (limit + open records), and pairs of vectors are none.
    """
    q, _, repeated = _dealt(queries.select("query_id", "qvec"), "query_id", "q", query_block)
    v, n, _ = _dealt(vectors.select("record_id", "vec_id", "embedding").where("record_id is not null"), "record_id", "v", vector_block)
    out = StructType([queries.schema["query_id"], vectors.schema["record_id"], StructField("best", ArrayType(DoubleType())), StructField("open", BooleanType())])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in out]
    # a repeated query's best pairs may lie in several blocks: a block knows its best records only by their one best pair
    within = limit if top == 1 or not repeated else 1 << 30
    found = _pairs(q, v, n).mapInArrow(partial(_block_best, kinds=kinds, top=top, limit=within), out)
    if top == 1:
        return found.groupBy("query_id", "record_id").agg(F.max(F.element_at("best", 1)).alias("score"))
    merged = found.groupBy("query_id", "record_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, top).alias("best"))
    return merged.select("query_id", "record_id", (F.aggregate("best", F.lit(0.0), lambda s, x: s + x) / F.size("best")).alias("score"))


def pool_max(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id", "record_id").agg(F.max("similarity").alias("score"))


def pool_mean_top3(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id", "record_id").orderBy(F.desc("similarity"), "vec_id")
    return scores.withColumn("r", F.row_number().over(order)).where("r <= 3").groupBy("query_id", "record_id").agg(F.avg("similarity").alias("score"))


def ordered_within(scores: DataFrame, bins: int = 4096) -> DataFrame:
    """scores with i, the place of a similarity among all of its query (ties by record and vector), and n, how many those are.

    Counts by range of similarity come first; a place is how many lie in lower ranges and the place within the range, so no task
    holds all of a query.
    """
    held = scores.withColumn("bin", F.least(F.greatest(F.floor((F.col("similarity") + 1) * (bins / 2)), F.lit(0)), F.lit(bins - 1)).cast("int"))
    counts = held.groupBy("query_id", "bin").agg(F.count("*").alias("in_bin"))
    # a query's counts are at most `bins` rows
    of = counts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("bin", "in_bin"))).alias("all"), F.sum("in_bin").alias("n"))
    below = F.transform("all", lambda x, i: F.struct(x["bin"].alias("bin"), F.aggregate(F.slice("all", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["in_bin"]).alias("below")))
    lower = of.select("query_id", "n", F.inline(below))
    order = Window.partitionBy("query_id", "bin").orderBy("similarity", "record_id", "vec_id")
    return held.withColumn("within", F.row_number().over(order)).join(lower, ["query_id", "bin"]).withColumn("i", F.col("below") + F.col("within")).drop("bin", "below", "within")


def pool_length_norm(scores: DataFrame) -> DataFrame:
    """A record's best score less the mean maximum of as many draws from the query's own scores."""
    every = ordered_within(scores)
    best = scores.groupBy("query_id", "record_id").agg(F.max("similarity").alias("best"), F.count("*").alias("draws"))
    lengths = best.select("query_id", "draws").distinct()
    step = F.pow(F.col("i") / F.col("n"), F.col("draws")) - F.pow((F.col("i") - 1) / F.col("n"), F.col("draws"))
    expected = every.join(lengths, "query_id").groupBy("query_id", "draws").agg(F.sum(F.col("similarity") * step).alias("expected"))
    return best.join(expected, ["query_id", "draws"]).select("query_id", "record_id", (F.col("best") - F.col("expected")).alias("score"))


#: Places of a query that one row may hold.
_PLACES = 1 << 16
#: What weighs less than this beside 1 does not change a double.
_NOTHING = 1e-18


def _block_units(batch: pa.RecordBatch, i: int) -> tuple:
    q, v = (batch.column(batch.schema.get_field_index(c))[i].values for c in ("q_rows", "v_rows"))
    (qs, n_q), (vs, n_v) = _matrix(q.field("qvec")), _matrix(v.field("embedding"))
    norms = lambda x: np.sqrt(np.einsum("ik,ik->i", x, x))[:, None]
    with np.errstate(all="ignore"):
        units = [{n: (at, np.divide(x, norms(x), out=np.zeros_like(x), where=norms(x) != 0)) for n, (at, x) in of.items()} for of in (qs, vs)]
    return q, n_q, n_v, units


def _block_floors(batches, share: float, kinds: list, together: int = 1 << 20):
    """What the best `share` of a block's similarities reach, for every query."""
    for batch in batches:
        for i in range(batch.num_rows):
            q, n_q, n_v, units = _block_units(batch, i)
            r, step = min(n_v, math.ceil(share * n_v)), max(1, together // n_v)
            parts = [np.partition(_products(lo, min(lo + step, n_q), n_v, *units, np.float64), n_v - r, axis=1)[:, n_v - r] for lo in range(0, n_q, step)]
            yield pa.RecordBatch.from_arrays([q.field("query_id").cast(kinds[0][1]), pa.array(np.concatenate(parts))], schema=pa.schema(kinds))


def _block_above(batches, kinds: list, together: int = 1 << 20):
    """A block's similarities from a query's floor on."""
    for batch in batches:
        for i in range(batch.num_rows):
            q, n_q, n_v, units = _block_units(batch, i)
            floor, step = q.field("floor").to_numpy(zero_copy_only=False) - 1e-9, max(1, together // n_v)
            for lo in range(0, n_q, step):
                hi = min(lo + step, n_q)
                similar = _products(lo, hi, n_v, *units, np.float64)
                above = ~(similar < floor[lo:hi, None])
                borders = pa.array(np.append(0, np.cumsum(above.sum(axis=1))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([q.field("query_id").slice(lo, hi - lo).cast(kinds[0][1]), pa.ListArray.from_arrays(borders, pa.array(similar[above]))], schema=pa.schema(kinds))


def _expected(batches, n: int, places: int, kinds: list):
    """The mean maximum of so many draws from a query's similarities, for each number of draws."""
    for batch in batches:
        for query, top, draws in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("query_id", "top", "lengths"))):
            best = np.sort(top.values.flatten().to_numpy())[-places:]
            i, d = np.arange(n - len(best) + 1, n + 1)[:, None], draws.values.to_numpy()
            expected = best @ ((i / n) ** d - ((i - 1) / n) ** d)
            yield pa.RecordBatch.from_arrays([pa.array([query.as_py()] * len(d)).cast(kinds[0][1]), pa.array(d), pa.array(expected)], schema=pa.schema(kinds))


def length_norm_best(queries: DataFrame, vectors: DataFrame, query_block: int = 2048, vector_block: int = 16384) -> DataFrame:
    """`pool_length_norm` of all pairs, without pairs as rows: query_id, record_id, score.

    The least of n similarities weighs ((1 / n) ** draws) and the weights grow with the place: all that are not among the best
    n * (1 - _NOTHING ** (1 / draws)) weigh less together than the last digit of a double.  Every block of vectors tells what its
    share of those reach, the least of that is a floor under them, and a second round keeps what lies above, about as many
    numbers a query as there are records times 41.  Where these are more than a row may hold, or a query or a null record is
    repeated, pairs are rows.
    """
    held = staged(vectors.groupBy("record_id").agg(F.count("*").alias("draws")))
    n, least, nulls = held.agg(F.sum("draws"), F.min("draws"), F.count(F.when(F.col("record_id").isNull(), 1))).first()
    q, _, repeated = _dealt(queries.select("query_id", "qvec"), "query_id", "q", query_block)
    places = math.ceil(n * (1 - _NOTHING ** (1 / least))) if n else 0
    if not n or nulls or repeated or places > _PLACES:
        return pool_length_norm(staged(dense_scores(queries, vectors)))
    v, blocks = _in_blocks(vectors.select("vec_id", "embedding"), "v", vector_block)
    key = queries.schema["query_id"]
    kinds = lambda *more: [(f.name, to_arrow_type(f.dataType)) for f in (key, *more)]
    reached, above, drawn = StructField("floor", DoubleType()), StructField("above", ArrayType(DoubleType())), (StructField("draws", LongType()), StructField("expected", DoubleType()))
    floors = _pairs(q, v, blocks).mapInArrow(partial(_block_floors, share=places / n, kinds=kinds(reached)), StructType([key, reached]))
    asked = staged(queries.select("query_id", "qvec").join(floors.groupBy("query_id").agg(F.min("floor").alias("floor")), "query_id"))
    found = _pairs(_in_blocks(asked, "q", query_block)[0], v, blocks).mapInArrow(partial(_block_above, kinds=kinds(above)), StructType([key, above]))
    lengths = held.agg(F.sort_array(F.collect_set("draws")).alias("lengths"))  # one row of distinct numbers
    top = found.groupBy("query_id").agg(F.collect_list("above").alias("top")).join(F.broadcast(lengths))
    expected = top.mapInArrow(partial(_expected, n=n, places=places, kinds=kinds(*drawn)), StructType([key, *drawn]))
    best = dense_best(queries, vectors, 1, 1 << 30, query_block, vector_block).join(held, "record_id")
    return best.join(expected, ["query_id", "draws"]).select("query_id", "record_id", (F.col("score") - F.col("expected")).alias("score"))


POOLINGS: dict[str, Callable[[DataFrame], DataFrame]] = {"max": pool_max, "mean_top3": pool_mean_top3, "length_norm": pool_length_norm}


def similarity_floor(scored: DataFrame, floor: float | None) -> DataFrame:
    return scored if floor is None else scored.where(F.col("score") >= floor)


def vector_candidates(scored: DataFrame, n: int = 100) -> DataFrame:
    return signal_rank(scored, n)


#: Poolings that a block can begin: how many of a record's best similarities they average.
PARTIAL = {"max": 1, "mean_top3": 3}


def pooled(queries: DataFrame, vectors: DataFrame, pooling: str, limit: int) -> DataFrame:
    """query_id, record_id, score of at least the `limit` best records of every query."""
    if pooling in PARTIAL:
        return dense_best(queries, vectors, PARTIAL[pooling], limit)
    return length_norm_best(queries, vectors)


def search_dense(queries: DataFrame, vectors: DataFrame, pooling: str = "mean_top3", floor: float | None = None, limit: int = 100) -> DataFrame:
    return vector_candidates(similarity_floor(pooled(queries, vectors, pooling, limit), floor), limit)


def rrf(signals: list[DataFrame], k: int = 60) -> DataFrame:
    """signals(query_id, record_id, rank) -> query_id, record_id, score, rank: the sum of 1 / (k + rank)."""
    every = signals[0].select("query_id", "record_id", "rank")
    for s in signals[1:]:
        every = every.unionByName(s.select("query_id", "record_id", "rank"))
    return signal_rank(every.groupBy("query_id", "record_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score")))


def rerank_window(hits: DataFrame, scores: DataFrame, top_k: int = 20) -> DataFrame:
    """The first top_k reordered by the new score; ties keep their order, a missing score is last among them, the tail stays."""
    rows = hits.join(scores.select("query_id", "record_id", F.col("score").alias("new")), ["query_id", "record_id"], "left")
    inside = F.col("rank") <= top_k
    order = Window.partitionBy("query_id").orderBy(~inside, F.when(inside, F.coalesce(-F.col("new"), F.lit(float("inf")))), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).drop("rank", "new").withColumnRenamed("new_rank", "rank")


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Scorer, top_k: int = 20, chars: int = 2000) -> DataFrame:
    """Rerank by scorer(query, text) on the first characters of each text; a query with any failed score keeps its whole order."""
    udf = F.pandas_udf(scorer, "double")
    window = hits.where(F.col("rank") <= top_k).join(queries.select("query_id", "query"), "query_id").join(texts.select("record_id", F.left("text", F.lit(chars)).alias("text")), "record_id", "left")
    scored = window.withColumn("score", F.when(F.col("text").isNotNull(), udf("query", "text")))
    failed = scored.groupBy("query_id").agg(F.bool_or(F.col("score").isNull()).alias("failed"))
    good = scored.join(failed, "query_id").where("not failed").select("query_id", "record_id", "score")
    new = rerank_window(hits, good, top_k)
    keep = failed.where("failed").select("query_id")
    return new.join(keep, "query_id", "left_anti").unionByName(hits.join(keep, "query_id", "left_semi").select(new.columns))


#: A way to find records: queries(query_id, query) -> query_id, record_id, score.
Signal = Callable[[DataFrame], DataFrame]


def lexical_signal(index: DataFrame | TextIndex) -> Signal:
    """Passages, or an index of them, as a signal."""
    return lambda queries: search_lexical(queries, index)


def dense_signal(vectors: DataFrame, qvecs: DataFrame, pooling: str = "mean_top3", floor: float | None = None, candidates: int = 100) -> Signal:
    """Vectors of records and of queries as a signal."""
    return lambda queries: search_dense(qvecs.join(queries.select("query_id"), "query_id", "left_semi"), vectors, pooling, floor, candidates)


def search_signals(queries: DataFrame, signals: dict[str, Signal], titles: DataFrame, limit: int = 10, similarity: str | None = None, reranked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Any signals, each ranked by its own scores and fused by rank; similarity names the one whose score is shown beside."""
    ranked = {name: signal_rank(find(queries).select("query_id", "record_id", "score")) for name, find in signals.items()}
    if not ranked:
        raise ValueError("no signal given")
    return _hits(rrf(list(ranked.values())), ranked.get(similarity), titles, limit, reranked)


def search_hybrid(
    queries: DataFrame, passages: DataFrame | TextIndex, vectors: DataFrame | None, titles: DataFrame, qvecs: DataFrame | None = None, *,
    limit: int = 10, pooling: str = "mean_top3", floor: float | None = None, candidates: int = 100, scorer: Scorer | None = None, texts: DataFrame | None = None, signals: Sequence[Signal] = (),
) -> DataFrame:
    """query_id, rank, record_id, score, similarity (null if the dense half did not find it), title ('' if unknown); signals: further ones to fuse."""
    found = [search_lexical(queries, passages)]
    similar = None
    if vectors is not None and qvecs is not None:
        similar = search_dense(qvecs, vectors, pooling, floor, candidates)
        found.append(similar)
    found += [signal_rank(s(queries).select("query_id", "record_id", "score")) for s in signals]
    return _hits(rrf(found), similar, titles, limit, (lambda fused: rerank(fused, queries, texts, scorer)) if scorer is not None else None)


def rewrite_queries(queries: DataFrame, rewriter: Callable[[pd.Series], pd.Series] | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, query rewritten) and (query_id, reason) of those refused: nothing came back, or a loop of one phrase.

    Without a rewriter by the fixed rule.  A refused query is not searched under the strategy's name, nor as it was.
    """
    if rewriter is None:
        return queries.select("query_id", T.rewrite_template(F.col("query")).alias("query")), queries.select("query_id", F.lit("").alias("reason")).where("false")
    made = staged(queries.select("query_id", T.clean_completion(F.pandas_udf(rewriter, "string")("query")).alias("query")))
    loops = outline.is_degenerate(made.select(F.col("query_id").alias("id"), "query").withColumnRenamed("query", "text")).where("degenerate").select(F.col("id").alias("query_id"), F.lit("loop").alias("reason"))
    empty = made.where("coalesce(query, '') = ''").select("query_id", F.lit("empty").alias("reason"))
    refused = loops.unionByName(empty)
    return made.join(refused, "query_id", "left_anti"), refused


def fuse(lexical: DataFrame, similar: DataFrame, titles: DataFrame, limit: int = 10) -> DataFrame:
    """The hits of search_hybrid from its two signals, for those who have them already: a sweep ranks the text once."""
    return _hits(rrf([lexical, similar]), similar, titles, limit)


def _hits(fused: DataFrame, similar: DataFrame | None, titles: DataFrame, limit: int, reranked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    hits = search_limit(reranked(fused) if reranked else fused, limit)
    if similar is not None:
        hits = hits.join(similar.select("query_id", "record_id", F.col("score").alias("similarity")), ["query_id", "record_id"], "left")
    else:
        hits = hits.withColumn("similarity", F.lit(None).cast("double"))
    return hits.join(titles.select("record_id", "title"), "record_id", "left").select("query_id", "rank", "record_id", "score", "similarity", F.coalesce("title", F.lit("")).alias("title"))


def membership_filter(ranked: DataFrame, members: DataFrame, limit: int, over: int = 10) -> DataFrame:
    """Candidates of an outside index, over-fetched, that are members; in their order, ranked anew and cut."""
    kept = ranked.where(F.col("rank") <= limit * over).join(members.select("record_id"), "record_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank", "record_id")
    return kept.withColumn("new", F.row_number().over(order)).where(F.col("new") <= limit).drop("rank").withColumnRenamed("new", "rank")


def similarity_pairs(vectors: DataFrame, record: str) -> DataFrame:
    """Every vector of the record with every vector of other records."""
    mine = vectors.where(F.col("record_id") == record).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return dense_scores(mine, vectors.where(F.col("record_id") != record)).select("record_id", F.col("query_id").alias("mine"), F.col("vec_id").alias("other"), "similarity")


def similar(vectors: DataFrame, record: str, limit: int) -> DataFrame:
    """The records nearest to a record by their best pair of vectors."""
    mine = vectors.where(F.col("record_id") == record).select(F.lit(0).alias("query_id"), F.col("embedding").alias("qvec"))
    best = dense_best(mine, vectors.where(F.col("record_id") != record), 1, limit).groupBy("record_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "record_id").limit(limit)


def similar_all(vectors: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """seeds(record_id) -> query_id, record_id, score, rank: `similar` for many records at once; a seed without vectors has no rows."""
    mine = vectors.join(seeds.select("record_id"), "record_id", "left_semi").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("qvec"))
    # the seed itself may be among the best
    best = dense_best(mine, vectors, 1, limit + 1).where("query_id <> record_id")
    return signal_rank(best, limit)


def centroid(vectors: DataFrame) -> DataFrame:
    """record_id, centroid, n: the normalised sum of a record's vectors; null if they differ in length or cancel out."""
    sizes = vectors.groupBy("record_id").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    sums = vectors.select("record_id", F.posexplode("embedding").alias("pos", "x")).groupBy("record_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    whole = sums.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("v"))
    rows = sizes.join(whole, "record_id", "left")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("record_id", F.when((F.col("lo") == F.col("hi")) & (norm > 0), F.transform("v", lambda x: x / norm)).alias("centroid"), "n")


def trace(signals: dict[str, DataFrame | None], fused: DataFrame) -> DataFrame:
    """query_id, stage, rank, record_id, score of every signal and of the fused order; a signal that was not run is absent."""
    part = lambda name, df: df.select("query_id", F.lit(name).alias("stage"), "rank", "record_id", F.col("score").cast("double").alias("score"))
    out = part("fused", fused)
    for name, df in signals.items():
        if df is not None:
            out = out.unionByName(part(name, df))
    return out


def notes(status: DataFrame) -> DataFrame:
    """status(query_id, signal, own, error) -> query_id, failed, fatal: fatal when the own full-text signal failed, or all did."""
    bad = F.col("error").isNotNull()
    return status.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(bad, F.col("signal")))).alias("failed"), (F.bool_or(bad & F.col("own")) | F.bool_and(bad)).alias("fatal")
    )


def window_contains_answer(rank: Column, top_k: int = 20) -> Column:
    return F.coalesce(rank <= top_k, F.lit(False))


def augment_vectors(vectors: DataFrame, generated: DataFrame) -> DataFrame:
    """generated(record_id, text_no, embedding) as further spans of their records, numbered on from the last one."""
    last = vectors.groupBy("record_id").agg(F.max("span_start").alias("last"))
    order = Window.partitionBy("record_id").orderBy("text_no")
    more = generated.join(last, "record_id", "left").select("record_id", (F.coalesce("last", F.lit(-1)) + F.row_number().over(order)).alias("span_start"), "embedding")
    return vectors.select("record_id", "span_start", "embedding").unionByName(more)
