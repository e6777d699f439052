"""Hard negatives by exact integer scores from float32 matrix products in a residue number system.

Components are quantised to integers.  For each of a few primes a block of anchors and a block
of rows become matrices of residues about zero, small enough that a float32 product of them is
exact over the dimensions it sums; the products modulo the primes are put together by Chinese
remaindering (Garner's mixed radix) into the signed score.  As many primes are taken as the
largest score possible in the two blocks asks for.

First pass: anchors meet rows of their own label, in blocks, and keep their first positives.
Second pass: anchors with their positives meet all rows, in blocks; rows of a block are put in
order once per anchor, and each positive takes the first ones of another label from the upper
end of its window of scores downward.  Blocks give a few rows per anchor and positive, and a
window over those keeps the first ones.

Every anchor block meets every row block: the anchors are a stated set of queries, and all
rows are their candidates.  Blocks are bounded in components, and what moves is a row per
anchor block and an anchor per row block.

Defined results: rows with a null label or id, a null or empty vector, or null or non-finite
components take no part; rows of one id are rows each, each of them asks for itself, and none
of them is a candidate for another one; only vectors of equal length are compared; fewer
candidates than wanted give all; equal scores go by the smaller id; further columns are not
read; an empty table gives no rows.  A table whose scores could pass 2^55 is an error.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.buffers import give_back
from quillspark.plans.staging import Staged, staged

#: Components of a block of anchors and of a block of rows, at most (about).
ANCHORS, ROWS = 1 << 18, 1 << 20
#: Scores that are worked on together.
TILE = 1 << 20
#: Largest sum that float32 holds exactly.
EXACT = 1 << 24
#: Most components summed in one product; longer vectors are summed in parts.
DIMS = 1024

_VALID = "label is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def primes_for(dims: int, bound: int) -> list[int]:
    """Primes, largest first, whose residues about zero can be multiplied and summed over dims in float32, and whose product tells apart -bound to bound."""
    half = int((EXACT / dims) ** 0.5)
    found, total, p = [], 1, 2 * half + 1
    while total <= 2 * bound:
        if p < 3:
            raise ValueError("scores of these vectors are too large to tell apart")
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            found.append(p)
            total *= p
        p -= 1
    return found


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, about zero."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def largest(a: np.ndarray, b: np.ndarray) -> int:
    """No score of these rows is further from 0 than this."""
    bound = max(1, a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)))
    if bound >= 1 << 55:
        raise ValueError("scores of these vectors could pass 2^55")
    return bound


class Residues:
    """An integer matrix as float32 matrices of residues, a list for every prime: one for each run of columns that is summed at once."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.of = {p: [_residues(x[:, i : i + DIMS], p) for i in range(0, x.shape[1], DIMS)] for p in primes}


def products(a: Residues, b: Residues, rows_a: slice, rows_b: slice) -> np.ndarray:
    """The inner products of rows of a with rows of b, exactly."""
    score, base = np.int64(0), 1
    for p in a.of:
        r = sum((x[rows_a] @ y[rows_b].T).astype(np.int64) for x, y in zip(a.of[p], b.of[p], strict=True))
        # Garner: the next digit, in mixed radix, is what this residue lacks
        score = score + (r - score) % p * pow(base % p, -1, p) % p * base
        base *= p
    return np.where(score > base // 2, score - base, score)


def _matrix(t: pa.Table) -> np.ndarray:
    q = t.column("q").combine_chunks()
    return q.flatten().to_numpy().reshape(len(q), -1)


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("vec_id", "ascending"), ("no", "ascending")])


def _tiles(anchors: pa.Table, rows: pa.Table):
    """(anchors, rows, keys): scores by tile, made one with the place of a row, so that greater keys come first and equal scores by smaller id."""
    a, b = _matrix(anchors), _matrix(rows)
    bound = largest(a, b)
    primes = primes_for(min(DIMS, a.shape[1]), bound)
    a, b, n = Residues(a, primes), Residues(b, primes), min(len(b), (1 << 62) // bound)
    step = max(1, TILE // n)
    for at in range(0, rows.num_rows, n):
        part = slice(at, min(at + n, rows.num_rows))
        own = part.stop - at
        for lo in range(0, anchors.num_rows, step):
            asking = slice(lo, min(lo + step, anchors.num_rows))
            yield asking, part, products(a, b, asking, part) * own + np.arange(own - 1, -1, -1)


_NEVER = np.iinfo(np.int64).min


def _first_positives(key: tuple, anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block, of the same label, for every anchor of a block."""
    out: list = [[], [], []]
    if anchors.num_rows and rows.num_rows:
        rows = _ordered(rows)
        own, every, no = anchors.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy(), anchors.column("no").to_numpy()
        for asking, part, keys in _tiles(anchors, rows):
            ids, n = every[part], part.stop - part.start
            keys[own[asking, None] == ids[None, :]] = _NEVER
            best = np.partition(keys, max(0, n - k), axis=1)[:, max(0, n - k) :]
            a, j = np.nonzero(best != _NEVER)
            score, place = np.divmod(best[a, j], n)
            out[0].append(no[asking][a])
            out[1].append(ids[n - 1 - place])
            out[2].append(score)
    give_back()
    return _table(out, ("no", "positive_id", "positive_score"))


def _first_negatives(key: tuple, anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The k best rows of a block, of another label and within the window, for every anchor and positive of a block.  anchors: a row each positive."""
    out: list = [[], [], [], []]
    if anchors.num_rows and rows.num_rows:
        rows, asked = _ordered(rows), anchors.sort_by([("no", "ascending"), ("rank", "ascending")])
        no, rank, score = (asked.column(c).to_numpy() for c in ("no", "rank", "positive_score"))
        first = np.flatnonzero(np.append(True, no[1:] != no[:-1]))
        last, single = np.append(first[1:], len(no)), asked.take(pa.array(first))
        every, vec = rows.column("vec_id").to_numpy(), single.column("vec_id").to_numpy()
        labels = pa.chunked_array([*single.column("label").chunks, *rows.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        own, theirs = labels[: len(first)], labels[len(first) :]
        # the window: low * positive <= 100 * negative <= high * positive
        least, most = -(-low * score // 100), high * score // 100
        for asking, part, keys in _tiles(single, rows):
            ids, n = every[part], part.stop - part.start
            keys[(own[asking, None] == theirs[None, part]) | (vec[asking, None] == ids[None, :])] = _NEVER
            keys.sort(axis=1)
            asks = np.arange(first[asking.start], last[asking.stop - 1])
            of = np.searchsorted(first, asks, "right") - 1 - asking.start
            # from the window's upper end downward
            top = np.array([np.searchsorted(keys[i], u, "right") for i, u in zip(of, most[asks] * n + n - 1, strict=True)], np.int64)
            for j in range(1, k + 1):
                got = keys[of, np.maximum(top - j, 0)]
                fits = (top >= j) & (got >= least[asks] * n) & (got != _NEVER)
                found, place = np.divmod(got[fits], n)
                out[0].append(no[asks[fits]])
                out[1].append(rank[asks[fits]].astype(np.int64))
                out[2].append(ids[n - 1 - place])
                out[3].append(found)
    give_back()
    return _table(out, ("no", "positive", "negative_id", "negative_score"))


def _table(columns: list, names: tuple) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, columns, strict=True)})


def vectors(table: DataFrame, scale: float, noisy: int, labels: int) -> DataFrame:
    """(no, vec_id, label, dims, q array<long>): valid rows, quantised and numbered; every `noisy`-th id has the next label of so many."""
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding")]
    label = F.when(F.col("vec_id") % noisy == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long") if noisy else F.col("label")
    rows = table.select(*cols).where(_VALID).select("vec_id", label.alias("label"), F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("q"))
    return rows.withColumn("no", F.monotonically_increasing_id())


def mine(
    table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, noisy: int = 7, labels: int = 10,
) -> DataFrame:
    """-> anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the anchors: rows whose id is divisible by `every`."""
    held = Staged(vectors(table, scale, noisy, labels))
    rows = held.df
    # the same table again, as a frame of its own: both sides of a pairing come from it
    others = table.sparkSession.read.schema(rows.schema).parquet(held.path)
    cores = max(1, table.sparkSession.sparkContext.defaultParallelism)
    # how many blocks a group of n rows is dealt into; small groups as many as keep all cores busy
    def dealt(n, dims, cells: int, least: int):
        return F.greatest(F.ceil(n * dims / cells), F.least(F.ceil(n / 1024), F.lit(least))).cast("long")

    block = lambda n, salt: F.pmod(F.xxhash64("no", F.lit(salt)), n)
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    is_anchor = F.col("vec_id") % every == 0
    # first pass: within a label
    counts = staged(rows.groupBy("label", "dims").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("asking")).where("asking > 0"))
    sized = counts.select("label", "dims", dealt(F.col("asking"), F.col("dims"), ANCHORS, 1).alias("asks"), dealt(F.col("n"), F.col("dims"), ROWS, cores).alias("blocks"))
    own, theirs = rows.join(sized, ["label", "dims"]), others.join(sized.select("*"), ["label", "dims"])
    keys = ["label", "dims", "ask", "block"]
    left = own.where(is_anchor).withColumn("ask", block(F.col("asks"), 1)).withColumn("block", to_all(F.col("blocks"))).select(*keys, "no", "vec_id", "q")
    right = theirs.withColumn("block", block(F.col("blocks"), 2)).withColumn("ask", to_all(F.col("asks"))).select(*keys, "no", "vec_id", "q")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda key, a, b: _first_positives(key, a, b, positives), "no long, positive_id long, positive_score long")
    order = Window.partitionBy("no").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    asked = staged(rows.where(is_anchor).join(found, "no"))
    # second pass: all labels of a length
    sizes = counts.select("dims").distinct().join(rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("asking")), "dims")
    sized = sizes.select("dims", dealt(F.col("asking"), F.col("dims"), ANCHORS, 1).alias("asks"), dealt(F.col("n"), F.col("dims"), ROWS, 4 * cores).alias("blocks"))
    keys = ["dims", "ask", "block"]
    left = asked.join(sized, "dims").withColumn("ask", block(F.col("asks"), 1)).withColumn("block", to_all(F.col("blocks"))).select(*keys, "no", "vec_id", "label", "q", "rank", "positive_score")
    right = others.join(sized, "dims").withColumn("block", block(F.col("blocks"), 2)).withColumn("ask", to_all(F.col("asks"))).select(*keys, "no", "vec_id", "label", "q")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda key, a, b: _first_negatives(key, a, b, negatives, low, high), "no long, positive long, negative_id long, negative_score long")
    order = Window.partitionBy("no", "positive").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= negatives)
    pairs = asked.select("no", F.col("rank").cast("long").alias("positive"), F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return near.join(pairs, ["no", "positive"]).select("anchor_id", "positive_id", F.col("at").alias("rank"), "negative_id", "positive_score", "negative_score")
