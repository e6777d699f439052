"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers; the index keeps, per block of rows and attribute,
one bitmap for each binary digit.  A query multiplies and adds bitmaps: the products of
an attribute with every query value that occurs come from shifted additions, a query's
score is a ripple addition of one product per attribute, and negative factors use the
complement of the slices.  The score's slices are then walked from the most significant
downward: bitmaps of rows surely in and rows still level narrow down to k, and rows level
at the boundary are resolved exactly, smallest id first.  Scores are read from the slices.

Queries and rows meet in blocks, every query block with every row block, the pairs dealt
out evenly; each pair gives at most k rows a query, and a window over those takes the
best k.

Defined results: vectors that are null, empty or hold null or non-finite components take
no part, nor do rows with a null id; where an id repeats, every row of it is a candidate
for other ids and none for its own, and all its rows ask together, for k hits in all;
scores compare only vectors of equal length; fewer than k candidates give all; equal
scores rank by smaller id; further columns are not read.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.plans.staging import staged

ROWS, QUERIES = 8192, 2048
#: Queries whose bitmaps are worked on together.
TOGETHER = 24

_VALID = "embedding is not null and size(embedding) > 0 and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def vectors(table: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dims, q array<long>): valid rows, quantised."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_VALID)
    return rows.select("vec_id", F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("q"))


def _packed(table: pa.Table, name: str) -> pa.Table:
    """One row for a group of rows: ids, least value and bits per value, and the values' bit slices or the values."""
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, dims = ids[order], table.column("dims")[0].as_py()
    values = table.column("q").combine_chunks().flatten().to_numpy().reshape(-1, dims)[order]
    low, bits, body = 0, 0, values.astype("<i8").tobytes()
    if name == "block":
        low = int(values.min())
        bits = max(1, int(values.max() - low).bit_length())
        wide = np.zeros((-(-len(ids) // 64) * 64, dims), np.uint64)
        wide[: len(ids)] = (values - low).astype(np.uint64)
        digits = (wide.T[:, None, :] >> np.arange(bits, dtype=np.uint64)[None, :, None]) & np.uint64(1)
        body = np.packbits(digits.astype(np.uint8), axis=2, bitorder="little").tobytes()
    return pa.table({"dims": pa.array([dims], pa.int32()), name: pa.array([table.column(name)[0].as_py()], pa.int64()), f"{name}_ids": [ids.astype("<i8").tobytes()], f"{name}_low": pa.array([low], pa.int64()), f"{name}_bits": pa.array([bits], pa.int32()), f"{name}_body": [body]})


def _add(a: list, b: list) -> list:
    """The slices of a + b, least significant first."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        if i < len(b):
            y = b[i]
            half = x ^ y
            if carry is None:
                out.append(half)
                carry = x & y
            else:
                out.append(half ^ carry)
                half &= carry
                carry = (x & y) | half
        elif carry is not None:
            out.append(x ^ carry)
            carry = x & carry
        else:
            out.append(x)
    if carry is not None:
        out.append(carry)
    return out


def _times(slices: list, factor: int) -> list:
    """The slices of factor times a number, by shifted additions; factor > 0."""
    zero = np.zeros_like(slices[0])
    total: list = []
    for shift in range(factor.bit_length()):
        if factor >> shift & 1:
            total = _add(total, [zero] * shift + slices) if total else [zero] * shift + slices
    return total


def _products(slices: np.ndarray, queries: np.ndarray, full: np.ndarray) -> tuple[list, list]:
    """Per attribute: the products with each occurring query value as one array per slice, and each query's place among them."""
    tables, places = [], []
    for d in range(queries.shape[1]):
        values, place = np.unique(queries[:, d], return_inverse=True)
        own = list(slices[d])
        flipped = [x ^ full for x in own]
        found = [_times(own if v > 0 else flipped, abs(int(v))) if v else [np.zeros_like(full)] for v in values]
        depth = max(map(len, found))
        zero = np.zeros_like(full)
        tables.append([np.stack([f[s] if s < len(f) else zero for f in found]) for s in range(depth)])
        places.append(place)
    return tables, places


def _select(total: list, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k highest, and of those level at the boundary."""
    sure = np.zeros_like(level)
    for s in reversed(total):
        high = level & s
        n = np.bitwise_count(sure).sum(1, dtype=np.int64) + np.bitwise_count(high).sum(1, dtype=np.int64)
        over = np.where(n > k, np.uint64(2**64 - 1), np.uint64(0))[:, None]
        sure |= high & ~over
        level = (high & over) | (level & ~s & ~over)
    return sure, level


def _pairs(batches, k: int):
    for b in batches:
        for row in range(b.num_rows):
            yield _pair(b.slice(row, 1).to_pylist()[0], k)


def _pair(row: dict, k: int) -> pa.RecordBatch:
    """The k best rows of one block for every query of one query block."""
    ids, dims, bits = np.frombuffer(row["block_ids"], "<i8"), row["dims"], row["block_bits"]
    qids = np.frombuffer(row["asked_ids"], "<i8")
    queries = np.frombuffer(row["asked_body"], "<i8").reshape(-1, dims)
    width = -(-len(ids) // 64)
    slices = np.frombuffer(row["block_body"], np.uint8).reshape(dims, bits, width * 8).view(np.uint64)
    full = np.full(width, 2**64 - 1, np.uint64)
    present = full.copy()
    if len(ids) % 64:
        present[-1] = np.uint64((1 << (len(ids) % 64)) - 1)
    tables, places = _products(slices, queries, full)
    top = (1 << bits) - 1
    # score = slices' sum + low * q for q >= 0; for q < 0 the complement adds |q| * (top - v)
    shift = (queries * row["block_low"]).sum(1) - np.where(queries < 0, -queries, 0).sum(1) * top
    out: list = [[], [], []]
    for lo in range(0, len(qids), TOGETHER):
        part = slice(lo, min(lo + TOGETHER, len(qids)))
        sums: list = []  # (products added up, slices): equal counts are added at once, so numbers stay short for long
        for t, place in zip(tables, places, strict=True):
            sums.append((1, [x[place[part]] for x in t]))
            while len(sums) > 1 and sums[-1][0] == sums[-2][0]:
                (m, y), (n, x) = sums.pop(), sums.pop()
                sums.append((m + n, _add(x, y)))
        while len(sums) > 1:
            (m, y), (n, x) = sums.pop(), sums.pop()
            sums.append((m + n, _add(x, y)))
        total = sums[0][1]
        level = np.repeat(present[None, :], part.stop - part.start, 0)
        # rows of the query's own id
        at, end = np.searchsorted(ids, qids[part]), np.searchsorted(ids, qids[part], "right")
        while (own := np.flatnonzero(at < end)).size:
            level[own, at[own] // 64] &= ~(np.uint64(1) << (at[own] % 64).astype(np.uint64))
            at[own] += 1
        sure, level = _select(total, level, k)
        for i in range(part.stop - part.start):
            best = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            if len(best) < k and level[i].any():
                best = np.concatenate([best, np.flatnonzero(np.unpackbits(level[i].view(np.uint8), bitorder="little"))[: k - len(best)]])
            score = np.zeros(len(best), np.int64)
            for s, plane in enumerate(total):
                score += ((plane[i, best // 64] >> (best % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
            out[0].append(np.full(len(best), qids[lo + i]))
            out[1].append(ids[best])
            out[2].append(score + shift[lo + i])
    cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "vec_id", "score"])


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """-> query_id, rank, vec_id, score for the rows whose id is divisible by `every`, against all other rows."""
    rows = staged(vectors(table, scale))
    n = rows.count()
    blocks, asked = max(1, math.ceil(n / ROWS)), max(1, math.ceil(n / every / QUERIES))
    # rows of one id may be many, so all columns decide on the block
    spread = lambda m, salt: F.pmod(F.xxhash64("vec_id", "q", F.lit(salt)) + F.monotonically_increasing_id(), F.lit(m))
    schema = "dims int, {0} long, {0}_ids binary, {0}_low long, {0}_bits int, {0}_body binary"
    index = rows.withColumn("block", spread(blocks, 1)).groupBy("dims", "block").applyInArrow(lambda t: _packed(t, "block"), schema.format("block"))
    query = rows.where(F.col("vec_id") % every == 0).withColumn("asked", spread(asked, 2))
    query = query.groupBy("dims", "asked").applyInArrow(lambda t: _packed(t, "asked"), schema.format("asked"))
    pairs = index.withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long")))).join(query, ["dims", "asked"])
    best = pairs.repartition(blocks * asked).mapInArrow(partial(_pairs, k=k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
