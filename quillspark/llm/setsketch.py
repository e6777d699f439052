"""MinHash near-dedup with SetSketch registers.

A register keeps the minimum of exponential draws over a document's shingles on an
exponentially spaced, truncated scale; registers of two sets merge by maximum, and
equal registers are likelier the more alike the sets are.  Candidates share a band of
registers, a likelihood over all registers estimates their similarity, and the full
shingle sets decide.

Only connectivity is asked for, so copies are never paired with each other.  Documents
with equal sets are one node.  The nodes of a bucket are first compared with its hub, the
node that meets most others; what links to hubs is joined into components.  A bucket that
still holds several components has its other pairs compared: in a small one pair by pair,
by likelihood and then by full sets; in a large one in blocks of bounded rows and
shingles, each block of nodes outside the hub's component against each block of the
bucket, by products of 0/1 matrices over full sets.  A block gives at most one link for
two components.  No bucket is capped, and no step depends on how many rounds others took.

Defined results: a null or blank text has an empty set and links with nothing; a null
id links with nothing, has a null component and is kept; rows that repeat an id are linked
with each other, whatever their texts; further columns of the input are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.buffers import LOWER, give_back, mixed, small_batches, span_hash, texts, tidy, words
from quillspark.plans.graph import connected_components
from quillspark.plans.staging import Scratch, staged

REGISTERS, BAND = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Likelihood estimates this far under the threshold are dropped: five standard errors at 0.8.
SLACK = 5 * np.sqrt(0.8 * 0.2 / REGISTERS)
#: Buckets up to this many nodes compare pairs; blocks of larger ones hold about so many nodes and shingles.
SMALL, BLOCK_NODES, BLOCK_SHINGLES = 16, 512, 1 << 18
#: Shingles of two blocks that are multiplied at once.
WIDTH = 4096
#: Ids or pairs up to this many (16 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct k-word shingles of each text; a text of fewer words has one, its whole sequence."""
    data = LOWER[data]
    start, end, row = words(data, at)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = span_hash(data, start, end)
    n = len(h) - k + 1
    got, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        got = sum(h[j : j + n] * _PLACE[j % 64] for j in range(k))
        whole = row[:n] == row[k - 1 :]
        got, rows = got[whole], row[:n][whole]
    count = np.bincount(row, minlength=len(at) - 1)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.concatenate([[0], np.cumsum(count)])
        short = [(h[first[r] : first[r] + count[r]] * _PLACE[np.arange(count[r]) % 64]).sum(keepdims=True) + count[r].astype(np.uint64) for r in few]
        got, rows = np.concatenate([got, *short]), np.concatenate([rows, few])
    got = mixed(got)
    order = np.lexsort((got, rows))
    got, rows = got[order], rows[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (rows[1:] != rows[:-1])
    return got[new], rows[new]


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The registers of each run of hashes that begins at `first`."""
    least = np.empty((len(first), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(h * _MUL[i] + _ADD[i], first)
    draw = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(draw, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype("<u2")


@tidy
def _sketches(batches, k: int):
    for b in batches:
        ids = b.column("doc_id")
        for lo, hi, data, at in texts(b.column("text"), 1 << 19):
            h, row = shingles(data, at, k)
            n = np.bincount(row, minlength=hi - lo).astype(np.int64)
            full = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[full]
            regs: list = [None] * (hi - lo)
            key = np.zeros((2, hi - lo), np.uint64)
            if len(full):
                for r, x in zip(full, registers(h, first), strict=True):
                    regs[r] = x.tobytes()
                for i in (0, 1):
                    key[i, full] = np.add.reduceat(mixed(h, i + 1), first)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(n), *(pa.array(x.view(np.int64)) for x in key), pa.array(regs, pa.binary())],
                names=["doc_id", "n", "k1", "k2", "regs"],
            )


@tidy
def _sets(batches, k: int):
    for b in batches:
        ids = b.column("doc_id")
        for lo, hi, data, at in texts(b.column("text"), 1 << 19):
            h, row = shingles(data, at, k)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([h[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary())],
                names=["node", "shingles"],
            )


def estimate(nu, nv, above, equal, below) -> np.ndarray:
    """The likeliest Jaccard similarity, given both set sizes and how many registers are above, equal or below."""
    nu, nv = (np.asarray(x, float)[:, None] for x in (nu, nv))
    above, equal, below = (np.asarray(x, float)[:, None] for x in (above, equal, below))
    u = nu / (nu + nv)
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(nu, nv) / np.maximum(nu, nv)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    fit = above * np.log(up) + below * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), fit.argmax(1)]


@tidy
def _likely(batches, percent: int):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
        if not len(x):
            continue
        # a thousand at a time: each has a likelihood at every step of similarity
        na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
        parts = [slice(i, i + 1000) for i in range(0, len(x), 1000)]
        j = np.concatenate([estimate(na[p], nb[p], (x[p] > y[p]).sum(1), (x[p] == y[p]).sum(1), (x[p] < y[p]).sum(1)) for p in parts])
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(j >= percent / 100 - SLACK))


@tidy
def _linked(batches, percent: int):
    for b in batches:
        sets = [[np.frombuffer(s.as_buffer(), np.uint64) for s in b.column(c)] for c in ("sa", "sb")]
        size = [np.array([len(s) for s in x], np.int64) for x in sets]
        both = np.array([np.isin(x, y, assume_unique=True, kind="sort").sum() for x, y in zip(*sets, strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["u", "v"]).filter(pa.array(100 * both >= percent * (size[0] + size[1] - both)))


def overlaps(left: list, right: list) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices over the shingles that both sides have."""
    flat, row = [], []
    for sets in (left, right):
        flat.append(np.concatenate(sets))
        row.append(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    for side in (0, 1):
        has = np.isin(flat[side], common)
        flat[side], row[side] = np.searchsorted(common, flat[side][has]), row[side][has]
        order = np.argsort(flat[side], kind="stable")
        flat[side], row[side] = flat[side][order], row[side][order]
    for lo in range(0, len(common), WIDTH):
        ones = []
        for side, n in ((0, len(left)), (1, len(right))):
            at = slice(*np.searchsorted(flat[side], [lo, lo + WIDTH]))
            m = np.zeros((n, min(WIDTH, len(common) - lo)), np.float32)
            m[row[side][at], flat[side][at] - lo] = 1
            ones.append(m)
        total += ones[0] @ ones[1].T
    return total.astype(np.int64)


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between components that the pairs of one block and one block show: each two components once."""
    out = np.zeros((0, 2), np.int64)
    asks = table.column("asks").to_numpy()
    comp = table.column("c").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles").combine_chunks()]
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    if len(x) and len(y):
        size = np.array([len(s) for s in sets], np.int64)
        both = overlaps([sets[i] for i in x], [sets[i] for i in y])
        hit = (100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)) & (comp[x][:, None] != comp[y][None, :])
        i, j = np.nonzero(hit)
        out = np.unique(np.stack([comp[x[i]], comp[y[j]]], 1), axis=0)
        del both, hit, i, j, sets
        give_back()
    return pa.table({"u": pa.array(out[:, 0]), "v": pa.array(out[:, 1])})


def _bounded(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few enough; else the join shuffles both sides."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


class _Compare:
    """Candidate pairs by sizes and register likelihood, then by their full sets: links (u, v)."""

    def __init__(self, scratch: Scratch, reps: DataFrame, sets: DataFrame, percent: int):
        self.scratch, self.reps, self.sets, self.percent = scratch, reps, sets, percent

    def __call__(self, pairs: DataFrame) -> DataFrame:
        side = lambda s: self.reps.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
        close = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        likely = self.scratch(close.mapInArrow(partial(_likely, percent=self.percent), "a long, b long").distinct())
        full = lambda s: self.sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}"))
        both = full("a").join(_bounded(likely), "a").join(full("b"), "b").select("a", "b", "sa", "sb")
        return self.scratch(both.mapInArrow(partial(_linked, percent=self.percent), "u long, v long"))


def _large(named: DataFrame, scratch: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """named(key, rep, n, c, hub_c) of large buckets -> links (u, v) between components, from blocks against blocks.

    Nodes outside the hub's component ask, all answer.  A bucket with few that ask is read once.
    """
    rows = scratch(named.withColumn("asks", F.col("c") != F.col("hub_c")))
    size = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.sum(F.col("asks").cast("long")).alias("ma"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)).alias("wa"))
    blocks = lambda m, w: F.greatest(F.ceil(F.col(m) / BLOCK_NODES), F.ceil(F.col(w) / BLOCK_SHINGLES))
    size = size.select("key", blocks("m", "w").alias("answering"), blocks("ma", "wa").alias("asking"))
    own = lambda n: F.pmod(F.xxhash64("rep", F.lit(7)), F.col(n))
    rows = rows.join(size, "key")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    unit = lambda asks, i, j: F.struct(F.lit(asks).alias("asks"), i.alias("i"), j.alias("j"))
    answer = F.transform(every("asking"), lambda i: unit(False, i, own("answering")))
    ask = F.transform(every("answering"), lambda j: unit(True, own("asking"), j))
    rows = rows.select("key", F.col("rep").alias("node"), "c", F.inline(F.when(F.col("asks"), F.concat(answer, ask)).otherwise(answer)))
    held = rows.join(sets, "node").select("key", "i", "j", "asks", "c", "shingles")
    return scratch(held.groupBy("key", "i", "j").applyInArrow(lambda t: _block_links(t, percent), "u long, v long").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, n_shingles, component_id, kept: one row per input row.

    Texts link when 100 * |A & B| >= percent * |A | B| over their distinct k-word shingles.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch() as scratch:
        sketch = scratch(small_batches(src).mapInArrow(partial(_sketches, k=k), "doc_id long, n long, k1 long, k2 long, regs binary"))
        keys = ["n", "k1", "k2"]
        reps = scratch(sketch.where("n > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.min_by("regs", "doc_id").alias("regs")))
        members = staged(sketch.select("doc_id", *keys).join(reps.select("rep", *keys), keys, "left").select("doc_id", "n", "rep"))
        # rows of one id with unlike texts
        torn = members.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("most")).where("u < most")
        torn = members.join(torn, "doc_id").select("u", F.col("rep").alias("v")).where("u <> v").distinct()

        cut = f"explode(transform(sequence(0, {REGISTERS // BAND - 1}), i -> xxhash64(i, substring(regs, i * {2 * BAND} + 1, {2 * BAND}))))"
        bands = reps.select("rep", "n", F.expr(cut).alias("key"))
        many = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
        live = scratch(bands.join(many, "key").select("key", "rep", "n", "size"))
        # The node that meets most others leads each of its buckets: copies are near their original more often than near each other.
        met = live.groupBy("rep").agg(F.sum("size").alias("met"))
        hubs = live.join(met, "rep").groupBy("key").agg(F.max_by("rep", F.col("met") * 1024 + F.pmod("rep", F.lit(1024))).alias("hub"))
        live = scratch(live.join(hubs, "key"))
        need = live.select(F.col("rep").alias("doc_id")).distinct()
        sets = scratch(src.join(_bounded(need), "doc_id", "left_semi").mapInArrow(partial(_sets, k=k), "node long, shingles binary"))
        compare = _Compare(scratch, reps, sets, percent)

        told = compare(live.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
        labels = scratch(connected_components(told.union(torn)))
        named = live.join(labels, live.rep == labels.node, "left").select("key", "rep", "n", "hub", "size", F.coalesce("component", "rep").alias("c"))
        split = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.expr("case when rep = hub then c end")).alias("hub_c")).where("lo < hi")
        named = scratch(named.join(split.select("key", "hub_c"), "key"))
        few = named.where(F.col("size") <= SMALL).select("key", "rep", "n", "c")
        near = f"x.rep < y.rep and x.c <> y.c and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
        pairs = few.alias("x").join(few.alias("y"), "key").where(near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
        more = compare(pairs).union(_large(named.where(F.col("size") > SMALL), scratch, sets, percent))
        labels = staged(connected_components(more.union(labels.select("node", "component"))))

    out = members.join(labels, members.rep == labels.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.expr("case when doc_id is not null then coalesce(component, rep, doc_id) end").alias("component_id"),
    )
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))
