"""Embedding near-dedup by an epsilon grid order join.

A cosine threshold is a distance: unit vectors link within eps = sqrt(2 - 2 * cosine).
Leading principal directions, fitted on a bounded sample, give coordinates in which no
distance grows; vectors sort by label and by their grid cells of side eps along those
directions.  The sorted sequence is cut into intervals.  Intervals whose boxes are
provably farther apart than eps never meet; the others are joined recursively, halving
the longer interval and dropping distant halves, and compared in full at the leaves.

A pair of intervals returns, for every vector that links, how many it links with and the
least vector of its links there, so groups of near copies never become lists of pairs.
Exactly equal vectors of a label are one node with a count.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and rows without a label or id, link with nothing and are kept as their own component (a
null id has a null component); labels are equal if they are in their own type; only
vectors of equal length are compared; rows that repeat an id are a vector each, like or
unlike, with links of their own; further columns are not read.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.graph import connected_components
from quillspark.plans.staging import staged

#: Principal directions, rows they are fitted on, vectors an interval holds, and a leaf of the recursion.
DIRECTIONS, SAMPLE, INTERVAL, LEAF = 8, 4096, 2048, 512

_VALID = (
    "embedding is not null and size(embedding) > 0 and label is not null and vec_id is not null"
    " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
)


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def directions(nodes: DataFrame, dims: int, sample: int = SAMPLE) -> np.ndarray:
    """The leading principal directions of unit vectors, from the `sample` rows that sort first by a hash."""
    rows = nodes.where(F.col("dims") == dims).orderBy(F.xxhash64("node", F.lit(4)), "node").limit(sample).select("embedding").toPandas()
    x = _unit(np.array(rows["embedding"].tolist(), float))
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return axes[: min(DIRECTIONS, len(axes))].T.copy()


def _celled(batches, axes: dict, eps: float):
    for b in batches:
        dims = b.column("dims").to_numpy()
        cells: list = [None] * len(dims)
        flat, at = b.column("embedding").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            x = _unit(np.stack([flat[at[i] : at[i] + d] for i in own])) @ axes[int(d)]
            for i, c in zip(own, np.floor(x / eps).astype(np.int32), strict=True):
                cells[i] = c
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])


def _intervals(batches, axes: dict, size: int):
    """Runs of the sorted rows, cut at labels, lengths and `size` vectors, each as one row."""
    held: list = []
    key = None

    def packed() -> pa.RecordBatch:
        label, d = key
        x = _unit(np.array([h[1] for h in held], float)) @ axes[d]
        body = np.array([h[1] for h in held], "<f8").tobytes()
        return pa.RecordBatch.from_pylist([{
            "label": label, "dims": d, "first": int(held[0][0]), "n": len(held), "nodes": np.array([h[0] for h in held], "<i8").tobytes(), "copies": np.array([h[2] for h in held], "<i8").tobytes(),
            "body": body, "lo": x.min(0).tolist(), "hi": x.max(0).tolist(),
        }], schema=_INTERVAL)

    for b in batches:
        for node, label, d, x, copies in zip(*(b.column(c).to_pylist() for c in ("node", "label", "dims", "embedding", "copies")), strict=True):
            if held and (key != (label, d) or len(held) >= size):
                yield packed()
                held = []
            key = (label, d)
            held.append((node, x, copies))
    if held:
        yield packed()


_INTERVAL = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("nodes", pa.binary()), ("copies", pa.binary()), ("body", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
_INTERVAL_DDL = "label string, dims int, first long, n int, nodes binary, copies binary, body binary, lo array<double>, hi array<double>"


def _far(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
    return float(gap @ gap) > eps * eps


def _joined(px, py, ux, uy, x, y, same: bool, eps: float, cosine: float, out: list) -> None:
    """Links between rows x of one interval and y of another (or the same) go to out."""
    if _far(px[x], py[y], eps):
        return
    if max(len(x), len(y)) <= LEAF:
        near = ux[x] @ uy[y].T >= cosine
        if same:
            near &= x[:, None] < y[None, :]
        i, j = np.nonzero(near)
        if len(i):
            out.append((x[i], y[j]))
        return
    if len(x) >= len(y):
        parts = [(p, y) for p in np.array_split(x, 2)]
    else:
        parts = [(x, p) for p in np.array_split(y, 2)]
    for p, q in parts:
        if not same or p[0] < q[-1]:
            _joined(px, py, ux, uy, p, q, same, eps, cosine, out)


def _least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index reachable from each index over the links."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _met(table: pa.Table, axes: dict, cosine: float, eps: float) -> pa.Table:
    """One pair of intervals: every linked node, how many vectors it links with, and the least node of its links here."""
    row = table.slice(0, 1).to_pylist()[0]
    same, d = row["xfirst"] == row["yfirst"], row["dims"]
    nodes, copies, unit, place = {}, {}, {}, {}
    for s in ("x", "y"):
        nodes[s], copies[s] = (np.frombuffer(row[f"{s}{c}"], "<i8") for c in ("nodes", "copies"))
        unit[s] = _unit(np.frombuffer(row[f"{s}body"], "<f8").reshape(-1, d))
        place[s] = unit[s] @ axes[d]
    out: list = []
    _joined(place["x"], place["y"], unit["x"], unit["y"], np.arange(len(nodes["x"])), np.arange(len(nodes["y"])), same, eps, cosine, out)
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate([o[k] for o in out]) if out else none for k in (0, 1))
    shift = 0 if same else len(nodes["x"])
    every = nodes["x"] if same else np.concatenate([nodes["x"], nodes["y"]])
    weight = copies["x"] if same else np.concatenate([copies["x"], copies["y"]])
    order = np.argsort(every, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    links = np.zeros(len(every), np.int64)
    np.add.at(links, i, weight[j + shift])
    np.add.at(links, j + shift, weight[i])
    label = order[_least(rank[i], rank[j + shift], len(every))][rank]
    hit = np.flatnonzero(links)
    return pa.table({"node": every[hit], "links": links[hit], "least": every[label[hit]]})


def near_vectors(table: DataFrame, cosine: float = 0.93) -> DataFrame:
    """-> vec_id, n_links, component_id, kept: links join vectors of one label with at least that cosine."""
    spark = table.sparkSession
    rows = staged(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")))
    valid = rows.where(_VALID)
    # numbered, as an id may repeat with unlike vectors
    nodes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = staged(nodes.withColumn("dims", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))
    lone = rows.join(nodes.select("label", "embedding", "node", "least_id", "copies"), ["label", "embedding"], "left").select("vec_id", "node", "least_id", "copies")
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-12
    axes = {r[0]: directions(nodes, r[0]) for r in nodes.select("dims").distinct().collect()}

    n = nodes.count()
    celled = staged(nodes.select("label", "embedding", "node", "copies", "dims").mapInArrow(partial(_celled, axes=axes, eps=eps), "label string, embedding array<double>, node long, copies long, dims int, cells array<int>"))
    parts = max(1, math.ceil(n / (4 * INTERVAL)))
    order = ["label", "dims", "cells", "node"]
    runs = celled.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(partial(_intervals, axes=axes, size=INTERVAL), _INTERVAL_DDL)
    runs = staged(runs)

    # Boxes of intervals, without their vectors, meet by label and cell of the first direction.
    box = runs.select("label", "dims", "first", "lo", "hi")
    cell = lambda c: F.floor(F.element_at(c, 1) / eps)
    left = box.select(F.col("first").alias("xfirst"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"), "label", "dims", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    right = box.select(F.col("first").alias("yfirst"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"), "label", "dims", F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("cell"))
    gap = "aggregate(zip_with(zip_with(xlo, yhi, (a, b) -> a - b), zip_with(ylo, xhi, (a, b) -> a - b), (a, b) -> pow(greatest(0d, a, b), 2)), 0d, (s, v) -> s + v)"
    pairs = left.join(right, ["label", "dims", "cell"]).where("xfirst <= yfirst").where(f"{gap} <= {eps * eps!r}").select("label", "dims", "xfirst", "yfirst").distinct()
    side = lambda s: runs.select("label", "dims", *[F.col(c).alias(s + c) for c in ("first", "nodes", "copies", "body")])
    both = pairs.join(side("x"), ["label", "dims", "xfirst"]).join(side("y"), ["label", "dims", "yfirst"])
    met = both.groupBy("label", "dims", "xfirst", "yfirst").applyInArrow(lambda t: _met(t, axes, cosine, eps), "node long, links long, least long")
    met = staged(met)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    labels = staged(connected_components(met.select(F.col("node").alias("u"), F.col("least").alias("v"))).join(nodes.select("node", "least_id"), "node"))
    labels = labels.join(labels.groupBy("component").agg(F.min("least_id").alias("reached")), "component").select("node", "reached")

    out = lone.join(links, "node", "left").join(labels, "node", "left")
    near = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    return out.select(
        "vec_id", near.cast("long").alias("n_links"),
        F.expr("case when vec_id is not null then coalesce(reached, least_id, vec_id) end").alias("component_id"),
    ).withColumn("kept", F.expr("vec_id <=> component_id"))
