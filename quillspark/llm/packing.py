"""Packing token streams into windows by order-preserving dynamic programming.

Documents follow each other as they are read, each with an end id behind.  A cut may fall
behind a document, behind a sentence (closing punctuation, or the last word of a line), and
inside sentences of more than ``COARSE`` tokens every ``FINE`` tokens.  A window [i, j)
costs its padding, which is window - (j - i), or nothing where j - i is a power of two, and
what its cut at j costs: nothing behind a document, ``sentence`` behind a sentence,
``inside`` elsewhere, ``every`` for the sequence itself.  The least total is

    best[j] = cut[j] + min( min over i of best[i] + i + window - j,  min over k of best[j - 2^k] )

The inner minimum slides over the last ``window`` tokens, so a monotone queue holds it and a
cut takes constant time.  The stream is solved ``RUN`` tokens at a time; all sequences but
the last one are written and the rest leads the next run, so only a task's very last
sequence ends for want of documents.

A task packs the documents of its part of the scan, which is the same whenever the task is
run again; sequence_id is the task's number and a count.

Defined results: a null or empty text is its end id alone; rows that repeat an id, or have
none, are documents each; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import tokenizer
from quillspark.llm.buffers import SPACE, small_batches, texts, tidy

#: Tokens that are solved together.
RUN = 1 << 18
#: A sentence of more tokens than COARSE can also be cut every FINE tokens.
COARSE, FINE = 128, 64
#: What cuts cost, in tokens of padding: behind a sentence, elsewhere in a document, and every sequence.
SENTENCE, INSIDE, EVERY = 8, 64, 8
#: Bytes of text that are encoded together; a longer text comes alone.
TOGETHER = 1 << 20

#: Fixed: closing punctuation, marks that may stand behind it, and closing punctuation of three bytes.
_CLOSING, _BEHIND = np.zeros(256, bool), np.zeros(256, bool)
_CLOSING[list(b".!?")] = True
_BEHIND[list(b"\"')]")] = True
_WIDE = [int.from_bytes(c.encode(), "big") for c in "。！？…"]


def cheapest(pos: list[int], cost: list[int], window: int) -> list[int]:
    """pos[0] = 0 and ascending places where a cut is allowed, no two further apart than window, cost of each -> the places cut, 0 and the last included."""
    end, none = pos[-1], float("inf")
    best, back = [none] * (end + 1), [0] * (end + 1)
    best[0] = 0
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    # places in the queue ascend and so do their best[i] + i; those before head are out of reach
    queue, level, head = [0], [0], 0
    for p, own in zip(pos[1:], cost[1:], strict=True):
        while queue[head] < p - window:
            head += 1
        at, least = queue[head], level[head] + window - p
        for w in powers:
            if w > p:
                break
            if best[p - w] < least:
                at, least = p - w, best[p - w]
        best[p], back[p] = least + own, at
        now = least + own + p
        while len(level) > head and level[-1] >= now:
            level.pop()
            queue.pop()
        level.append(now)
        queue.append(p)
    out = [end]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def sentence_ends(data: np.ndarray, at: np.ndarray, row: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which pieces, ending at these bytes of their texts, close a sentence or a line."""
    last = end == at[row + 1]
    following = data[np.minimum(end, len(data) - 1)]
    byte = lambda n: np.where(end - n >= at[row], data[np.maximum(end - n, 0)], 0)
    one, two, three = byte(1), byte(2), byte(3)
    closing = _CLOSING[one] | (_BEHIND[one] & _CLOSING[two])
    wide = np.isin((three.astype(np.int64) << 16) | (two.astype(np.int64) << 8) | one, _WIDE)
    return ((last | SPACE[following]) & closing) | wide | (~last & (following == 10))


class Stream:
    """The tokens of some documents that are not packed yet, and where they may be cut."""

    def __init__(self, window: int, costs: tuple[int, int, int]):
        self.window, (self.sentence, self.inside, self.every) = window, costs
        self.ids = np.zeros(0, np.uint32)
        self.pos, self.cost = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.doc: list = []
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, docs: list, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> None:
        """Documents of these sizes, end ids included; ends: places in ids behind sentences."""
        base, close = len(self.ids), np.cumsum(sizes)
        # the end id stays with the last sentence
        ends = ends[~np.isin(ends, close - 1)]
        pos = np.concatenate([ends, close])
        cost = np.repeat([self.sentence, 0], [len(ends), len(close)])
        pos, first = np.unique(pos[::-1], return_index=True)
        cost = cost[::-1][first]
        gap = np.diff(pos, prepend=0)
        wide = np.flatnonzero(gap > COARSE)
        n = (gap[wide] - 1) // FINE
        more = np.repeat(pos[wide] - gap[wide], n) + FINE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        pos, cost = np.append(pos, more), np.append(cost, np.full(len(more), self.inside))
        order = np.argsort(pos, kind="stable")
        self.pos, self.cost = np.append(self.pos, base + pos[order]), np.append(self.cost, cost[order])
        self.ids = np.append(self.ids, ids.astype(np.uint32))
        self.doc += docs
        self.start, self.size = np.append(self.start, base + close - sizes), np.append(self.size, sizes)

    def solved(self, whole: bool) -> tuple[list[np.ndarray], int] | None:
        """The columns of the pieces of a run and how many sequences they fill; None while there is too little to go on."""
        if not len(self.ids) or not whole and len(self.ids) < RUN:
            return None
        n = max(1, int(np.searchsorted(self.pos, RUN, "right")))
        cuts = np.array(cheapest([0, *self.pos[:n].tolist()], [0, *(self.cost[:n] + self.every).tolist()], self.window))
        done = whole and n == len(self.pos)
        if not done and len(cuts) > 2:
            cuts = cuts[:-1]
        closes = self.start + self.size
        border = np.union1d(cuts, closes[closes <= cuts[-1]])
        here, size = border[:-1], np.diff(border)
        of, seq = np.searchsorted(self.start, here, "right") - 1, np.searchsorted(cuts, here, "right") - 1
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(here), [None, pa.py_buffer(4 * border), pa.py_buffer(np.ascontiguousarray(self.ids[: cuts[-1]], "<u4"))])
        columns = [pa.array([self.doc[i] for i in of], pa.int64()), pa.array(here - self.start[of]), pa.array(size), pa.array(self.size[of]), seq, pa.array(here - cuts[seq]), packed]
        # the rest leads on
        end = cuts[-1]
        open_docs, later = int(np.searchsorted(closes, end, "right")), int(np.searchsorted(self.pos, end, "right"))
        self.ids, self.pos, self.cost = self.ids[end:], self.pos[later:] - end, self.cost[later:]
        self.doc, self.start, self.size = self.doc[open_docs:], self.start[open_docs:] - end, self.size[open_docs:]
        return columns, len(cuts) - 1


_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


@tidy
def _packed(batches, path: str, window: int, end_id: int, costs: tuple):
    t, stream, count = tokenizer(path), Stream(window, costs), TaskContext.get().partitionId() << 40
    try:
        for b in batches:
            for lo, hi, data, at in texts(b.column("text"), TOGETHER):
                got = t.tokens(data, at)
                sizes = np.bincount(got.row, weights=got.sizes, minlength=hi - lo).astype(np.int64) + 1
                ids, close = np.full(sizes.sum(), end_id, np.int64), np.cumsum(sizes) - 1
                ids[np.arange(len(got.ids)) + np.repeat(got.row, got.sizes)] = got.ids
                ends = np.cumsum(got.sizes) + got.row
                stream.add(b.column("doc_id").slice(lo, hi - lo).to_pylist(), ids, sizes, ends[sentence_ends(data, at, got.row, got.end) & (got.sizes > 0)] if len(data) else close[:0])
                while (solved := stream.solved(False)) is not None:
                    yield _batch(solved, count)
                    count += solved[1]
        while (solved := stream.solved(True)) is not None:
            yield _batch(solved, count)
            count += solved[1]
    finally:
        t.forget()


def _batch(solved: tuple, count: int) -> pa.RecordBatch:
    columns = solved[0]
    columns[4] = pa.array(columns[4] + count)
    return pa.RecordBatch.from_arrays([*columns[:6], columns[6].cast(pa.binary())], names=_NAMES)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, costs: tuple[int, int, int] = (SENTENCE, INSIDE, EVERY), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, start, length, doc_tokens, sequence_id, offset, ids: every piece with its place in document and sequence, and its ids as little-endian 32-bit numbers."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return small_batches(src).mapInArrow(partial(_packed, path=path, window=window, end_id=end_id, costs=costs), schema)
