"""Interaction of filters: what each filter removes, in every order in which they could run.

Reading: one pass of a table-driven transducer over the bytes of whole texts.  Its state is
the kind of the last byte (the end of a text, white space, or the inside of a word), its table
gives for every state and byte the events to emit: a word begins, a word ends, a code point,
a capital, a symbol.  As the state depends on the last byte alone, all steps of a block are
looked up at once.  Word spans go into a hash table of open addressing whose entries are
spans of the text: an entry with the same hash is compared byte by byte before a word counts
as seen, and one that differs lets the word step on.  A text of more than a block is read
in blocks that end between words, with one table for all of them.

Counting: documents become (part, failing filters, digest, labels); copies are counted before
any shuffle by digest, so a text of many copies is a few rows.  What an order removes follows
from how many documents fail each set of filters.

Defined results: a null text is empty and a copy of the empty ones; a null id is smaller than
no id and no id is smaller than it; rows that repeat an id are documents each, and none of
them makes another one a copy; a null source is the empty part; labels of an id that occur
more than once count if one of them does; further columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.buffers import SPACE, small_batches, span_hash, texts, tidy

#: Bytes of texts that are read together; a longer text comes alone, in blocks of this size.
BLOCK = 1 << 20
FILTERS = "ABCDE"

#: Events of the transducer, and its states: outside and inside a word.
BEGINS, ENDS, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
OUTSIDE, INSIDE = 0, 1
#: Fixed: the symbols that no text may hold.
SYMBOLS = b"#$%&*|"


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """next[byte] and out[state << 8 | byte]."""
    after = np.where(SPACE, OUTSIDE, INSIDE).astype(np.uint8)
    out = np.zeros((2, 256), np.uint8)
    out[OUTSIDE, after == INSIDE] |= BEGINS
    out[INSIDE, after == OUTSIDE] |= ENDS
    # every byte but a continuation opens a code point
    out[:, [b for b in range(256) if b & 0xC0 != 0x80]] |= POINT
    out[:, 65:91] |= CAPITAL
    out[:, list(SYMBOLS)] |= SYMBOL
    return after, out.ravel()


AFTER, OUT = _transducer()


def events(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the transducer emits at every byte, begun anew outside a word at every border."""
    state = np.zeros(len(data), np.uint16)
    state[1:] = AFTER[data[:-1]]
    state[at[:-1][at[:-1] < len(data)]] = OUTSIDE
    return OUT[(state << np.uint16(8)) | data]


class Seen:
    """Distinct words, as spans of one array of bytes, in a table of open addressing."""

    def __init__(self, data: np.ndarray, size: int = 1 << 12):
        self.data = data
        self.start, self.end, self.hash = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
        self.slots = np.full(size, -1, np.int64)

    def _grown(self, more: int) -> None:
        size = len(self.slots)
        if 2 * (len(self.start) + more) <= size:
            return
        self.slots = np.full(1 << (4 * (len(self.start) + more)).bit_length(), -1, np.int64)
        todo = np.arange(len(self.start))
        place = (self.hash & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(todo):
            free = self.slots[place] < 0
            self.slots[place[free]] = todo[free]
            lost = self.slots[place] != todo
            todo, place = todo[lost], (place[lost] + 1) & (len(self.slots) - 1)

    def _equal(self, start: np.ndarray, end: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Are these spans the entries', byte by byte?"""
        size = end - start
        same = size == self.end[entry] - self.start[entry]
        at = np.flatnonzero(same)
        n = size[at]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = self.data[np.repeat(start[at], n) + step] != self.data[np.repeat(self.start[entry[at]], n) + step]
        same[at[np.repeat(np.arange(len(at)), n)[differ]]] = False
        return same

    def add(self, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Which of these spans are new words; of equal ones among them, one is."""
        self._grown(len(start))
        new = np.zeros(len(start), bool)
        first = len(self.start)
        # as many entries as spans for now; those that turn out to be known are let go of at the end
        self.start, self.end, self.hash = np.append(self.start, start), np.append(self.end, end), np.append(self.hash, hashed)
        todo = np.arange(len(start))
        place = (hashed & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(todo):
            free = self.slots[place] < 0
            self.slots[place[free]] = first + todo[free]
            entry = self.slots[place]
            own = entry == first + todo
            new[todo[own]] = True
            known = ~own & (self.hash[entry] == hashed[todo])
            at = np.flatnonzero(known)
            known[at] = self._equal(start[todo[at]], end[todo[at]], entry[at])
            on = ~(own | known)
            todo, place = todo[on], (place[on] + 1) & (len(self.slots) - 1)
        number = np.cumsum(new) - 1 + first
        fresh = np.flatnonzero(self.slots >= first)
        self.slots[fresh] = number[self.slots[fresh] - first]
        keep = np.append(np.arange(first), first + np.flatnonzero(new))
        self.start, self.end, self.hash = self.start[keep], self.end[keep], self.hash[keep]
        return new


def measured(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: words, distinct words, code points, capitals, symbols.  Texts are short, or there is one of any length."""
    out = np.zeros((len(at) - 1, 5), np.int64)
    if len(at) > 2 or at[-1] <= BLOCK:
        _measure(data, at, out, 0, Seen(data))
        return out
    seen, lo = Seen(data), 0
    while lo < len(data):
        hi = min(lo + BLOCK, len(data))
        while hi < len(data) and not SPACE[data[lo:hi]].any():  # one word of more than a block
            hi = min(hi + BLOCK, len(data))
        if hi < len(data):
            hi = lo + int(np.flatnonzero(SPACE[data[lo:hi]])[-1]) + 1
        _measure(data[lo:hi], np.array([0, hi - lo]), out, lo, seen)
        lo = hi
    return out


def _measure(data: np.ndarray, at: np.ndarray, out: np.ndarray, base: int, seen: Seen) -> None:
    """Adds the counts of these bytes, which stand at `base` of what `seen` holds spans of."""
    emitted = events(data, at)
    # a text that ends inside a word ends it
    start, close = np.flatnonzero(emitted & BEGINS), np.flatnonzero(emitted & ENDS)
    last = at[1:][at[1:] > at[:-1]]
    end = np.sort(np.append(close, last[AFTER[data[last - 1]] == INSIDE])) if len(data) else close
    row = np.searchsorted(at, start, "right") - 1
    # one table for all texts: the text's number is part of the hash, and words of two texts are told apart by it alone
    hashed = span_hash(data, start, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    new = seen.add(start + base, end + base, hashed)
    total = np.zeros(len(data) + 1, np.int64)
    out[:, 0] += np.bincount(row, minlength=len(out))
    out[:, 1] += np.bincount(row[new], minlength=len(out))
    for i, kind in enumerate((POINT, CAPITAL, SYMBOL)):
        np.cumsum((emitted & kind) > 0, out=total[1:])
        out[:, 2 + i] += total[at[1:]] - total[at[:-1]]


@tidy
def _read(batches):
    for b in batches:
        for lo, hi, data, at in texts(b.column("text"), BLOCK):
            words, distinct, points, capitals, symbols = measured(data, at).T
            fails = (words < 50) | (100 * distinct < 65 * words) << 1 | (100 * capitals > 5 * points) << 2 | (symbols > 0) << 3
            digest = [hashlib.sha256(data[at[i] : at[i + 1]]).digest() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("part").slice(lo, hi - lo), pa.array(fails.astype(np.int32)), pa.array(digest, pa.binary())], names=["doc_id", "part", "fails", "digest"])


def failing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """-> doc_id, part, fails, digest: per document the filters A to D it fails, as bits, and the SHA-256 of its whole text."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return small_batches(src).mapInArrow(_read, "doc_id long, part string, fails int, digest binary")


def sets(read: DataFrame, labels: DataFrame) -> DataFrame:
    """-> part, fails, n, good, toxic: how many documents fail just these filters, E among them; of good and of toxic ones."""
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = read.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    same = ["digest", "fails", "part", "good", "toxic"]
    ids = rows.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    has_id = F.col("doc_id").isNotNull()
    kinds = ids.groupBy(*same).agg(
        F.sum(F.when(has_id, F.col("n"))).alias("with_id"), F.sum(F.when(~has_id, F.col("n"))).alias("without"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first")
    )
    # a row for each part and pair of labels that share a text; the document of the least id is no copy, however often it is repeated
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    kinds = kinds.withColumn("copies", zero(F.col("with_id") - F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)))
    both = F.array(F.struct("fails", (zero(F.col("with_id")) + zero(F.col("without")) - F.col("copies")).alias("n")), F.struct((F.col("fails") + 16).alias("fails"), F.col("copies").alias("n")))
    each = kinds.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return each.groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders(found: DataFrame) -> DataFrame:
    """-> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, for all orders of the five filters."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord("A"))
    ways = found.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])))
    steps = ways.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = F.aggregate(F.filter(F.split("filter_order", ""), lambda c, i: i < F.col("step") - 1), F.lit(0), lambda s, c: s + bit(c))
    own = bit(F.substr("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("late", F.col("fails").bitwiseAND(before) > 0).withColumn("fail", F.col("fails").bitwiseAND(own) > 0).withColumn("alone", F.col("fails") == own)
    total = lambda when, c="n": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    gone = F.expr("fail and not late")
    every = len(list(permutations(FILTERS)))
    return steps.groupBy("part", "filter_order", "step").agg(
        total(F.expr("not fail and not late")).alias("kept"), total(gone).alias("removed"), total(F.expr("fail and late")).alias("redundant"), total(F.col("alone")).alias("unique_fails"),
        total(gone, "good").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"),
        # of the orders of all filters, each of the k filters that a document fails comes first in one of k
        F.coalesce(F.sum(F.when(F.col("fail"), F.expr(f"n * {every} div bit_count(fails)"))), F.lit(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of filters A to E over all documents, by part."""
    return orders(sets(failing(docs), labels))
