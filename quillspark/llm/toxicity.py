"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

Segments are words: letters only, lower case, so marks and digits put into an insult fall
away; a run of one-letter words is one segment, so spelt-out insults are whole.  The kernel
counts common subsequences of three characters within five places, each gap costing a
factor, and is normalised; the first character of a subsequence may be the start of the
word.

Training: sentences of clean documents are negative in every segment; a toxic document has
at least one toxic sentence, whose witness segments are those that many toxic and no clean
documents have, or else found in turns with the machine (by document counts, then by score).  Segments are mapped by Nyström to their kernel values
with landmarks, whitened, and a squared-hinge machine is fitted by Newton steps.

The machine is a weighted sum of kernels with landmarks, so it folds into one weight per
subsequence: reading a text is a few table look-ups per character in numpy, and only
segments that lean to toxic need their own norm.  A document's score is that of its most
toxic segment, through a logistic curve fitted on the training documents.

Defined results: a null, empty or letterless text has the score of a segment without any
landmark in it; repeated rows give repeated results; without labelled rows of both kinds
every score is 0.5 or the one label seen; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.buffers import SPACE, small_batches, texts, tidy

#: Labelled texts longer than this are not learned from (all are scored whole).
LONGEST = 200_000
#: Bounds: labelled documents the machine is trained on, landmarks, negative segments.
SAMPLE, LANDMARKS, NEGATIVES, ROUNDS = 3000, 160, 8_000, 3
GAP = 0.5
#: Share of toxic documents that a segment must occur in, and no clean one, to be taken as a witness from the start.
SURE = 0.03
A = 64
_PLACES = ((1, 2, 0), (1, 3, 1), (2, 3, 1), (1, 4, 2), (2, 4, 2), (3, 4, 2))

#: Byte classes: 0 ends a segment, 1-26 letters, 28-59 what follows the lead byte of other letters, 63 is left out.
_CLASS = np.full(256, 63, np.uint8)
_CLASS[SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:192] = 28 + (np.arange(64) & 31)
#: Pipes, commas and the like between words end a segment too.
_CLASS[[ord("|"), ord(","), ord(";")]] = 0


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, segment of each character, row of each segment); every segment begins with its start mark 0."""
    n = len(at) - 1
    # each row is preceded by a space, so no segment crosses rows
    room = np.full(len(data) + n, 32, np.uint8)
    row_of = np.repeat(np.arange(n), np.diff(at))
    room[np.arange(len(data)) + row_of + 1] = data
    heads = at[:-1] + np.arange(n)
    c = _CLASS[room]
    keep = c != 63
    keep &= ~((c == 0) & np.concatenate([c[1:] == 0, [True]])) if len(c) else keep
    place = np.flatnonzero(keep)
    c = c[place]
    if not len(c):
        return c, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # left-out characters may have stood between two ends
    c = c.copy()
    twice = np.zeros(len(c), bool)
    twice[:-1] = (c[:-1] == 0) & (c[1:] == 0)
    twice[-1] = c[-1] == 0
    c, place = c[~twice], place[~twice]
    starts = np.flatnonzero(c == 0)
    if not len(starts):
        return c[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(heads, place[starts], "right") - 1
    size = np.diff(np.concatenate([starts, [len(c)]])) - 1
    join = np.zeros(len(starts), bool)
    join[1:] = (size[1:] == 1) & (size[:-1] == 1) & (row[1:] == row[:-1])
    stay = np.ones(len(c), bool)
    stay[starts[join]] = False
    c = c[stay]
    seg = np.cumsum(c == 0) - 1
    return c, seg, row[~join]


def _codes(c: np.ndarray, seg: np.ndarray):
    """(position, code, weight) of every subsequence, one place pattern at a time."""
    wide = c.astype(np.int32)
    for i, j, gaps in _PLACES:
        if len(c) <= j:
            continue
        n = len(c) - j
        whole = seg[:n] == seg[j:]
        code = (wide[:n] * A + wide[i : i + n]) * A + wide[j:]
        yield whole, code, GAP**gaps


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, value): the subsequences of each word, summed."""
    raw = "\n".join(words).encode()
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    c = np.concatenate([[0], c]).astype(np.uint8)
    c = c[c != 63]
    seg = np.cumsum(c == 0) - 1
    keys, values = [], []
    for whole, code, weight in _codes(c, seg):
        own = np.flatnonzero(whole)
        keys.append(seg[own].astype(np.int64) * A**3 + code[own])
        values.append(np.full(len(own), weight))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key // A**3, key % A**3, np.bincount(place, np.concatenate(values))


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of words with landmarks."""
    w, code, v = features(words)
    lw, lcode, lv = features(landmarks)
    norm = np.sqrt(np.maximum(1e-9, np.bincount(w, v * v, len(words))))
    own = np.sqrt(np.maximum(1e-9, np.bincount(lw, lv * lv, len(landmarks))))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    table = np.zeros(A**3)  # one landmark at a time: a table of all would be large
    for j in range(len(landmarks)):
        mine = lw == j
        table[lcode[mine]] = lv[mine]
        out[:, j] = np.bincount(w, v * table[code], len(words)) / own[j]
        table[lcode[mine]] = 0
    return out / norm[:, None]


def _fit(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge, by Newton steps over the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (x @ w) < 1
        k = weight[inside] * 2 * cost
        h = ridge + (x[inside] * k[:, None]).T @ x[inside]
        new = np.linalg.solve(h, x[inside].T @ (k * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            w = new
            break
        w = new
    return w[:-1], float(w[-1])


def _spelt(c: np.ndarray, seg: np.ndarray) -> list[str]:
    """Segments as strings over a private alphabet that `features` reads back."""
    text = _LETTER[c].tobytes().decode("latin-1").split(" ")
    return text[1:]


_LETTER = np.full(64, ord("?"), np.uint8)
_LETTER[0] = 32
_LETTER[1:27] = np.arange(97, 123)
_LETTER[28:60] = np.arange(160, 192)


def _as_utf8(word: str) -> str:
    """A private letter 160-191 is the second byte of U+00E0-U+00FF: one letter whose class is the same."""
    return "".join(chr(ord(ch) + 64 if ord(ch) >= 160 else ord(ch)) if ord(ch) >= 128 else ch for ch in word)


def _disguised(words: list[str], rng) -> list[str]:
    """Each word of five letters or more once with a letter put in: what the kernel's gaps are to forgive."""
    out = []
    for w in words:
        if len(w) >= 5:
            i = int(rng.integers(1, len(w)))
            out.append(w[:i] + "xzqkv"[int(rng.integers(0, 5))] + w[i:])
    return out


class Machine:
    """Weights per subsequence, a bias and a logistic curve; the landmarks and their weights that were folded are kept to be looked at."""

    def __init__(self, beta: np.ndarray, bias: float, slope: float, shift: float, landmarks: tuple = (), alpha: tuple = ()):
        self.beta, self.bias, self.slope, self.shift = beta.astype(np.float32), bias, slope, shift
        self.landmarks, self.alpha = list(landmarks), np.asarray(alpha, float)

    def margins(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin of each row's most toxic segment, of no toxic segment: 0; that segment's number or -1)."""
        n = len(at) - 1
        best, which = np.zeros(n), np.full(n, -1)
        c, seg, row = segments(data, at)
        if len(seg) < 3:
            return best, which
        total = np.zeros(len(c), np.float32)
        for whole, code, weight in _codes(c, seg):
            total[: len(code)] += self.beta[code] * whole * np.float32(weight)
        first = np.flatnonzero(c == 0)
        sums = np.add.reduceat(total, first).astype(float)
        lean = np.flatnonzero(sums > 0)
        if not len(lean):
            return best, which
        ends = np.concatenate([first[1:], [len(c)]])
        keep = np.zeros(len(first), bool)
        keep[lean] = True
        own = keep[seg]
        cc, ss = c[own], np.repeat(np.arange(len(lean)), (ends - first)[lean])
        keys, values = [], []
        for whole, code, weight in _codes(cc, ss):
            i = np.flatnonzero(whole)
            keys.append(ss[i].astype(np.int64) * A**3 + code[i])
            values.append(np.full(len(i), weight))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, value = key[order], np.concatenate(values)[order]
        if not len(key):
            return best, which
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        square = np.add.reduceat(value, new) ** 2
        norm = np.sqrt(np.maximum(1e-9, np.bincount(key[new] // A**3, square, len(lean))))
        got = sums[lean] / norm
        np.maximum.at(best, row[lean], got)
        top = got == best[row[lean]]
        which[row[lean][top]] = lean[top]
        return best, which

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins + self.bias) + self.shift, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve with softened targets, by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 0.05 * a, (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def train(rows: list[tuple[str, int]]) -> Machine:
    """A machine from (text, toxic) rows."""
    kinds = {y for _, y in rows}
    if len(kinds) < 2:
        p = float(next(iter(kinds), 0.5))
        return Machine(np.zeros(A**3), 0.0, 1e-3, np.log((p + 1e-4) / (1 - p + 1e-4)))
    rng = np.random.default_rng(1)
    # every fourth row is kept back for the logistic curve
    back = [r for i, r in enumerate(rows) if i % 4 == 3]
    if {y for _, y in back} == kinds:
        rows = [r for i, r in enumerate(rows) if i % 4 != 3]
    else:
        back = rows
    labels = np.array([y for _, y in rows])
    chunks, bags = [], []
    for lo, hi, data, at in texts(pa.array([t or "" for t, _ in rows]), 1 << 18):
        c, seg, row = segments(data, at)
        names = np.array(_spelt(c, seg), object) if len(c) else np.zeros(0, object)
        chunks.append((lo, hi, data, at, names))
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        bags += [({w for w in names[x:y] if len(w) > 1}, labels[lo + i]) for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False))]
    # copies of one document count once
    toxic, clean = ([set(b) for b in dict.fromkeys(frozenset(b) for b, y in bags if y == kind)] for kind in (1, 0))
    in_toxic, in_clean = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    odds = {w: np.log((n + 0.1) / (len(toxic) + 1)) - np.log((in_clean[w] + 0.1) / (len(clean) + 1)) for w, n in in_toxic.items()}
    worth = lambda w: odds[w] * min(in_toxic[w], 30)
    # segments in many toxic and no clean documents are witnesses wherever they stand; other toxic documents get their likeliest
    sure = {w: n for w, n in in_toxic.items() if n >= max(5, SURE * len(toxic)) and not in_clean[w]}
    witness = [max(b, key=lambda w: (worth(w), w)) for b in toxic if b and sure.keys().isdisjoint(b)]
    # every order is by count and then by word, so that training does not depend on how a process hashes strings
    common = sorted(in_clean, key=lambda w: (-in_clean[w], w))[: NEGATIVES // 4]
    rest = sorted(in_clean)
    negative = list(dict.fromkeys(common + [rest[i] for i in rng.permutation(len(rest))[: NEGATIVES - len(common)]]))
    machine = None
    for turn in range(ROUNDS):
        positive = Counter(sure) + Counter(witness)
        if not positive:
            positive = Counter(w for b in toxic for w in b) or Counter(["?"])
        positive.update(_disguised(sorted(positive), rng))
        own = sorted(positive, key=lambda w: (-positive[w], w))
        half = LANDMARKS // 4
        picked = own[:half] + [own[half:][i] for i in rng.permutation(max(0, len(own) - half))[:half]]
        landmarks = picked + [negative[i] for i in rng.permutation(len(negative))[: LANDMARKS - len(picked)]]
        gram = _kernel([_as_utf8(w) for w in landmarks], [_as_utf8(w) for w in landmarks])
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        good = value > 1e-6
        whiten = vector[:, good] / np.sqrt(value[good])
        words = own + negative
        z = _kernel([_as_utf8(w) for w in words], [_as_utf8(w) for w in landmarks]) @ whiten
        y = np.r_[np.ones(len(own)), -np.ones(len(negative))]
        weight = np.r_[np.sqrt([positive[w] for w in own]), np.ones(len(negative))]
        w, bias = _fit(z, y, weight)
        alpha = whiten @ w
        lw, lcode, lv = features([_as_utf8(x) for x in landmarks])
        norm = np.sqrt(np.bincount(lw, lv * lv, len(landmarks)))
        beta = np.bincount(lcode, lv * (alpha / np.maximum(norm, 1e-9))[lw], A**3)
        machine = Machine(beta, bias, 1.0, 0.0, landmarks, alpha)
        found, hard = [], []
        for lo, hi, data, at, names in chunks:
            best, which = machine.margins(data, at)
            for (bag, label), m, i in zip(bags[lo:hi], best + bias, which, strict=True):
                word = names[i] if i >= 0 else ""
                if label and word and not in_clean[word] and m > -0.5 and sure.keys().isdisjoint(bag):
                    found.append(word)
                elif not label and word and m > -0.8:
                    hard.append(word)
        if turn < ROUNDS - 1:
            witness = found
            negative = list(dict.fromkeys(hard + negative))
    margin = [machine.margins(data, at)[0] for _, _, data, at in texts(pa.array([t or "" for t, _ in back]), 1 << 18)]
    slope, shift = _logistic(np.concatenate(margin) + machine.bias, np.array([y for _, y in back], float))
    return Machine(machine.beta, machine.bias, slope, shift, machine.landmarks, machine.alpha)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> list[tuple[str, int]]:
    """At most `sample` (text, label) rows of texts up to LONGEST: the first by a hash among ids whose crc32 is not 2 modulo 4.

    Where an id repeats, its greatest label and its least text count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    got = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).toArrow().sort_by("doc_id")
    return list(zip(got["text"].to_pylist(), got["y"].to_pylist(), strict=True))


@tidy
def _scored(batches, machine: Machine, threshold: float):
    for b in batches:
        for lo, hi, data, at in texts(b.column("text"), 1 << 18):
            score = machine.scores(machine.margins(data, at)[0])
            ids = b.column("doc_id").slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """-> doc_id, held_out, score, predicted for every whole text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = small_batches(src).mapInArrow(partial(_scored, machine=machine, threshold=threshold), "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    return score(docs, train(labelled_sample(docs, labels, "toxic", sample)), threshold)
