"""BPE encoding and decoding with a tokenization automaton.

Compiling reads the merges in order.  Merge number r of (a, b) is one gadget on the
automaton over tokens: the state behind arc a loses its arc b, and a new arc ab goes
where b went, so the state behind ab is the state behind b as it stands at r.  A state
is thus kept as (the token that led there, the number of gadgets applied), and an arc is
looked up by walking to the parts that a token had when it was added.  A word has exactly
one path whose arc labels spell it: the BPE segmentation.

Encoding runs a deterministic automaton over characters.  Its states are the sets of arcs
of the token automaton that may be under way, each with the token it started behind; by
the one path of every prefix, entering a state also tells the last token of the word so
far.  States are numbered and their transitions kept in a table per state, filled when
first taken.  A word is one table step a character, without going back; its ids are read
off the last tokens from the end.  Decoding joins the arc labels.

Texts are taken some MB at a time as one array of bytes; every distinct chunk between white
space goes through the automaton once, and ids and labels are then gathered chunk by chunk.

Defined results: a null text counts as empty and gives no ids and an empty string; marks
of the start and end of text in a text are their own ids, as in the tokenizers library;
further columns are not read, repeated rows give repeated results.
"""

from __future__ import annotations

import gc
import json
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.buffers import LOWER, SPACE, row_sums, small_batches, texts, tidy, words

#: Chunks that need the library's splitter a worker remembers within a task; then it starts anew.
REMEMBERED = 40_000
#: Arc lookups, transitions of long pieces and automaton states a worker remembers (some 0.4 kB a state); then each starts anew.
ARCS, MOVES, STATES = 200_000, 50_000, 150_000
#: Bytes of text whose pieces are told apart together; a longer text comes alone.
TOGETHER = 1 << 20
#: Pieces that go through the automaton side by side, and the symbols above which a piece goes alone.
SIDE_BY_SIDE, ALONE = 1 << 14, 64
#: A transition's key: state, end mark, symbol.
_END, _KEY_BITS = 1 << 9, 10
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Fixed: the byte-level alphabet.  Printable Latin-1 stands for itself, the other bytes follow from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
LETTER = np.zeros(256, np.int64)
LETTER[_PLAIN] = _PLAIN
LETTER[[b for b in range(256) if b not in set(_PLAIN)]] = 256 + np.arange(256 - len(_PLAIN))
_BYTE = {chr(c): b for b, c in enumerate(LETTER)}

#: Kinds of bytes in plain chunks, as the splitter tells them apart: letters, digits, the rest.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = 1
_KIND[48:58] = 2
#: Bytes of plain chunks: printable ASCII but for what begins a contraction or a mark of the file, and the lead of U+00C0 to U+00FF.
_SIMPLE = np.zeros(256, bool)
_SIMPLE[33:127] = True
_SIMPLE[[0x27, 0x3C]] = False
_SIMPLE[0xC3] = True


class Automaton:
    """The automaton of a list of merges over a vocabulary, with an optional end-of-word mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.ids, self.suffix = vocab, suffix
        self.size = max(vocab.values(), default=-1) + 1
        self.label = [""] * self.size
        for text, i in vocab.items():
            self.label[i] = text
        self.born = [-1] * self.size
        self.parts: list[tuple[int, int]] = [(-1, -1)] * self.size
        self.gadget: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        dead = set()
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            # no path has b behind a any more, so this gadget finds no arcs and adds none
            if x in dead or y in dead or not self._walk(x, y):
                if self.born[z] < 0 and z not in dead:
                    dead.add(z)
                continue
            dead.discard(z)
            self.gadget[x * self.size + y] = r
            if self.born[z] < 0:
                self.born[z], self.parts[z] = r, (x, y)
        self.arcs.clear()
        self.start = {t: i for t, i in vocab.items() if i not in dead}
        # the spellings of all arcs, character by character; the last character of a word carries the end mark
        self.next: list[dict[str, int]] = [{}]
        self.token, self.length = [-1], [0] * self.size
        for text, i in self.start.items():
            ends = bool(suffix) and text.endswith(suffix)
            own = list(text.removesuffix(suffix) if ends else text)
            if ends and own:
                own[-1] += suffix
            at = 0
            for c in own:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                at = to
            self.length[i] = len(own)
            if at:
                self.token[at] = i
        self.next = [x or None for x in self.next]
        self._begin()

    def _begin(self) -> None:
        """Only the start state: no arc under way, no token behind."""
        self.under_way: list[tuple] = [(0,)]
        self.last = np.full(1 << 10, -1, np.int32)
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, int] = {}
        self.keys, self.values, self.held = np.full(1 << 12, -1, np.int64), np.zeros(1 << 12, np.int32), 0

    def _walk(self, p: int, t: int) -> bool:
        """Is there an arc t in the state behind p?"""
        bound, born = 1 << 60, self.born
        while True:
            r = self.gadget.get(p * self.size + t)
            if r is not None and r < bound:
                return False
            if born[p] < 0 and born[t] < 0:
                return True
            if born[p] > born[t]:
                # the state behind p is that behind its last part, just before p's own gadget
                bound, p = born[p], self.parts[p][1]
            else:
                # arc t stands where its first part's arc stood, that gadget's own cut included
                bound, t = born[t] + 1, self.parts[t][0]

    def arc(self, p: int, t: int) -> bool:
        key = p * self.size + t
        got = self.arcs.get(key)
        if got is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            got = self.arcs[key] = self._walk(p, t)
        return got

    def _over(self, state: int, c: str) -> tuple[list[int], int]:
        """The arcs still under way after c, as (place in its spelling, token behind) in one number, and the one arc that ends with c."""
        going, done, size = [], -1, self.size + 1
        for arc in self.under_way[state]:
            node, behind = divmod(arc, size)
            to = (self.next[node] or {}).get(c)
            if to is None:
                continue
            if self.next[to]:
                going.append(to * size + behind)
            t = self.token[to]
            if t >= 0 and done < 0 and (not behind or self.arc(behind - 1, t)):
                done = t
        if done < 0:
            raise ValueError("the vocabulary lacks a symbol of this word")
        return going, done

    def _target(self, key: int) -> int:
        """Where a transition that is not in the table yet leads: a state; for a symbol with the end mark, the last token."""
        state, c = key >> _KEY_BITS, chr(key & (_END - 1))
        if key & _END:
            return self._over(state, c + self.suffix)[1]
        going, done = self._over(state, c)
        of = (*going, done + 1)  # the last: a new arc behind the token that has just ended
        to = self.number.get(of)
        if to is None:
            to = self.number[of] = len(self.under_way)
            self.under_way.append(of)
            if to == len(self.last):
                self.last = np.concatenate([self.last, np.full(to, -1, np.int32)])
            self.last[to] = done
        return to

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys into the transition table: open addressing, a step on where a slot is taken."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            size = 1 << (4 * len(keys)).bit_length()
            self.keys, self.values, self.held = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0
        self.held += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], (slot[~own] + 1) & (len(self.keys) - 1)

    def _go(self, keys: np.ndarray) -> np.ndarray:
        """One table step for every key."""
        out = np.empty(len(keys), np.int32)
        todo, slot, missing = np.arange(len(keys)), self._slots(keys), []
        while len(todo):
            found = self.keys[slot]
            hit, none = found == keys[todo], found < 0
            out[todo[hit]] = self.values[slot[hit]]
            missing.append(todo[none])
            on = ~(hit | none)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        lacking = np.concatenate(missing) if missing else todo
        if len(lacking):
            new, place = np.unique(keys[lacking], return_inverse=True)
            values = np.array([self._target(k) for k in new.tolist()], np.int32)
            self._put(new, values)
            out[lacking] = values[place]
        return out

    def encode(self, word: str) -> list[int]:
        """The ids along the one path that spells word and its end mark."""
        if not word:
            return []
        if len(self.under_way) > STATES:
            self._begin()
        if len(self.moves) > MOVES:
            self.moves.clear()
        state, seen, moves = 0, [], self.moves
        for c in word[:-1]:
            seen.append(state)
            key = state << _KEY_BITS | ord(c)
            to = moves.get(key)
            if to is None:
                to = moves[key] = self._target(key)
            state = to
        seen.append(state)
        t = self._target(state << _KEY_BITS | _END | ord(word[-1]))
        at, length, out = len(seen) - self.length[t], self.length, [t]
        while at:
            t = int(self.last[seen[at]])
            out.append(t)
            at -= length[t]
        out.reverse()
        return out

    def encode_all(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many a word) of many words, all a symbol further at each step.  symbols, at: code points of all words and their borders; no word is empty."""
        if len(self.under_way) > STATES:
            self._begin()
        size, length = np.diff(at), np.array(self.length)
        order = np.argsort(-size, kind="stable")
        begin, left = at[:-1][order], -size[order]
        before, state = np.zeros(at[-1], np.int64), np.zeros(len(size), np.int64)
        for j in range(int(size.max(initial=1)) - 1):
            live = int(np.searchsorted(left, -(j + 1)))
            here = begin[:live] + j
            state = self._go((state[:live] << _KEY_BITS) | symbols[here]).astype(np.int64)
            before[here + 1] = state
        ends = at[1:] - 1
        token = self._go((before[ends] << _KEY_BITS) | _END | symbols[ends])
        word, place, rounds = np.arange(len(size)), size - length[token], [(np.arange(len(size)), token)]
        while (on := place > 0).any():
            word, place = word[on], place[on]
            token = self.last[before[at[word] + place]]
            place = place - length[token]
            rounds.append((word, token))
        count = np.zeros(len(size), np.int64)
        for word, _ in rounds:
            count[word] += 1
        behind, ids = np.cumsum(count) - 1, np.empty(count.sum(), np.int32)
        for i, (word, token) in enumerate(rounds):
            ids[behind[word] - i] = token
        return ids, count


class Tokenized(NamedTuple):
    """Token ids of some texts: ids one after the other, how many a piece has, and each piece's text row and end in the bytes."""

    ids: np.ndarray
    sizes: np.ndarray
    row: np.ndarray
    end: np.ndarray


class Tokenizer:
    """The automaton behind the normaliser and the splitter of the tokenizer's file.

    Chunks between the six ASCII white-space bytes are encoded by themselves: no mark of the file holds white space, and
    neither composition nor the splitter reaches across it.  Plain chunks are lower-cased and cut where the kind of byte changes;
    all others go through the library's own normaliser and splitter, whose Unicode tables are not those of Python.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # without the vocabulary, which is not needed for that
        library = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        label = dict(enumerate(self.automaton.label)) | {i: x for x, i in self.special.items()}
        self.labels = pa.array([label[i] for i in range(len(label))], pa.string())
        self.known: dict[bytes, list] = {}

    def forget(self) -> None:
        """Drop what was remembered of texts; the compiled merges and the automaton's states stay."""
        self.known.clear()
        self.automaton.moves.clear()

    def _parts(self, raw: bytes) -> list:
        """Pieces of a chunk that is not plain, as bytes; marks of the file as their ids."""
        got = self.known.get(raw)
        if got is None:
            text, got = raw.decode(), []
            for part in filter(None, self.cut.split(text) if self.cut else [text]):
                got += [self.special[part]] if part in self.special else [bytes(map(_BYTE.__getitem__, w)) for w, _ in self.split(self.normal(part))]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(raw) < 64:
                self.known[raw] = got
        return got

    def _encoded(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many a piece) of distinct pieces, given by their bytes and sizes."""
        ids, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], np.append(0, np.cumsum(size))
        for lo in range(0, len(size), SIDE_BY_SIDE):
            own, hi = size[lo : lo + SIDE_BY_SIDE], min(lo + SIDE_BY_SIDE, len(size))
            part, short = LETTER[data[at[lo] : at[hi]]], own <= ALONE
            if short.all():
                got, n = self.automaton.encode_all(part, at[lo : hi + 1] - at[lo])
            else:
                alone = [self.automaton.encode("".join(map(chr, part[at[lo + i] - at[lo] : at[lo + i + 1] - at[lo]]))) for i in np.flatnonzero(~short)]
                got, n = self.automaton.encode_all(gathered(part, own, np.flatnonzero(short)), np.append(0, np.cumsum(own[short])))
                place = np.concatenate([np.repeat(np.flatnonzero(short), n), np.repeat(np.flatnonzero(~short), [len(x) for x in alone])])
                got, n = np.append(got, np.array([t for x in alone for t in x], np.int32))[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(own))
            ids.append(got)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def tokens(self, data: np.ndarray, at: np.ndarray) -> Tokenized:
        """Of all texts with these bytes and borders."""
        units = cut_up(data, at)
        code, size, odd = units.code, np.diff(units.at), np.zeros(len(units.at) - 1, bool)
        odd[code[units.odd]] = True
        plain, strange = np.flatnonzero(~odd), np.flatnonzero(odd)
        flat, sizes = self._encoded(gathered(units.held, size, plain), size[plain])
        if len(strange):
            # the parts of odd chunks, each distinct one once; a mark of the file is a part of one known id
            number: dict = {}
            parts = [[number.setdefault(x, len(number)) for x in self._parts(units.held[units.at[i] : units.at[i + 1]].tobytes())] for i in strange]
            words, marks = [x for x in number if isinstance(x, bytes)], [x for x in number if not isinstance(x, bytes)]
            ids, n = self._encoded(np.frombuffer(b"".join(words), np.uint8), np.array([len(x) for x in words], np.int64))
            ids, n = np.append(ids, np.array(marks, np.int32)), np.append(n, np.ones(len(marks), np.int64))
            place = np.empty(len(number), np.int64)
            place[[number[x] for x in words + marks]] = np.arange(len(number))
            own = place[np.array([x for p in parts for x in p], np.int64)]
            of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            flat = np.append(flat, gathered(ids, n, own))
            sizes = np.append(sizes, row_sums(n[own], of, len(parts)).astype(np.int64))
            rank = np.empty(len(odd), np.int64)
            rank[np.append(plain, strange)] = np.arange(len(odd))
            code = rank[code]
        return Tokenized(gathered(flat, sizes, code), sizes[code], units.row, units.end)

    def encode(self, text: str) -> tuple[bytes, str]:
        """(little-endian 32-bit ids, their labels joined by spaces) of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        ids = self.tokens(data, np.array([0, len(data)])).ids
        return ids.astype("<i4").tobytes(), " ".join(self.labels.take(pa.array(ids)).to_pylist())


class Units(NamedTuple):
    """Pieces of plain chunks, lower-cased, and whole odd chunks: number among the distinct ones, text row, end in the bytes, whether odd;
    and the distinct ones' bytes with their borders."""

    code: np.ndarray
    row: np.ndarray
    end: np.ndarray
    odd: np.ndarray
    held: np.ndarray
    at: np.ndarray


def cut_up(data: np.ndarray, at: np.ndarray) -> Units:
    start, end, row = words(data, at)
    if not len(start):
        return Units(start, row, end, np.zeros(0, bool), np.zeros(0, np.uint8), np.zeros(1, np.int64))
    ink, second = ~SPACE[data], np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    # chunks with a byte that is not plain
    odd = np.zeros(len(start), bool)
    odd[np.searchsorted(start, np.flatnonzero(ink & ~second & ~_SIMPLE[data]), "right") - 1] = True
    border = np.zeros(len(data) + 1, np.int8)
    border[start[odd]] += 1
    border[end[odd]] -= 1
    inside = np.cumsum(border[:-1], dtype=np.int8).view(bool)
    # lower case; U+00D7 and U+00F7 are no letters
    low, kind = LOWER[data], _KIND[data]
    kind[second] = 1
    lead = np.flatnonzero(second)
    own = data[lead]
    low[lead[(own <= 0x9E) & (own != 0x97)]] += 0x20
    signs = lead[(own == 0x97) | (own == 0xB7)]
    kind[signs] = kind[signs - 1] = 3
    low[inside] = data[inside]
    first = np.zeros(len(data), bool)
    first[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ink[1:] & ~inside[1:]
    first[start] = True
    unit = np.flatnonzero(first)
    opens = np.zeros(len(data), bool)
    opens[start] = True
    word = np.cumsum(opens[unit]) - 1
    ends = np.minimum(np.append(unit[1:], len(data)), end[word])
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ink, out=place[1:])
    held = low[ink]
    packed = pa.Array.from_buffers(pa.large_binary(), len(unit), [None, pa.py_buffer(np.append(place[unit], len(held))), pa.py_buffer(held)]).dictionary_encode()
    _, borders, distinct = packed.dictionary.buffers()
    return Units(packed.indices.to_numpy(), row[word], ends, odd[word], np.frombuffer(distinct, np.uint8), np.frombuffer(borders, np.int64)[: len(packed.dictionary) + 1])


def gathered(flat: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The runs of `flat`, of these sizes, one after the other as `code` names them."""
    starts = np.cumsum(sizes) - sizes
    want = sizes[code]
    total = np.cumsum(want)
    return flat[np.repeat(starts[code] - (total - want), want) + np.arange(total[-1] if len(total) else 0)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    made = Tokenizer(path)
    gc.freeze()  # its hundred thousand tables live as long as the worker; no collection need walk them
    return made


@tidy
def _encoded(batches, path: str, limit: int):
    t = tokenizer(path)
    try:
        for b in batches:
            yield from _encoded_batch(t, b, limit)
    finally:
        t.forget()


def _encoded_batch(t: Tokenizer, b: pa.RecordBatch, limit: int):
    doc = b.column("doc_id")
    for lo, hi, data, at in texts(b.column("text"), limit):
        got = t.tokens(data, at)
        count = row_sums(got.sizes, got.row, hi - lo).astype(np.int64)
        borders, ids = pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(got.ids)
        spelt = pc.binary_join(pa.ListArray.from_arrays(borders, t.labels.take(ids)), " ")
        yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), pa.array(count), pa.ListArray.from_arrays(borders, ids), spelt], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = TOGETHER) -> DataFrame:
    """-> doc_id, n_tokens, ids array<int>, decoded: every whole text, encoded and decoded again."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(src).mapInArrow(partial(_encoded, path=path, limit=batch_bytes), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text."""
    return encoded.select(
        "doc_id", "n_tokens",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
