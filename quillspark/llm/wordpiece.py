"""Token counts by linear longest-match: greedy word pieces, counted without being built.

A trie holds the vocabulary.  Where a match cannot go on, the failure link leads to the
node that is reached after greedily taking pieces off the front of what has been matched,
and each node knows how many pieces that takes off.  Reading a word is then one step per
character and a sum of numbers.

A word is a run of non-space characters.  Its first piece carries the word mark; a
character that no piece covers counts as its UTF-8 bytes and restarts the match.

Defined results: a null or blank text has no words and no pieces; words of any length are
read whole; repeated rows give repeated results; further columns are not read.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
REMEMBERED = 200_000


class LongestMatch:
    """The automaton of a set of pieces; `mark` is the character that opens a word."""

    def __init__(self, pieces, mark: str = MARK):
        self.mark = mark
        self.next: list[dict[str, int]] = [{}]
        piece = [False]
        for p in pieces:
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                at = to
            piece[at] = True
        # fail[v]: where greedy matching of v's text stands after the pieces it can take; -1 if it can take none
        self.fail, self.taken = [-1] * len(piece), [0] * len(piece)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if piece[v]:
                    self.fail[v], self.taken[v] = 0, 1
                elif u:
                    z, n = self.fail[u], self.taken[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.taken[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.taken[v] = self.next[z][c], n
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of the word, with the mark in front."""
        nxt, fail, taken = self.next, self.fail, self.taken
        total = at = 0
        text = self.mark + word
        start = 0  # where the part that the automaton has not yet paid for began
        i = 0
        while i < len(text):
            to = nxt[at].get(text[i])
            if to is not None:
                at = to
                i += 1
            elif at and fail[at] >= 0:
                total += taken[at]
                at = fail[at]
            elif at:
                # what is matched cannot be cut into pieces to its end: settle it by character
                done, start = self._settled(text, i - self._depth(at), i)
                total += done
                at, i = 0, start
            else:
                total += len(text[i].encode())
                i += 1
        while at:
            if fail[at] >= 0:
                total += taken[at]
                at = fail[at]
            else:
                done, start = self._settled(text, len(text) - self._depth(at), len(text))
                total += done
                at = 0
                while start < len(text):
                    done, start = self._settled(text, start, len(text))
                    total += done
        return total

    @property
    def depth(self) -> list[int]:
        got = self.__dict__.get("_depths")
        if got is None:
            got = [0] * len(self.next)
            queue = deque([0])
            while queue:
                u = queue.popleft()
                for v in self.next[u].values():
                    got[v] = got[u] + 1
                    queue.append(v)
            self._depths = got
        return got

    def _depth(self, at: int) -> int:
        return self.depth[at]

    def _settled(self, text: str, lo: int, hi: int) -> tuple[int, int]:
        """One longest piece from lo, or the bytes of one character: (count, position behind it)."""
        at, best = 0, -1
        for i in range(lo, len(text)):
            at = self.next[at].get(text[i], 0)
            if not at:
                break
            if self.fail[at] == 0 and self.taken[at] == 1:
                best = i + 1
        return (1, best) if best > 0 else (len(text[lo].encode()), lo + 1)


@lru_cache(maxsize=2)
def matcher(path: str) -> tuple[LongestMatch, dict]:
    """The automaton of a sentencepiece vocabulary, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return LongestMatch(sp.id_to_piece(i) for i in keep), {}


def _counted(batches, path: str):
    m, known = matcher(path)
    for b in batches:
        words, pieces = [], []
        for text in b.column("text"):
            parts = (text.as_py() or "").split()
            total = 0
            for w in parts:
                n = known.get(w)
                if n is None:
                    n = m.count(w)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(w) < 64:
                        known[w] = n
                total += n
            words.append(len(parts))
            pieces.append(total)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], names=["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, n_words, n_tokens: greedy longest-match pieces of every whole text."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(partial(_counted, path=path), "doc_id long, n_words long, n_tokens long")
