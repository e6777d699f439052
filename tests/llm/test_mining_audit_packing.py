"""Hard negatives, the filter audit and packing against brute force on small tables."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import audit, hardneg, packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# --- hard negatives


@pytest.mark.parametrize("dims, high", [(1, 3), (7, 1 << 8), (64, 1 << 12), (1500, 1 << 20), (3, 1 << 26)])
def test_residues_give_exact_products(dims, high):
    rng = np.random.default_rng(dims)
    a, b = (rng.integers(-high, high + 1, (n, dims)) for n in (5, 9))
    a[0], b[0], b[1] = high, high, -high
    primes = hardneg.primes_for(min(dims, hardneg.DIMS), hardneg.largest(a, b))
    assert all(max(abs(p // 2), 1) ** 2 * min(dims, hardneg.DIMS) <= hardneg.EXACT for p in primes)
    got = hardneg.products(hardneg.Residues(a, primes), hardneg.Residues(b, primes), slice(0, 5), slice(0, 9))
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]


def _mined(rows, every, positives, negatives, scale, noisy, labels):
    """Rows of one id ask each for itself and are no candidates for each other."""
    good = [
        (i, (lab + 1) % labels if i % noisy == 0 else lab, [int(np.floor(scale * x)) for x in v])
        for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, lab, q in good:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), j, other) for j, other, p in good if j != i and len(p) == len(q))
        for minus, pos, _ in [s for s in scored if s[2] == lab][:positives]:
            fit = [s for s in scored if s[2] != lab and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:negatives]
            out += [(i, pos, r + 1, s[1], -minus, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(6)], rng.randint(0, 3)) for i in range(150)]
    rows += [(i, [rng.gauss(0.3, 1) for _ in range(3)], i % 2) for i in range(200, 215)]
    # ties, repeated rows and ids, rows that take no part
    rows += [(300 + i, rows[3][1], i % 4) for i in range(12)] + [rows[0], (0, rows[7][1], 2), (10, rows[8][1], None), (20, None, 1), (30, [], 1), (40, [None] * 6, 1), (50, [float("nan")] * 6, 1), (None, rows[9][1], 1)]
    table = spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, no string, rank int, q int")
    want = _mined(rows, 10, 4, 3, 256.0, 7, 4)
    assert len(want) > 60
    for cells in ((hardneg.ANCHORS, hardneg.ROWS), (12, 60)):
        monkeypatch.setattr(hardneg, "ANCHORS", cells[0])
        monkeypatch.setattr(hardneg, "ROWS", cells[1])
        assert sorted(map(tuple, hardneg.mine(table, every=10, positives=4, labels=4).collect())) == want
    assert hardneg.mine(table.where("false")).count() == 0


def test_hard_negatives_of_large_scores_go_in_smaller_tiles(spark):
    rng = random.Random(12)
    rows = [(i, [rng.uniform(-1, 1) * (1 << 26) for _ in range(4)], i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hardneg.mine(table, every=5, scale=1.0, noisy=7, labels=2).collect())) == _mined(rows, 5, 5, 3, 1.0, 7, 2)
    with pytest.raises(Exception, match="2\\^55"):
        hardneg.mine(table, every=5, scale=64.0).collect()


# --- filter audit

_WORD = r"[^\x20\x09-\x0D]+"


def _counted(text):
    w = re.findall(_WORD, text)
    return [len(w), len(set(w)), len(text), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text))]


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


def _odd_texts(rng, n=120):
    some = ["", " ", "a", "Aa", "  \t\nB\x0b\x0c\r", "é", "🙂 日本 日本", "#$", "x\x85y", "\x1c", "word " * 60, " ".join(f"w{i}" for i in range(70)), "A" * 300]
    return some + ["".join(rng.choice("ab AB\n\t é日🙂#&|.") for _ in range(rng.randint(0, 400))) for _ in range(n)]


def test_transducer_counts_match_patterns(monkeypatch):
    texts = _odd_texts(random.Random(1))
    assert audit.measured(*_bytes(texts)).tolist() == [_counted(t) for t in texts]
    # long texts in blocks, words of more than a block among them
    monkeypatch.setattr(audit, "BLOCK", 16)
    for t in texts:
        assert audit.measured(*_bytes([t])).tolist() == [_counted(t)]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = _odd_texts(random.Random(2), 30)
    monkeypatch.setattr(audit, "span_hash", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(2))
    assert audit.measured(*_bytes(texts)).tolist() == [_counted(t) for t in texts]


def _audited(docs, labels):
    rows = []
    for i, text, source in docs:
        words, distinct, points, capitals, symbols = _counted(text or "")
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        bad = {c for c, b in zip("ABCDE", (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols > 0, copy), strict=True) if b}
        marks = [(q, t) for j, q, t in labels if j == i and j is not None]
        rows.append((source or "", bad, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    want, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, own in enumerate(order, 1):
            for part in {r[0] for r in rows}:
                of = [(bad, good, toxic, bool(bad & set(order[: step - 1]))) for p, bad, good, toxic in rows if p == part]
                gone = [(good, toxic) for bad, good, toxic, late in of if own in bad and not late]
                shapley[part, own] += len(gone)
                want[part, order, step] = [
                    sum(not late and own not in bad for bad, _, _, late in of), len(gone), sum(late and own in bad for bad, _, _, late in of), sum(bad == {own} for bad, *_ in of),
                    sum(g for g, _ in gone), sum(t for _, t in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_audit_matches_brute_force(spark):
    rng = random.Random(3)
    texts = _odd_texts(rng, 60)
    docs = [(i, t, rng.choice(["s1", "s2", None])) for i, t in enumerate(texts)]
    docs += [(rng.choice([None, 500, 501, 502, 3]), rng.choice([*texts[:20], None]), rng.choice(["s1", "s3", ""])) for _ in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(0, 60, 2), 500, 500, 502, None]]
    table = spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in docs], "doc_id long, text string, source string, part string, n int, fails int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(table, marks).collect()}
    assert got == _audited(docs, labels)
    assert audit.audit(table.where("false"), marks).count() == 0


# --- packing


def test_cheapest_cuts_match_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        window, pos = rng.choice([8, 16, 32]), [0]
        while len(pos) < rng.randint(2, 50):
            pos.append(pos[-1] + rng.randint(1, window))
        cost = [0, *(rng.choice([1, 9, 65]) for _ in pos[1:])]
        price = lambda n: 0 if n & (n - 1) == 0 else window - n  # noqa: B023, E731
        best = [0.0] + [float("inf")] * (len(pos) - 1)
        for j in range(1, len(pos)):
            best[j] = cost[j] + min(best[i] + price(pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= window)
        cuts, of = packing.cheapest(pos, cost, window), dict(zip(pos, cost, strict=True))
        assert cuts[0] == 0 and cuts[-1] == pos[-1] and all(b - a <= window for a, b in itertools.pairwise(cuts))
        assert sum(of[b] + price(b - a) for a, b in itertools.pairwise(cuts)) == best[-1]


@pytest.mark.parametrize("run", [packing.RUN, 500])
def test_pieces_hold_every_id_once(spark, monkeypatch, run):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RUN", run)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "cat", "sat.", "déjà?", "on\n", 'mats!"', "日本。", "x1"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    texts += [None, "", " ", "word " * 5000, "a.b" * 2000, texts[0], texts[0]]
    ids = [*range(60), 60, None, 61, 62, 63, 0, 64]
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, ids string, start int, offset int").coalesce(2)
    ref = Tokenizer.from_file(WORD_BPE)
    window = 256
    got = packing.pack(table, WORD_BPE, window=window).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    want = {}
    for i, t in zip(ids, texts, strict=True):
        want.setdefault(i, []).append([*ref.encode(t or "", add_special_tokens=False).ids, 1])
    for i, of in want.items():
        # rows of one id are documents each: their pieces follow each other in order of sequence
        flat = [x for r in sorted(pieces[i], key=lambda r: (r.sequence_id, r.offset)) for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert Counter(flat) == Counter(x for ids in of for x in ids) and (len(of) > 1 or flat == of[0])
        assert sum(r.start == 0 for r in pieces[i]) == len(of) and {r.doc_tokens for r in pieces[i]} == {len(x) for x in of}
    padding = total = 0
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= window
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else window - at)
    assert padding < 0.06 * total
    assert packing.pack(table.where("false"), WORD_BPE).count() == 0


def test_query_digests_are_of_the_ids(spark):
    from quillspark.llm.queries import op13_window_packing

    got = op13_window_packing(spark, "/root/testdata/sf0.001")
    whole = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), WORD_BPE)
    crc = {(r.sequence_id, r.offset): r.ids_crc32 for r in got.collect()}
    assert crc == {(r.sequence_id, r.offset): zlib.crc32(r.ids) for r in whole.collect()}


def test_sentences_end_at_closing_marks_and_lines():
    text = 'One. Two!" three\nfour 1.5 five. 日。six'
    data, at = _bytes([text, "No."])
    t = packing.tokenizer(WORD_BPE)
    got = t.tokens(data, at)
    ends = got.end[packing.sentence_ends(data, at, got.row, got.end)]
    assert [data[:e].tobytes().decode() for e in ends[:4]] == ["One.", 'One. Two!"', 'One. Two!" three', 'One. Two!" three\nfour 1.5 five.']
    assert ends[-1] == len(data)
