"""Operators whose queries have no SQL, against plain Python written from their description."""

from __future__ import annotations

import hashlib
import random
import re
from email.message import EmailMessage

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation, links, mail, maintenance, outline, retrieval
from quillspark.queries import QUERIES
from quillspark.sources import records

SF = "/root/testdata/sf0.001"

_PIECES = ["* Head", "** Deep :tag:", "#+title: x", "| a | b |", "- item", "12. item", "  + é item", "SCHEDULED: <d>", "# note", "------", "", "  ", "plain é text", "#+BEGIN_SRC py", "#+end_src", ":PROPERTIES:", ":END:", "#+begin_quote", "#+END_QUOTE", "*bold* no head", "-----x"]


def _classes(text):
    """(byte_start, line, class, level, in block) of every line; blocks do not nest here."""
    out, at, block = [], 0, None
    for line in text.split("\n"):
        low = line.lower()
        opened = re.match(r"\s*#\+begin_(src|example|quote)", low)
        opened = opened[1] if opened else "drawer" if re.fullmatch(r"\s*:properties:\s*", low) else None
        closed = bool(re.match(r"\s*#\+end_(src|example|quote)", low) or re.fullmatch(r"\s*:end:\s*", low))
        now = block or opened
        level = 0
        if now:
            kind = now
        elif m := re.match(r"(\*+) ", line):
            kind, level = "heading", len(m[1])
        else:
            forms = [("keyword", r"#\+\w+:", low), ("table", r"\s*\|", line), ("list", r"\s*([-+]|\d+[.)])\s", line), ("planning", r"\s*(scheduled|deadline|closed):", low), ("comment", r"\s*#\s", line), ("rule", r"\s*-{5,}\s*$", line), ("blank", r" *$", line)]
            kind = next((k for k, p, x in forms if re.match(p, x)), "paragraph")
        out.append((at, line, kind, level, bool(now)))
        at += len(line.encode()) + 1
        block = None if closed and block else block or (opened if not closed else None)
    return out


def test_lines_have_their_class_place_and_block(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        lines, inside = [], False
        for _ in range(rng.randint(1, 25)):
            piece = rng.choice(_PIECES)
            low = piece.lower().strip()
            if low.startswith("#+begin") or low == ":properties:":
                if inside:
                    continue
                inside = True
            elif low.startswith("#+end") or low == ":end:":
                if not inside:
                    continue
                inside = False
            lines.append(piece)
        texts.append("\n".join(lines))
    docs = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "record_id string, text string")
    got = {}
    for r in outline.outline_lines(docs).collect():
        got.setdefault(r.record_id, []).append((r.line_no, (r.byte_start, r.line, r["class"], r.heading_level, r.in_block)))
    for i, t in enumerate(texts):
        assert [x for _, x in sorted(got[f"r{i}"])] == _classes(t), t


def _spans(raw, most):
    """Cut where the text says: as much as fits, back to a line's end in the last quarter, and never inside a character."""
    out, at = [], 0
    while len(raw) - at > most:
        full = at + most
        while raw[full] & 0xC0 == 0x80:
            full -= 1
        breaks = [i + 1 for i in range(at + most - most // 4, full) if raw[i : i + 1] == b"\n"]
        end = breaks[-1] if breaks else full
        out.append((at, end - at))
        at = end
    return [*out, (at, len(raw) - at)]


def test_chunk_spans_of_whole_texts(spark):
    rows = {r.record_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select(F.concat(F.lit("doc-"), "doc_id").alias("record_id"), "text").collect()}
    got = {}
    for r in QUERIES["chunk_spans"](spark, SF).collect():
        got.setdefault(r.record_id, []).append((r.span_start, r.span_len))
    assert {k: sorted(v) for k, v in got.items()} == {k: _spans(t.encode(), 1500) for k, t in rows.items()}


def test_chunks_fit_hold_all_and_overlap(spark):
    texts = {f"doc-{r.doc_id}": r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in QUERIES["chunk_document"](spark, SF).collect():
        got.setdefault(r.record_id, []).append((r.chunk_no, r.chunk))
    assert got.keys() == texts.keys()
    for record, chunks in got.items():
        bodies = []
        for i, (no, chunk) in enumerate(sorted(chunks)):
            head, _, body = chunk.partition("\n")
            assert no == i and head == record and len(chunk) <= 2000
            bodies.append(body)
        # what a chunk repeats is the end of the one before; without it the chunks are the text
        text = bodies[0]
        for before, body in zip(bodies, bodies[1:], strict=False):
            again = max((k for k in range(1, 201) if body[k : k + 1] == "\n" and before.endswith(body[:k])), default=-1)
            text += "\n" + body[again + 1 :]
        assert re.sub(r"\s+", "", text) == re.sub(r"\s+", "", texts[record])


def test_questions_become_statements(spark):
    given = {
        "What is my name?": "the operator's name", "Who are we and what do I do??": "the operator and the operator do", "how does  it work": "it work", "A statement.": "A statement.",
        "why": "why", "Where did our cat go and when?": "the operator's cat go and when", "": "", "Mine is not me": "Mine is not the operator",
    }
    rows = spark.createDataFrame([(k,) for k in given], "q string")
    assert {r.q: r.s for r in rows.select("q", T.rewrite_template(F.col("q")).alias("s")).collect()} == given
    words = {r.item_id: r.text.split(" ") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = lambda w: re.sub(r"\b(my|our)\b", "the operator's", re.sub(r"\b(I|me|we|us)\b", "the operator", w, flags=re.I), flags=re.I)
    got = {r.item_id: r.statement for r in QUERIES["rewrite_template"](spark, SF).collect()}
    want = {i: " ".join(f"the operator's {plain(w[0])} and the operator read {plain(w[1])}".split()) for i, w in words.items()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_tags_are_placed_on_their_line_or_in_front(spark):
    rows = [("#+filetags: :a:\nx", ["b", "c"], "#+filetags: :a:b:c:\nx"), ("t\n#+FILETAGS: :a: \ny", ["b"], "t\n#+FILETAGS: :a:b:\ny"), ("no line", ["b"], "#+filetags: :b:\nno line"), ("same", [], "same"), ("", ["z"], "#+filetags: :z:\n")]
    table = spark.createDataFrame(rows, "text string, tags array<string>, want string")
    assert [r[0] for r in table.select(T.place_tags(F.col("text"), F.col("tags"))).collect()] == [w for _, _, w in rows]
    for r in QUERIES["place_tags"](spark, SF).collect():
        lines = r.head.split("\n")
        own = [x for x in lines if x.startswith("#+filetags:")]
        assert len(own) == 1 and own[0].endswith(":added:") and "MixedCase" not in r.head and lines[0].startswith("#+title: Note ")


def test_messages_are_parsed(spark):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"], m["Message-ID"] = "Ann <a@x>", "b@x, c@x", "café", "Tue, 02 Jan 2024 03:04:05 +0100", "<1@x>"
    m["In-Reply-To"], m["References"] = "<0@x>", "<r1@x> <r2@x>"
    m.set_content("hello\nworld\n")
    page = EmailMessage()
    page["Message-ID"] = "<2@x>"
    page.set_content("<p>one <b>two</b></p>", subtype="html")
    both = EmailMessage()
    both.set_content("plain")
    both.add_alternative("<i>html</i>", subtype="html")
    files = [("a", m.as_bytes()), ("b", page.as_bytes()), ("c", both.as_bytes()), ("d", b"\xff\xfe no headers"), ("e", b""), ("f", b"Date: never\n\nx")]
    got = {r.locator: r for r in mail.parse_messages(spark.createDataFrame(files, "locator string, content binary")).collect()}
    a = got["a"]
    assert (a.message_id, a["from"], a.to, a.subject, a.epoch, a.in_reply_to, a.refs, a.body) == ("<1@x>", "Ann <a@x>", "b@x, c@x", "café", 1704161045, "<0@x>", ["<r1@x>", "<r2@x>"], "hello\nworld\n")
    assert (got["b"].body, got["b"].message_id, got["b"].epoch) == ("one two", "<2@x>", None) and got["c"].body == "plain\n"
    assert len(got) == 6 and got["e"].body == "" and got["f"].epoch is None and got["f"].body == "x"
    own = {r.message_id: (r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(F.format_string("<c%d-%d@example.invalid>", "conv_id", "turn").alias("message_id"), "role", "text").collect()}
    rows = QUERIES["parse_messages"](spark, SF).collect()
    assert len(rows) == len(own)
    for r in rows:
        # the body as it is in the message, whose text part Python reads by its declared characters
        assert r.message_id == r.locator and (r["from"], r.epoch, r.subject) == (own[r.locator][0], 1704067200, "café")
        if own[r.locator][1].isascii():
            assert r.body == own[r.locator][1].replace("\r\n", "\n")


def test_mail_records_are_threads_and_messages(spark):
    rows = QUERIES["rebuild_mail"](spark, SF).collect()
    single = {r.record_id: r.text for r in rows if r.kind == "mail-message"}
    threads = {r.record_id: r.text for r in rows if r.kind == "mail-thread"}
    talk = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    wanted = {(c, t) for c, t in talk if (c * 1000 + t) % 7 == 0 or (c % 6 != 5 and c % 4 != 0)}
    assert single.keys() == {f"<c{c}-{t}@example.invalid>" for c, t in wanted}
    assert threads.keys() <= single.keys()
    for c, t in wanted:
        if talk[c, t].isascii():
            assert single[f"<c{c}-{t}@example.invalid>"] == talk[c, t].replace("\r\n", "\n")
            # a reply and what it answers are in one thread; a message by itself is none
            if (c, t - 1) in wanted or (c, t + 1) in wanted:
                assert any(talk[c, t].strip() in text for text in threads.values()), (c, t)


def test_missing_spans_and_their_vectors(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    every = {(hashlib.sha256(t.encode()).hexdigest(), a, n): t.encode()[a : a + n].decode() for _, t in docs for a, n in _spans(t.encode(), 1500)}
    want = {k: v for k, v in every.items() if k[1]}
    assert {tuple(r) for r in QUERIES["spans_to_embed"](spark, SF).collect()} == set(want)
    made = QUERIES["embed_missing"](spark, SF).collect()
    assert {(r.stream_hash, r.span_start, r.span_len) for r in made} == set(want) and len(made) == len(want)
    import zlib

    for r in made:
        v = np.zeros(16, np.float32)
        for w in want[r.stream_hash, r.span_start, r.span_len].lower().split():
            v[zlib.crc32(w.encode()) % 16] += 1
        assert np.allclose(r.vector, v / max(1e-9, float(np.linalg.norm(v))), atol=1e-6)


# --- what this library does with odd rows


def test_spans_inside_long_records_and_ties(spark, monkeypatch):
    rng = random.Random(2)
    for swept in (16, 3):
        monkeypatch.setattr(maintenance, "SWEPT", swept)
        passages = [(f"r{rng.randint(0, 2)}", rng.randint(0, 60), rng.choice([0, 1, 5, 40])) for _ in range(25)]
        vectors = [(i, f"r{rng.randint(0, 3)}", rng.randint(0, 70), rng.choice([0, 1, 2, 9])) for i in range(120)]
        inside = {(r, s, n) for _, r, s, n in vectors if any(q == r and a <= s and s + n <= a + m for q, a, m in passages)}
        v = spark.createDataFrame(vectors, "vec_id int, record_id string, span_start int, span_len int")
        p = spark.createDataFrame(passages, "record_id string, span_start long, span_len long")
        got = maintenance.embedded_spans(v, p).collect()
        assert {tuple(r) for r in got} == inside and len(got) == len(inside)
        assert {r.vec_id for r in maintenance.orphan_vectors(v, p).collect()} == {i for i, r, s, n in vectors if (r, s, n) not in inside}
    assert maintenance.embedded_spans(v.where("false"), p).count() == 0 and maintenance.orphan_vectors(v, p.where("false")).count() == 120


def test_percentiles_match_interpolation(spark):
    rng = random.Random(3)
    rows = [(c, k, float(rng.choice([1, 2, 2, 5, rng.random() * 100]))) for c in ("a", "b", None) for k in (1, 2) for _ in range(rng.randint(1, 60))] + [("a", 3, None)]
    df = spark.createDataFrame(rows, "cell string, k int, latency_ms double")
    got = {(r.cell, r.k): r for r in evaluation.latency_stats(df, "cell", "k").collect()}
    for key in {(c, k) for c, k, _ in rows}:
        values = [v for c, k, v in rows if (c, k) == key and v is not None]
        r = got[key]
        assert r.n == len(values)
        if values:
            assert np.allclose([r.p50, r.p95, r.max_ms, r.mean_ms], [np.percentile(values, 50), np.percentile(values, 95), max(values), np.mean(values)])
        else:
            assert r.p50 is None and r.p95 is None
    assert evaluation.latency_stats(df.where("false"), "cell").count() == 0


def test_four_tests_of_a_bench(spark):
    o = spark.createDataFrame([("backend", "idle", 1, 10.0, None), ("backend", "ingest", 1, 15.0, None), ("cli", "idle", 1, 0.0, "other"), ("cli", "ingest", 1, 9.0, None)], "variant string, condition string, clients int, latency_ms double, error_kind string")
    w = spark.createDataFrame([(True, True), (False, None)], "started boolean, completed boolean")
    s = spark.createDataFrame([("backend", "dense", 100.0), ("cli", "dense", 900.0), ("backend", "text", 900.0)], "variant string, stage string, latency_ms double")
    tests = lambda *x: {r.test: (r.value, r.passed) for r in evaluation.verdict_tests(*x).collect()}
    assert tests(o, w, s) == {"no_database_errors": (0.0, True), "writers_completed": (0.0, True), "loaded_p95_within_ratio": (1.5, True), "dense_p95_below_threshold": (100.0, True)}
    bad = tests(o.withColumn("error_kind", F.lit("database")), w.withColumn("completed", F.lit(None).cast("boolean")), s.where("false"))
    assert bad == {"no_database_errors": (4.0, False), "writers_completed": (1.0, False), "loaded_p95_within_ratio": (1.5, True), "dense_p95_below_threshold": (None, False)}


def test_links_are_replaced_in_place(spark):
    text = "é [[id:b]] then [[slug-c][see|c]] and [[gone]] [[https://x]] [[#here]] end"
    raw = text.encode()
    found = [(m.start(), m.end() - m.start(), m[1], m[3]) for m in re.finditer(rb"\[\[([^\]\n]+?)(\]\[([^\n]+?))?\]\]", raw)]
    to = {"b": "b", "slug-c": "c"}
    rows = [("a", "record", t.decode().removeprefix("id:"), d.decode() if d else None, to.get(t.decode().removeprefix("id:")), at, n) for at, n, t, d in found]
    rows += [("a", "record", "b", None, "b", 4, 3), ("a", "record", "b", None, "b", len(raw) - 1, 9)]  # within another one; past the end
    linked = spark.createDataFrame(rows, "record_id string, target_kind string, target string, description string, resolved string, span_start long, span_len long")
    notes = spark.createDataFrame([("a", "k", "A", text), ("b", "k", "B", ""), ("c", "k", None, None)], "record_id string, corpus string, title string, text string")
    got = {r.page: r for r in records.project_pages(notes, linked).collect()}
    assert got["k/a"].body == "---\ntitle: A\n---\né [[k/b|b]] then [[k/c|seec]] and gone [https://x](https://x) [#here](#here) end" and got["k/a"].unresolved == ["gone"]
    assert got["k/b"].body == "---\ntitle: B\n---\n" and got["k/c"].body == "---\ntitle: \n---\n" and got["k/c"].unresolved == []


def test_distances_of_many_seeds(spark):
    rng = random.Random(4)
    n = 150
    edges = [(f"r{rng.randrange(n)}", f"r{rng.randrange(n)}") for _ in range(170)] + [("r0", "r0"), ("r1", "none")]
    recs = spark.createDataFrame([(f"r{i}", None) for i in range(n)], "record_id string, name_slug string")
    li = spark.createDataFrame([(a, "record", b, 0) for a, b in edges], "record_id string, target_kind string, target string, span_start int")
    around = {f"r{i}": set() for i in range(n)}
    for a, b in edges:
        if b in around:
            around[a].add(b)
            around[b].add(a)
    want = set()
    for s in around:
        seen, front = {s: 0}, [s]
        for d in range(1, 4):
            front = [y for x in front for y in around[x] if y not in seen and not seen.update({y: d})]
        want |= {(s, x, d) for x, d in seen.items()}
    got = [tuple(r) for r in links.link_distance(li, recs, recs.select("record_id"), 3).collect()]
    assert set(got) == want and len(got) == len(want)
    assert links.link_distance(li, recs, recs.select("record_id").where("false"), 3).count() == 0


def test_dense_best_of_split_records_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(f"r{i % 7}" if i % 3 else "hot", i, rng.normal(size=4).tolist()) for i in range(90)]
    rows += [("odd", 100, None), ("odd", 101, [0.0] * 4), ("odd", 102, [1.0]), ("same", 103, rows[5][2]), ("also", 104, rows[5][2]), ("odd", 105, [None] * 4), ("r1", 106, [])]
    v = spark.createDataFrame(rows, "record_id string, vec_id int, embedding array<double>")
    asked = [("q1", rows[5][2]), ("q2", rng.normal(size=4).tolist()), ("q3", [1.0]), ("q4", None)]
    q = spark.createDataFrame(asked, "query_id string, qvec array<double>")

    def cos(a, b):
        if a is None or b is None or None in a + b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))

    for top in (1, 3):
        want = {}
        for name, x in asked:
            pooled = {}
            for r, _, y in rows:
                pooled.setdefault(r, []).append(cos(x, y))
            best = sorted(((-round(np.mean(sorted(s)[-top:]), 9), r) for r, s in pooled.items()))
            want[name] = [(r, -s) for s, r in best]
        for block, limit in ((16384, 100), (12, 4), (12, 100)):
            got = retrieval.vector_candidates(retrieval.dense_best(q, v, top, limit, 2, block), limit).collect()
            for name, _ in asked:
                mine = [(r.record_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == name]
                assert mine == [(r, pytest.approx(s, abs=1e-8)) for r, s in want[name][:limit]]
    assert retrieval.dense_best(q, v.where("false"), 3, 5).count() == 0 and retrieval.dense_best(q.where("false"), v, 3, 5).count() == 0


def test_queries_without_a_word_inside_and_short_texts(spark, tmp_path):
    """The fixture of questions finds what comparing every pair finds."""
    from quillspark.queries.fixtures import fixture

    docs = [(0, "xone two three four five\nmore"), (1, "one two"), (2, "one"), (3, ""), (4, "zz one two three four fiveyy"), (5, "two three four")]
    asked = [(0, "one two three four five"), (1, "one"), (2, "one two\nx"), (3, "two three four"), (4, "absent words are here")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.question_id, r.expected) for r in fixture(spark, str(tmp_path), "fx_questions").collect()}
    assert got == {(i, f"doc-{j}") for i, q in asked for j, t in docs if q.split("\n")[0][:60] in t}
