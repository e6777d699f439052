"""Texts into lines, passages, links and chunks, with byte offsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T


def outline_lines(docs: DataFrame) -> DataFrame:
    """(record_id, text) -> record_id, line_no, byte_start, line, class, heading_level, in_block.

    A line's class is set by its own form, except inside a begin/end block or a drawer, which
    run from their opening line to their closing one.
    """
    rows = docs.select("record_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    upto = Window.partitionBy("record_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = byte_offsets(rows)
    low = F.lower("line")
    opens = low.rlike(r"^\s*#\+begin_(src|example|quote)").cast("int") + low.rlike(r"^\s*:properties:\s*$").cast("int")
    closes = low.rlike(r"^\s*#\+end_(src|example|quote)").cast("int") + low.rlike(r"^\s*:end:\s*$").cast("int")
    rows = block_state(rows.withColumn("opens", opens).withColumn("closes", closes), upto)
    kind = F.first(F.when(F.col("opens") == 1, F.when(low.rlike("properties"), "drawer").otherwise(F.regexp_extract(low, r"#\+begin_(\w+)", 1))), ignorenulls=True)
    rows = rows.withColumn("block_id", F.sum("opens").over(Window.partitionBy("record_id").orderBy("line_no")))
    rows = rows.withColumn("block", kind.over(Window.partitionBy("record_id", "block_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = F.col("in_block") | (F.col("opens") == 1)
    form = (
        F.when(inside, F.col("block")).when(F.col("line").rlike(r"^\*+ "), "heading").when(low.rlike(r"^#\+\w+:"), "keyword").when(F.col("line").rlike(r"^\s*\|"), "table")
        .when(F.col("line").rlike(r"^\s*([-+]|\d+[.)])\s"), "list").when(low.rlike(r"^\s*(scheduled|deadline|closed):"), "planning").when(F.col("line").rlike(r"^\s*#\s"), "comment")
        .when(F.col("line").rlike(r"^\s*-{5,}\s*$"), "rule").when(F.trim("line") == "", "blank").otherwise("paragraph")
    )
    level = F.when(form == "heading", F.length(F.regexp_extract("line", r"^(\*+) ", 1))).otherwise(0)
    return rows.select("record_id", "line_no", "byte_start", "line", form.alias("class"), level.alias("heading_level"), inside.alias("in_block"))


def block_state(rows: DataFrame, before) -> DataFrame:
    """rows with opens and closes -> also in_block: more opened than closed before the line."""
    return rows.withColumn("in_block", F.coalesce(F.sum(F.col("opens") - F.col("closes")).over(before), F.lit(0)) > 0)


def byte_offsets(rows: DataFrame) -> DataFrame:
    """rows(record_id, line_no, line) -> also byte_start: UTF-8 bytes before the line, ends of lines included."""
    before = Window.partitionBy("record_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))


def span_end(starts: DataFrame) -> DataFrame:
    """starts(record_id, byte_start, total) -> also byte_end: the next start, else the total."""
    order = Window.partitionBy("record_id").orderBy("byte_start")
    return starts.withColumn("byte_end", F.lead("byte_start").over(order)).withColumn("byte_end", F.coalesce("byte_end", "total"))


def passages(docs: DataFrame) -> DataFrame:
    """(record_id, kind, text) -> record_id, level, span_start, span_len, body: sections of notes and turns of transcripts from one top heading to the next.

    A text without a top heading is one passage, an empty text none; what stands before the first heading belongs to none.
    """
    heads = outline_lines(docs).where("class = 'heading' and heading_level = 1").select("record_id", "byte_start")
    sized = docs.select("record_id", "kind", "text", F.octet_length("text").alias("total")).where("total > 0")
    cut = span_end(heads.join(sized.select("record_id", "total"), "record_id"))
    whole = sized.join(heads, "record_id", "left_anti").select("record_id", "total", F.lit(0).cast("long").alias("byte_start"), F.col("total").cast("long").alias("byte_end"))
    spans = cut.select("record_id", "total", "byte_start", "byte_end").unionByName(whole)
    level = F.when(F.col("kind") == "session-transcript", "turn").otherwise("section")
    body = F.substring(F.encode("text", "UTF-8"), F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int")).cast("string")
    return spans.join(sized.select("record_id", "kind", "text"), "record_id").select(
        "record_id", level.alias("level"), F.col("byte_start").alias("span_start"), (F.col("byte_end") - F.col("byte_start")).alias("span_len"), body.alias("body")
    )


def extract_links(docs: DataFrame) -> DataFrame:
    """(record_id, text) -> record_id, target_kind, target, description, span_start, span_len in bytes: every [[target]] and [[target][description]]."""
    pattern = r"\[\[[^\n]+?\]\]"
    hits, parts = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    rows = docs.where(F.col("text").contains("[[")).select("record_id", F.posexplode(F.arrays_zip(hits.alias("hit"), parts.alias("part"))).alias("no", "x")).select("record_id", "no", "x.hit", "x.part")
    before = Window.partitionBy("record_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("part") + F.coalesce(F.octet_length("hit"), F.lit(0))).over(before), F.lit(0)) + F.octet_length("part")
    rows = rows.withColumn("span_start", start).where("hit is not null")
    inner = F.split(F.expr("substring(hit, 3, length(hit) - 4)"), r"\]\[", 2)
    target = inner[0]
    kind = T.link_kind(target)
    return rows.select(
        "record_id", kind.alias("target_kind"), F.regexp_replace(target, "^id:", "").alias("target"), F.try_element_at(inner, F.lit(2)).alias("description"),
        "span_start", F.octet_length("hit").alias("span_len"),
    )


def _cut(raw: bytes, most: int) -> list[tuple[int, int]]:
    """Spans of at most `most` bytes: at the last line end in the last quarter, else full, never inside a character."""
    out, at = [], 0
    while most > 0 and len(raw) - at > most:
        end = at + most
        while end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        line = raw.rfind(b"\n", at + most - most // 4, end)
        end = line + 1 if line >= 0 else max(end, at + 1)
        out.append((at, end - at))
        at = end
    out.append((at, len(raw) - at))
    return out


def chunk_spans(rows: DataFrame, max_bytes: int) -> DataFrame:
    """(record_id, span_start, body) -> record_id, span_start, span_len: spans that fit the budget, at their place in the record."""

    def cut(batches):
        for pdf in batches:
            out = [(r, s + a, n) for r, s, body in zip(pdf.record_id, pdf.span_start, pdf.body, strict=True) for a, n in _cut((body or "").encode(), max_bytes)]
            yield pd.DataFrame(out, columns=["record_id", "span_start", "span_len"])

    return rows.select("record_id", F.col("span_start").cast("long").alias("span_start"), "body").mapInPandas(cut, "record_id string, span_start long, span_len long")


def _packed(title: str, units: list[str], most: int) -> list[str]:
    """Units packed greedily under a title; a chunk opens with the last tenth of the one before, cut at a word."""
    head = title + "\n" if title else ""
    room = max(1, most - len(head))
    pieces: list[str] = []
    for u in units:
        while len(u) > room:
            cut = u.rfind(" ", 1, room)
            cut = cut if cut > 0 else room
            pieces.append(u[:cut])
            u = u[cut:].lstrip()
        pieces.append(u)
    out, now = [], ""
    for p in pieces:
        if now and len(now) + 1 + len(p) > room:
            out.append(now)
            tail = now[-(most // 10) :] if most >= 10 else ""
            tail = tail[tail.find(" ") + 1 :] if " " in tail else ""
            now = f"{tail}\n{p}" if tail and len(tail) + 1 + len(p) <= room else p
        else:
            now = f"{now}\n{p}" if now else p
    return [head + x for x in [*out, now]] if now or out else []


def chunk_document(units: DataFrame, max_chars: int = 6000) -> DataFrame:
    """(record_id, title, line_no, unit) -> record_id, chunk_no, chunk: one chunk if all fits."""
    rows = units.groupBy("record_id").agg(F.first("title").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "unit"))), lambda x: x["unit"]).alias("units"))

    def pack(batches):
        for pdf in batches:
            out = [(r, i, c) for r, t, u in zip(pdf.record_id, pdf.title, pdf.units, strict=True) for i, c in enumerate(_packed(t or "", list(u), max_chars))]
            yield pd.DataFrame(out, columns=["record_id", "chunk_no", "chunk"])

    return rows.mapInPandas(pack, "record_id string, chunk_no int, chunk string")


def assemble_document(passages: DataFrame, titles: DataFrame) -> DataFrame:
    """passages(record_id, span_start, body), titles(record_id, title) -> record_id, document: one section of the record's passages in order, blank ones left out, under its id."""
    kept = passages.where("trim(body, ' \t\n\r') <> ''").select("record_id", F.struct("span_start", T.trimmed(F.col("body")).alias("body")).alias("x"))
    joined = kept.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["body"]), "\n\n").alias("joined"))
    rows = titles.select("record_id", F.coalesce("title", F.lit("")).alias("title")).join(joined, "record_id", "left")
    t, j = F.col("title"), F.coalesce("joined", F.lit(""))
    return rows.select("record_id", F.concat(F.lit("#+title: "), t, F.lit("\n\n* "), t, F.lit("\n:PROPERTIES:\n:ID: "), F.col("record_id"), F.lit("\n:END:\n\n"), j, F.lit("\n")).alias("document"))


def record_text(pieces: DataFrame) -> DataFrame:
    """passages -> record_id, text: a record's passages but the thread level, in span order, one to a line."""
    rows = pieces.where("level <> 'thread'").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "body"))).alias("p"))
    return rows.select("record_id", F.array_join(F.transform("p", lambda x: x["body"]), "\n").alias("text"))


def body_text(docs: DataFrame, prose: bool = False) -> DataFrame:
    """(record_id, text) -> record_id, body: paragraphs, lists, quotes and tables in order, links shown by their words; prose leaves src and example out."""
    keep = ["paragraph", "list", "quote", "table"] + ([] if prose else ["src", "example"])
    rows = outline_lines(docs).where(F.col("class").isin(*keep) & ~F.lower("line").rlike(r"^\s*#\+(begin|end)_"))
    rows = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return rows.select("record_id", T.body_without_links(F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("body"))


def summary_body(lines: DataFrame, chars: int = 500) -> DataFrame:
    """outline lines with title -> record_id, summary: title and first paragraph, cut at so many characters with an ellipsis."""
    first = lines.where("class = 'paragraph'").groupBy("record_id", "title").agg(F.min_by("line", "line_no").alias("first"))
    whole = F.concat_ws("\n", "title", "first")
    return first.select("record_id", F.when(F.length(whole) > chars, F.concat(F.left(whole, F.lit(chars)), F.lit("…"))).otherwise(whole).alias("summary"))


def short_title(lines: DataFrame, titles: DataFrame, chars: int = 80) -> DataFrame:
    """#+title if not blank, else the first heading or paragraph that is not blank, else (untitled)."""
    own = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\*+ ", ""), r"(^|[ \t]):[^ \t]+:[ \t]*$", ""))
    first = lines.where(F.col("class").isin("heading", "paragraph")).withColumn("own", own).where("own <> ''").groupBy("record_id").agg(F.min_by("own", "line_no").alias("first"))
    title = F.coalesce(F.when(F.trim("title") != "", F.trim("title")), "first", F.lit("(untitled)"))
    return titles.join(first, "record_id", "left").select("record_id", F.left(title, F.lit(chars)).alias("short_title"))


def is_degenerate(texts: DataFrame, window: int = 12, threshold: float = 0.25) -> DataFrame:
    """(id, text) -> id, degenerate: 3 * window words or more and the commonest three words in a row are more than a share of all such."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    rows = texts.select("id", words.alias("w"))
    grams = rows.where(F.size("w") >= 3 * window).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("g"))
    share = grams.groupBy("id", "g").count().groupBy("id").agg((F.max("count") / F.sum("count")).alias("share"))
    return rows.select("id").join(share, "id", "left").select("id", F.coalesce(F.col("share") > threshold, F.lit(False)).alias("degenerate"))


def split_generated(rows: DataFrame) -> DataFrame:
    """(id, form, text) -> id, form, no, piece: a summary is one piece, questions one a line without list marks."""
    pieces = F.when(F.col("form") == "summary", F.array(F.trim("text"))).otherwise(
        F.filter(F.transform(T.lines(F.col("text")), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)])\s+", ""))), lambda x: x != "")
    )
    return rows.select("id", "form", F.posexplode(pieces).alias("no", "piece"))
