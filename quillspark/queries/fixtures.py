"""Records, links, tags, vectors, mail and outcomes, as views of the given tables.

One text for both engines: sha(x) and pos(x, y) stand for the functions that differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = "concat('doc-', cast(doc_id as varchar(20)))"

FIXTURES: dict[str, str] = {
    "fx_records": f"""select {_ID} as record_id, 'notes' as corpus,
        case when source in ('src0', 'src1') then 'session-transcript' else 'note' end as kind,
        cast(1704067200 + doc_id * 60 as bigint) as created_s, cast(1704067200 + doc_id * 60 + n_chars as bigint) as updated_s,
        sha(text) as stream_hash, substring(split_part(text, chr(10), 1), 1, 80) as title,
        case when doc_id % 3 = 0 then concat('slug-', cast(doc_id as varchar(20))) end as name_slug,
        case when doc_id % 5 = 0 then null else source end as project, lang as context from documents""",
    "fx_links": f"""select {_ID} as record_id, 'record' as target_kind, concat('doc-', cast((doc_id * 7 + 3) % 300 as varchar(20))) as target, 0 as span_start from documents
        union all select {_ID}, 'name', concat('slug-', cast((doc_id * 11) % 400 as varchar(20))), 1 from documents where doc_id % 2 = 0
        union all select {_ID}, 'url', 'https://example.invalid/', 2 from documents where doc_id % 4 = 0""",
    "fx_tags": f"""select {_ID} as record_id, lang as tag from documents
        union all select {_ID}, concat('quality-', cast(quality as varchar(4))) from labels
        union all select {_ID}, 'toxic' from labels where toxic = 1""",
    "fx_vectors": """select vec_id, concat('doc-', cast(vec_id % 37 as varchar(20))) as record_id, vec_id * 100 as span_start,
        100 as span_len, 'm' as model, embedding, label from embeddings""",
    "fx_messages": """select concat('<c', cast(conv_id as varchar(20)), '-', cast(turn as varchar(20)), '@example.invalid>') as message_id,
        case when turn > 0 then concat('<c', cast(conv_id as varchar(20)), '-', cast(turn - 1 as varchar(20)), '@example.invalid>')
          when conv_id % 10 = 9 then concat('<c', cast(conv_id - 1 as varchar(20)), '-0@example.invalid>') else '' end as in_reply_to,
        conv_id * 1000 + turn as epoch, role as sender,
        case when conv_id % 6 = 5 then 'Junk' when conv_id % 2 = 0 then 'Inbox' else 'Archive' end as folder,
        case when conv_id % 4 = 0 then concat('From: ', role, chr(10), 'List-Id: x', chr(10), chr(10), text)
          else concat('From: ', role, chr(10), 'X-Note: a', chr(10), ' List-Id: folded', chr(10), chr(10), text) end as raw,
        text as body from conversations""",
    "fx_questions": f"""select b.item_id as question_id, b.text as query, {_ID.replace('doc_id', 'd.doc_id')} as expected
        from benchmark b join documents d on pos(d.text, substring(split_part(b.text, chr(10), 1), 1, 60)) > 0""",
    "fx_outcomes": """select event_id, case when event_type in ('click', 'view') then 'idle' when event_type = 'purchase' then 'ingest' else 'reindex' end as condition,
        case user_id % 3 when 0 then 1 when 1 then 4 else 8 end as clients, cast(value as double) as latency_ms from events""",
    # passages: the lines of a text that are not empty, with byte offsets
    "fx_texts": f"select {_ID} as record_id, doc_id, text, sha(text) as stream_hash, source, lang from documents",
    # org-like notes: a title line, tags, headings and links around the text
    "fx_notes": f"""select {_ID} as record_id, doc_id, concat('#+title: Note ', cast(doc_id as varchar(20)), chr(10),
        case when doc_id % 3 = 0 then concat('#+name: slug-', cast(doc_id as varchar(20)), chr(10)) else '' end,
        '#+filetags: :', lang, ':MixedCase:', chr(10), 'before', chr(10), '* First :alpha:beta_2:', chr(10), text, chr(10),
        '[[id:doc-', cast((doc_id * 7 + 3) % 300 as varchar(20)), ']]', chr(10), '* Second', chr(10), 'see [[slug-', cast((doc_id * 11) % 400 as varchar(20)),
        '][words]] and [[https://example.invalid/]]', chr(10), '#+begin_src', chr(10), '* not a heading', chr(10), '#+end_src') as text from documents""",
    # a later state of the records: some gone, some changed, some new
    "fx_new_records": f"""select {_ID} as record_id, case when doc_id % 13 = 0 then sha(concat(text, '!')) else sha(text) end as stream_hash, concat('v2 ', lang) as title,
        cast(1804067200 as bigint) as updated_s from documents where doc_id % 17 <> 0
        union all select concat('new-', cast(doc_id as varchar(20))), sha(concat('new', text)), 'new', cast(1804067200 as bigint) from documents where doc_id % 29 = 0""",
}

_TABLES = ("documents", "labels", "embeddings", "conversations", "benchmark", "events", "pages")


def in_duckdb(sql: str) -> str:
    return re.sub(r"\bpos\(", "strpos(", re.sub(r"\bsha\(", "sha256(", sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_questions without comparing every question with every text.

    A text that holds the 60 characters holds the whole words inside them, between the first and the last one; texts and questions
    meet on the first three of those (or as many as there are), and the characters are then looked for in the texts met.  Questions
    without a whole word inside meet every text, if there are any.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    opening = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
    words = F.split("wanted", " ")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"), opening.alias("wanted"))
    asked = asked.withColumn("n", F.least(F.size(words) - 2, F.lit(3))).withColumn("inner", F.when(F.col("n") > 0, F.array_join(F.slice(words, 2, F.greatest("n", F.lit(1))), " ")))
    sizes = [r[0] for r in asked.where("n > 0").select("n").distinct().collect()]  # 1, 2 or 3
    runs = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array(*[F.array_join(F.slice("w", i, n), " ") for n in sizes] or [F.lit(None).cast("string")]))
    held = docs.select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(F.flatten(runs))).alias("inner"))
    near = asked.where("n > 0").join(held, "inner").select("question_id", "query", "wanted", "doc_id").distinct().join(docs, "doc_id")
    found = near.where("instr(text, wanted) > 0")
    short = asked.where("n <= 0")
    if not short.isEmpty():
        found = found.select("question_id", "query", "doc_id").unionByName(short.join(docs.select("doc_id", "text"), F.expr("instr(text, wanted) > 0")).select("question_id", "query", "doc_id"))
    return found.select("question_id", "query", F.concat(F.lit("doc-"), "doc_id").alias("expected"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    if name == "fx_questions":
        return _questions(spark, sf_dir)
    sql = re.sub(r"\bpos\(", "instr(", FIXTURES[name])
    sql = re.sub(r"\bsha\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", sql).replace("varchar(20)", "string").replace("varchar(4)", "string")
    used = [t for t in _TABLES if re.search(rf"\b(from|join) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
