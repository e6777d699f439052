"""Markup is escaped on every line of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.queries import QUERIES


def test_markup_inside_a_text_is_escaped(spark, tmp_path):
    texts = ["plain", "a\n* b\n#+c: d\n *e", "*\n\n**", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    escape = lambda t: t and "\n".join(" " + x if x.startswith(("*", "#+")) else x for x in t.split("\n"))
    got = {r.doc_id: r.escaped for r in QUERIES["escape_markup"](spark, str(tmp_path)).collect()}
    assert got == {i: escape(t and "* " + t) for i, t in enumerate(texts)}
