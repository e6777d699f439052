"""The training-data pipeline over ``documents``: five stages, each on all its predecessor kept.

1. quality      rows that the quality classifier rejects go.
2. near_dedup   one document of each group of near copies stays (five-word shingles, 0.8), and one of rows that
                repeat an id and a text.
3. secrets      every span that the secret scan finds is masked in the text.
4. mixing       a document appears as many times as the mix takes it; those not taken go.
5. encoding     every text is encoded and decoded; ids are counted and digested.

Each function takes (spark, docs, sf_dir).  All but the last return the columns of docs, whatever further ones there are.
Defined results: an empty table gives an empty table; a null text is as an empty one and is judged by its score, links with
nothing, holds no secret and, having no words, is not mixed in; a row with a null id links with nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, secrets, setsketch
from quillspark.llm import quality as subwords
from quillspark.llm.toxicity import labelled_sample
from quillspark.plans.staging import staged

#: A document is rejected under this score: clean documents are to stay, so only clear junk goes.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows of this stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = subwords.train(labelled_sample(docs, labels, "quality", subwords.SAMPLE))
    return subwords.passing(docs, model, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept document of every group; texts without a word link with nothing and stay.

    Of rows that repeat an id (or have none) and a text, the least stays.
    """
    near = staged(setsketch.near_duplicates(docs, k=5, percent=80))
    # written, so that the joins know how small they are; few are dropped, and hardly any id repeats
    dropped = staged(near.where("not kept").select(F.col("doc_id").alias("of")).distinct())
    again = staged(near.where("kept").groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("times")).where("times > 1").select("of"))
    docs = docs.join(dropped, docs.doc_id.eqNullSafe(dropped.of), "left_anti")
    single = docs.join(again, docs.doc_id.eqNullSafe(again.of), "left_anti")
    many = docs.join(again, docs.doc_id.eqNullSafe(again.of), "left_semi")
    one = many.groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("row"))
    return single.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars brought up to date; documents without secrets are unchanged."""
    return secrets.masked(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    mixed = mixing.mix(rows, keep=("row",)).where("size > 0 and taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return mixed.select("row", F.explode(times)).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mixing", mixing_stage), ("encoding", encoding)]

#: The classifier and the tokenizer are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
