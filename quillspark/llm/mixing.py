"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a share of the budget by its weight, at most `most_epochs` times its own
size; what is above is shared again by weight.  The target of a source is so many complete
epochs of all its documents plus a fraction.  The fraction is a weighted sample: documents
sort by -ln(u) / quality, an exponential key, and are taken while the prefix sum of sizes
stays within the fraction; the document at the border is taken if that comes nearer.

A source's prefix sum is never one task.  Keys fall into buckets of a few thousand
documents: a key of a document of quality q is exponential with rate q, so the share of a
source's keys under a key follows from how its qualities are distributed, and buckets cut
that share evenly whatever the qualities are.  Bucket sums are prefix-summed per source;
the one bucket at the border is ordered row by row, and its last row taken is the cut.
Every other document decides by its own key, so no text is moved.

Defined results: a null or blank text has size 0 and is taken 0 times its size; a null
source is a source of its own, ordered last; documents with equal keys are ordered by id,
then size; rows alike in id and size are taken together or not at all, by the nearer side;
null ids share a key and are ordered by size; an empty table gives no rows; of further
columns only those asked for are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.plans.staging import Scratch, staged

#: Fixed: the word pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Source weights by the order of their names, repeating.
WEIGHTS = (3, 1, 2)
BUCKET = 4096
#: Classes of quality whose counts stand for a source's distribution.
CLASSES = 16
#: Characters that prose has few of: digits and marks of markup, tables and encoded data.
MARKS = "0123456789*%$&#|<>=+/\\@^~_{}[]()"
#: Characters a word that prose has on average.
LEAST_WORD, MOST_WORD = 2.5, 12.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """The fourth power of the share of characters not in MARKS, halved where words are not as long as in prose; at least 0.05."""
    plain = F.length(F.translate(text, MARKS, "")) / F.greatest(F.length(text), F.lit(1))
    word = F.length(F.translate(text, " \t\n\x0b\f\r", "")) / F.greatest(size, F.lit(1))
    prose = F.when(word.between(LEAST_WORD, MOST_WORD), 1.0).otherwise(0.5)
    return F.coalesce(F.greatest(F.lit(0.05), plain * plain * plain * plain * prose), F.lit(1.0)).cast("double")


def key_of(doc_id: Column, quality: Column, seed: str) -> Column:
    """-ln(u) / quality with u from a hash of the id, so reruns agree."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / quality


def targets(sources: DataFrame, share: float, most_epochs: int, weights: tuple) -> DataFrame:
    """sources(source, source_size, n) -> also target: weighted shares of `share` times all sizes, each at most most_epochs of its source.

    One row per source, so its windows see source names and not documents.  Sharing the
    excess again and again ends at min(cap, level * weight), and the level is where the
    sources sorted by cap / weight stop being full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = sources.withColumn("i", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights)).cast("int") + 1))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    w = w.withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", "i").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("fill", "i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    w = w.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything))
    return w.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("source", "source_size", "n", "target")


def _measured(docs: DataFrame, seed: str, size: Column | None, quality: Column | None, keep: tuple) -> DataFrame:
    """(doc_id, source, size, quality, key) and, under a prefix, the columns in keep."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (size if size is not None else size_of(F.col("text"))).cast("long").alias("size"),
        (F.lit(None) if quality is not None else F.col("text")).alias("text"), (quality if quality is not None else F.lit(None)).cast("double").alias("quality"), *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    rows = rows.withColumn("quality", F.coalesce("quality", quality_of(F.col("text"), F.col("size")))).drop("text")
    return rows.withColumn("key", key_of(F.col("doc_id"), F.col("quality"), seed))


def _bucketed(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """rows with their source's aims and the bucket: the share of the source's keys expected under the key, cut evenly."""
    rows = rows.join(aims.withColumnRenamed("source", "of"), rows.source.eqNullSafe(F.col("of"))).drop("of")
    over = F.aggregate("mixture", F.lit(0.0), lambda a, x: a + x["share"] * F.exp(-x["rate"] * F.col("key")))
    return rows.withColumn("bucket", F.floor((1 - over) * F.col("buckets")).cast("long"))


def plan(rows: DataFrame, share: float = 1.5, most_epochs: int = 2, weights: tuple = WEIGHTS) -> DataFrame:
    """rows(doc_id, source, size, quality, key) -> one row per source: sizes, target, epochs, and the border bucket and row of the fraction."""
    classes = rows.groupBy("source", F.floor(F.col("quality") * CLASSES).alias("class")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.sum("quality").alias("q"))
    sources = classes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("class", "n", "q"))).alias("classes"))
    with Scratch() as scratch:
        sources = scratch(sources)
        aims = targets(sources.drop("classes"), share, most_epochs, weights)
        aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        aims = aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("n") / BUCKET))
        mixture = sources.select(F.col("source").alias("of"), F.expr("transform(classes, x -> struct(x.n / n as share, x.q / x.n as rate))").alias("mixture"))
        # written, so that its size is known when the rows meet it
        aims = scratch(aims.join(mixture, aims.source.eqNullSafe(mixture.of)).drop("of"))
        placed = _bucketed(rows, aims)
        sums = placed.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("in_bucket"))
        earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("earlier", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
        border = scratch(sums.where("earlier <= rest").groupBy("source").agg(F.max("bucket").alias("border"), F.max("earlier").alias("earlier")))
        near = border.withColumnRenamed("source", "of")
        inside = placed.join(near, placed.source.eqNullSafe(near.of) & (placed.bucket == near.border)).groupBy("source", "rest", "earlier", "key", "doc_id", "size").agg(F.count("*").alias("alike"))
        before = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        words = F.col("alike") * F.col("size")
        inside = inside.withColumn("upto", F.col("earlier") + F.coalesce(F.sum(words).over(before), F.lit(0)))
        cut = inside.where(F.col("upto") + words / 2 <= F.col("rest")).groupBy(F.col("source").alias("of")).agg(F.max(F.struct("key", "doc_id", "size")).alias("cut"))
        out = aims.join(border.select(F.col("source").alias("at"), "border"), aims.source.eqNullSafe(F.col("at")), "left").drop("at")
        return staged(out.join(cut, out.source.eqNullSafe(cut.of), "left").drop("of"))


def mix(docs: DataFrame, share: float = 1.5, most_epochs: int = 2, weights: tuple = WEIGHTS, seed: str = "mix", keep: tuple = (), size: Column | None = None, quality: Column | None = None) -> DataFrame:
    """-> doc_id, size, source_size, target, taken and the columns in `keep`; needs doc_id, source and text."""
    rows = staged(_measured(docs, seed, size, quality, ()))
    aims = plan(rows, share, most_epochs, weights)
    placed = _bucketed(_measured(docs, seed, size, quality, keep) if keep else rows, aims)
    sampled = (F.col("bucket") < F.col("border")) | ((F.col("bucket") == F.col("border")) & F.coalesce(F.struct("key", "doc_id", "size") <= F.col("cut"), F.lit(False)))
    taken = F.col("epochs") + F.when(sampled, 1).otherwise(0)
    taken = F.least(taken, F.lit(most_epochs)) * F.col("size")
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"kept_{c}").alias(c) for c in keep])
