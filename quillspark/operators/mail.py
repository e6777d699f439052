"""Mail: parsing, selection, threads and samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.plans.graph import connected_components

INCREMENT_FOLDERS = ("Inbox", "Archive")


def parse_messages(files: DataFrame) -> DataFrame:
    """files(locator, content binary) -> locator, message_id, from, to, cc, date, epoch, subject, in_reply_to, refs, body.

    A message that cannot be read keeps what can be read as its body.
    """

    def parse(batches):
        import re
        from email import message_from_bytes, policy
        from email.utils import parsedate_to_datetime

        def ids(value: str | None) -> list[str]:
            return re.findall(r"<[^<>\s]+>", value or "")

        for pdf in batches:
            rows = []
            for locator, raw in zip(pdf.locator, pdf.content, strict=True):
                try:
                    m = message_from_bytes(bytes(raw), policy=policy.default)
                    part = m.get_body(preferencelist=("plain", "html"))
                    body = part.get_content() if part is not None else ""
                    if part is not None and part.get_content_subtype() == "html":
                        body = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", body)).strip()
                    one = lambda n, m=m: " ".join(str(m.get(n, "") or "").split())
                    try:
                        epoch = int(parsedate_to_datetime(one("date")).timestamp())
                    except (TypeError, ValueError):
                        epoch = None
                    own = ids(one("message-id"))
                    rows.append((locator, own[0] if own else "", one("from"), one("to"), one("cc"), one("date"), epoch, one("subject"), (ids(one("in-reply-to")) or [""])[0], ids(one("references")), body.replace("\r\n", "\n")))
                except Exception:  # noqa: BLE001  any input is mail to somebody
                    rows.append((locator, "", "", "", "", "", None, "", "", [], bytes(raw).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["locator", "message_id", "from", "to", "cc", "date", "epoch", "subject", "in_reply_to", "refs", "body"]).astype({"epoch": "Int64"})

    return files.select("locator", "content").mapInPandas(parse, "locator string, message_id string, `from` string, `to` string, cc string, date string, epoch long, subject string, in_reply_to string, refs array<string>, body string")


def render_message(m: DataFrame) -> Column:
    """Headers in fixed order, blank ones left out, a blank line, the body."""
    def head(name: str, col: str) -> Column:
        return F.when(F.trim(F.coalesce(col, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), F.trim(col)))

    names = [("From", "from"), ("To", "to"), ("Cc", "cc"), ("Date", "date"), ("Subject", "subject"), ("Message-ID", "message_id")]
    return F.concat_ws("\n", *[head(n, c) for n, c in names if c in m.columns], F.concat(F.lit("\n"), F.col("body")))


def increment_scope(messages: DataFrame, folders: tuple = INCREMENT_FOLDERS) -> DataFrame:
    return messages.where(F.col("folder").isin(*folders))


def select_mail(catalogue: DataFrame, truth: DataFrame) -> DataFrame:
    """catalogue(message_id, folder, bulk), truth(message_id) -> message_id, status: selected, override, excluded, out_of_scope or missing."""
    rows = catalogue.join(truth.select("message_id", F.lit(True).alias("wanted")), "message_id", "full_outer")
    wanted = F.coalesce("wanted", F.lit(False))
    status = (
        F.when(F.col("folder").isNull(), "missing").when(~F.col("folder").isin(*INCREMENT_FOLDERS) & ~wanted, "out_of_scope")
        .when(~F.col("bulk") & F.col("folder").isin(*INCREMENT_FOLDERS), "selected").when(wanted, "override").otherwise("excluded")
    )
    return rows.select("message_id", status.alias("status"))


def mail_scope(catalogue: DataFrame, truth: DataFrame, drifted: DataFrame) -> DataFrame:
    """One row of counts."""
    s = select_mail(catalogue, truth)
    n = lambda *v: F.count_if(F.col("status").isin(*v))
    got = s.agg(n("selected", "override", "excluded", "out_of_scope").alias("catalogued"), n("selected", "override").alias("selected"), n("excluded").alias("excluded"), n("missing").alias("missing"))
    return got.join(truth.agg(F.count("*").alias("ground_truth")), how="cross").join(drifted.agg(F.count("*").alias("drifted")), how="cross")  # one row each


def thread_edges(messages: DataFrame) -> DataFrame:
    """messages(message_id, in_reply_to, refs) -> u, v: replies and references between messages that are there."""
    every = messages.select("message_id", F.explode(F.array_distinct(F.concat(F.coalesce("refs", F.array().cast("array<string>")), F.array("in_reply_to")))).alias("v")).where("v <> ''")
    return every.join(messages.select(F.col("message_id").alias("v")).distinct(), "v").select(F.col("message_id").alias("u"), "v").distinct()


def threads(messages: DataFrame) -> DataFrame:
    """message_id, thread_id: messages in threads of two or more."""
    return connected_components(thread_edges(messages)).select(F.col("node").alias("message_id"), F.col("component").alias("thread_id"))


def thread_order(members: DataFrame) -> DataFrame:
    """members(thread_id, message_id, epoch) -> also position and root, by time, then id."""
    w = Window.partitionBy("thread_id").orderBy("epoch", "message_id")
    return members.withColumn("position", F.row_number().over(w)).withColumn("root", F.first("message_id").over(w))


def thread_records(members: DataFrame) -> DataFrame:
    """members(thread_id, message_id, epoch, sender, body) -> thread_id, root, n, text: all messages in order, each behind a From line."""
    one = F.struct("epoch", "message_id", F.concat(F.lit("From "), F.col("sender"), F.lit("\n"), F.col("body")).alias("text"))
    rows = members.groupBy("thread_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return rows.select("thread_id", F.col("m")[0]["message_id"].alias("root"), F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"))


def joined_threads(messages: DataFrame, owner: Column) -> DataFrame:
    """Ids of threads the owner wrote into: the owner's messages and all they answer or refer to."""
    mine = messages.where(owner).select(F.explode(F.concat(F.array("message_id", "in_reply_to"), F.coalesce("refs", F.array().cast("array<string>")))).alias("message_id"))
    return mine.where("message_id <> ''").distinct()


def disputed_bulk(messages: DataFrame, owner: Column) -> DataFrame:
    """Bulk by rule, but part of a thread the owner wrote into."""
    return messages.where(~owner & F.col("bulk")).join(joined_threads(messages, owner), "message_id", "left_semi").select("message_id")


def stratified_sample(messages: DataFrame, size: int, seed: int) -> DataFrame:
    """messages(message_id, year) -> `size` ids, an equal part of each year, topped up from the rest; order by a hash of the id."""
    key = F.md5(F.concat(F.col("message_id"), F.lit(f":{seed}")))
    years = messages.select("year").distinct().count()
    part = max(1, size // max(1, years))
    ranked = messages.withColumn("key", key).withColumn("r", F.row_number().over(Window.partitionBy("year").orderBy("key", "message_id")))
    return ranked.orderBy(F.col("r") > part, "key", "message_id").limit(size).select("message_id", "year")


def write_sample(sample: DataFrame, total: int, seed: int) -> DataFrame:
    """One JSON report: seed, total, and the sample, which is bounded by its own size."""
    return sample.agg(F.to_json(F.struct(F.lit(seed).alias("seed"), F.lit(total).alias("total"), F.array_sort(F.collect_list("message_id")).alias("sample"))).alias("report"))


def bulk(messages: DataFrame) -> DataFrame:
    return messages.withColumn("bulk", T.classify_bulk(F.col("raw")).isNotNull())
