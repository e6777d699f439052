"""Chat logs of four formats as one conversation model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators.links import surviving_branch

_BLOCKS = "array<struct<type:string,text:string,thinking:string>>"
#: Fixed: the shapes of the four formats, as far as they are read.
EXPORT = f"uuid string, name string, created_at string, chat_messages array<struct<uuid:string,sender:string,created_at:string,text:string,content:{_BLOCKS}>>"
TREE = "conversation_id string, title string, create_time double, current_node string, mapping map<string,struct<parent:string,message:struct<role:string,text:string,create_time:double>>>"
ROLLOUT = "type string, timestamp string, payload struct<id:string,cwd:string,type:string,role:string,message:string,text:string,content:array<struct<type:string,text:string>>>"
CLAUDE_CODE = f"type string, uuid string, timestamp string, cwd string, entrypoint string, isMeta boolean, isSidechain boolean, aiTitle string, message struct<id:string,role:string,content:{_BLOCKS}>"
#: Fixed: openings of turns that a tool put into the log.
INJECTED = ("<environment_context>", "<user_instructions>", "<system-reminder>")


def scan_sessions(lines: DataFrame, schema: str) -> DataFrame:
    """lines(path, account, seq, line) -> path, account, seq, r: lines that parse; files without any are gone."""
    return lines.select("path", "account", "seq", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null and r.type is not null")


def read_lines(spark, path: str, depth: int = 2) -> DataFrame:
    """Lines of log files under a folder, with their file, account (a part of the path) and place in the file."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = files.select("path", F.try_element_at(F.split("path", "/"), F.lit(-depth)).alias("account"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return rows.where("trim(line) <> ''")


def shown_blocks(blocks: Column, kind: str, field: str) -> Column:
    """Texts of the blocks of one kind, a blank line between them."""
    return F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: b[field]), lambda x: x.isNotNull() & (x != "")), "\n\n")


def read_claude_export(conversations: DataFrame) -> DataFrame:
    """Rows of EXPORT -> conv, seq, role, at, text, reasoning; without text blocks the message's own text."""
    m = conversations.select(F.col("uuid").alias("conv"), F.posexplode("chat_messages").alias("seq", "m"))
    text = shown_blocks(F.col("m.content"), "text", "text")
    role = F.when(F.col("m.sender") == "human", "user").otherwise("assistant")
    return m.select("conv", "seq", role.alias("role"), F.col("m.created_at").alias("at"), F.when(text != "", text).otherwise(F.coalesce("m.text", F.lit(""))).alias("text"), shown_blocks(F.col("m.content"), "thinking", "thinking").alias("reasoning"))


def read_chatgpt_export(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of TREE -> turns of the surviving branch, and conversations without a current node."""
    bad = conversations.where("current_node is null").select(F.col("conversation_id").alias("conv"))
    nodes = conversations.where("current_node is not null").select(F.col("conversation_id").alias("conv"), F.col("current_node").alias("current"), F.explode("mapping").alias("node", "v"))
    path = surviving_branch(nodes.select("conv", "node", F.col("v.parent").alias("parent"), "current"))
    turns = path.join(nodes.select("conv", "node", "v.message.role", "v.message.text"), ["conv", "node"]).where("role in ('user', 'assistant') and coalesce(text, '') <> ''")
    return turns.select("conv", F.col("depth").alias("seq"), "role", "text"), bad


def first_session_meta(records: DataFrame) -> DataFrame:
    """records(session, seq, r: ROLLOUT) -> session, id, cwd of the first meta record."""
    metas = records.where("r.type = 'session_meta'")
    order = Window.partitionBy("session").orderBy("seq")
    return metas.withColumn("n", F.row_number().over(order)).where("n = 1").select("session", F.col("r.payload.id").alias("id"), F.col("r.payload.cwd").alias("cwd"))


def pending_reasoning(events: DataFrame) -> DataFrame:
    """events(session, seq, kind: turn or reasoning, role, text) -> turns with the reasoning lines since the turn before; only assistants keep theirs."""
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("turn_no", F.coalesce(F.count_if(F.col("kind") == "turn").over(before), F.lit(0)))
    lines = rows.where("kind = 'reasoning'").groupBy("session", "turn_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("pending"))
    turns = rows.where("kind = 'turn'").join(lines, ["session", "turn_no"], "left")
    return turns.select("session", "seq", "role", "text", F.when(F.col("role") == "assistant", F.coalesce("pending", F.lit(""))).otherwise("").alias("reasoning"))


def drop_meta(records: DataFrame) -> DataFrame:
    """Turns that are neither meta nor a side chain."""
    return records.where("coalesce(r.isMeta, false) = false and coalesce(r.isSidechain, false) = false and r.type in ('user', 'assistant')")


def injected(text: Column) -> Column:
    found = F.lit(False)
    for opening in INJECTED:
        found = found | F.ltrim(text).startswith(opening)
    return found


def read_codex_rollout(records: DataFrame) -> DataFrame:
    """records(session, seq, r: ROLLOUT) -> session, seq, role, text, reasoning: event turns, or response items where a session has no event turn."""
    p = F.col("r.payload")
    kind = F.when((F.col("r.type") == "event_msg") & p["type"].isin("user_message", "agent_message"), "turn").when((F.col("r.type") == "event_msg") & (p["type"] == "agent_reasoning"), "reasoning")
    role = F.when(p["type"] == "user_message", "user").otherwise("assistant")
    events = records.select("session", "seq", kind.alias("kind"), role.alias("role"), F.coalesce(p["message"], p["text"]).alias("text")).where("kind is not null").where(~((F.col("kind") == "turn") & (F.col("role") == "user") & injected(F.col("text"))))
    told = pending_reasoning(events)
    items = records.where((F.col("r.type") == "response_item") & (p["type"] == "message") & p["role"].isin("user", "assistant"))
    items = items.select("session", "seq", p["role"].alias("role"), F.array_join(F.transform(p["content"], lambda c: c["text"]), "\n\n").alias("text"), F.lit("").alias("reasoning")).where(~injected(F.col("text")))
    return told.unionByName(items.join(told.select("session").distinct(), "session", "left_anti"))


def drop_programmatic(records: DataFrame) -> DataFrame:
    """Sessions that have entrypoints, none of them cli, are gone; sessions without any stay."""
    entries = records.groupBy("session").agg(F.bool_or(F.col("r.entrypoint") == "cli").alias("cli"), F.count("r.entrypoint").alias("n"))
    return records.join(entries.where("cli or n = 0").select("session"), "session", "left_semi")


def merge_fragments(rows: DataFrame) -> DataFrame:
    """rows(session, seq, key, role, text, reasoning) -> one row per reply, its parts in file order."""
    part = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce(c, F.lit("")).alias("x")))), lambda v: v["x"]), lambda x: x != ""), "\n\n")
    return rows.groupBy("session", "key").agg(F.min("seq").alias("seq"), F.min_by("role", "seq").alias("role"), part("text").alias("text"), part("reasoning").alias("reasoning"))


def read_claude_code(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(session, seq, r: CLAUDE_CODE) -> turns, and the last title of each session."""
    records = drop_programmatic(records)
    titles = records.where("r.aiTitle is not null").groupBy("session").agg(F.max_by("r.aiTitle", "seq").alias("title"))
    own = drop_meta(records)
    rows = own.select("session", "seq", F.coalesce("r.message.id", "r.uuid").alias("key"), F.col("r.message.role").alias("role"), shown_blocks(F.col("r.message.content"), "text", "text").alias("text"), shown_blocks(F.col("r.message.content"), "thinking", "thinking").alias("reasoning"))
    return merge_fragments(rows).where("text <> '' or reasoning <> ''").drop("key"), titles


def assemble_conversation(turns: DataFrame) -> DataFrame:
    """turns(conv, seq, role, text) -> conv, messages, n: blank turns and empty conversations are left out."""
    rows = turns.where(F.col("text").rlike(r"\S")).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("messages"))
    return rows.withColumn("n", F.size("messages").cast("long"))


def render_conversation(conversations: DataFrame) -> DataFrame:
    """conv, text: a heading per turn with its role, markup in the turn escaped."""
    body = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("* "), F.initcap(m["role"]), F.lit("\n"), T.escape_markup(m["text"]))), "\n")
    return conversations.select("conv", body.alias("text"))


def related_threads(sessions: DataFrame) -> DataFrame:
    """sessions(record_id, parent, resumed_from) -> links to the records they came from."""
    kinds = F.array(F.struct(F.lit("parent").alias("relation"), F.col("parent").alias("target")), F.struct(F.lit("resumed").alias("relation"), F.col("resumed_from").alias("target")))
    return sessions.select("record_id", F.explode(kinds).alias("x")).select("record_id", F.lit("record").alias("target_kind"), "x.target", "x.relation").where("target is not null")


def select_conversations(conversations: DataFrame, session: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """conversations(source_id, node_id, started_at): by id, then not before `since` as text with null as '', then the first few."""
    out = conversations
    if session is not None:
        out = out.where((F.col("source_id") == session) | (F.col("node_id") == session))
    if since is not None:
        out = out.where(F.coalesce("started_at", F.lit("")) >= since)
    return out.orderBy("started_at", "source_id").limit(limit) if limit is not None else out


def since_filter(events: DataFrame, since: str) -> DataFrame:
    """events(session, seq, at, modified) -> sessions whose first readable time, else the file's, is not before a date."""
    first = events.groupBy("session").agg(F.min_by(T.parse_time(F.col("at")), F.when(T.parse_time(F.col("at")).isNotNull(), F.col("seq"))).alias("t"), F.max("modified").alias("m"))
    day = F.to_date(F.coalesce("t", "m"))
    return first.where(day >= F.lit(since).cast("date")).select("session", day.alias("day"))
