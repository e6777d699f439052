"""Queries over chat logs, made from the conversations table in each format."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import transcripts as X
from quillspark.queries.fixtures import table
from quillspark.queries.registry import query


def _c(spark, d):
    return table(spark, d, "conversations").withColumn("conv", F.concat(F.lit("c"), F.col("conv_id")))


def _claude_code(spark, d):
    """Each turn as one or two records of one message; conversation 6k is programmatic, a meta line stands in every one."""
    c = _c(spark, d)
    entry = F.when(F.col("conv_id") % 6 == 0, "sdk").when(F.col("conv_id") % 6 == 1, "cli")
    record = lambda seq, text, meta, part: F.struct(
        seq.cast("int").alias("seq"),
        F.struct(
            F.col("role").alias("type"), F.concat_ws("-", "conv", "turn", F.lit(part)).alias("uuid"), F.lit(None).cast("string").alias("timestamp"), F.lit("/w").alias("cwd"), entry.alias("entrypoint"), F.lit(meta).alias("isMeta"),
            F.lit(False).alias("isSidechain"), F.concat(F.lit("T"), F.col("turn")).alias("aiTitle"),
            F.struct(F.concat_ws("-", "conv", "turn").alias("id"), F.col("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("thinking"))).alias("content")).alias("message"),
        ).alias("r"),
    )
    first = record(F.col("turn") * 3, F.col("text"), False, "a")
    second = record(F.col("turn") * 3 + 1, F.concat(F.lit("more "), F.col("turn")), False, "b")
    meta = record(F.col("turn") * 3 + 2, F.lit("meta"), True, "m")
    every = F.when(F.col("turn") % 2 == 0, F.array(first, second, meta)).otherwise(F.array(first, meta))
    return c.select(F.col("conv").alias("session"), F.explode(every).alias("x")).select("session", "x.seq", "x.r")


@query("select conv_id::varchar as conv, turn as seq, case role when 'user' then 'user' else 'assistant' end as role, concat(text, chr(10), chr(10), 'b') as text, 'think' as reasoning from conversations")
def read_claude_export(spark, d):
    c = table(spark, d, "conversations")
    block = lambda kind, text, thought: F.struct(F.lit(kind).alias("type"), text.alias("text"), thought.alias("thinking"))
    none = F.lit(None).cast("string")
    message = F.struct(
        F.col("turn").alias("order"), F.lit("u").alias("uuid"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), none.alias("created_at"), none.alias("text"),
        F.array(block("text", F.col("text"), none), block("tool_use", F.lit("no"), none), block("text", F.lit("b"), none), block("thinking", none, F.lit("think"))).alias("content"),
    )
    export = c.groupBy(F.col("conv_id").cast("string").alias("uuid")).agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))
    return X.read_claude_export(export).select("conv", F.col("seq").cast("long").alias("seq"), "role", "text", "reasoning")


@query("select 'c' || conv_id as conv, turn as seq, case role when 'user' then 'user' else 'assistant' end as role, text from conversations where conv_id % 9 <> 0 and text <> '' and role in ('user', 'assistant')")
def read_chatgpt_export(spark, d):
    c = _c(spark, d)
    node = F.struct(F.col("turn").cast("string").alias("k"), F.struct(F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), F.struct("role", "text", F.lit(None).cast("double").alias("create_time")).alias("message")).alias("v"))
    side = F.struct(F.lit("side").alias("k"), F.struct(F.lit("0").alias("parent"), F.struct(F.lit("user").alias("role"), F.lit("dropped").alias("text"), F.lit(None).cast("double").alias("create_time")).alias("message")).alias("v"))
    tree = c.groupBy("conv", "conv_id").agg(F.collect_list(node).alias("nodes"), F.max("turn").alias("last"))
    tree = tree.select(F.col("conv").alias("conversation_id"), F.lit(None).cast("string").alias("title"), F.when(F.col("conv_id") % 9 != 0, F.col("last").cast("string")).alias("current_node"), F.map_from_entries(F.concat("nodes", F.array(side))).alias("mapping"))
    return X.read_chatgpt_export(tree)[0].withColumn("seq", F.col("seq").cast("long"))


def _rollout(spark, d):
    """Every conversation with meta records, reasoning before assistant turns, and response items; every fifth has items only."""
    c = _c(spark, d)
    none = F.lit(None).cast("string")

    def rec(seq, kind, ptype, role=none, message=none, text=none, pid=none):
        content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
        payload = F.struct(pid.alias("id"), F.lit("/w").alias("cwd"), ptype.alias("type"), role.alias("role"), message.alias("message"), text.alias("text"), content.alias("content"))
        return F.struct(seq.cast("int").alias("seq"), F.struct(F.lit(kind).alias("type"), none.alias("timestamp"), payload.alias("payload")).alias("r"))

    base = F.col("turn") * 4
    meta = rec(base, "session_meta", none, pid=F.concat(F.lit("id"), F.col("turn")))
    thought = rec(base + 1, "event_msg", F.lit("agent_reasoning"), text=F.concat(F.lit("r"), F.col("turn")))
    turn = rec(base + 2, "event_msg", F.when(F.col("role") == "user", "user_message").otherwise("agent_message"), message=F.col("text"))
    item = rec(base + 3, "response_item", F.lit("message"), role=F.when(F.col("role") == "user", "user").otherwise("assistant"))
    every = F.when(F.col("conv_id") % 5 == 0, F.array(meta, item)).otherwise(F.array(meta, thought, turn, item))
    return c.select(F.col("conv").alias("session"), F.explode(every).alias("x")).select("session", "x.seq", "x.r")


_ROLE = "case role when 'user' then 'user' else 'assistant' end"


@query(f"""select 'c' || conv_id as session, (turn * 4 + case when conv_id % 5 = 0 then 3 else 2 end)::int as seq, {_ROLE} as role, text, case when conv_id % 5 <> 0 and role <> 'user' then 'r' || turn else '' end as reasoning from conversations""")
def read_codex_rollout(spark, d):
    return X.read_codex_rollout(_rollout(spark, d))


@query("select 'c' || conv_id as session, 'id' || min(turn) as id, '/w' as cwd from conversations group by conv_id")
def first_session_meta(spark, d):
    return X.first_session_meta(_rollout(spark, d))


@query(f"with c as (select *, lead({_ROLE}) over (partition by conv_id order by turn) as nxt from conversations) select 'c' || conv_id as session, turn * 2 + 1 as seq, {_ROLE} as role, text, case when role <> 'user' then 'r' || turn else '' end as reasoning from c")
def pending_reasoning(spark, d):
    c = _c(spark, d)
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    events = c.select(F.col("conv").alias("session"), (F.col("turn") * 2).alias("seq"), F.lit("reasoning").alias("kind"), F.lit(None).cast("string").alias("role"), F.concat(F.lit("r"), F.col("turn")).alias("text"))
    events = events.union(c.select("conv", F.col("turn") * 2 + 1, F.lit("turn"), role, "text"))
    return X.pending_reasoning(events)


_FRAG = "case when turn % 2 = 0 then concat(text, chr(10), chr(10), 'more ', turn) else text end"


@query(f"select 'c' || conv_id as session, (turn * 3)::int as seq, role, {_FRAG} as text, '' as reasoning from conversations where conv_id % 6 <> 0 and role in ('user', 'assistant')")
def read_claude_code(spark, d):
    return X.read_claude_code(_claude_code(spark, d))[0]


@query(f"select 'c' || conv_id as session, 'c' || conv_id || '-' || turn as key, (turn * 3)::int as seq, role, {_FRAG} as text, '' as reasoning from conversations where role in ('user', 'assistant')")
def merge_fragments(spark, d):
    own = X.drop_meta(_claude_code(spark, d))
    rows = own.select("session", "seq", F.col("r.message.id").alias("key"), F.col("r.message.role").alias("role"), F.col("r.message.content")[0]["text"].alias("text"), F.lit("").alias("reasoning"))
    return X.merge_fragments(rows)


@query("select distinct 'c' || conv_id as session from conversations where conv_id % 6 <> 0")
def drop_programmatic(spark, d):
    return X.drop_programmatic(_claude_code(spark, d)).select("session").distinct()


@query("select 'c' || conv_id as session, count(*) + count_if(turn % 2 = 0) as n from conversations where role in ('user', 'assistant') group by conv_id")
def drop_meta(spark, d):
    return X.drop_meta(_claude_code(spark, d)).groupBy("session").agg(F.count("*").alias("n"))


@query("select 'c' || conv_id as conv, count(*) as n, string_agg(role, ',' order by turn) as roles from conversations where trim(text) <> '' group by conv_id")
def assemble_conversation(spark, d):
    c = _c(spark, d).select("conv", F.col("turn").alias("seq"), "role", "text")
    blank = c.select("conv", F.col("seq") + 1000, "role", F.lit(" \n"))
    return X.assemble_conversation(c.union(blank)).select("conv", "n", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("select 'c' || conv_id as conv, string_agg(concat('* ', upper(role[1]), role[2:], chr(10), text), chr(10) order by turn) as text from conversations group by conv_id")
def render_conversation(spark, d):
    c = _c(spark, d).select("conv", F.col("turn").alias("seq"), "role", "text")
    return X.render_conversation(X.assemble_conversation(c))


@query("select conv, left(coalesce(case when conv_id % 3 = 0 then 'hint' end, case when trim(line) <> '' then trim(line, ' ') end, conv), 80) as title from (select 'c' || conv_id as conv, conv_id, split_part(text, chr(10), 1) as line from conversations where turn = 0)")
def fallback_title(spark, d):
    from quillspark.functions import text as T

    c = _c(spark, d).where("turn = 0")
    return c.select("conv", T.fallback_title(F.when(F.col("conv_id") % 3 == 0, "hint"), F.split("text", "\n")[0], F.col("conv")).alias("title"))


@query("select distinct 'c' || conv_id as record_id, 'record' as target_kind, 'c' || (conv_id - 1) as target, 'parent' as relation from conversations where conv_id % 10 = 9 union all select distinct 'c' || conv_id, 'record', 'c' || (conv_id - 2), 'resumed' from conversations where conv_id % 10 = 5")
def related_threads(spark, d):
    c = _c(spark, d).select("conv", "conv_id").distinct()
    prior = lambda k, m: F.when(F.col("conv_id") % 10 == m, F.concat(F.lit("c"), F.col("conv_id") - k))
    return X.related_threads(c.select(F.col("conv").alias("record_id"), prior(1, 9).alias("parent"), prior(2, 5).alias("resumed_from")))


@query("""select source_id from (select distinct 'c' || conv_id as source_id, case when conv_id % 4 <> 0 then '2024-01-' || lpad((1 + conv_id % 28)::varchar, 2, '0') end as started_at from conversations) where coalesce(started_at, '') >= '2024-01-10' order by started_at, source_id limit 20""")
def select_conversations(spark, d):
    c = _c(spark, d).select("conv", "conv_id").distinct()
    at = F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("conv_id") % 28).cast("string"), 2, "0")))
    rows = c.select(F.col("conv").alias("source_id"), F.lit("n").alias("node_id"), at.alias("started_at"))
    return X.select_conversations(rows, since="2024-01-10", limit=20).select("source_id")


@query("""select session, day from (select 'c' || conv_id as session, case when conv_id % 3 = 0 then date '2024-02-01' else date '2024-01-01' + (conv_id % 28)::int end as day from conversations group by conv_id) where day >= date '2024-01-15'""")
def since_filter(spark, d):
    c = _c(spark, d)
    at = F.when((F.col("conv_id") % 3 != 0) & (F.col("turn") == 0), F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("conv_id") % 28).cast("string"), 2, "0"), F.lit("T10:00:00Z"))).otherwise("no time")
    events = c.select(F.col("conv").alias("session"), F.col("turn").alias("seq"), at.alias("at"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("modified"))
    return X.since_filter(events, "2024-01-15")


@query("select 'p' || conv_id as path, 'a' as account, turn::int as seq, role as type from conversations where turn % 4 <> 3")
def scan_sessions(spark, d):
    c = table(spark, d, "conversations")
    line = F.when(F.col("turn") % 4 == 3, "{broken").otherwise(F.to_json(F.struct(F.col("role").alias("type"), F.struct("role").alias("message"))))
    lines = c.select(F.concat(F.lit("p"), F.col("conv_id")).alias("path"), F.lit("a").alias("account"), F.col("turn").cast("int").alias("seq"), line.alias("line"))
    return X.scan_sessions(lines, X.CLAUDE_CODE).select("path", "account", "seq", "r.type")
