"""Conversations: formats, chunks, episodes, ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import CHARS_PER_TOKEN, CHUNK_GAP_MINUTES, CHUNK_MESSAGES, CHUNK_TOKENS
from mnemora.functions.text import normalize, trim_all

#: (conv_id, turn, role, text[, ts, name, tool_name])
MESSAGE = "conv_id, turn, role, text"


def sessions(events: DataFrame, key: str, ts: str, gap_minutes: int = CHUNK_GAP_MINUTES, order: str | None = None) -> DataFrame:
    """Events with a session number a key: a session ends where the next event comes more than the gap later."""
    w = Window.partitionBy(key).orderBy(ts, *([order] if order else []))
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) > gap_minutes * 60_000_000
    marked = events.withColumn("_new", F.when(gap, 1).otherwise(0))
    return marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def token_estimate(text: Column, role: Column) -> Column:
    """Characters that a message adds to a chunk; a chunk has a quarter as many tokens, rounded up."""
    return F.length(text) + F.length(role) + 2


def chunks(messages: DataFrame, max_messages: int = CHUNK_MESSAGES, max_tokens: int = CHUNK_TOKENS, gap_minutes: int = CHUNK_GAP_MINUTES) -> DataFrame:
    """Messages (conv_id, turn, role, text, optional ts) with ``chunk``: the rules are applied message by message within each conversation.

    A gap ends a chunk; so does a full one, by messages or tokens, but an answer right after a question still joins it. What a message
    joins depends on all before it, so each conversation is folded in order, in one pass over its sizes, roles and times; no text is moved.
    """
    ts = F.unix_micros(F.col("ts").cast("timestamp_ntz").cast("timestamp")) if "ts" in messages.columns else F.lit(None).cast("long")
    sizes = messages.select("conv_id", "turn", "role", token_estimate(F.col("text"), F.col("role")).cast("long").alias("size"), ts.alias("at"))
    gap = gap_minutes * 60_000_000

    def fold(table):
        import pyarrow as pa

        table = table.sort_by("turn")
        out, chunk, n, chars, asked, last = [], 0, 0, 0, False, None
        for role, size, at in zip(*(table.column(c).to_pylist() for c in ("role", "size", "at")), strict=True):
            if n and last is not None and at is not None and at - last > gap:
                chunk, n, chars = chunk + 1, 0, 0
            full = n >= max_messages or (n > 0 and -(-(chars + (size or 0)) // CHARS_PER_TOKEN) > max_tokens)
            if full and n > 0 and role == "assistant" and asked:  # an answer is drawn into the full chunk, which ends after it
                out.append(chunk)
                chunk, n, chars = chunk + 1, 0, 0
            else:
                if full:
                    chunk, n, chars = chunk + 1, 0, 0
                out.append(chunk)
                n, chars = n + 1, chars + (size or 0)
            asked, last = role == "user", at
        return pa.table([table.column("conv_id"), table.column("turn"), pa.array(out, pa.int32())], names=["conv_id", "turn", "chunk"])

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    placed = sizes.groupBy("conv_id").applyInArrow(fold, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, chunk int")
    return messages.join(placed, ["conv_id", "turn"])


def topic(first_user: Column) -> Column:
    t = trim_all(first_user)
    return F.when(F.length(t) <= 80, t).otherwise(F.concat(F.substring(t, 1, 77), F.lit("...")))


def _plural(n: Column, word: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, F.lit("s")).otherwise(F.lit(""))))


def chunk_episodes(chunked: DataFrame) -> DataFrame:
    """Episodes of chunked messages: title, summary, content, token estimate."""
    name = F.coalesce(F.col("name"), F.col("role")) if "name" in chunked.columns else F.col("role")
    line = F.concat(F.lit("["), name, F.lit("]: "), F.col("text"))
    user, answer, tool = (F.count_if(F.col("role") == r) for r in ("user", "assistant", "tool"))
    tools = F.array_sort(F.collect_set("tool_name")) if "tool_name" in chunked.columns else F.array().cast("array<string>")
    g = chunked.groupBy("conv_id", "chunk").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"),
        user.alias("users"), answer.alias("answers"), tool.alias("tools"), tools.alias("tool_names"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("content"),
        F.ceil(F.sum(token_estimate(F.col("text"), F.col("role"))) / CHARS_PER_TOKEN).cast("long").alias("tokens"), F.count(F.lit(1)).alias("messages"),
    )
    used = F.when(F.col("tools") > 0, F.concat(F.lit("tools: "), F.when(F.size("tool_names") > 0, F.array_join("tool_names", ", ")).otherwise(F.lit("unnamed"))))
    parts = F.array_join(F.array_compact(F.array(_plural(F.col("users"), "user message"), _plural(F.col("answers"), "assistant response"), used)), ", ")
    return g.select(
        "conv_id", "chunk", F.coalesce(topic(F.col("first_user")), F.lit("Untitled conversation")).alias("title"), F.concat(F.lit("Conversation chunk with "), parts).alias("summary"),
        "content", "tokens", "messages", F.lit("conversation").alias("type"), F.lit(0.5).alias("importance"),
    )


def chat_entities(chunked: DataFrame, aliases: dict[str, str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Entities of chunks (conv_id, chunk, turn, role, text[, name, tool_name]): conv_id, chunk, name, label, type, confidence, speakers, excerpts.

    System messages name nothing; a tool's name and a user's name are entities too. Of each normalised name in a chunk the most confident
    mention counts, the first of equals, with all who mention it; excerpts are the first three messages of the chunk that contain it.
    """
    from mnemora.operators import extract

    given = lambda c: F.col(c) if c in chunked.columns else F.lit(None).cast("string")
    m = chunked.select("conv_id", "chunk", "turn", "role", "text", given("name").alias("_n"), given("tool_name").alias("_t"))
    said = m.filter("role <> 'system'").withColumn("speaker", F.coalesce("_n", "role"))
    whose = F.struct("conv_id", "chunk", "turn", "speaker")
    sections = said.select(whose.alias("file"), F.lit("").alias("section"), F.lit("notes").alias("heading"), F.lit(0).cast("long").alias("line"), F.col("text").alias("content"))
    found = extract.structural(sections, extract.CHAT_NOISE).unionByName(extract.custom(sections, extract.CHAT_TOOLS)).filter("type <> 'tag'")
    rank = F.when((F.col("extractor") == "custom") & (F.col("type") == "tool") & (F.col("confidence") == 0.9), 0).when(F.col("extractor") == "structural", 1).otherwise(2)
    columns = ["file.*", "text", "type", "confidence"]
    rows = found.select(*columns, rank.alias("k"), "ord")
    extra = lambda condition, c, kind: said.filter(condition).select(whose.alias("file"), F.col(c).alias("text"), F.lit(kind).alias("type"), F.lit(0.95).alias("confidence")).select(*columns, F.lit(3).alias("k"), F.lit(0).cast("long").alias("ord"))
    rows = rows.unionByName(extra("role = 'tool' and _t is not null", "_t", "tool")).unionByName(extra("role = 'user' and _n is not null", "_n", "person"))
    key = normalize(F.col("text"))
    rows = rows.filter(~key.isin(*extract.CHAT_STOPWORDS, *(x.lower() for x in ignore or [])))
    if aliases:
        rows = rows.withColumn("text", F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[key], F.col("text")))
    rows = rows.withColumn("name", normalize(F.col("text"))).filter("name <> ''")
    order = F.struct((-F.col("confidence")).alias("c"), "turn", "k", "ord")
    best = rows.groupBy("conv_id", "chunk", "name").agg(F.min_by(F.struct("text", "type", "confidence"), order).alias("b"), F.min(F.struct("turn", "k", "ord")).alias("first"), F.sort_array(F.collect_set("speaker")).alias("speakers"))
    best = best.select("conv_id", "chunk", "name", F.col("b.text").alias("label"), "b.type", "b.confidence", "first", "speakers")
    # a chunk has few messages, so its names are held against all of them
    near = best.select("conv_id", "chunk", "name", normalize(F.col("label")).alias("n")).join(m.select("conv_id", "chunk", "turn", "text"), ["conv_id", "chunk"]).filter(F.lower("text").contains(F.col("n")))
    w = Window.partitionBy("conv_id", "chunk", "name").orderBy("turn")
    near = near.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("conv_id", "chunk", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.substring("text", 1, 200).alias("t")))), lambda x: x["t"]).alias("excerpts"))
    return best.join(near, ["conv_id", "chunk", "name"], "left").withColumn("excerpts", F.coalesce("excerpts", F.array().cast("array<string>")))


def content_hash(messages: DataFrame) -> DataFrame:
    """(conv_id, content_hash) of whole conversations."""
    line = F.concat_ws(":", "role", "text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")
    return messages.groupBy("conv_id").agg(F.substring(F.sha2(text, 256), 1, 32).alias("content_hash"))


def new_conversations(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """The conversations to ingest: of each content the one with the least id, none whose id or content was ingested before. seen: conv_id, content_hash."""
    h = content_hash(messages).join(seen.select("conv_id"), "conv_id", "left_anti").join(seen.select("content_hash"), "content_hash", "left_anti")
    return h.groupBy("content_hash").agg(F.min("conv_id").alias("conv_id")).select("conv_id", "content_hash")


# formats


def from_tool_calls(raw: DataFrame) -> DataFrame:
    """Messages of chat exports: rows (conv_id, turn, role, content, tool_calls array<struct<name,arguments>>); each call is a message of its own after its message."""
    calls = F.coalesce("tool_calls", F.array().cast("array<struct<name:string,arguments:string>>"))
    own = F.when(F.col("content").isNotNull(), F.array(F.struct(F.col("role").alias("role"), F.col("content").alias("text"), F.lit(None).cast("string").alias("tool_name"))))
    each = F.transform(calls, lambda c: F.struct(F.lit("tool").alias("role"), F.concat(F.lit("Called "), c["name"], F.lit("("), F.coalesce(c["arguments"], F.lit("")), F.lit(")")).alias("text"), c["name"].alias("tool_name")))
    every = F.concat(F.coalesce(own, F.array().cast("array<struct<role:string,text:string,tool_name:string>>")), each)
    return raw.select("conv_id", "turn", F.posexplode(every).alias("p", "m")).select("conv_id", (F.col("turn") * 1000 + F.col("p")).alias("turn"), "m.role", "m.text", "m.tool_name")


def from_blocks(raw: DataFrame) -> DataFrame:
    """Messages of block exports: rows (conv_id, turn, role, blocks array<struct<type,text,name,input,content>>): text, tool_use and tool_result in order."""
    one = lambda b: F.when(b["type"] == "text", F.struct(F.col("role").alias("role"), b["text"].alias("text"), F.lit(None).cast("string").alias("tool_name"))).when(
        b["type"] == "tool_use", F.struct(F.lit("tool").alias("role"), F.concat(F.lit("Called "), b["name"], F.lit("("), F.coalesce(b["input"], F.lit("{}")), F.lit(")")).alias("text"), b["name"].alias("tool_name"))
    ).when(b["type"] == "tool_result", F.struct(F.lit("tool").alias("role"), b["content"].alias("text"), F.lit(None).cast("string").alias("tool_name")))
    rows = F.filter(F.transform("blocks", one), lambda x: x.isNotNull() & F.coalesce(x["text"] != "", F.lit(False)))
    return raw.select("conv_id", "turn", F.posexplode(rows).alias("p", "m")).select("conv_id", (F.col("turn") * 1000 + F.col("p")).alias("turn"), "m.role", "m.text", "m.tool_name")


def from_json_lines(lines: DataFrame) -> DataFrame:
    """Messages of JSON lines (conv_id, turn, line): content, text or message; lines that are no objects, or empty, are passed over."""
    x = F.from_json("line", "role string, content string, text string, message string, timestamp string", {"mode": "PERMISSIVE"})
    out = lines.select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", F.coalesce("x.role", F.lit("user")).alias("role"), F.coalesce("x.content", "x.text", "x.message").alias("text"), F.col("x.timestamp").alias("ts"))
    return out.filter("text is not null and text <> ''")


def from_sessions(raw: DataFrame) -> DataFrame:
    """Messages of session exports (conv_id, turn, role, content): an unknown role is a user's."""
    role = F.when(F.col("role").isin("user", "assistant", "system", "tool"), F.col("role")).otherwise("user")
    return raw.select("conv_id", "turn", role.alias("role"), F.col("content").alias("text"))


def detect_format(raw: Column) -> Column:
    """Which of the formats a file's text is in."""
    first = F.get_json_object(F.when(raw.rlike(r"^\s*\["), raw).otherwise(F.get_json_object(raw, "$.messages")), "$[0]")
    content = F.get_json_object(first, "$.content")
    return (
        F.when(F.get_json_object(raw, "$.sessionId").isNotNull() | F.get_json_object(raw, "$.session").isNotNull(), "session")
        .when(first.isNull(), "jsonl")
        .when(content.rlike(r"^\s*\["), "blocks")
        .when(F.get_json_object(first, "$.role").isNotNull(), "chat")
        .otherwise("jsonl")
    )
