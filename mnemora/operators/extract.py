"""Mentions in sections of notes and in messages."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import ENTITY_STOPWORDS, normalize, strip_markdown, trim_all
from mnemora.operators.tagger import Tagger, tagged_names

#: Headings that name no entity.
GENERIC_HEADINGS = ("projects", "tools", "lessons", "decisions", "events", "notes", "summary", "overview", "research", "implementation", "architecture", "intro", "(intro)")
#: Names of tools that are known at sight.
KNOWN_TOOLS = (
    "Claude Code", "Codex", "Vite", "tmux", "Three.js", "VS Code", "Git", "Docker", "Playwright", "TypeScript", "JavaScript", "Node.js", "npm", "React", "Next.js",
    "Bun", "Webpack", "ESLint", "Prettier", "D3.js", "SQLite", "WebGL", "Esbuild", "tsup", "remark", "unified", "Hono", "Express", "Prisma",
)
#: Names of tools that are known at sight in chats.
CHAT_TOOLS = (
    "Claude Code", "Codex", "Vite", "tmux", "Three.js", "VS Code", "Git", "Docker", "Playwright", "TypeScript", "JavaScript", "Node.js", "npm", "React", "Next.js",
    "Bun", "Webpack", "ESLint", "Prettier", "SQLite", "WebGL", "tsup", "Hono", "Express", "Prisma", "Python", "Rust", "Go", "PostgreSQL", "Redis", "Kubernetes", "AWS", "Terraform",
)
#: Words of chats that name no entity.
CHAT_STOPWORDS = (
    "the it this that a an is was are were be been being have has had also just very good great well much big day today "
    "yes no ok okay sure thanks thank please hello hi hey bye yeah yep nope right let me"
).split()
CAUSAL_RE = r"(?i)(led to|because of|resulted in|caused by|due to|which meant|this meant)\s"
#: What makes a code token no name.
NOISE = {
    "path or address": r"^(/|\./|\.\./|~|https?://|file://|MEDIA:)|/",
    "command with flags": r"\s--|\s-[a-zA-Z]",
    "network address": r"^\d+\.\d+\.\d+\.\d+(:\d+)?\z|localhost:\d+|127\.0\.0\.1|172\.17\.",
    "mount": r":rw|:ro",
    "code or a pattern": r"[{}()=<>&|$+^~]|^\\.",
}
#: In chats a statement's end is noise too.
CHAT_NOISE = NOISE | {"statement": r";"}
WORD_EDGE = "(^|[^A-Za-z0-9_])"


def noisy(token: Column, rules: dict[str, str] = NOISE) -> Column:
    """Whether a code token is a path, an address, a command or the like."""
    return token.rlike("|".join(f"(?:{x})" for x in rules.values()))


def _found(text: Column, pattern: str, kind: str, confidence: float, prefix: str = "") -> Column:
    """array<struct<text, type, confidence>> of a pattern's first group."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), trim_all)
    return F.transform(hits, lambda x: F.struct(F.concat(F.lit(prefix), x).alias("text"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))


def _rows(sections: DataFrame, found: Column, extractor: str, base: int) -> DataFrame:
    out = sections.select("file", "section", "line", F.posexplode(found).alias("p", "x"))
    return out.select("file", "section", "line", "x.text", "x.type", "x.confidence", F.lit(extractor).alias("extractor"), (F.col("p") + base).cast("long").alias("ord"))


def structural(sections: DataFrame, noise: dict[str, str] = NOISE) -> DataFrame:
    """Mentions of sections (file, section, heading, line, content): wikilinks, bold, code and headings."""
    return _rows(sections, _structural(noise), "structural", 1_000_000)


def _structural(noise: dict[str, str]) -> Column:
    c = F.col("content")
    bold = F.filter(_found(c, r"\*\*([^*]+)\*\*", "concept", 0.7), lambda x: F.length(x["text"]) > 2)
    code = F.filter(_found(c, r"`([^`]+)`", "tool", 0.7), lambda x: (F.length(x["text"]) > 1) & (F.length(x["text"]) <= 40) & ~noisy(x["text"], noise))
    h = trim_all(F.lower("heading"))
    head = F.when(~h.isin(*GENERIC_HEADINGS) & (F.length(h) > 2), F.array(F.struct(F.col("heading").alias("text"), F.lit("concept").alias("type"), F.lit(0.6).alias("confidence"))))
    empty = F.array().cast("array<struct<text:string,type:string,confidence:double>>")
    return F.concat(_found(c, r"\[\[([^\]]+)\]\]", "concept", 0.9), bold, code, F.coalesce(head, empty))


def custom(sections: DataFrame, tools: tuple[str, ...] = KNOWN_TOOLS, projects: tuple[str, ...] = (), people: tuple[str, ...] = ()) -> DataFrame:
    """Mentions of known names (each once a section), repositories, tags and scoped packages."""
    return _rows(sections, _custom(tools, projects, people), "custom", 3_000_000)


def _custom(tools: tuple[str, ...], projects: tuple[str, ...] = (), people: tuple[str, ...] = ()) -> Column:
    c = F.col("content")
    known = [(n, "tool", 0.9, "(?i)") for n in tools] + [(n, "project", 0.9, "(?i)") for n in projects] + [(n, "person", 0.95, "") for n in people]
    tests = [F.when(F.lower(c).contains(n.lower()) & c.rlike(f"{f}{WORD_EDGE}{re.escape(n)}([^A-Za-z0-9_]|\\z)"), F.struct(F.lit(n).alias("text"), F.lit(k).alias("type"), F.lit(p).alias("confidence"))) for n, k, p, f in known]
    names = none = F.array().cast("array<struct<text:string,type:string,confidence:double>>")
    if tests:  # plain searches first: few texts have any name
        named = F.exists(F.array(F.lower(c)), lambda low: reduce(or_, [low.contains(n.lower()) for n, *_ in known]))
        names = F.when(named, F.array_compact(F.array(*tests))).otherwise(none)
    rest = F.concat(
        _found(c, r"github\.com/([a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+)", "project", 0.9), _found(c, r"#([a-zA-Z][A-Za-z0-9_]+)", "tag", 0.8), _found(c, r"@([a-z0-9_-]+/[a-z0-9_-]+)", "tool", 0.8, "@")
    )
    return F.concat(names, rest)


def structural_and_custom(sections: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The mentions of ``structural`` and ``custom`` in one pass over the sections, with further columns of theirs (keep)."""
    placed = lambda found, base: F.transform(found, lambda x, p: F.struct(x["text"].alias("text"), x["type"].alias("type"), x["confidence"].alias("confidence"), (p + base).cast("long").alias("ord")))
    every = F.concat(placed(_structural(NOISE), 1_000_000), placed(_custom(KNOWN_TOOLS), 3_000_000))
    return sections.select("file", "section", *keep, F.explode(every).alias("x")).select("file", "section", *keep, "x.text", "x.type", "x.confidence", "x.ord")


def tagged(sections: DataFrame, people: tuple[str, ...] = (), places: tuple[str, ...] = ()) -> DataFrame:
    """Names without a fitted tagger (tagged_by takes one): gazetteers of people and places, and runs of capitalised words as organisations (projects)."""
    c = strip_markdown(F.col("content"))
    runs = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"((?:[A-Z][a-z]+ )+(?:Inc|Corp|Labs|Foundation|University|Institute|Company))"), F.lit(1)), trim_all), lambda x: ~F.lower(x).isin(*ENTITY_STOPWORDS))
    orgs = F.transform(F.array_distinct(runs), lambda x: F.struct(x.alias("text"), F.lit("project").alias("type"), F.lit(0.6).alias("confidence")))
    named = [(n, "person", 0.8) for n in people] + [(n, "place", 0.7) for n in places]
    tests = [F.when(c.rlike(f"{WORD_EDGE}{re.escape(n)}([^A-Za-z0-9_]|\\z)"), F.struct(F.lit(n).alias("text"), F.lit(k).alias("type"), F.lit(p).alias("confidence"))) for n, k, p in named]
    found = F.concat(F.array_compact(F.array(*tests)), orgs) if tests else orgs
    return _rows(sections, found, "nlp", 2_000_000)


def tagged_by(sections: DataFrame, tagger: Tagger) -> DataFrame:
    """Mentions that a fitted sequence tagger finds in the sections' running text."""
    own = tagged_names(sections.withColumn("_c", strip_markdown(F.col("content"))), tagger, F.col("_c"))
    return _rows(own, F.filter("names", lambda x: ~F.lower(x["text"]).isin(*ENTITY_STOPWORDS) & (F.length(x["text"]) > 1)), "nlp", 2_000_000)


def causal(sections: DataFrame) -> DataFrame:
    """Sections whose text has a causal phrase."""
    return sections.filter(F.col("content").rlike(CAUSAL_RE))


def strongest(mentions: DataFrame) -> DataFrame:
    """One mention of each normalised text a section: the most confident, the first of equals."""
    w = Window.partitionBy("file", "section", "name").orderBy(F.desc("confidence"), "ord")
    m = mentions.withColumn("name", normalize(F.col("text"))).filter("name <> ''")
    return m.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


#: Kinds that a language model may answer with.
ANSWERED = ("person", "project", "tool", "concept", "decision", "event", "lesson", "place", "tag")


def model_prompts(sections: DataFrame, kinds: tuple[str, ...] = ANSWERED, most: int = 12_000) -> DataFrame:
    """(file, section, part, prompt): what a language model is asked about each section, in parts of so many characters, so that long ones are asked about whole."""
    ask = f"Name the entities of the note below. Answer with a JSON array alone, of objects with text, type (one of {', '.join(kinds)}) and confidence (0 to 1)."
    whole = F.coalesce("content", F.lit(""))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(whole) / most), F.lit(1)).cast("int") - 1))
    return sections.select("file", "section", "heading", whole.alias("_c"), part.alias("part")).select(
        "file", "section", "part", F.concat(F.lit(ask + "\n\n## "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.substring(F.col("_c"), F.col("part") * most + 1, F.lit(most))).alias("prompt")
    )


def parse_model_answer(answers: DataFrame) -> DataFrame:
    """(file, section, text, type, confidence) from a model's JSON answers (file, section, answer): an array, bare or within other text; bad entries are dropped."""
    kinds = ANSWERED
    body = F.regexp_extract("answer", r"(?s)(\[.*\])", 1)
    rows = F.from_json(body, "array<struct<text:string,type:string,confidence:double>>", {"mode": "PERMISSIVE"})
    out = answers.select("file", "section", F.explode(rows).alias("x")).select("file", "section", trim_all(F.col("x.text")).alias("text"), "x.type", F.coalesce("x.confidence", F.lit(0.8)).alias("confidence"))
    return out.filter(F.col("type").isin(*kinds) & (F.col("text") != "") & F.col("confidence").between(0, 1))


def episodes(sections: DataFrame) -> DataFrame:
    """Episodes of dated sections (file, section, heading, content, date): id, type by the heading, title and content."""
    h = F.lower("heading")
    kind = F.when(h.rlike("decision|decided|chose"), "decision").when(h.rlike("event|meeting|session") | F.col("heading").rlike(r"\d{4}-\d{2}-\d{2}"), "event").otherwise("observation")
    ident = F.substring(F.sha2(F.concat_ws(":", "file", "heading", "content"), 256), 1, 16)
    return sections.select(ident.alias("id"), F.col("date").alias("timestamp"), kind.alias("type"), F.col("heading").alias("title"), "content", F.lit(0.5).alias("importance"), F.col("file").alias("source"), "section")


def role(kind: Column) -> Column:
    """The part a node of a type plays in an episode."""
    return F.when(kind == "person", "participant").when(kind.isin("concept", "project", "tool", "tag"), "topic").otherwise("mentioned")
