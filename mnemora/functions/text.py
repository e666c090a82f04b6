"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
QUERY_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into about "
    "between through after before above below and or but not no nor so if then than that this it its what which who how when where why all each every both few "
    "more most some any i me my we our you your he she they them his her just also very much"
).split()
#: Words that a tagger's entity never consists of.
ENTITY_STOPWORDS = (
    "the it this that a an is was are were be been being have has had also just very good great well much big day today phase current status session version "
    "default latest first last next tasks rules skip check"
).split()


def trim_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


#: Names that no step of ``normalize`` but lower case changes: plain words with single spaces.
PLAIN_NAME = r"\A[A-Za-z0-9_#@/]+(?: [A-Za-z0-9_#@/]+)*\z"


def normalize(c: Column) -> Column:
    """The form in which names are compared; the order of the steps matters."""
    plain, low = c.rlike(PLAIN_NAME), F.lower(c)
    for pattern, new in ((r"[’‘]s\z", ""), (r"[“”‘’\"]", ""), (r"[—–-]+\s*\z", ""), (r"^\s*[—–-]+", "")):
        c = F.regexp_replace(c, pattern, new)
    c = F.regexp_replace(trim_all(F.lower(c)), r"\s+", " ")
    return F.when(plain, low).otherwise(F.regexp_replace(F.regexp_replace(c, r"'s\z", ""), r"[.,;:!?]+\z", ""))


def query_terms(c: Column) -> Column:
    """Distinct terms of a query, in order."""
    parts = F.transform(F.split(c, r"[\s,;:!?()\[\]{}\"']+"), normalize)
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*QUERY_STOPWORDS)))


def fuzzy_match(a: Column, b: Column, distance: int = 2) -> Column:
    """Whether two names may be the same: few edits for short ones, else half of the tokens."""
    a, b = normalize(a), normalize(b)
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    near = F.levenshtein(a, b, distance) >= 0
    shared = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(ta), F.size(tb))
    return F.when((F.length(a) <= 15) & (F.length(b) <= 15), near).otherwise(shared >= 0.5)


def node_id(label: Column) -> Column:
    return F.substring(F.sha2(F.lower(trim_all(label)), 256), 1, 16)


def edge_id(source: Column, target: Column, kind: Column, directed: Column | None = None) -> Column:
    a, b = F.least(source, target), F.greatest(source, target)
    plain = F.concat_ws("--", a, b, kind)
    return plain if directed is None else F.when(directed, F.concat_ws("--", source, target, kind)).otherwise(plain)


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def slug(c: Column) -> Column:
    """A file name of at most 60 characters, cut at the last dash if that lies past the middle."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, r"\[\[|\]\]", "")), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    cut = F.substring(s, 1, 60)
    last = F.length(cut) - F.length(F.substring_index(cut, "-", -1)) - 1
    short = F.when(last > 30, F.substring(cut, F.lit(1), last.cast("int"))).otherwise(cut)
    return F.when(F.length(s) > 60, short).otherwise(s)


def wikilinks(c: Column) -> Column:
    """Link targets without alias or anchor, each once."""
    found = F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    plain = F.transform(found, lambda x: trim_all(F.regexp_replace(x, r"[|#].*\z", "")))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def claim(body: Column) -> Column:
    """The first paragraph before the first second-level heading that is no heading."""
    head = F.get(F.split(body, r"(?m)^## "), F.lit(0))
    parts = F.filter(F.transform(F.split(head, r"\n\s*\n"), trim_all), lambda p: (p != "") & ~p.startswith("#"))
    return F.get(parts, F.lit(0))


def source_section(body: Column) -> Column:
    found = F.regexp_extract(body, r"(?ms)^## Source[ \t]*\n(.*?)(?=^## |\z)", 1)
    return F.when(trim_all(found) == "", None).otherwise(trim_all(found))


def strip_markdown(c: Column) -> Column:
    for pattern, new in ((r"\[\[([^\]]+)\]\]", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"`[^`]+`", ""), (r"(?m)^#+\s+", ""), (r"#\w+", ""), (r"[—–]", ","), (r"\(\w+\)", "")):
        c = F.regexp_replace(c, pattern, new)
    return c


def text_hash(c: Column) -> Column:
    """The 31-polynomial hash in 32 bits, as base 36 of its absolute value."""
    h = F.call_function("reflect", F.lit("java.util.Objects"), F.lit("hashCode"), c).cast("long")
    return F.lower(F.conv(F.abs(h).cast("string"), 10, 36))


def procedure_id(statement: Column, scheme: str = "list") -> Column:
    """Three forms are in use: hash of the statement, hash of ``proc:`` and it, and the latter as a node."""
    if scheme == "list":
        return F.concat(F.lit("proc-"), text_hash(statement))
    return F.concat(F.lit("proc-" if scheme == "service" else "n-"), text_hash(F.concat(F.lit("proc:"), statement)))


def memory_id(*parts: Column) -> Column:
    return F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat(*parts), 256), 1, 12))


def keywords(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), trim_all), lambda x: x != "")
