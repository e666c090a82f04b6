"""Canonical memory files: front matter of a closed schema, a claim, and optionally its source."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import claim, source_section, wikilinks
from mnemora.shared import ship
from mnemora.sources import files

#: The keys of the front matter, in the order in which they are written.
KEYS = ("id", "type", "status", "title", "created", "last_reinforced", "reinforcement_count", "importance", "scope", "tags", "links", "source")
REQUIRED = ("id", "type", "created")
KINDS = ("fact", "decision", "preference", "lesson", "event", "procedure", "observation")
STATES = ("active", "candidate", "superseded", "archived")
SCHEMA = (
    "path string, id string, type string, status string, title string, created string, last_reinforced string, reinforcement_count long, importance double, "
    "scope string, tags array<string>, links array<string>, source string, body string, warnings array<string>, error string"
)
MEMORY_ID = re.compile(r"mem_[0-9a-f]{12}\Z")
SCOPE = re.compile(r"(global|secret|(project|agent|user)/[a-z0-9][a-z0-9._-]*)\Z")


def scope_of(path: str) -> str | None:
    """The scope that a file's folder stands for."""
    parts = path.strip("/").split("/")[:-1]
    if parts[:1] == ["global"]:
        return "global"
    return f"{parts[0].removesuffix('s')}/{parts[1]}" if len(parts) >= 2 and parts[0] in ("projects", "agents", "users") else None


def parse(path: str, content: str) -> dict:
    """The fields of a file; ``error`` where it is none, ``warnings`` where it is one with faults."""
    import yaml

    out: dict = dict.fromkeys(SCHEMA_NAMES)
    out |= {"path": path, "warnings": [], "tags": [], "links": []}
    m = re.match(r"---\n(.*?)\n---\n?(.*)\Z", content or "", re.S)
    if not m:
        return out | {"error": "no front matter"}
    try:
        head = yaml.safe_load(m[1]) or {}
    except yaml.YAMLError:
        return out | {"error": "front matter is no YAML"}
    if not isinstance(head, dict):
        return out | {"error": "front matter is no mapping"}
    for key in head:
        if key not in KEYS:
            out["warnings"].append(f"unknown key {key}")
    missing = [k for k in REQUIRED if head.get(k) in (None, "")]
    if missing:
        return out | {"error": f"missing {', '.join(missing)}"}
    own = {k: head.get(k) for k in KEYS}
    if not MEMORY_ID.match(str(own["id"])):
        return out | {"error": "malformed id"}
    if own["type"] not in KINDS:
        return out | {"error": "unknown type"}
    if own["status"] is None:
        own["status"] = "active"
    if own["status"] not in STATES:
        return out | {"error": "unknown status"}
    place = scope_of(path)
    scope = place or str(own["scope"] or "global")
    if own["scope"] and place and own["scope"] != place:
        out["warnings"].append("the folder's scope is taken")
    if not SCOPE.match(scope):
        return out | {"error": "unknown scope"}
    if scope == "secret":
        return out | {"error": "secret memories are not read"}
    try:
        importance = None if own["importance"] is None else float(own["importance"])
        count = int(own["reinforcement_count"] or 0)
    except (TypeError, ValueError):
        return out | {"error": "a number is none"}
    if importance is not None and not 0 <= importance <= 1 or count < 0:
        return out | {"error": "a number is out of range"}
    texts = {k: None if own[k] is None else str(own[k]) for k in ("id", "type", "status", "title", "created", "last_reinforced", "source")}
    lists = {k: [str(x) for x in own[k]] if isinstance(own[k], list) else [] for k in ("tags", "links")}
    return out | texts | lists | {"importance": importance, "reinforcement_count": count, "scope": scope, "body": m[2]}


SCHEMA_NAMES = [re.match(r"\w+", c)[0] for c in SCHEMA.split(", ")]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All files under a folder with their fields, claim, source section and wikilinks; hidden folders are left out."""
    found = files.below(spark, folder)
    base = re.sub("^file:/+", "/", folder.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base) + "/", "")
    raw = found.select(path.alias("path"), F.decode("content", "UTF-8").alias("text")).filter(~F.col("path").rlike(r"(^|/)\."))
    return with_claims(parsed(raw))


def parsed(raw: DataFrame) -> DataFrame:
    """Fields of (path, text)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([parse(p, t) for p, t in zip(pdf["path"], pdf["text"], strict=True)], columns=SCHEMA_NAMES)

    ship(raw.sparkSession)
    return raw.mapInPandas(run, SCHEMA)


def with_claims(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"claim": claim(F.col("body")), "source_text": source_section(F.col("body")), "wikilinks": wikilinks(F.col("body"))})


def serialized(memories: DataFrame) -> DataFrame:
    """(path, text): files as they are written, keys in their fixed order."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import yaml

        for pdf in batches:
            rows = []
            for x in pdf.to_dict("records"):
                head = {}
                for k in KEYS:
                    v = x.get(k)
                    v = v.tolist() if hasattr(v, "tolist") else v
                    if v is not None and v != [] and v == v:
                        head[k] = v
                rows.append((x["path"], "---\n" + yaml.safe_dump(head, sort_keys=False, allow_unicode=True) + "---\n" + (x["body"] or "")))
            yield pd.DataFrame(rows, columns=["path", "text"])

    ship(memories.sparkSession)
    return memories.mapInPandas(run, "path string, text string")
