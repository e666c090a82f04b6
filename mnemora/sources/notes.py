"""Markdown notes: discovery, change detection, sections, dates."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions.dates import file_date
from mnemora.shared import hadoop, ship
from mnemora.sources import files, markdown


def discover(spark: SparkSession, *inputs: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, hash, modified) of the ``.md`` files under folders, or of single files; inputs that are not there are passed over."""
    there = [p for p in inputs if hadoop(spark, p)[0].exists(hadoop(spark, p)[1])]
    empty = spark.createDataFrame([], "path string, text string, hash string, modified timestamp")
    if not there:
        return empty
    text = F.decode("content", "UTF-8")
    out = files.below(spark, *there).select("path", text.alias("text"), F.sha2(text, 256).alias("hash"), "modified")
    for name in ignore:
        out = out.filter(~F.col("path").contains(f"/{name.strip('/')}/"))
    return out


def relative(path: Column, base: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^" + re.escape(base.rstrip("/")) + "/", "")


def changes(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, status): new, changed or unchanged against the ledger (path, hash)."""
    l = ledger.select(F.col("path").alias("_p"), F.col("hash").alias("_h"))
    j = found.join(l, found["path"] == l["_p"], "left")
    status = F.when(F.col("_p").isNull(), "new").when(F.col("_h") != F.col("hash"), "changed").otherwise("unchanged")
    return j.select("path", status.alias("status"))


def document_date(path: Column, text: Column, modified: Column) -> Column:
    """The ``date:`` of the front matter, else the date in the file's name, else the time of its last change."""
    own = F.regexp_extract(text, r"(?ms)\A---\n.*?^date:\s*[\"']?(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(own != "", own), file_date(path), F.date_format(modified, "yyyy-MM-dd"))


def split_sections(text: str, keep_markup: bool = False) -> list[tuple[str, str, int, int, str]]:
    """(heading, heading path, first line, last line, content) of the second-level sections of a note.

    A section begins at a heading of the second level that stands in no quote, list or code, of either form (``##`` or underlined). Text before the
    first is ``(intro)``; sections without text are dropped; a note with none is one section. Code and HTML are left out; inline marks go unless kept.
    """
    out, heading, first, parts = [], "(intro)", 1, []

    def close(last: int) -> None:
        content = "\n".join(parts).strip()
        if content:
            out.append((heading, "(intro)" if heading == "(intro)" else f"## {heading}", first, max(last, first), content))
        parts.clear()

    found = markdown.document(text or "")
    for b in found:
        if b.kind == "heading" and b.level == 2:
            close(b.first - 1)
            heading, first = b.text().replace("\n", " "), b.first
        else:
            own = b.text(keep_markup)
            if own.strip():
                parts.append(own)
    close(found[-1].last if found else 1)
    whole = (text or "").strip()
    return out or ([("(intro)", "(intro)", 1, text.count("\n") + 1, whole)] if whole else [])


def sections(found: DataFrame, keep_markup: bool = False) -> DataFrame:
    """(file, section, heading, line, last_line, content, section_ord) of notes (path, text)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(p, s[1], s[0], s[2], s[3], s[4], i) for p, t in zip(pdf["path"], pdf["text"], strict=True) for i, s in enumerate(split_sections(t, keep_markup))]
            yield pd.DataFrame(rows, columns=["file", "section", "heading", "line", "last_line", "content", "section_ord"])

    ship(found.sparkSession)
    return found.select("path", "text").mapInPandas(run, "file string, section string, heading string, line long, last_line long, content string, section_ord long")


def carried_headings(lines: DataFrame) -> DataFrame:
    """Lines (file, line, text) with the last second-level heading at or above each, without Python."""
    own = F.when(F.col("text").rlike(r"^##\s+[^#]"), F.regexp_extract("text", r"^##\s+(.*?)\s*#*\s*\z", 1))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("(intro)")))
