"""Blocks of Markdown texts: headings, paragraphs, lists, quotes, code, HTML, nested as they stand.

The blocks of a text are found in one pass over its lines. Quotes and list items are containers: their lines, without
what marks them, are parsed by the same rules, to a depth of DEPTH. Code, HTML, breaks and link definitions have no text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from mnemora.shared import ship

#: Containers within containers; deeper ones are text.
DEPTH = 32
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|$)")
TAG = re.compile(r" {0,3}<(?:!--|[/?!]?[A-Za-z])")
LINK = re.compile(r" {0,3}\[[^\[\]]+\]:\s*\S+")


@dataclass
class Block:
    """kind: heading, paragraph, list, item, quote, code, html or break; level: of a heading; lines from 1."""

    kind: str
    first: int
    last: int
    level: int = 0
    lines: list[str] = field(default_factory=list)
    children: list[Block] = field(default_factory=list)

    def text(self, keep_markup: bool = False) -> str:
        """Its text, a line for each line of it; inner blocks one after another."""
        if self.children:
            return "\n".join(t for t in (c.text(keep_markup) for c in self.children) if t.strip())
        own = "\n".join(x.strip() for x in self.lines)
        return own if keep_markup else inline(own)


def inline(text: str) -> str:
    """Text without its inline marks: emphasis, links and tags; code keeps its backticks, double brackets stay."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[0][1:] if m[0][0] == "\\" else m[0])
        return f"\x00{len(held) - 1}\x00"

    t = re.sub(r"(?<!`)(`+)(?!`)(?:.|\n)*?(?<!`)\1(?!`)|\\[!-/:-@\[-`{-~]|\[\[[^\[\]\n]*\]\]", hold, text.replace("\x00", "�"))
    t = re.sub(r"!\[[^\[\]]*\]\([^()\s]*[^()]*\)", "", t)
    t = re.sub(r"\[([^\[\]]*)\]\([^()\s]*[^()]*\)", r"\1", t)
    t = re.sub(r"<([A-Za-z][A-Za-z0-9+.-]+:[^<>\s]*)>", r"\1", t)
    t = re.sub(r"</?[A-Za-z][^<>]*>|<!--(?:.|\n)*?-->", "", t)
    t = re.sub(r"\*\*|__(?=\S)|(?<=\S)__", "", t)
    t = re.sub(r"(?<![*\w])\*(?=[^\s*])([^*\n]*[^\s*])\*(?!\*)", r"\1", t)
    t = re.sub(r"(?<![_\w])_(?=[^\s_])([^_\n]*[^\s_])_(?![_\w])", r"\1", t)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], html.unescape(t))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _starts(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    m = ITEM.match(line)
    listed = m and line[m.end() :].strip() and (m[2] in "-+*" or m[2][:-1] == "1")
    return bool(listed or ATX.match(line) or FENCE.match(line) or BREAK.match(line) or QUOTE.match(line) or TAG.match(line))


def _runs_on(inner: list[tuple[int, str]], line: str) -> bool:
    """Whether a line without a container's mark goes on with the paragraph that the container's last line is in."""
    if not inner or _starts(line) or ITEM.match(line) or not line.strip():
        return False
    last = inner[-1][1]
    for _ in range(DEPTH):
        m = QUOTE.match(last) or ITEM.match(last)
        if not m:
            break
        last = last[m.end() :]
    fences = 0
    for _, x in inner:
        fences += bool(FENCE.match(x))
    return bool(last.strip()) and _indent(last) < 4 and not (ATX.match(last) or FENCE.match(last) or BREAK.match(last) or TAG.match(last)) and fences % 2 == 0


def _fenced(lines: list[tuple[int, str]], i: int) -> int:
    """The line behind the fenced code that begins at line i."""
    mark = FENCE.match(lines[i][1])[1]
    end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
    i += 1
    while i < len(lines) and not end.match(lines[i][1]):
        i += 1
    return min(i + 1, len(lines))


def _quoted(lines: list[tuple[int, str]], i: int) -> tuple[list[tuple[int, str]], int]:
    inner: list[tuple[int, str]] = []
    while i < len(lines):
        n, line = lines[i]
        m = QUOTE.match(line)
        if not m and not _runs_on(inner[-64:], line):
            break
        inner.append((n, line[m.end() :] if m else line.lstrip(" ")))
        i += 1
    return inner, i


def _item(lines: list[tuple[int, str]], i: int) -> tuple[list[tuple[int, str]], int]:
    """The lines of the item that begins at line i, without its indentation, and the line behind it."""
    n, line = lines[i]
    m = ITEM.match(line)
    wide = len(m[3]) > 4 or not line[m.end() :].strip()
    column = m.end() - len(m[3]) + 1 if wide else m.end()
    inner, blank = [(n, line[column:])], False
    i += 1
    while i < len(lines):
        n, line = lines[i]
        if not line.strip():
            if not any(x.strip() for _, x in inner):
                break  # an item begins with one blank line at most
            blank = True
            inner.append((n, ""))
        elif _indent(line) >= column:
            inner.append((n, line[column:]))
            blank = False
        elif not blank and _runs_on(inner[-64:], line):
            inner.append((n, line.lstrip(" ")))
        else:
            break
        i += 1
    while inner and not inner[-1][1].strip():
        inner.pop()
    return inner or [(lines[i - 1][0], "")], i


def parse(lines: list[tuple[int, str]], depth: int = 0) -> list[Block]:
    """The blocks of numbered lines without tabs."""
    out: list[Block] = []
    i = 0
    while i < len(lines):
        n, line = lines[i]
        start = i
        m = ITEM.match(line)
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            while i < len(lines) and (_indent(lines[i][1]) >= 4 or not lines[i][1].strip()):
                i += 1
            while not lines[i - 1][1].strip():
                i -= 1
            out.append(Block("code", n, lines[i - 1][0]))
        elif FENCE.match(line):
            i = _fenced(lines, i)
            out.append(Block("code", n, lines[i - 1][0]))
        elif h := ATX.match(line):
            i += 1
            out.append(Block("heading", n, n, len(h[1]), [h[2] or ""]))
        elif BREAK.match(line):
            i += 1
            out.append(Block("break", n, n))
        elif QUOTE.match(line) and depth < DEPTH:
            inner, i = _quoted(lines, i)
            out.append(Block("quote", n, lines[i - 1][0], children=parse(inner, depth + 1)))
        elif m and depth < DEPTH:
            items, kind = [], m[2][-1]
            while i < len(lines) and (m := ITEM.match(lines[i][1])) and m[2][-1] == kind and not BREAK.match(lines[i][1]):
                first = lines[i][0]
                inner, i = _item(lines, i)
                items.append(Block("item", first, inner[-1][0], children=parse(inner, depth + 1)))
            out.append(Block("list", n, items[-1].last, children=items))
        elif TAG.match(line):
            comment = line.lstrip(" ").startswith("<!--")
            while i < len(lines) and (lines[i][1].strip() or comment):
                i += 1
                if comment and "-->" in lines[i - 1][1]:
                    break
            out.append(Block("html", n, lines[i - 1][0]))
        elif LINK.match(line):
            i += 1
        else:
            i += 1
            while i < len(lines) and lines[i][1].strip() and not SETEXT.match(lines[i][1]) and not _starts(lines[i][1]):
                i += 1
            own = [x for _, x in lines[start:i]]
            under = SETEXT.match(lines[i][1]) if i < len(lines) else None
            if under:
                i += 1
                out.append(Block("heading", n, lines[i - 1][0], 1 if under[1][0] == "=" else 2, own))
            else:
                out.append(Block("paragraph", n, lines[i - 1][0], lines=own))
    return out


def document(text: str) -> list[Block]:
    """The blocks of a text; front matter counts as blank lines."""
    body = re.sub(r"\A---\n.*?\n---(?:\n|\Z)", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    return parse([(n, line.expandtabs(4)) for n, line in enumerate(re.split(r"\r\n|\n|\r", body), 1)])


def blocks(files: DataFrame) -> DataFrame:
    """(path, ord, depth, kind, level, line, last_line, text) of the blocks of notes (path, text), containers before what they hold; text is of blocks that hold no others."""

    def walk(found: list[Block], depth: int) -> Iterator[tuple]:
        for b in found:
            yield depth, b.kind, b.level, b.first, b.last, "" if b.children else b.text()
            yield from walk(b.children, depth + 1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["path", "ord", "depth", "kind", "level", "line", "last_line", "text"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(path, k, *b) for k, b in enumerate(walk(document(text.as_py() or ""), 0))]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    ship(files.sparkSession)
    return files.select("path", "text").mapInArrow(run, "path string, ord long, depth long, kind string, level long, line long, last_line long, text string")
