"""Blocks and sections of Markdown, case by case, and over the tables against SQL."""

from __future__ import annotations

import time

import pytest

from mnemora.plans import catalog
from mnemora.sources import markdown, notes


def shape(found):
    """Blocks as nested tuples: kind (with the level of headings), then the inner ones or the text."""
    out = []
    for b in found:
        kind = f"h{b.level}" if b.kind == "heading" else b.kind
        out.append((kind, shape(b.children)) if b.children else (kind, b.text()) if b.text() else (kind,))
    return out


P = "paragraph"
CASES = [
    ("# A #\n## B ##  \n### C\n#no\n####### no", [("h1", "A"), ("h2", "B"), ("h3", "C"), (P, "#no\n####### no")]),
    ("A\n===\nB\nb\n---\n- - -\n***", [("h1", "A"), ("h2", "B\nb"), ("break",), ("break",)]),
    ("```py\n## no\n```\n~~~~\n```\n## no\n~~~\n~~~~\nx", [("code",), ("code",), (P, "x")]),
    ("```\nopen\n## no", [("code",)]),
    ("``` a`b\nx", [(P, "``` a`b\nx")]),
    ("    ## code\n\n    more\n\ntext\n    runs on", [("code",), (P, "text\nruns on")]),
    ("> ## quoted\n> text\nlazy\n\nout", [("quote", [("h2", "quoted"), (P, "text\nlazy")]), (P, "out")]),
    ("> a\n> > b\n# h", [("quote", [(P, "a"), ("quote", [(P, "b")])]), ("h1", "h")]),
    ("> ```\n> ## no\nout", [("quote", [("code",)]), (P, "out")]),
    ("- a\n- b\n  - c\n  - d\n\n    e\n- f", [("list", [("item", [(P, "a")]), ("item", [(P, "b"), ("list", [("item", [(P, "c")]), ("item", [(P, "d"), (P, "e")])])]), ("item", [(P, "f")])])]),
    ("- ## in item\n  text\n\n## out", [("list", [("item", [("h2", "in item"), (P, "text")])]), ("h2", "out")]),
    ("1. a\n2) b\n- c\n+ d", [("list", [("item", [(P, "a")])]), ("list", [("item", [(P, "b")])]), ("list", [("item", [(P, "c")])]), ("list", [("item", [(P, "d")])])]),
    ("text\n2. no list\n1. list", [(P, "text\n2. no list"), ("list", [("item", [(P, "list")])])]),
    ("- a\nlazy\n\nout", [("list", [("item", [(P, "a\nlazy")])]), (P, "out")]),
    ("-\n  a\n-\n\n  b", [("list", [("item", [(P, "a")]), ("item", [])]), (P, "b")]),
    ("<div>\n## no\n</div>\n\nx\n<!-- a\n\n## no -->\ny", [("html",), (P, "x"), ("html",), (P, "y")]),
    ("[a]: http://x\ntext [a](u) ![i](u) <b>bold</b>", [(P, "text a  bold")]),
    ("\ta tab", [("code",)]),
    ("- a\n\n      code\n\n  text", [("list", [("item", [(P, "a"), ("code",), (P, "text")])])]),
    ("* * *\n* a", [("break",), ("list", [("item", [(P, "a")])])]),
    ("a\r\nb\r\n\r\n## c\r\n", [(P, "a\nb"), ("h2", "c")]),
    ("", []), ("\n \n", []), ("##", [("h2",)]), (">", [("quote",)]),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_blocks(text, expected):
    def tidy(x):
        return [(k[0], tidy(k[1])) if len(k) > 1 and isinstance(k[1], list) and k[1] else k[:1] if len(k) > 1 and k[1] == [] else k for k in x]

    assert tidy(shape(markdown.document(text))) == tidy(expected)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a **b** __c__ *d* _e_ snake_case_name 2 * 3 * 4", "a b c d e snake_case_name 2 * 3 * 4"), ("`**x**` and ``a ` b``", "`**x**` and ``a ` b``"), (r"\*no\* \# &amp; &lt;", "*no* # & <"),
        ("[[Wiki *link*]] [t](http://a/b_c_d) <http://x.y>", "[[Wiki *link*]] t http://x.y"), ("a <!-- x --> b<br/>c", "a  bc"),
    ],
)
def test_inline(text, expected):
    assert markdown.inline(text) == expected


def test_sections_by_blocks():
    text = "---\ndate: 2026-01-01\n---\nbefore\n\nOne\n---\n```\n## no\n```\n> ## no\n> quoted\n\n- ## no\n\n## Two\n### sub\ntext\n\n## Empty\n"
    got = notes.split_sections(text)
    assert [(s[0], s[1], s[2], s[4]) for s in got] == [("(intro)", "(intro)", 1, "before"), ("One", "## One", 6, "no\nquoted\nno"), ("Two", "## Two", 16, "sub\ntext")]
    assert [s[3] for s in got] == [5, 15, 19]


def test_long_and_deep_texts_take_linear_time():
    def seconds(text):
        t = time.process_time()
        markdown.document(text)
        return time.process_time() - t

    for piece in ("- a\n", "> a\n", "word word\n", "> ", "- ", "```\n", "    c\n", "*a* **b** `c` ", "- a\n\n", "> - a\nlazy\n"):
        short, long = seconds(piece * 20_000), seconds(piece * 60_000)
        assert long < 6 * short + 1, piece


def test_tables_of_blocks(spark, sf_dir, same):
    rows = spark.createDataFrame([("a.md", "# T\n\n- x\n  > y\n"), ("b.md", None), ("c.md", "")], "path string, text string")
    got = [(r["path"], r["ord"], r["depth"], r["kind"], r["level"], r["line"], r["last_line"], r["text"]) for r in markdown.blocks(rows).collect()]
    assert got == [
        ("a.md", 0, 0, "heading", 1, 1, 1, "T"), ("a.md", 1, 0, "list", 0, 3, 4, ""), ("a.md", 2, 1, "item", 0, 3, 4, ""), ("a.md", 3, 2, "paragraph", 0, 3, 3, "x"), ("a.md", 4, 2, "quote", 0, 4, 4, ""),
        ("a.md", 5, 3, "paragraph", 0, 4, 4, "y"),
    ]
    for name in ("markdown_sections", "markdown_blocks"):
        same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])
