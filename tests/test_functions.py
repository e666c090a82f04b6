from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from mnemora.functions import dates, text, weights


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("  The  Search Index. ", "the search index"), ("Ada’s", "ada"), ("Ada's", "ada"), ("“Quoted”", "quoted"), ("— dash", "dash"), ("dash --", "dash"),
        ("What?!", "what"), ("", ""), ("\t a ", "a"), ("Étude", "étude"),
    ],
)
def test_normalize(spark, raw, name):
    assert one(spark, text.normalize(F.col("v")), v=raw) == name


@pytest.mark.parametrize(
    ("a", "b", "yes"),
    [("docker", "dokcer", True), ("git", "gitlab", False), ("git", "gat", True), ("a long name of things", "a long name of stuff", True), ("one two three four five", "six seven eight nine", False)],
)
def test_fuzzy_match(spark, a, b, yes):
    assert one(spark, text.fuzzy_match(F.col("a"), F.col("b")), a=a, b=b) is yes


def test_query_terms(spark):
    assert one(spark, text.query_terms(F.col("v")), v="What is the Search Index, and the search (index)?") == ["search", "index"]


def test_ids(spark):
    import hashlib

    assert one(spark, text.node_id(F.col("v")), v=" Search ") == hashlib.sha256(b"search").hexdigest()[:16]
    assert one(spark, text.edge_id(F.lit("b"), F.lit("a"), F.lit("explicit"))) == "a--b--explicit"
    assert one(spark, text.edge_id(F.lit("b"), F.lit("a"), F.lit("causal"), F.lit(True))) == "b--a--causal"
    h = 0
    for c in "proc:abc":
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    assert one(spark, text.procedure_id(F.col("v"), "service"), v="abc") == "proc-" + digits


@pytest.mark.parametrize(("raw", "out"), [("[[Search]] Index!", "search-index"), ("x" * 70, "x" * 60), ("a" * 40 + " " + "b" * 30, "a" * 40), ("ab " + "c" * 70, "ab-" + "c" * 57)])
def test_slug(spark, raw, out):
    assert one(spark, text.slug(F.col("v")), v=raw) == out


def test_memory_text(spark):
    body = "# Head\n\nThe claim, with [[A|b]] and [[C#d]] and [[A]].\n\n## Source\nfirst\nsecond\n\n## More\nx"
    assert one(spark, text.claim(F.col("v")), v=body) == "The claim, with [[A|b]] and [[C#d]] and [[A]]."
    assert one(spark, text.source_section(F.col("v")), v=body) == "first\nsecond"
    assert one(spark, text.wikilinks(F.col("v")), v=body) == ["A", "C"]
    assert one(spark, text.truncate(F.col("v"), 4), v="abcdef") == "abc…"


@pytest.mark.parametrize(("a", "b", "core", "view"), [("2026-01-02T12:00:00", "2026-01-01T13:00:00", 0, 0), ("2026-01-01T13:00:00", "2026-01-02T12:00:00", 0, 1), ("2026-01-05", "2026-01-01", 4, 4)])
def test_days(spark, a, b, core, view):
    x, y = dates.instant(F.lit(a)), dates.instant(F.lit(b))
    assert one(spark, dates.days_between(x, y)) == core
    assert one(spark, dates.days_floored(x, y)) == view


@pytest.mark.parametrize(("raw", "minutes"), [("30d", 43200), ("24h", 1440), ("15m", 15), ("15x", None), ("", None)])
def test_duration(spark, raw, minutes):
    assert one(spark, dates.duration_minutes(F.col("v")), v=raw) == minutes


def test_bad_dates_are_null(spark):
    assert one(spark, dates.instant(F.lit("no date"))) is None


@pytest.mark.parametrize(("base", "rc", "days"), [(1.0, 0, 0), (0.3, 5, 100), (0.1, 50, 3000)])
def test_weight(spark, base, rc, days):
    expected = base * math.exp(-0.015 * days / (1 + 1.5 * math.log(rc + 1)))
    assert one(spark, weights.current_weight(F.lit(base), F.lit(rc), F.lit(days))) == pytest.approx(expected)


def test_cosine_of_nothing_is_zero(spark):
    assert one(spark, weights.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
