"""What plans shuffle and form, so that it grows no faster than the tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators import increments, merge, pairs as counting
from mnemora.plans import derive, ingest_queries

NOTE = "file string, section string, heading string, line long, content string, date string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def own_notes(spark, files=40):
    random.seed(5)
    rows = []
    for f in range(files):
        for k in range(random.randint(1, 5)):
            names = " ".join(f"[[Name {random.choice([random.randint(0, 9), random.randint(10, 120)])}]]" for _ in range(4))
            rows.append((f"f{f}.md", f"## s{k}", f"Head {f} {k}", k, names + random.choice(["", " by Docker", " due to rain"]), f"2026-01-{k + 1:02}"))
    return spark.createDataFrame(rows, NOTE)


def test_notes_are_shuffled_once_for_their_sightings(spark):
    p = plan(ingest_queries.sightings(own_notes(spark)))
    assert p.count("Exchange ") == 1 and "Join" not in p


def test_files_are_walked_in_batches_not_a_group_each(spark):
    rows = [(f"f{i % 7}", s, f"n{i % 5}", i, "2026-01-01") for i in range(60) for s in (i % 3, 3 + i % 2)]
    pairs = merge.temporal_pairs(spark.createDataFrame(rows, "file string, section_ord long, node_id string, ord long, date string"))
    assert "FlatMapGroups" not in plan(pairs)
    assert pairs.count() == pairs.distinct().count() > 0 and pairs.select("file").distinct().count() == 7


def test_section_pairs_are_made_of_a_section_without_a_join(spark):
    seen = spark.createDataFrame([("f", "s", x, i, "d") for i, x in enumerate("cabca")] + [("f", "t", "a", 9, "d")], "file string, section string, node_id string, ord long, date string")
    pairs = merge.section_pairs(seen)
    assert "Join" not in plan(pairs)
    assert sorted((r["section"], r["source"], r["target"], r["ord"]) for r in pairs.collect()) == [("s", "a", "b", 1), ("s", "a", "c", 1), ("s", "b", "c", 2)]


def test_pairs_kept_up_with_changes_are_those_of_all_notes(spark, monkeypatch):
    """Names that a changed file brings to a second sighting have their first one in a file that did not change; nodes seen once are in no part."""
    own, formed = own_notes(spark), []
    parts = ingest_queries.increments.pair_parts
    monkeypatch.setattr(ingest_queries.increments, "pair_parts", lambda seen, none: formed.append(seen) or parts(seen, none))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(ingest_queries.note_cooccurrence_after_changes(spark, "", own)) == key(ingest_queries.note_cooccurrence(spark, "", own)) != []
    assert all(seen.filter(F.col("name").startswith("head ")).count() == 0 for seen in formed)


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def own_sightings(spark):
    """A large file and small ones, nodes that come twice in a section, missing dates and excerpts."""
    random.seed(1)
    rows = [(f"f{random.randint(0, 9)}" if i % 3 else "big", f"s{random.randint(0, 30)}", f"n{random.randint(0, 20)}", i, f"d{i % 9}" if i % 5 else None, f"l{i}", f"t{i % 3}", f"e{i}" if i % 4 else None, i % 3 == 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "file string, section string, node_id string, ord long, date string, label string, type string, excerpt string, is_link boolean")
    return df.withColumn("section_ord", F.expr("40 - cast(substring(section, 2) as long)"))


def test_parts_of_sections_are_read_off_whole_files_with_no_sort_of_pairs(spark, monkeypatch):
    seen = own_sightings(spark)
    assert "Window" not in plan(increments.pair_parts(seen, seen.filter("false")).filter("type = 'co-occurrence'"))
    want = rows_of(increments._parted(merge.section_pairs(seen), "co-occurrence", ["section", "ord"], "context"))
    for pairs, rows in ((200_000, 50_000), (50, 100), (1, 1)):  # a large file is cut by its pairs' sources
        monkeypatch.setattr(increments, "PAIRS_AT_ONCE", pairs)
        monkeypatch.setattr(increments, "ROWS_AT_ONCE", rows)
        assert rows_of(increments.section_parts(seen)) == want


def test_parts_of_nodes_take_one_shuffle_and_no_join(spark, monkeypatch):
    seen, (by, place) = own_sightings(spark), (["node_id", "file"], F.struct("section", "ord"))
    p = plan(increments.node_parts(seen))
    assert p.count("Exchange ") == 1 and "Join" not in p and "Window" not in p
    texts = merge.first_rows(seen.filter("excerpt is not null"), by, ["section", "ord"], 10, F.struct("file", F.col("excerpt").alias("text"), "date"), "excerpts")
    places = merge.first_rows(seen, by, ["section_ord", "ord"], 2, F.struct("section_ord", "ord"), "places")
    one = seen.groupBy(*by).agg(F.min_by("label", place).alias("label"), F.min_by("type", place).alias("type"), F.count("*").alias("n"), F.min_by("date", place).alias("first"), F.max_by("date", place).alias("last"))
    want = rows_of(one.join(texts, by, "left").join(places, by).withColumn("excerpts", F.coalesce("excerpts", F.array().cast("array<struct<file:string,text:string,date:string>>"))))
    for rows in (50_000, 7, 1):
        monkeypatch.setattr(increments, "ROWS_AT_ONCE", rows)
        assert rows_of(increments.node_parts(seen)) == want


def test_lean_tables_leave_no_shuffled_files(spark, tmp_path):
    import glob
    import time

    from mnemora.shared import CLEANUP, written

    files = lambda: set(glob.glob(f"{spark._jvm.System.getProperty('java.io.tmpdir')}/blockmgr-*/*/shuffle_*.data"))
    before, was = files(), spark.conf.get(CLEANUP)
    own = written(spark.range(1000).repartition(7, "id"), "own", lean=True)
    end = time.time() + 10  # blocks are removed in the background
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == was
    assert own.count() == 1000


def test_links_meet_their_section_without_a_join_and_evidence_is_made_where_it_is_read(spark):
    seen = own_sightings(spark)
    e = merge.explicit(seen)
    p = plan(e.select("id", "reinforcement_count"))
    assert "Join" not in p and "Window" not in p and p.count("Exchange ") == 2
    m = seen.groupBy("file", "section", "node_id").agg(F.max("is_link").alias("link"), F.min("date").alias("date"))
    a, b = m.filter("link").selectExpr("file", "section", "node_id as x", "date"), m.selectExpr("file", "section", "node_id as y")
    pairs = a.join(b, ["file", "section"]).filter("x <> y").selectExpr("least(x, y) as source", "greatest(x, y) as target", "file", "section", "date")
    assert rows_of(merge.explicit_pairs(seen)) == rows_of(pairs)
    assert {r["id"]: len(r["evidence"]) for r in e.collect()} == {f"{r['source']}--{r['target']}--explicit": min(20, r["count"]) for r in pairs.groupBy("source", "target").count().collect()}


def test_pairs_of_orders_need_no_join_of_lines_with_lines(spark, sf_dir):
    m = derive.orders(spark, sf_dir)
    p = plan(derive.pairs_of(spark, sf_dir, m))
    assert p.count("Scan parquet") == 2 and p.count("Join") == 1
    assert "sha2" not in p  # ids are made of the pairs that are read


def test_plain_names_are_normalised_as_all_are(spark):
    """The short way gives what the steps give, and is taken for plain words alone."""
    from mnemora.functions import text

    names = ["Brand#7", "blue ring", "A  b", " a", "a ", "It's", "x's", "a.", "a/b_c", "-a", "a-", "K\u212a", "", "a\n", "a\tb", "\u201ca\u201d", "@x/y", "a b c d", "9"]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    plain = {r["n"] for r in df.filter(F.col("n").rlike(text.PLAIN_NAME)).collect()}
    assert plain == {"Brand#7", "blue ring", "a/b_c", "@x/y", "a b c d", "9"}
    got = {r["n"]: r["x"] for r in df.select("n", text.normalize(F.col("n")).alias("x")).collect()}
    assert all(got[n] == n.lower() for n in plain) and got[None] is None
    assert [got[n] for n in ("A  b", " a", "x's", "a.", "-a", "a\n", "\u201ca\u201d")] == ["a b", "a", "x", "a", "a", "a", "a"]


def test_crowded_pairs_shuffle_no_copies_of_items(spark, monkeypatch):
    """Only the numbers of cells are dealt, one task each, whatever their size; the items lie in sorted blocks that cells read. Pairs of a cell come by source, then target, which their files keep small."""
    monkeypatch.setattr(counting, "CELL", 8)
    df = spark.createDataFrame([(i, g) for i in range(60) for g in range(5) if (i + g) % 4], "item int, group int")
    got = counting.counted(df, crowded=True)
    exchanges = [x for x in plan(got).splitlines() if "Exchange " in x]
    assert len(exchanges) == 1 and "rangepartitioning(_i" in exchanges[0] and "groups" not in exchanges[0]
    parts = [[tuple(r) for r in p] for p in got.rdd.glom().collect()]
    assert len([p for p in parts if p]) > 20 and all([r[:2] for r in p] == sorted(r[:2] for r in p) for p in parts)
    shared = {(a, b): sum((a + g) % 4 and (b + g) % 4 and 1 for g in range(5)) for a in range(60) for b in range(a + 1, 60)}
    assert {r[:2]: r[2] for p in parts for r in p} == {k: n for k, n in shared.items() if n}


def test_crowded_pairs_of_no_rows_and_of_times(spark):
    none = spark.createDataFrame([], "item string, group timestamp")
    assert counting.counted(none, crowded=True).count() == 0 == counting.partners(none, crowded=True).count()
    far = spark.sql("select i as item, g as group from values (1L), (2L) t(i), values (timestamp '0001-01-01 00:00:00'), (timestamp '9999-01-01 00:00:00') u(g)")
    assert [tuple(r) for r in counting.counted(far, crowded=True).collect()] == [(1, 2, 2)]


def test_small_files_are_dealt_by_number_and_read_as_spark_reads_them(spark, tmp_path):
    """300 files are a task a core, not one each 32; the rows are those of Spark's own reader, whatever the names."""
    from mnemora.sources import files

    odd = ["a b.md", "x%20y.md", "ü.md", "x.txt", ".h.md", "_h.md", "_k=1.md", ".hidden/in.md", "_no/in.md", "deep/er/k=v/a.md", "deep/empty.md"]
    for name in [*(f"d{i % 3}/n{i}.md" for i in range(300)), *odd]:
        (tmp_path / "in dir" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in dir" / name).write_text("" if "empty" in name else f"text of {name}")
    for inputs in ([str(tmp_path / "in dir")], [str(tmp_path / "in dir/d0"), f"file://{tmp_path}/in dir/a b.md"]):
        got = files.below(spark, *inputs)
        own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(inputs).selectExpr("path", "content", "modificationTime")
        assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in own.collect())
    assert files.dealt(spark.range(files.FILES * 9), "id").rdd.getNumPartitions() == 10
    with pytest.raises(FileNotFoundError):
        files.below(spark, str(tmp_path / "none"))
