from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import conversations, dynamics, extract, federation, graph, pairs, procedures, resolve, temporal, vectors


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    if len(a) <= 15 and len(b) <= 15:
        return lev(a, b) <= 2
    x, y = set(a.split(" ")), set(b.split(" "))
    return len(x & y) / max(len(x), len(y)) >= 0.5


def some_names(n=60):
    random.seed(3)
    short = ["".join(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(n)]
    return sorted({*short, "x", "a long name of one", "a long name of two", "quite another name here", "a long list of names", "abcab abcab abcab abc"})


def test_fuzzy_pairs_are_complete(spark):
    names = some_names()
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["name"], r["other"]) for r in resolve.fuzzy_pairs(df, df).collect()}
    assert got == {(a, b) for a in names for b in names if alike(a, b)}


def test_leaders_follow_the_order(spark):
    names = some_names(25)
    random.seed(4)
    random.shuffle(names)
    leaders, expected = [], {}
    for n in names:
        expected[n] = next((x for x in leaders if alike(n, x)), n)
        if expected[n] == n:
            leaders.append(n)
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")
    assert {r["name"]: r["leader"] for r in resolve.leaders(df).collect()} == expected


@pytest.mark.parametrize("in_order", [resolve.IN_ORDER, 600])
def test_leaders_of_a_chain(spark, monkeypatch, in_order):
    """2000 labels, each like the one before only: rounds alone would settle them link by link."""
    names = [f"word{i:08d} word{i + 1:08d}" for i in range(2000)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")
    tasks, settled = [], resolve._settled
    monkeypatch.setattr(resolve, "_settled", lambda p: tasks.append(1) or settled(p))
    assert {r["name"]: r["leader"] for r in resolve.leaders(df, in_order).collect()} == {n: names[i - i % 2] for i, n in enumerate(names)}
    assert len(tasks) == (1 if in_order > 2000 else len(tasks)) and len(tasks) <= 5


def plain_chunks(messages, most, tokens, gap=30 * 60):
    out, current = [], []
    size = lambda ms: -(-sum(len(m[3]) + len(m[2]) + 2 for m in ms) // 4)
    for m in messages:
        if current and current[-1][4] is not None and m[4] is not None and m[4] - current[-1][4] > gap:
            out.append(current)
            current = []
        if current and (len(current) >= most or size([*current, m]) > tokens):
            if m[2] == "assistant" and current[-1][2] == "user":
                out.append([*current, m])
                current = []
                continue
            out.append(current)
            current = []
        current.append(m)
    return [*out, current] if current else out


@pytest.mark.parametrize(("most", "tokens"), [(3, 4000), (2, 30), (20, 15), (1, 4000)])
def test_chunks(spark, most, tokens):
    random.seed(most * tokens)
    rows = []
    for c in range(12):
        t = 0
        for i in range(random.randint(1, 14)):
            t += random.choice([60, 1800, 1801, 4000])
            rows.append((c, i, random.choice(["user", "assistant", "user", "tool"]), "w" * random.randint(0, 60), t if random.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {(r["conv_id"], r["turn"]): r["chunk"] for r in conversations.chunks(df, most, tokens).collect()}
    for c in range(12):
        for k, chunk in enumerate(plain_chunks([r for r in rows if r[0] == c], most, tokens)):
            assert [got[c, m[1]] for m in chunk] == [k] * len(chunk)


def test_mock_vectors():
    (v,) = vectors.mock_vectors(["héllo"])
    assert v.dtype == np.float32 and len(v) == 64 and abs(float((v.astype(float) ** 2).sum()) - 1) < 1e-5
    assert (vectors.mock_vectors(["héllo"])[0] == v).all() and not (vectors.mock_vectors(["hello"])[0] == v).all()


def test_search_passes_over_other_lengths(spark):
    rows = [("a", [1.0, 0.0], "node"), ("b", [0.0, 0.0], "node"), ("c", [1.0], "node"), ("d", [0.6, 0.8], "episode")]
    df = spark.createDataFrame(rows, "id string, vector array<float>, type string")
    assert [r["id"] for r in vectors.search(df, [1.0, 0.0]).collect()] == ["a", "d", "b"]
    assert [r["id"] for r in vectors.search(df, [1.0, 0.0], least=0.5, kind="episode").collect()] == ["d"]


def test_encoder_mismatch(spark):
    df = spark.createDataFrame([("x", 2), ("x", 3)], "provider string, dimensions int")
    with pytest.raises(vectors.EncoderMismatch):
        vectors.fingerprint(df)
    assert vectors.fingerprint(df.limit(0)) is None


def tiny_graph(spark, edges, nodes="abcdefg"):
    n = spark.createDataFrame([(x, x.upper(), "tool", [], i) for i, x in enumerate(nodes)], "id string, label string, type string, aliases array<string>, mention_count long")
    e = spark.createDataFrame([(f"{a}{b}{i}", a, b, "co-occurrence", w) for i, (a, b, w) in enumerate(edges)], "id string, source string, target string, type string, weight double")
    return n, e


def test_components_and_labels(spark):
    n, e = tiny_graph(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("f", "e", 1.0), ("g", "g", 1.0)])
    comps = graph.components(n, e)
    assert {r["id"]: r["component"] for r in comps.collect()} == dict(zip("abcdefg", "aaaaeeg", strict=True))
    labels = {r["component"]: r["label"] for r in graph.cluster_infos(n, comps).collect()}
    assert labels == {"a": "D (4 tools)", "e": "E, F", "g": "G"}


def test_components_of_random_graphs(spark):
    random.seed(9)
    names = [f"n{i:03d}" for i in range(120)]
    pairs = [(random.choice(names), random.choice(names), 1.0) for _ in range(90)]
    n, e = tiny_graph(spark, pairs, names)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r["id"]: r["component"] for r in graph.components(n, e).collect()} == {x: find(x) for x in names}


def test_degrees_count_loops_twice(spark):
    n, e = tiny_graph(spark, [("a", "a", 1.0), ("a", "b", 1.0), ("a", "b", 1.0)], "abc")
    assert {r["id"]: r["degree"] for r in graph.degrees(n, e).collect()} == {"a": 4, "b": 2, "c": 0}


def test_neighbors_and_empty_graph(spark):
    n, e = tiny_graph(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    assert {(r["id"], r["hop"]) for r in graph.neighbors(e, "a", 2).collect()} == {("b", 1), ("c", 2)}
    assert {r["id"] for r in graph.touched_edges(e, "a", 2).collect()} == {"ab0", "bc1"}
    assert graph.neighbors(e.limit(0), "a", 2).count() == 0
    assert graph.components(n, e.limit(0)).filter("id <> component").count() == 0


def test_graduation_is_by_repeat(spark):
    rows = [("a", "b", f"f{i}", "s", i, f"2026-01-{i + 1:02d}", "") for i in range(25)] + [("a", "c", "f0", "s", 0, "2026-01-01", "")]
    obs = spark.createDataFrame(rows, "source string, target string, file string, section string, ord long, date string, context string")
    edges, pending = dynamics.graduate(obs)
    (e,) = edges.collect()
    assert (e["reinforcement_count"], len(e["evidence"])) == (23, 20)
    assert [(r["target"], r["count"]) for r in pending.collect()] == [("c", 1)]


def test_hive_fold(spark):
    rows = [(0, "e", "a", "b", 0.5, 3), (1, "e", "a", "b", 0.4, 7), (2, "e", "a", "b", 0.9, 2)]
    df = spark.createDataFrame(rows, "agent_ord int, id string, source string, target string, weight double, reinforcement_count long")
    assert federation.merge_edges(df).first()["reinforcement_count"] == 8  # 3 doubled, then 2 more
    assert federation.merge_edges(df, strict=False).first()["reinforcement_count"] == 12


def test_diff_of_arrays(spark):
    ddl = "id string, label string, type string, mention_count long, reinforcement_count long, last_reinforced string, aliases array<string>, source_files array<string>"
    a = spark.createDataFrame([("x", "X", "tool", 1, 0, "d", ["p"], ["f"]), ("y", "Y", "tool", 1, 0, "d", [], [])], ddl)
    b = spark.createDataFrame([("x", "X2", "tool", 1, 0, "d", ["q"], ["f", "g"]), ("z", "Z", "tool", 1, 0, "d", [], [])], ddl)
    got = {r["id"]: (r["change"], r["fields"]) for r in temporal.diff_nodes(a, b).collect()}
    assert got == {"x": ("changed", "label,aliases,source_files"), "y": ("removed", ""), "z": ("added", "")}


def test_model_answers(spark):
    rows = [("f", "s", 'Sure: [{"text": "Ada", "type": "person", "confidence": 0.7}, {"text": "X", "type": "alien"}, {"text": "Vite", "type": "tool"}] done'), ("f", "s", "none")]
    out = extract.parse_model_answer(spark.createDataFrame(rows, "file string, section string, answer string"))
    assert {(r["text"], r["type"], r["confidence"]) for r in out.collect()} == {("Ada", "person", 0.7), ("Vite", "tool", 0.8)}


def test_formats(spark):
    calls = spark.createDataFrame([(1, 0, "assistant", None, [("f", "{}")]), (1, 1, "user", "hi", None), (1, 2, "assistant", None, None)], "conv_id int, turn int, role string, content string, tool_calls array<struct<name:string,arguments:string>>")
    assert [(r["role"], r["text"]) for r in conversations.from_tool_calls(calls).orderBy("turn").collect()] == [("tool", "Called f({})"), ("user", "hi")]
    lines = spark.createDataFrame([(1, 0, '{"role": "user", "text": "a"}'), (1, 1, "bad"), (1, 2, '{"message": "b"}'), (1, 3, '{"content": ""}')], "conv_id int, turn int, line string")
    assert [(r["role"], r["text"]) for r in conversations.from_json_lines(lines).orderBy("turn").collect()] == [("user", "a"), ("user", "b")]
    texts = ['[{"role": "user", "content": "x"}]', '{"messages": [{"role": "user", "content": [{"type": "text"}]}]}', '{"sessionId": "s", "messages": []}', '{"a": 1}\n{"b": 2}']
    got = [r["f"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(conversations.detect_format(F.col("t")).alias("f")).collect()]
    assert got == ["chat", "blocks", "session", "jsonl"]


def test_components_of_an_ordered_chain(spark, monkeypatch):
    """A chain in the order of its ids takes logarithmic rounds, and so do a star and shuffled ids."""
    from mnemora.operators import components

    made = []
    monkeypatch.setattr(components, "written", lambda df, label, f=components.written: made.append(label) or f(df, label))
    n = 10_000
    ids = list(range(n))
    random.seed(9)
    random.shuffle(ids)
    pairs = [(i, i + 1) for i in range(n - 1)] + [(n, n + i) for i in range(1, 500)] + [(2 * n + ids[i], 2 * n + ids[i + 1]) for i in range(n - 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = components.contract(df)
    assert made.count("up") <= 20
    assert {r["root"]: r["n"] for r in got.groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: n, n: 500, 2 * n: n}
    any_root = components.contract(df, least=False)
    assert sorted(r["n"] for r in any_root.groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()) == [500, n, n]


def test_few_procedures(spark):
    """Matches and feedback on procedures small enough to follow by hand."""
    schema = "id string, statement string, trigger_keywords array<string>, trigger_contexts array<string>, confidence double, last_applied string, contradictions long, flagged_for_review boolean"
    rows = [
        ("p1", "run tests before pushing", ["tests", "push"], ["ci"], 0.8, None, 0, False), ("p2", "prefer small commits", ["commit", "small", "review"], ["git"], 0.6, "2001-03-01", 1, False),
        ("p3", "rotate the tokens", ["token", "rotate"], [], 0.4, "1999-01-01", 2, False), ("p4", "index before search", ["index", "search"], ["db", "ci"], 0.9, None, 0, True),
    ]
    p = spark.createDataFrame(rows, schema).withColumns({"stability": F.lit(1.0), "applications": F.lit(0).cast("long"), "type": F.lit("preference")})
    now = F.lit("2001-09-01").cast("timestamp_ntz")
    got = {r["id"]: round(r["score"], 6) for r in procedures.match(p, ["search", "indexes", "testing", "tests"], ["CI"], now).collect()}
    assert got == {"p1": round((0.5 * 0.7 + 0.3) * 0.8, 6), "p4": round((0.7 + 0.15) * 0.9, 6)}
    f = [("p1", 1, "positive"), ("p1", 2, "neutral"), ("p3", 1, "negative"), ("p3", 2, "negative"), ("p4", 1, "positive"), ("p4", 2, "negative")]
    after = dynamics.apply_feedback(p, spark.createDataFrame([(*x, "2001-08-01") for x in f], "procedure_id string, ord long, feedback string, at string"))
    got = {r["id"]: (round(r["confidence"], 6), r["applications"], r["contradictions"], r["flagged_for_review"]) for r in after.collect()}
    assert got == {"p1": (0.82, 1, 0, False), "p2": (0.6, 0, 1, False), "p3": (0.256, 0, 4, True), "p4": (0.728, 1, 1, True)}


def plain_score(name, term):
    longer = max(len(name), len(term), 1)
    far = lev(term, name) / longer
    return 1.0 if name == term else 0.8 if term in name else 0.6 if name in term else 0.4 * (1 - far) if abs(len(name) - len(term)) <= 0.3 * longer and far <= 0.3 else 0.0


def test_search_finds_what_a_scan_finds(spark):
    random.seed(11)
    words = ["".join(random.choice("abcd ") for _ in range(random.randint(0, 9))).strip() for _ in range(150)] + ["a", "b", "aa", "abc", "aaaa", "abab", "éa", ""]
    nodes = [(f"n{i}", w, [random.choice(words)] if i % 3 else None) for i, w in enumerate(words)]
    df = spark.createDataFrame(nodes, "id string, label string, aliases array<string>")
    kept = graph.name_grams(df)
    for terms in (["abc", "aabb"], ["a"], ["", "abcd"], ["dcbaabcd", "ab", "éa"], ["zzzz"]):
        want = {}
        for i, label, aliases in nodes:
            names = {" ".join(x.split()) for x in [label, *(aliases or [])]}
            s = sum(max(plain_score(n, t) for n in names) for t in terms) / len(terms)
            if s > 0:
                want[i] = round(s, 9)
        for index in (None, kept):
            assert {r["id"]: round(r["match_score"], 9) for r in graph.search(df, terms, index=index).collect()} == want
    plan = graph.search(df, ["abc", "aabb"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("least", [1, 2, 3])
def test_pairs_with_a_hot_group(spark, least):
    random.seed(least)
    rows = [(i, "hot") for i in range(60)] + [(random.randint(0, 90), f"g{random.randint(0, 30)}") for _ in range(250)] + [(None, "hot"), (1, None), (1, "hot")]
    groups: dict = {}
    for i, g in rows:
        if i is not None and g is not None:
            groups.setdefault(g, set()).add(i)
    want: dict = {}
    for items in groups.values():
        for a in items:
            for b in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "item int, group string")
    got = pairs.counted(df, least, block=7)
    assert {(r["source"], r["target"]): r["n"] for r in got.collect()} == {k: n for k, n in want.items() if n >= least}


def test_a_hot_group_proposes_nothing_and_is_many_cells(spark):
    """With a least count of two, a group that every item is in makes no pairs; counted alone, its pairs spread over cells."""
    rows = spark.range(400).select(F.col("id").alias("item"), F.lit("hot").alias("group")).unionByName(spark.range(400).select(F.col("id").alias("item"), F.floor(F.col("id") / 2).cast("string").alias("group")))
    got = {(r["source"], r["target"], r["n"]) for r in pairs.counted(rows, 2, block=50).collect()}
    assert got == {(i, i + 1, 2) for i in range(0, 400, 2)}
    cells = pairs.together(rows.filter("group = 'hot'"), block=50).groupBy(F.spark_partition_id()).count()
    assert cells.agg(F.sum("count")).first()[0] == 400 * 399 // 2 and cells.count() > 1


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_crowded_groups_are_counted_in_cells(spark, monkeypatch, least, kind):
    """Cells of items count what joined rows count, over many cells and strips of groups, and no pair is shuffled after them."""
    random.seed(least)
    rows = [(i, g) for g in range(1200) for i in random.sample(range(50), 2)] + [(i, 5000) for i in range(60)] + [(None, 1), (1, None), (1, 5000)]
    df = spark.createDataFrame(rows, "item int, group int").selectExpr(f"cast(item as {kind}) item", "group")
    monkeypatch.setattr(pairs, "CELL", 13)
    seen = lambda d: sorted(tuple(r) for r in d.collect())
    got = pairs.counted(df, least, crowded=True)
    assert seen(got) == seen(pairs.counted(df, least, crowded=False)) == seen(pairs.counted(df, least))
    assert seen(pairs.partners(df, least, crowded=True)) == seen(pairs.partners(df, least, crowded=False))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan[: plan.index("FlatMapGroupsInArrow")] for x in ("Aggregate", "Join"))
