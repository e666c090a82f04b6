from __future__ import annotations

import random


from mnemora.operators import extract, tagger
from mnemora.plans import catalog, ingest_queries


def test_planted_names_of_the_query(spark, sf_dir):
    """Names of every note against those planted; half of the people and organisations are not among the marked ones."""
    got = {(r["c_custkey"], r["name"]) for r in catalog.QUERIES["names_tagged"](spark, sf_dir).collect()}
    want = {(r["c_custkey"], n) for r in ingest_queries.name_notes(spark, sf_dir).collect() for n in r["names"]}
    right = len(got & want)
    assert len(want) > 250 and right / len(got) >= 0.95 and right / len(want) >= 0.95


def test_names_never_seen(spark):
    """Fitted on sentences with some names, held against others in the same and in other sentences."""
    random.seed(9)
    firsts, lasts = ["Ada", "Berta", "Carl", "Dora", "Emil", "Frida", "Georg", "Hanna", "Ivo", "Jana"], ["Ahlers", "Berger", "Conrad", "Dietz", "Ebert", "Franke", "Gruber", "Huber", "Imhof", "Jung"]
    places, firms = ["Lisbon", "Oslo", "Vienna", "Prague", "Riga", "Turin", "Ghent", "Malmo"], ["Acme Labs", "Delta Foundation", "Orion Institute", "Vega Corp", "Nova Labs", "Terra Institute"]
    plain = ["The build failed again.", "We ship on Monday.", "Please review the plan.", "Nothing was said about it.", "It is a good day to rest."]
    forms = ["{p} met {q} in {l}.", "Then {p} joined {o}.", "The office in {l} is run by {p}.", "{o} opened a branch in {l}.", "Ask {p} or {q} about it.", "I saw {p} at {o} today."]
    new_forms = ["Later {p} left for {l}.", "Our guest {p} comes from {o}."]

    def note(f, people, places, firms):
        p, q = random.sample(people, 2)
        place, firm = random.choice(places), random.choice(firms)
        used = {v: k for key, v, k in (("{p}", p, "person"), ("{q}", q, "person"), ("{l}", place, "place"), ("{o}", firm, "project")) if key in f}
        return f.format(p=p, q=q, l=place, o=firm) + " " + random.choice(plain), used

    old = [f"{a} {b}" for a in firsts[:6] for b in lasts[:6]]
    new = [f"{a} {b}" for a in firsts[6:] for b in lasts[6:]]
    train = [note(random.choice(forms), old, places[:5], firms[:4]) for _ in range(400)]
    known = {n: k for _, used in train for n, k in used.items()}
    df = spark.createDataFrame([(t,) for t, _ in train], "text string")
    model = tagger.fit(tagger.labelled_by(df, known))
    again = tagger.fit(tagger.labelled_by(df.repartition(3), known))
    assert model.dumps() == again.dumps()
    test = [note(random.choice(forms + new_forms), new, places[5:], firms[4:]) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(test)], "i int, text string")
    got = {(r["i"], x["text"], x["type"]) for r in tagger.tagged_names(rows, model).collect() for x in r["names"]}
    want = {(i, n, k) for i, (_, used) in enumerate(test) for n, k in used.items()}
    precision, recall = len(got & want) / len(got), len(got & want) / len(want)
    assert precision > 0.9 and recall > 0.9, (precision, recall)
    # as mentions of sections
    s = spark.createDataFrame([("a.md", "## S", "S", 1, "Later **Hanna Huber** met [[Jana Jung]] in Turin.")], "file string, section string, heading string, line long, content string")
    found = {(r["text"], r["type"], r["confidence"]) for r in extract.tagged_by(s, model).collect()}
    assert {("Hanna Huber", "person", 0.8), ("Jana Jung", "person", 0.8), ("Turin", "place", 0.7)} <= found


def test_odd_texts(spark):
    model = tagger.fit_sentences([(["Ada", "Ahlers", "came", "."], ["B-person", "I-person", "O", "O"]), (["Nothing", "new", "."], ["O", "O", "O"]), ([], [])])
    rows = spark.createDataFrame([(None,), ("",), ("  \n ",), ("?!",), ("Ada Ahlers came. Ada Ahlers came.",), ("word " * 20_000,)], "text string")
    names = [[x["text"] for x in r["names"]] for r in tagger.tagged_names(rows, model).collect()]
    assert names[:4] == [[], [], [], []] and names[4] == ["Ada Ahlers"] and len(names) == 6
    assert tagger.tagged_names(rows.limit(0), model).count() == 0
    empty = tagger.fit(spark.createDataFrame([], "tokens array<string>, tags array<string>"))
    assert empty.names("Ada came.") == []
    # an inside tag never begins a name
    for tokens in (["a"], ["a", "b"], ["X", "y", "Z"]):
        tags = model.tags(tokens)
        assert all(not t.startswith("I-") or (i and tags[i - 1][1:] == t[1:]) for i, t in enumerate(tags))
