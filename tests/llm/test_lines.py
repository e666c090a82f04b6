from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from mnemora.llm import lines

from .conftest import CLASHING, ODD


WHITE = " \t\n\x0b\x0c\r"


def key(x):
    return re.sub(r"[ \t-\r]+", " ", x.lower().strip(WHITE))


def later(docs, units, least):
    """{doc: covered places} of windows of three units that occur earlier too, of runs with a window of so many characters. units: from a text to (place, key)."""
    seen, gone = {}, {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        own = units(text or "")
        runs = []
        for j in range(len(own) - 2):
            w = tuple(x[1] for x in own[j : j + 3])
            if seen.setdefault(w, (i, own[j][0])) != (i, own[j][0]):
                if not runs or j - runs[-1][-1][0] > 3:
                    runs.append([])
                runs[-1].append((j, sum(map(len, w))))
        for run in runs:
            if max(n for _, n in run) >= least:
                gone.setdefault(i, set()).update(own[j + k][0] for j, _ in run for k in range(3))
    return gone


def pieces(text):
    return [x for x in re.findall(r"(?s).*?(?:[.!?,;:][ \t-\r]+|\Z)", text) if x]


def plain(docs, clauses=True):
    """Texts after dedup; docs: (id, text) in order."""
    gone = later(docs, lambda t: [(k, key(x)) for k, x in enumerate(t.split("\n")) if x.strip(WHITE)], 0)
    cut = later(docs, lambda t: [(k, key(x)) for k, x in enumerate(pieces(t))], 80) if clauses else {}
    out = {}
    for i, text in docs:
        own = (text or "").split("\n")
        rest = "".join(re.sub(r"[^\n]+", "", x) if k in cut.get(i, ()) else x for k, x in enumerate(pieces(text or ""))).split("\n")
        left = [r for k, (x, r) in enumerate(zip(own, rest or [""], strict=False)) if k not in gone.get(i, ()) and x.strip(WHITE) and r.strip(WHITE)]
        out[i] = "\n".join(left) if i in gone or i in cut else text or ""
    return out


def test_by_brute_force(documents):
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert {r["doc_id"]: r["text"] for r in lines.report(documents).collect()} == plain(texts)


def test_overlaps(docs_of):
    texts = ["a\nb\nc\nd", "x\nA \n b\nc\ny", "b\nc\nd\nz", "r\nr\nr\nr\nr\n\nend", "p\n\nq\n\n\ns", "p\nq\ns"]
    assert {r["doc_id"]: r["text"] for r in lines.report(docs_of(texts)).collect()} == plain(list(enumerate(texts)))


PASSAGE = (
    "The keeper of the old lighthouse wrote each evening, in a small blue book, what ships had passed. Some nights nothing came; then he drew the waves, the gulls, the moon. "
    "When the book was full he began another, and nobody ever asked him why he did so. He would have said that a light without a record is only half a light."
)


def test_passages_within_lines(docs_of):
    """A passage of over 50 words goes from where it stands again, be it inside a line, at its end, or wrapped in another way; the rest stays."""
    assert len(PASSAGE.split()) > 50
    a, b, c = ("Alpha one begins here with words of its own. ", "Beta two has quite another way to start, as one sees. ", "Gamma three is a third. ")
    end = " And so it ends with other words in number %d of all."
    wrapped = re.sub(r"((?:\S+ ){9})", r"\1\n", PASSAGE)
    texts = [a + PASSAGE + end % 1, b + PASSAGE + end % 2, c + wrapped + end % 3, PASSAGE, "Short. Yes. No. Short. Yes. No.", "Yes. No. Short, and well. Yes. No."]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_cut"]) for r in lines.report(docs_of(texts)).collect()}
    assert {i: t for i, (t, _, _) in got.items()} == plain(list(enumerate(texts)))
    assert got[0][0] == texts[0] and got[1][0] == b + (end % 2).strip() and "lighthouse" not in got[2][0] and "Gamma" in got[2][0] and "number 3" in got[2][0] and got[3][0] == ""
    assert got[4] == (texts[4], 0, 0) and got[5] == (texts[5], 0, 0)


def test_shuffled_joins(documents, monkeypatch):
    """Nothing broadcast gives the same."""
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    some = documents.limit(60)
    texts = [(r["doc_id"], r["text"]) for r in some.collect()]
    assert {r["doc_id"]: r["text"] for r in lines.without_repeats(some, clauses=False).collect()} == plain(texts, False)
    assert {r["doc_id"]: r["text"] for r in lines.report(some).collect()} == plain(texts)


def test_odd_rows(odd, nothing):
    got = lines.report(odd).collect()
    assert len(got) == odd.count() and lines.report(nothing).count() == 0
    expected = plain(list(enumerate(ODD)))
    assert all(r["text"] == expected[r["doc_id"]] for r in got if r["doc_id"] is not None)
    out = lines.without_repeats(odd)
    assert out.columns == odd.columns and all(r[c] == f"own {c}" for r in out.collect() for c in CLASHING)


def test_long_texts_without_white_space(docs_of):
    texts = ["1,2.3;" * 60_000 + " and so on, as it goes, in the very same words, to the end of all.", "1,2.3;" * 60_000 + " and so on, as it goes, in the very same words, to the end of all.\n"]
    got = {r["doc_id"]: r["text"] for r in lines.report(docs_of(texts)).collect()}
    assert got == plain(list(enumerate(texts))) and got[1] == ""


def test_lower_case_at_ends_of_units(docs_of):
    """Lines are lower-cased one by one: letters whose lower case hangs on what follows, or has another length, are as in the whole text."""
    passage = "ΟΔΟΣ ΤΗΣ ΠΟΛΗΣ, ΚΑΙ Ο ΚΟΣΜΟΣ. İstanbul'da İYİ bir gün geçirdik, ve sonra EVE döndük. Straße UND GRÖSSE sind ÜBERALL, wie man weiß: ΤΕΛΟΣ"
    texts = [passage, "Alpha. " + passage.replace(", ", ",\n"), "Beta\n" + passage.swapcase().swapcase() + "\nGamma", "ΟΔΟΣ\nΤΗΣ\t ΠΟΛΗΣ\r\nÉTÉ", "x\n ΟΔΟΣ\n\nτης  ΠΟΛΗΣ\n\x0bété\x0c\nend"]
    assert {r["doc_id"]: r["text"] for r in lines.report(docs_of(texts)).collect()} == plain(list(enumerate(texts)))


def test_cost_of_units(spark, monkeypatch):
    """Both readings are cut and hashed in the time of some three passes of one regular expression; before it was over four and a half."""

    class Cut(Exception):
        pass

    def caught(df, label):
        assert label == "units"
        raise Cut(df)

    monkeypatch.setattr(lines, "kept", caught)
    words = F.concat_ws(" ", *[F.concat(F.lit("Word é"), F.col("id").cast("string"), F.lit(f" and {i} more of them stand here, then comes an end. "), F.lit("\n" if i % 3 == 0 else "")) for i in range(60)])
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit(0).cast("long").alias("th")).localCheckpoint()
    try:
        lines.removals(docs)
    except Cut as e:
        units = e.args[0]

    once, seconds = docs.select(F.split("text", "(?<=[.!?,;:]) ")), {}
    for _ in range(8):
        for name, df in (("units", units), ("once", once)):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            seconds[name] = min(time.perf_counter() - began, seconds.get(name, 99))
    assert seconds["units"] < 3.8 * seconds["once"], seconds
