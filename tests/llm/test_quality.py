from __future__ import annotations

from collections import Counter

from mnemora.llm import quality

from .conftest import CLASHING, ODD

WHITE = " \t\n\x0b\x0c\r"


def split(text):
    import re

    return [w for w in re.split(r"[ \t-\r]+", text or "") if w]


def plain(text):
    words, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_by_brute_force(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in quality.verdicts(documents).collect():
        expected = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])


def test_odd_rows(odd, nothing):
    got = quality.verdicts(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(ODD[r["doc_id"]])
    assert quality.verdicts(nothing).count() == 0


def test_line_rules(docs_of):
    good = "\n".join(" ".join(f"clean{i}x{j}" for j in range(12)) + "." for i in range(8))
    furniture = "\n".join(["Home | About | News | Contact | More"] + ["no closing mark here at all " * 3] * 2 + ["! ".join("shouted so often".split()) + "!"] + ["Read more about cookies and our privacy policy."])
    out = {r["doc_id"]: r["text"] for r in quality.keep_good(docs_of([good, good + "\n" + furniture, furniture * 6])).collect()}
    assert out == {0: good, 1: good}


def test_other_columns_come_through(odd):
    from pyspark.sql import functions as F

    kept = quality.keep_good(odd.withColumn("text", F.lit(" ".join(f"word{i} of text." for i in range(60)))))
    assert kept.columns == odd.columns
    row = kept.first()
    assert all(row[c] == f"own {c}" for c in CLASHING) and row["n_chars"] == len(row["text"])
