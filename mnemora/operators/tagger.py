"""Names of people, places and organisations in running text, by a sequence tagger learned from labelled sentences.

A structured perceptron with averaged weights: a sentence's tags are the best path over its tokens' features and the step from tag
to tag (Viterbi). It is fitted on the driver on a bounded sample of labelled sentences (``SAMPLE``, drawn by hash, so the same in every run); texts
of any number are tagged in Arrow batches, each task with the model, whose size is checked before it is sent.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.shared import ship

#: Most sentences that the model is fitted on, most passes over them, most bytes of a model that tasks carry.
SAMPLE, PASSES, MODEL_BYTES = 20_000, 5, 32 << 20
KINDS = ("person", "place", "project")
#: How sure a mention of each kind is.
CONFIDENCE = {"person": 0.8, "place": 0.7, "project": 0.6}
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TOKEN = re.compile(r"\w+(?:[.'’-]\w+)*|[^\w\s]")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-ÞΑ-ΩА-Я\"'(])|\n+")


def shape(token: str) -> str:
    """Runs of upper case, lower case, digits and others, each once."""
    out = "".join("X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else "-" for c in token)
    return re.sub(r"(.)\1+", r"\1", out)


def features(tokens: list[str]) -> list[list[str]]:
    padded = ["<", *tokens, ">"]
    low, form = [t.lower() for t in padded], [shape(t) for t in padded]
    return [
        [
            "bias", f"w={low[i]}", f"s={low[i][-3:]}", f"f={form[i]}", f"p={low[i - 1]}", f"n={low[i + 1]}", f"pf={form[i - 1]} {form[i]}", f"fn={form[i]} {form[i + 1]}",
            f"pw={low[i - 1]} {form[i]}", f"nw={form[i]} {low[i + 1]}", f"first={i == 1} {form[i]}",
        ]
        for i in range(1, len(padded) - 1)
    ]


#: From tag a (or the start, the last row) to tag b: an inside tag goes on with its own kind alone.
ALLOWED = [[not b.startswith("I-") or (a != "start" and a[1:] == b[1:] and a != "O") for b in TAGS] for a in (*TAGS, "start")]


@dataclass(frozen=True)
class Tagger:
    """Weights by feature and tag, and of the steps between tags (the last row: from the start)."""

    weights: dict[str, list[float]]
    steps: list[list[float]]

    def tags(self, tokens: list[str]) -> list[str]:
        """The best tags of a sentence."""
        return [TAGS[t] for t in _best(self.weights, self.steps, features(tokens))] if tokens else []

    def names(self, text: str) -> list[tuple[str, str]]:
        """(text, kind) of the names of a text, in order."""
        found = []
        for sentence in SENTENCE.split(text):
            places = [(m.start(), m.end()) for m in TOKEN.finditer(sentence)]
            start = kind = None
            tags = [*self.tags([sentence[a:b] for a, b in places]), "O"]
            for i, tag in enumerate(tags):
                if start is not None and not tag.startswith("I-"):
                    found.append((sentence[places[start][0] : places[i - 1][1]], kind))
                    start = None
                if tag.startswith("B-"):
                    start, kind = i, tag[2:]
        return found

    def dumps(self) -> str:
        return json.dumps({"weights": self.weights, "steps": self.steps})

    @staticmethod
    def loads(text: str) -> Tagger:
        return Tagger(**json.loads(text))


def _best(weights, steps, feats: list[list[str]]) -> list[int]:
    import numpy as np

    k = len(TAGS)
    own = np.zeros((len(feats), k))
    for i, fs in enumerate(feats):
        for f in fs:
            w = weights.get(f)
            if w is not None:
                own[i] += w
    step = np.where(ALLOWED, np.asarray(steps), -1e9)
    score, back = own[0] + step[k], []
    for i in range(1, len(feats)):
        every = score[:, None] + step[:k]
        back.append(every.argmax(axis=0))
        score = every.max(axis=0) + own[i]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def fit_sentences(sentences: list[tuple[list[str], list[str]]], passes: int = PASSES) -> Tagger:
    """The averaged perceptron over (tokens, tags)."""
    import random

    k = len(TAGS)
    number = {t: i for i, t in enumerate(TAGS)}
    data = [(features(tokens), [number[t] for t in tags]) for tokens, tags in sentences if tokens]
    weights, sums = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [0.0] * k)
    steps, step_sums = [[0.0] * k for _ in range(k + 1)], [[0.0] * k for _ in range(k + 1)]
    now, draw = 1, random.Random(7)
    for _ in range(passes):
        wrong = 0
        draw.shuffle(data)
        for feats, gold in data:
            now += 1
            guess = _best(weights, steps, feats)
            if guess == gold:
                continue
            wrong += 1
            for i, fs in enumerate(feats):
                a, b = (gold[i - 1], guess[i - 1]) if i else (k, k)
                for (row, tag), by in (((a, gold[i]), 1.0), ((b, guess[i]), -1.0)):
                    steps[row][tag] += by
                    step_sums[row][tag] += by * now
                if gold[i] != guess[i]:
                    for f in fs:
                        for tag, by in ((gold[i], 1.0), (guess[i], -1.0)):
                            weights[f][tag] += by
                            sums[f][tag] += by * now
        if not wrong:
            break
    mean = lambda w, s: [x - y / now for x, y in zip(w, s, strict=True)]
    kept = {f: [round(x, 6) for x in mean(w, sums[f])] for f, w in weights.items()}
    return Tagger({f: w for f, w in kept.items() if any(w)}, [mean(w, s) for w, s in zip(steps, step_sums, strict=True)])


def fit(labelled: DataFrame, sample: int = SAMPLE, passes: int = PASSES) -> Tagger:
    """Learns from sentences (tokens array<string>, tags array<string>), of more than ``sample`` those of the least hashes."""
    few = labelled.select("tokens", "tags").filter(F.size("tokens") == F.size("tags")).orderBy(F.xxhash64("tokens"), "tokens", "tags").limit(sample).collect()
    return fit_sentences([(list(r["tokens"]), list(r["tags"])) for r in few], passes)


def labelled_by(sentences: DataFrame, names: dict[str, str]) -> DataFrame:
    """Labelled sentences (tokens, tags) of plain ones (text): every occurrence of a known name (name: kind) is tagged, the longest first."""
    known = {tuple(TOKEN.findall(n)): k for n, k in names.items()}
    longest = max(map(len, known), default=0)

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            rows = []
            for text in pdf["text"].dropna():
                for sentence in SENTENCE.split(text):
                    tokens, i = TOKEN.findall(sentence), 0
                    tags = ["O"] * len(tokens)
                    while i < len(tokens):
                        n = next((n for n in range(min(longest, len(tokens) - i), 0, -1) if tuple(tokens[i : i + n]) in known), 0)
                        if n:
                            kind = known[tuple(tokens[i : i + n])]
                            tags[i : i + n] = [f"B-{kind}", *[f"I-{kind}"] * (n - 1)]
                        i += max(n, 1)
                    if tokens:
                        rows.append((tokens, tags))
            yield pd.DataFrame(rows, columns=["tokens", "tags"])

    ship(sentences.sparkSession)
    return sentences.select("text").mapInPandas(run, "tokens array<string>, tags array<string>")


def tagged_names(texts: DataFrame, tagger: Tagger, text: Column | None = None) -> DataFrame:
    """texts with ``names``, an array of (text, type, confidence) in order, each once. A null text has none. Raises where the model is too large to go with every task."""
    model = tagger.dumps()
    if len(model) > MODEL_BYTES:
        raise ValueError(f"a model of {len(model)} bytes is too large for every task; fit it on fewer sentences")

    @F.pandas_udf("array<struct<text:string,type:string,confidence:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Tagger.loads(model)
        for column in batches:
            yield pd.Series([[{"text": t, "type": k, "confidence": CONFIDENCE[k]} for t, k in dict.fromkeys(own.names(x or ""))] for x in column])

    ship(texts.sparkSession)
    return texts.withColumn("names", run(F.col("text") if text is None else text))
