from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000)) + "."


def rows(texts):
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts: spark.createDataFrame(rows(texts), DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


ODD = [None, "", " ", "\n\n", "one", "one two three four", "A.\nB.\nC.\nD.", "A.\nB.\nC.\nD.", "é ü ß   x", "x" * 5000, LONG, LONG, "tab\tand\rreturn\x0bhere", "++--@@..@a.b", "1.2.3.4.5.6.7.8 +1 (2"]
#: Names that the operators use themselves, with values that must come through.
CLASHING = ("q", "d", "th", "row", "_id", "_th", "_drop", "_w", "_l", "sha", "found", "n", "s1", "s2", "tokens", "rep", "kept", "w", "key", "lot", "shard")


@pytest.fixture(scope="session")
def odd(docs_of):
    from pyspark.sql import functions as F

    df = docs_of(ODD)
    df = df.unionByName(df.filter("doc_id in (5, 7, 10)"))  # repeated rows
    df = df.unionByName(df.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])
