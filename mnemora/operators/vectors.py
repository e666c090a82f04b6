"""Exact vector search, embedder interface and the deterministic mock embedder."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.config import EMBED_BATCH
from mnemora.shared import ship


class EncoderMismatch(ValueError):
    """Vectors of another encoder or length than the index holds."""


def fingerprint(embeddings: DataFrame) -> str | None:
    """``provider:dimensions`` of an index; None where it is empty. Raises where rows disagree."""
    found = [r[0] for r in embeddings.select(F.concat_ws(":", "provider", F.col("dimensions").cast("string"))).distinct().limit(2).collect()]
    if len(found) > 1:
        raise EncoderMismatch(f"the index mixes {found[0]} and {found[1]}")
    return found[0] if found else None


def search(embeddings: DataFrame, query: list[float], limit: int = 10, least: float | None = None, kind: str | None = None) -> DataFrame:
    """(id, similarity) of the nearest rows by cosine; rows of other lengths are passed over, a zero norm is similar to nothing.

    The query is a literal and every row is read once; each task keeps its best rows, the last step merges them.
    """
    e = embeddings if kind is None else embeddings.filter(F.col("type") == kind)
    e = e.filter(F.size("vector") == len(query))
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("vector", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(F.transform("vector", lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    norm = float(sum(x * x for x in query)) ** 0.5
    sim = F.when((own == 0) | F.lit(norm == 0), F.lit(0.0)).otherwise(dot / (own * F.lit(norm or 1.0)))
    out = e.select("id", sim.alias("similarity"))
    if least is not None:
        out = out.filter(F.col("similarity") >= least)
    return out.orderBy(F.desc(F.round("similarity", 12)), "id").limit(limit)


def mock_vectors(texts: list[str], dimensions: int = 64):
    """Unit vectors from a 32-bit hash; the products are taken in doubles first, and that rounding is part of the result."""
    import numpy as np

    def to32(x: int) -> int:
        x &= 0xFFFFFFFF
        return x - (1 << 32) if x >= 1 << 31 else x

    out = []
    for text in texts:
        h = 0
        units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2")
        for u in units.tolist():
            h = to32((h << 5) - h + u)
        vec = np.empty(dimensions, np.float32)
        for i in range(dimensions):
            h = to32((h << 13) ^ h)
            h = to32(int(np.float64(h) * np.float64(0x5BD1E995)))
            h = to32(h ^ (h >> 15))
            vec[i] = (h & 0xFFFF) / 0x10000 - 0.5
        norm = float(np.sqrt((vec.astype(np.float64) ** 2).sum()))
        out.append((vec.astype(np.float64) / norm).astype(np.float32) if norm > 0 else vec)
    return out


Embedder = Callable[[list[str]], list]


def embed(rows: DataFrame, embedder: Embedder = mock_vectors, provider: str = "mock") -> DataFrame:
    """Embedding rows of (id, type, content), some at a time; the embedder may be any function from texts to vectors.

    A batch that the embedder fails on has no rows, and the others go on; ``stale`` finds its contents for the next run.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for i in range(0, len(pdf), EMBED_BATCH):
                part = pdf.iloc[i : i + EMBED_BATCH]
                try:
                    v = embedder(part["content"].fillna("").tolist())
                except Exception as error:
                    logging.getLogger(__name__).warning("no embeddings for %d rows: %s", len(part), error)
                    continue
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "type": part["type"].to_numpy(), "content": part["content"].to_numpy(), "vector": [x.tolist() for x in v],
                    "dimensions": [len(x) for x in v], "provider": provider, "vector_norm": [float((x.astype("float64") ** 2).sum()) ** 0.5 for x in v],
                })

    ship(rows.sparkSession)
    return rows.select("id", "type", "content").mapInPandas(run, "id string, type string, content string, vector array<float>, dimensions int, provider string, vector_norm double")


def stale(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows (id, content) whose content has no embedding yet."""
    return rows.join(embeddings.select("id", "content"), ["id", "content"], "left_anti")


def node_text(label: Column, excerpts: Column) -> Column:
    """What is embedded of a node: its label and the texts of its excerpts."""
    return F.concat(label, F.lit(" — "), F.array_join(F.transform(F.coalesce(excerpts, F.array().cast("array<struct<file:string,text:string,date:string>>")), lambda x: x["text"]), ". "))


def from_bytes(column: Column) -> Column:
    """Vectors that other stores keep as little-endian single-precision bytes, without Python: sign, exponent and fraction of each."""
    places = F.sequence(F.lit(0), (F.octet_length(column) / 4).cast("int") - 1)

    def one(i: Column) -> Column:
        byte = lambda k: F.conv(F.hex(F.substring(column, i * 4 + k, F.lit(1))), 16, 10).cast("long")
        bits = byte(1) + byte(2) * 256 + byte(3) * 65536 + byte(4) * 16777216
        sign, exponent, fraction = F.when(bits >= 1 << 31, -1.0).otherwise(1.0), F.floor(bits / (1 << 23)) % 256, bits % (1 << 23)
        whole = F.when(exponent == 0, fraction * 2.0**-149).otherwise((fraction + (1 << 23)) * F.pow(F.lit(2.0), exponent - 150))
        return (sign * whole).cast("float")

    return F.when(F.octet_length(column) >= 4, F.transform(places, one)).otherwise(F.array().cast("array<float>"))


def counts_by_type(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def missing(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, label) of nodes without an embedding."""
    return nodes.join(embeddings.select("id"), "id", "left_anti").select("id", "label")


def coverage(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: nodes, embedded ones, percent."""
    have = nodes.select("id").join(embeddings.select(F.col("id"), F.lit(1).alias("e")).distinct(), "id", "left")
    return have.agg(F.count(F.lit(1)).alias("total"), F.count("e").alias("embedded")).withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("embedded") / F.col("total")).otherwise(0.0))
