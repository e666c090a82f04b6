"""Embedding of single nodes as they are written: best effort, and never silent about what is not searchable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.operators import vectors
from mnemora.shared import written
from mnemora.store import GraphStore, full

#: Reasons, and what they tell a user.
WARNINGS = {
    "encoder-mismatch": "Not semantically searchable: the store's vectors use a different encoder. Embed all anew or fix the provider's settings.",
    "provider-config": "Not semantically searchable: the store is configured for a different embedding provider.",
    "error": "Not semantically searchable: the embedding call failed (provider unavailable?). Embed again to fill in.",
}


def embed_nodes(store: GraphStore, ids: DataFrame, embedder: vectors.Embedder | None, provider: str = "mock", dimensions: int = 64) -> DataFrame:
    """(id, embedded, reason, warning) of nodes (ids: id), which get their vectors where the store's index is of the same encoder.

    reason: null where embedded; ``no-provider`` without an embedder, ``encoder-mismatch`` where the index holds vectors of another provider or length,
    ``provider-config`` where the store is stamped for another provider, ``error`` where the embedder failed on a node's batch. A refused or failed node never
    fails the write; the first vectors stamp the store. Unknown ids have no row.
    """
    nodes = written(store.lookup("nodes", ids.select("id")).select("id", F.lit("node").alias("type"), vectors.node_text(F.col("label"), F.col("excerpts")).alias("content")), "to-embed")
    have = vectors.fingerprint(store.table("embeddings"))
    stamp = store.get("meta", "embedding_provider")
    reason = None
    if embedder is None:
        reason = "no-provider"
    elif have and have != f"{provider}:{dimensions}":
        reason = "encoder-mismatch"
    elif stamp and stamp["value"] != provider:
        reason = "provider-config"
    if reason:
        out = nodes.select("id", F.lit(False).alias("embedded"), F.lit(reason).alias("reason"))
    else:
        new = written(full(vectors.embed(nodes, embedder, provider), "embeddings"), "embedded")
        changes = {"embeddings": (new, None)}
        if not stamp and new.limit(1).count():
            changes["meta"] = (store.spark.createDataFrame([("embedding_provider", provider), ("embedding_dimensions", str(dimensions))], "key string, value string"), None)
        store.commit(changes=changes)
        done = nodes.select("id").join(new.select("id", F.lit(True).alias("e")), "id", "left")
        out = done.select("id", F.coalesce("e", F.lit(False)).alias("embedded"), F.when(F.col("e").isNull(), F.lit("error")).alias("reason"))
    said = F.lit("")
    for name, text in WARNINGS.items():
        said = F.when(F.col("reason") == name, F.lit(text)).otherwise(said)
    return out.withColumn("warning", said)
