"""Canonical files and the store: promotion, compilation, salience, forgetting, renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import edge_id, slug


def forgotten_ids(tombstones: DataFrame, forgotten: DataFrame) -> DataFrame:
    return tombstones.select("id").unionByName(forgotten.select("id")).distinct()


def to_promote(captures: DataFrame, gone: DataFrame, files: DataFrame, promoted: DataFrame) -> DataFrame:
    """The first capture of each id that is neither forgotten, nor a file (id), nor promoted before (id)."""
    w = Window.partitionBy("id").orderBy("ts", "title")
    first = captures.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    for other in (gone, files, promoted):
        first = first.join(other.select("id"), "id", "left_anti")
    return first


def target_paths(memories: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, path) of new files: the slug of the title in the directory of the scope, with -2 to -99 where that is taken. A memory for which none of these is free has a null path: it is reported, not dropped.

    A title may itself end in such a number: its own file comes before another's numbered one.
    """
    m = memories.withColumn("stem", F.concat_ws("/", F.coalesce("scope", F.lit("global")), F.coalesce(slug(F.col("title")), F.lit("memory"))))
    names = taken.select(F.regexp_replace("path", r"\.md\z", "").alias("name"))
    numbered = names.unionByName(m.select(F.col("stem").alias("name"))).withColumn("k", F.expr("try_cast(regexp_extract(name, '-([2-9]|[1-9][0-9])$', 1) AS int)")).filter("k is not null")
    used = names.select(F.col("name").alias("stem"), F.lit(1).alias("k")).unionByName(numbered.select(F.regexp_replace("name", r"-\d+\z", "").alias("stem"), "k"))
    used = used.groupBy("stem").agg(F.collect_set("k").alias("used"))  # 99 numbers at most
    w = Window.partitionBy("stem").orderBy("id")
    n = m.withColumn("r", F.row_number().over(w)).join(used, "stem", "left")
    k = F.get(F.array_except(F.sequence(F.lit(1), F.lit(99)), F.coalesce("used", F.array().cast("array<int>"))), F.col("r") - 1)
    return n.withColumn("k", k).select("id", F.when(F.col("k").isNotNull(), F.concat("stem", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(F.lit("")), F.lit(".md"))).alias("path"))


def compiled(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Files (path, id, ...) that become nodes: the first path of each id, none that is forgotten."""
    w = Window.partitionBy("id").orderBy("path")
    return files.join(gone.select("id"), "id", "left_anti").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def duplicate_ids(files: DataFrame) -> DataFrame:
    return files.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def stale_edges(edges: DataFrame, compiled_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Explicit edges out of compiled nodes that the files no longer state. fresh: id of the edges they state."""
    return edges.filter(F.col("type") == "explicit").join(compiled_ids.select(F.col("id").alias("source")), "source", "left_semi").join(fresh.select("id"), "id", "left_anti")


def deleted_files(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Paths compiled before that are gone now."""
    return ledger.join(files.select("path"), "path", "left_anti")


def salience(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files with counts and dates raised to those of their nodes; nothing is lowered."""
    n = nodes.select(F.col("id").alias("_id"), F.col("reinforcement_count").alias("_r"), F.col("last_reinforced").alias("_l"))
    f = files.join(n, files["id"] == n["_id"], "left")
    return f.withColumns({
        "reinforcement_count": F.greatest("reinforcement_count", F.coalesce("_r", F.lit(0))), "last_reinforced": F.greatest("last_reinforced", F.coalesce("_l", F.col("last_reinforced"))),
    }).drop("_id", "_r", "_l")


def forget(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without some nodes, their edges, embeddings and links."""
    gone = ids.select("id")
    out = dict(tables)
    out["nodes"] = tables["nodes"].join(gone, "id", "left_anti")
    e = tables["edges"].join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
    out["edges"] = e.join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(tables["edges"].columns)
    if "embeddings" in tables:
        out["embeddings"] = tables["embeddings"].join(gone, "id", "left_anti")
    if "episode_entities" in tables:
        out["episode_entities"] = tables["episode_entities"].join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti").select(tables["episode_entities"].columns)
    return out


def renamed_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with endpoints renamed (names: old, new) and their ids made anew."""
    a, b = names.select(F.col("old").alias("_s"), F.col("new").alias("_sn")), names.select(F.col("old").alias("_t"), F.col("new").alias("_tn"))
    e = edges.join(a, edges["source"] == a["_s"], "left").join(b, edges["target"] == b["_t"], "left")
    e = e.withColumns({"source": F.coalesce("_sn", "source"), "target": F.coalesce("_tn", "target")})
    directed = F.col("directed") if "directed" in edges.columns else F.lit(False)
    return e.withColumn("id", edge_id(F.col("source"), F.col("target"), F.col("type"), directed)).drop("_s", "_sn", "_t", "_tn")


def renamed_ids(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    n = names.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
    return df.join(n, df[column] == n["_o"], "left").withColumn(column, F.coalesce("_n", column)).drop("_o", "_n")


def database_only(nodes: DataFrame) -> DataFrame:
    """Memories that no file holds: those that were remembered or captured, without a canonical path."""
    return nodes.filter(F.col("canonical_path").isNull() & F.exists("source_files", lambda f: f.startswith("mcp:") | f.startswith("api:") | f.startswith("sdk:") | f.startswith("capture:")))


def replayed(captures: DataFrame, gone: DataFrame, files: DataFrame) -> DataFrame:
    """Captures that no file holds yet, as candidate nodes; ids may come in more than once, the first counts."""
    w = Window.partitionBy("id").orderBy("ts", "title")
    first = captures.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    first = first.join(gone.select("id"), "id", "left_anti").join(files.select("id"), "id", "left_anti")
    return first.select("id", F.col("title").alias("label"), F.lit("candidate").alias("status"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_reinforced"))


def exported(nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, export_id, path) of memories that only the store holds, as the files they become."""
    m = database_only(nodes).select(F.col("id").alias("old"), F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat(F.lit("export|"), "id"), 256), 1, 12)).alias("id"), F.col("label").alias("title"), F.lit("global").alias("scope"))
    return m.join(target_paths(m, taken), "id").select(F.col("old").alias("id"), F.col("id").alias("export_id"), "path")
