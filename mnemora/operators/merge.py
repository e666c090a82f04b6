"""From resolved mentions to nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import DEFAULT, EVIDENCE, EXCERPTS, TEMPORAL_PER_FILE, GraphConfig
from mnemora.functions.text import edge_id, node_id
from mnemora.functions.weights import stability
from mnemora.operators.dynamics import first_rows, graduate
from mnemora.shared import small_enough, written


def roll_up(sightings: DataFrame) -> DataFrame:
    """Nodes of sightings (node_id, label, type, file, section, ord, date, excerpt): every deduplicated mention is a sighting."""
    order = F.struct("file", "section", "ord")
    one = F.struct(F.col("file"), F.col("excerpt").alias("text"), F.col("date"))
    excerpts = first_rows(sightings.filter("excerpt is not null"), ["node_id"], ["file", "section", "ord"], EXCERPTS, one, "excerpts")
    nodes = sightings.groupBy("node_id").agg(
        F.min_by("label", order).alias("label"), F.min_by("type", order).alias("type"), F.count(F.lit(1)).alias("mention_count"),
        (F.count(F.lit(1)) - 1).alias("reinforcement_count"), F.min_by("date", order).alias("first_seen"), F.max_by("date", order).alias("last_reinforced"),
        F.sort_array(F.collect_set("file")).alias("source_files"),
    )
    none = F.array().cast(excerpts.schema["excerpts"].dataType)
    return nodes.join(excerpts, "node_id", "left").withColumn("excerpts", F.coalesce("excerpts", none)).withColumnRenamed("node_id", "id")


def often(sightings: DataFrame, least: int = DEFAULT.graduation) -> DataFrame:
    """(node_id) of nodes with so many sightings: no pair is seen more often than either of its nodes."""
    return sightings.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("node_id")


def only(sightings: DataFrame, nodes: DataFrame, most: int = 100_000) -> DataFrame:
    """The sightings of some nodes (node_id); those are written, and broadcast where they are few."""
    return sightings.join(if_few(nodes, most), "node_id", "left_semi")


def if_few(nodes: DataFrame, most: int = 100_000) -> DataFrame:
    """What was found of each node, written, and broadcast where that are few rows."""
    nodes = written(nodes, "nodes", lean=True)
    return F.broadcast(nodes) if small_enough(nodes, most) else nodes


def section_pairs(sightings: DataFrame) -> DataFrame:
    """Observations of unordered pairs of nodes in a section (file and heading), each once a section. All goes by section, or by file where the rows already do."""
    m = sightings.groupBy("file", "section", "node_id").agg(F.min("ord").alias("ord"), F.min("date").alias("date"))
    named = m.groupBy("file", "section").agg(F.sort_array(F.collect_list(F.struct("node_id", "ord", "date"))).alias("_n"))
    a = named.select("file", "section", "_n", F.posexplode("_n").alias("_i", "_a"))
    b = a.select("file", "section", "_a", F.explode(F.slice("_n", F.col("_i") + 2, F.size("_n"))).alias("_b"))
    return b.select("file", "section", F.col("_a.node_id").alias("source"), "_a.ord", "_a.date", F.col("_b.node_id").alias("target"), F.col("section").alias("context"))


def explicit(sightings: DataFrame, config: GraphConfig = DEFAULT) -> DataFrame:
    """Edges from links to all other nodes of their section; a pair seen n times, from either end, is reinforced n - 1 times. sightings: also is_link."""
    own = sightings.select("file", "section", "node_id", "is_link", "date").repartition("file", "section")  # once, for nodes of sections and for sections
    return _edges(explicit_pairs(own), "explicit", config)


def explicit_pairs(sightings: DataFrame) -> DataFrame:
    """(source, target, file, section, date) of every link and every other node of its section: made of a section's row, with no join."""
    m = sightings.filter("file is not null and section is not null").groupBy("file", "section", "node_id").agg(F.max(F.col("is_link").cast("int")).alias("link"), F.min("date").alias("date"))
    named = m.groupBy("file", "section").agg(F.collect_list(F.when(F.col("link") == 1, F.struct(F.col("node_id").alias("x"), "date"))).alias("_a"), F.collect_list("node_id").alias("_y"))
    a = named.select("file", "section", "_y", F.explode("_a").alias("_a"))
    b = a.select("file", "section", F.col("_a.x").alias("x"), "_a.date", F.explode("_y").alias("y")).filter("x <> y")
    return b.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "file", "section", "date")


def causal(sightings: DataFrame, sections: DataFrame, config: GraphConfig = DEFAULT) -> DataFrame:
    """Directed edges between the first two nodes of each causal section (file, section)."""
    return _edges(written(causal_pairs(sightings, sections), "causal-pairs"), "causal", config, directed=True)


def causal_pairs(sightings: DataFrame, sections: DataFrame) -> DataFrame:
    m = sightings.join(sections.select("file", "section").distinct(), ["file", "section"], "left_semi").groupBy("file", "section", "node_id").agg(F.min("ord").alias("ord"), F.min("date").alias("date"))
    w = Window.partitionBy("file", "section").orderBy("ord", "node_id")
    two = m.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("file", "section").agg(
        F.min_by("node_id", "r").alias("source"), F.max_by("node_id", "r").alias("target"), F.count(F.lit(1)).alias("n"), F.min("date").alias("date")
    )
    return two.filter("n = 2").drop("n")


def temporal(sightings: DataFrame, config: GraphConfig = DEFAULT) -> DataFrame:
    """Edges between nodes of different sections of a file, both mentioned twice or more by then; at most 50 are formed a file, in reading order.

    sightings: also section_ord.
    """
    place = F.struct("file", "section_ord", "ord")
    # a node counts from its second sighting on: the least place, and the least one after it, are combined before the shuffle
    twice = only(sightings, often(sightings, 2))
    first = twice.groupBy("node_id").agg(F.min(place).alias("_first"))
    second = twice.join(if_few(first), "node_id").filter(place > F.col("_first")).groupBy("node_id").agg(F.min(place).alias("_s")).select("node_id", "_s.*")
    kept = written(temporal_pairs(counted(twice, if_few(second))), "temporal-pairs")
    return _edges(kept.withColumn("section", F.lit("")).withColumn("date", F.col("date").cast(sightings.schema["date"].dataType)), "temporal", config)


def counted(sightings: DataFrame, second: DataFrame) -> DataFrame:
    """(file, section_ord, node_id, ord, date) of nodes in sections at or after their second place (node_id, file, section_ord, ord)."""
    place = F.struct("file", "section_ord", "ord")
    m = sightings.groupBy("file", "section_ord", "node_id").agg(F.min("ord").alias("ord"), F.max(place).alias("_last"), F.min("date").alias("date"))
    m = m.join(second.select("node_id", place.alias("_second")), "node_id").filter(F.col("_last") >= F.col("_second"))
    return m.select("file", "section_ord", "node_id", "ord", "date")


def temporal_pairs(m: DataFrame) -> DataFrame:
    """(file, source, target, date): the first different pairs of a file in reading order: section, later section, place in the one, place in the other.

    A pair first meets where the node that begins earlier does, at the other's first section; two that begin in one section meet there and at the
    first of their second sections. So two sections of every node are all that the walk needs, and a pair comes up four times at most before 50
    different ones are found, however often a file repeats its nodes.
    """

    def form(batches):
        import pyarrow as pa

        file, sections, out = None, {}, ([], [], [], [])

        def close():
            order, found = sorted(sections), {}
            pairs = ((x, y) for i, a in enumerate(order) for b in order[i + 1 :] for x in sections[a] for y in sections[b] if x[0] != y[0])
            for (x, _, date), (y, _, other) in pairs:
                pair = (x, y) if x < y else (y, x)
                if pair in found:
                    continue
                found[pair] = min(d for d in (date, other) if d is not None) if date or other else None
                if len(found) == TEMPORAL_PER_FILE:
                    break
            for (x, y), date in found.items():
                for column, value in zip(out, (file, x, y, date), strict=True):
                    column.append(value)

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["file", "source", "target", "date"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:  # a file may go on in the next one
            for own, section, node, place, date in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if own != file:
                    close()
                    file, sections = own, {}
                sections.setdefault(section, []).append((node, place, date))
            if len(out[0]) >= 10_000:
                yield flushed()
        close()
        yield flushed()

    begin = Window.partitionBy("file", "node_id").orderBy("section_ord")
    m = m.repartition("file").withColumn("_k", F.row_number().over(begin)).filter("_k <= 2")
    text = m.select(F.col("file").cast("string"), F.col("section_ord").cast("long"), F.col("node_id").cast("string"), F.col("ord").cast("long"), F.col("date").cast("string"))
    return text.sortWithinPartitions("file", "section_ord", "ord", "node_id").mapInArrow(form, "file string, source string, target string, date string")


def _edges(pairs: DataFrame, kind: str, config: GraphConfig, directed: bool = False) -> DataFrame:
    base = config.base_weights[kind]
    order = F.struct("file", "section", "date")
    one = F.struct(F.col("file"), F.col("date"), F.col("section").alias("context"))
    evidence = first_rows(pairs, ["source", "target"], ["file", "section", "date"], EVIDENCE, one, "evidence")
    g = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min_by("date", order).alias("first"), F.max_by("date", order).alias("last"))
    g = g.join(evidence, ["source", "target"], "left")  # every pair has some; an outer join is left out where nobody reads it
    rc = F.col("n") - 1
    return g.select(
        edge_id(F.col("source"), F.col("target"), F.lit(kind), F.lit(directed)).alias("id"), "source", "target", F.lit(kind).alias("type"), F.lit(directed).alias("directed"),
        F.lit(base).alias("weight"), F.lit(base).alias("base_weight"), rc.alias("reinforcement_count"), F.col("first").alias("first_formed"),
        F.col("last").alias("last_reinforced"), F.when(rc == 0, F.lit(1.0)).otherwise(stability(rc, config)).alias("stability"), "evidence",
    )


def build(sightings: DataFrame, causal_sections: DataFrame, config: GraphConfig = DEFAULT) -> dict[str, DataFrame]:
    """Nodes, edges of all four kinds, and pending pairs."""
    co, pending = graduate(section_pairs(sightings), config)
    edges = co.unionByName(explicit(sightings, config)).unionByName(causal(sightings, causal_sections, config)).unionByName(temporal(sightings, config))
    return {"nodes": roll_up(sightings), "edges": edges, "pending": pending}


def ingested(entities: DataFrame, nodes: DataFrame, edges: DataFrame, at: str) -> dict[str, DataFrame]:
    """Nodes and edges after new chunks' entities (conv_id, chunk, source, label, type, excerpts), only those that the chunks touch.

    Every chunk that names a node adds a mention and a reinforcement, the first one of a new node only a mention; what the store has of it
    (label, type, aliases, first sight, excerpts) stays. Every chunk with both ends of an edge reinforces it; a new edge begins at weight 0.3.
    An edge's first formation, weight and base weight stay. Excerpts are filled up to 10, evidence to 20.
    """
    e = entities.select(node_id(F.col("label")).alias("id"), "conv_id", "chunk", "source", "label", "type", "excerpts").dropDuplicates(["id", "conv_id", "chunk"])
    chunk = F.struct("conv_id", "chunk")
    delta = e.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("label", "type", "source"), chunk).alias("new"), F.min(chunk).alias("head"))
    old = nodes.select("id", F.struct(*[F.col(c) for c in nodes.columns]).alias("old"))
    d = delta.join(old, "id", "left")
    first = d.select("id", "head", F.col("old").isNull().alias("is_new"))
    texts = e.join(first, "id").select("id", "conv_id", "chunk", "source", F.posexplode(F.slice("excerpts", F.lit(1), F.when(F.col("is_new") & chunk.eqNullSafe(F.col("head")), 3).otherwise(1))).alias("p", "text"))
    seen = first_rows(texts, ["id"], ["conv_id", "chunk", "p"], EXCERPTS, F.struct(F.col("source").alias("file"), F.col("text"), F.lit(at).alias("date")), "seen")
    d = d.join(seen, "id", "left")
    kinds = {f.name: f.dataType for f in nodes.schema}
    own = lambda c: F.col(f"old.{c}") if c in kinds else F.lit(None)
    known = F.col("old").isNotNull()
    none = F.array().cast("array<struct<file:string,text:string,date:string>>")
    added = {
        "id": F.col("id"), "label": F.coalesce(own("label"), "new.label"), "type": F.coalesce(own("type"), "new.type"), "aliases": F.coalesce(own("aliases"), F.array().cast("array<string>")),
        "first_seen": F.coalesce(own("first_seen").cast("string"), F.lit(at)), "last_reinforced": F.lit(at), "mention_count": F.coalesce(own("mention_count"), F.lit(0)) + F.col("c"),
        "reinforcement_count": F.when(known, F.coalesce(own("reinforcement_count"), F.lit(0)) + F.col("c")).otherwise(F.col("c") - 1),
        "source_files": F.when(known, own("source_files")).otherwise(F.array("new.source")), "excerpts": F.slice(F.concat(F.coalesce(own("excerpts").cast("array<struct<file:string,text:string,date:string>>"), none), F.coalesce("seen", none)), 1, EXCERPTS),
    }
    rest = [own(c).alias(c) for c in nodes.columns if c not in added]
    new_nodes = d.select(*[v.alias(k) for k, v in added.items()], *rest)

    a, b = e.select("conv_id", "chunk", "source", F.col("id").alias("x")), e.select("conv_id", "chunk", F.col("id").alias("y"))
    pairs = a.join(b, ["conv_id", "chunk"]).filter("x < y")  # the names of one chunk
    kind = "co-occurrence"
    pairs = pairs.select(F.concat_ws("--", "x", "y", F.lit(kind)).alias("id"), F.col("x").alias("source"), F.col("y").alias("target"), "conv_id", "chunk", F.col("source").alias("file"))
    more = pairs.groupBy("id", "source", "target").agg(F.count(F.lit(1)).alias("n"))
    proof = first_rows(pairs, ["id"], ["conv_id", "chunk"], EVIDENCE, F.struct("file", F.lit(at).alias("date"), F.lit("co-mentioned in conversation").alias("context")), "proof")
    was = edges.select("id", F.struct(*[F.col(c) for c in edges.columns]).alias("old"))
    g = more.join(proof, "id").join(was, "id", "left")
    kinds = {f.name: f.dataType for f in edges.schema}
    rc = F.coalesce(own("reinforcement_count") + F.col("n"), F.col("n") - 1)
    evidence = F.array().cast("array<struct<file:string,date:string,context:string>>")
    new_edges = g.select(
        "id", "source", "target", F.lit(kind).alias("type"), F.coalesce(own("directed"), F.lit(False)).alias("directed"), F.coalesce(own("weight"), F.lit(0.3)).alias("weight"),
        F.coalesce(own("base_weight"), F.lit(0.3)).alias("base_weight"), rc.cast("long").alias("reinforcement_count"), F.coalesce(own("first_formed").cast("string"), F.lit(at)).alias("first_formed"),
        F.lit(at).alias("last_reinforced"), F.when(rc == 0, F.lit(1.0)).otherwise(stability(rc)).alias("stability"),
        F.slice(F.concat(F.coalesce(own("evidence").cast("array<struct<file:string,date:string,context:string>>"), evidence), "proof"), 1, EVIDENCE).alias("evidence"),
    )
    return {"nodes": new_nodes, "edges": new_edges}
