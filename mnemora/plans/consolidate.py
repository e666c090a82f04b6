"""From notes and conversations to the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.config import DEFAULT, EVIDENCE, EXCERPTS, GraphConfig
from mnemora.functions.text import node_id
from mnemora.functions.weights import stability
from mnemora.operators import conversations, dynamics, extract, increments, merge, resolve, vectors
from mnemora.operators.tagger import Tagger
from mnemora.shared import written
from mnemora.sources import notes as notes_source
from mnemora.store import GraphStore, full


def mentions_of(sections: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    names = extract.tagged(sections) if tagger is None else extract.tagged_by(sections, tagger)
    m = extract.structural(sections).unionByName(extract.custom(sections)).unionByName(names)
    return extract.strongest(m)


def sightings_of(sections: DataFrame, nodes: DataFrame, aliases: dict[str, str] | None = None, ignore: list[str] | None = None, tagger: Tagger | None = None) -> DataFrame:
    """Resolved mentions of dated sections (file, section, heading, line, content, date, section_ord)."""
    found = resolve.resolve(mentions_of(sections, tagger).drop("name"), nodes, aliases, ignore)
    about = sections.groupBy("file", "section").agg(F.min("date").alias("date"), F.min("section_ord").alias("section_ord"), F.min_by("content", "line").alias("content"))
    s = found.join(about, ["file", "section"])
    return s.select(
        "node_id", F.col("text").alias("label"), "type", "file", "section", "section_ord", "ord", "date", F.substring("content", 1, 200).alias("excerpt"),
        ((F.col("extractor") == "structural") & (F.col("confidence") == 0.9)).alias("is_link"),
    )


def _with_parts(store: GraphStore) -> None:
    """A store whose sightings have no parts yet gets them, all at once."""
    if "node_parts" in store.version()["tables"] or not store.table("sightings").limit(1).count():
        return
    seen = store.table("sightings")
    parts = written(increments.node_parts(seen), "parts")
    second = written(increments.seconds(parts), "seconds")
    pairs = increments.pair_parts(seen, store.table("causes")).unionByName(increments.temporal_parts(seen, second))
    episodes = store.table("episodes").select(F.col("source").alias("file"), F.col("id").alias("episode_id"))
    store.replace(node_parts=parts, seconds=second, edge_parts=pairs, file_episodes=episodes)


def consolidate(store: GraphStore, files: DataFrame, now: Column, config: GraphConfig = DEFAULT, aliases: dict[str, str] | None = None, ignore: list[str] | None = None, embedder: vectors.Embedder | None = None, provider: str = "mock", decay: bool = True, tagger: Tagger | None = None) -> int:
    """Brings the graph up to date with notes (path, text, hash, modified) and commits it, decayed; where no note is new, changed or gone, nothing is done.

    Only new and changed notes are read. The store keeps what each file adds to each node and pair of nodes; of these parts, those that the
    changed files name are looked up and summed before and after, and only their nodes, edges and pending pairs are written. What other
    sources added to a node or edge stays: counts move by the difference of the sums. New contents of nodes and
    episodes are embedded where an embedder is given. Weights fall with time alone: all edges are written anew only where ``now`` is another moment than
    that of their last decay, and not at all without decay (``dynamics.decayed`` gives the weights of any moment).
    """
    ledger = store.table("file_ledger")
    status = written(notes_source.changes(files, ledger), "status")
    gone = ledger.join(files.select("path"), "path", "left_anti")
    if not status.filter("status <> 'unchanged'").limit(1).count() and not gone.limit(1).count():
        return store.version()["n"]
    _with_parts(store)
    todo = files.join(status.filter("status <> 'unchanged'").select("path"), "path", "left_semi")
    dated = todo.withColumn("date", notes_source.document_date(F.col("path"), F.col("text"), F.col("modified")))
    sections = written(notes_source.sections(todo).join(dated.select(F.col("path").alias("file"), "date"), "file"), "sections")
    replaced = written(todo.select(F.col("path").alias("file")).unionByName(gone.select(F.col("path").alias("file"))), "replaced")

    kinds = {f.name: f.dataType for f in store.table("sightings").schema}
    fresh = sightings_of(sections, store.table("nodes"), aliases, ignore, tagger)
    fresh = written(fresh.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]), "sightings")
    causes = written(extract.causal(sections).select("file", "section").distinct(), "causes")
    touched = changed_graph(store, replaced, fresh, causes, config)

    episodes = written(full(extract.episodes(sections), "episodes"), "episodes")
    own_episodes = episodes.select(F.col("source").alias("file"), F.col("id").alias("episode_id"))
    old_episodes = written(store.lookup("file_episodes", replaced), "old-episodes")
    named = extract.episodes(sections)
    links = fresh.join(named.select(F.col("id").alias("episode_id"), F.col("source").alias("file"), "section"), ["file", "section"])
    links = links.select("episode_id", "node_id", extract.role(F.col("type")).alias("role")).distinct()
    old_links = store.lookup("episode_entities", old_episodes.select("episode_id"))
    nodes = written(full(touched["nodes"], "nodes"), "nodes")
    edges = full(dynamics.decayed(touched["edges"], now, config), "edges")
    changes = {
        "nodes": (nodes, _lost(touched["node_ids"], nodes, ["id"])), "edges": (edges, _lost(touched["edge_ids"], edges, ["id"])),
        "pending": (full(touched["pending"], "pending"), _lost(touched["pairs"], touched["pending"], ["source", "target"])),
        "episodes": (episodes, old_episodes.select(F.col("episode_id").alias("id"))), "episode_entities": (full(links, "episode_entities"), old_links.select("episode_id", "node_id", "role")),
        "file_episodes": (own_episodes, old_episodes), "file_ledger": (full(todo.select("path", "hash"), "file_ledger"), gone.select("path")),
        "sightings": (fresh, touched["old_sightings"]), "causes": (causes, store.lookup("causes", replaced)),
        "node_parts": (touched["node_parts"], touched["old_node_parts"]), "edge_parts": (touched["edge_parts"], touched["old_edge_parts"]), "seconds": (touched["seconds"], touched["node_ids"].select(F.col("id").alias("node_id"))),
    }
    stamp = str(store.spark.range(1).select(now.cast("string")).first()[0])
    changes["meta"] = (store.spark.createDataFrame([("decayed_at", stamp)], "key string, value string"), None)
    if embedder:
        n = written(nodes.select("id", F.lit("node").alias("type"), vectors.node_text(F.col("label"), F.col("excerpts")).alias("content")).unionByName(episodes.select("id", F.lit("episode").alias("type"), "content")), "contents")
        new = vectors.embed(vectors.stale(n, store.lookup("embeddings", n.select("id"))), embedder, provider)
        changes["embeddings"] = (full(new, "embeddings"), None)
    last = store.get("meta", "decayed_at")
    version = store.commit(changes=changes)
    if decay and last is not None and last["value"] != stamp:
        version = store.replace(edges=dynamics.decayed(store.table("edges"), now, config))
    return version


def _lost(named: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return named.select(*keys).join(kept.select(*keys), keys, "left_anti")


def changed_graph(store: GraphStore, replaced: DataFrame, fresh: DataFrame, causes: DataFrame, config: GraphConfig = DEFAULT) -> dict[str, DataFrame]:
    """Nodes, edges and pending pairs that change where files (replaced: file) get other sightings and causal sections, with the parts before and after.

    Reads the sightings and parts of these files, nodes and pairs alone, by lookups.
    """
    old = written(store.lookup("sightings", replaced), "old-sightings")
    old_causes = store.lookup("causes", replaced)
    was_parts, now_parts = increments.node_parts(old), written(increments.node_parts(fresh), "node-parts")
    ids = written(old.select("node_id").unionByName(fresh.select("node_id")).distinct(), "node-ids")
    before = written(store.lookup("node_parts", ids), "parts-before")
    after = written(before.join(replaced, "file", "left_anti").select(now_parts.columns).unionByName(now_parts), "parts-after")
    second_before = written(store.lookup("seconds", ids), "seconds-before")
    second_after = written(increments.seconds(after), "seconds-after")

    # where a node's second place moved, files between see it counted otherwise
    moved = increments.between(second_before, second_after)
    every = before.select("node_id", "file").unionByName(now_parts.select("node_id", "file"))
    seen = every.join(moved, "node_id").filter((F.col("file") >= F.col("low")) & (F.col("high").isNull() | (F.col("file") <= F.col("high")))).select("file")
    walked = written(seen.unionByName(replaced).distinct(), "walked")
    others = written(store.lookup("sightings", walked.join(replaced, "file", "left_anti")), "other-sightings")
    unmoved = written(store.lookup("seconds", others.select("node_id").distinct().join(ids, "node_id", "left_anti")), "seconds-of-others")
    temporal = lambda s, second: increments.temporal_parts(others.unionByName(s.select(others.columns)), second.unionByName(unmoved))
    was_pairs = written(increments.pair_parts(old, old_causes).unionByName(temporal(old, second_before)), "pairs-before")
    now_pairs = written(increments.pair_parts(fresh, causes).unionByName(temporal(fresh, second_after)), "pairs-after")
    pairs = written(was_pairs.select(*increments.PAIR).unionByName(now_pairs.select(*increments.PAIR)).distinct(), "pairs")
    all_pairs = written(store.lookup("edge_parts", pairs), "all-pairs")
    left = increments.without(all_pairs, was_pairs.unionByName(now_pairs), increments.PAIR)

    was, built = increments.nodes_of(before), increments.nodes_of(after)
    stored = store.lookup("nodes", ids.select(F.col("node_id").alias("id")))
    nodes = _moved(stored, was.select("id", F.col("mention_count").alias("_n")), built, F.col("mention_count"), ("mention_count", "reinforcement_count"), "first_seen", "excerpts", EXCERPTS)
    was_edges, _ = increments.edges_of(increments.pairs_of(all_pairs), config)
    built_edges, pending = increments.edges_of(increments.pairs_of(left.unionByName(now_pairs.select(left.columns))), config)
    edge_ids = pairs.select(increments.pair_id().alias("id"))
    ends = F.col("reinforcement_count") + 1
    edges = _moved(store.lookup("edges", edge_ids), was_edges.select("id", ends.alias("_n")), written(built_edges, "edges"), ends, ("reinforcement_count",), "first_formed", "evidence", EVIDENCE)
    edges = edges.withColumn("stability", F.when(F.col("reinforcement_count") <= 0, F.lit(1.0)).otherwise(stability(F.col("reinforcement_count"), config)))
    return {
        "nodes": nodes, "edges": edges, "pending": written(pending, "pending"), "node_ids": ids.select(F.col("node_id").alias("id")), "edge_ids": edge_ids, "pairs": pairs.filter("type = 'co-occurrence'").select("source", "target"),
        "old_sightings": old.select("file", "section", "ord"), "node_parts": now_parts, "old_node_parts": was_parts.select("node_id", "file"),
        "edge_parts": now_pairs, "old_edge_parts": was_pairs.select(*increments.PAIR, "file"), "seconds": second_after,
    }


def _moved(stored: DataFrame, was: DataFrame, built: DataFrame, total: Column, counts: tuple[str, ...], first: str, proofs: str, most: int) -> DataFrame:
    """Stored rows with what notes say of them now in place of what they said before (was: id, _n), rows that only notes held gone with them, and new rows."""
    s = stored.select("id", F.struct(*[F.col(c) for c in stored.columns]).alias("_s"))
    b = built.select("id", F.struct(*[F.col(c) for c in built.columns], total.alias("_t")).alias("_b"))
    j = s.join(b, "id", "full_outer").join(was, "id", "left")
    old, new = F.coalesce("_n", F.lit(0)), F.coalesce("_b._t", F.lit(0))
    lead = counts[0]
    # what others added: the stored total less the notes' share of it
    base = F.coalesce(F.col(f"_s.{lead}"), F.lit(0)) + (1 if lead == "reinforcement_count" else 0) - old
    others = F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), base))
    out = []
    for f in stored.schema:
        c = f.name
        have, said = F.col(f"_s.{c}"), (F.col(f"_b.{c}") if c in built.columns else F.lit(None).cast(f.dataType))
        if c == "id":
            v = F.col("id")
        elif c in counts:
            v = F.when(others > 0, have + new - old).otherwise(said)
        elif c == first:
            v = F.when(others > 0, F.least(have, said.cast(f.dataType))).otherwise(said)
        elif c == proofs:
            none = F.array().cast(f.dataType)
            v = F.slice(F.array_distinct(F.concat(F.coalesce(said.cast(f.dataType), none), F.when(others > 0, F.coalesce(have, none)).otherwise(none))), 1, most)
        else:
            v = F.coalesce(said, have)
        out.append(v.cast(f.dataType).alias(c))
    return j.filter((new > 0) | (others > 0)).select(*out)


def ingest(store: GraphStore, messages: DataFrame, at: str, aliases: dict[str, str] | None = None, ignore: list[str] | None = None, embedder: vectors.Embedder | None = None, provider: str = "mock", extractor=conversations.chat_entities) -> int:
    """Adds conversations that are new: their chunks as episodes, and their entities to the nodes and edges that are there.

    extractor: any function from chunked messages to entities; embedder: embeds the episodes' contents, a failing batch is left out.
    """
    done = store.table("meta").filter(F.col("key").startswith("conversation:")).select(F.substring("key", 14, 100).alias("conv_id"), F.col("value").alias("content_hash"))
    new = written(conversations.new_conversations(messages, done), "new-conversations")
    m = messages.join(new.select("conv_id"), "conv_id", "left_semi")
    chunked = written(conversations.chunks(m), "chunks")
    name = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("chunk").cast("string"))
    eps = conversations.chunk_episodes(chunked).select(F.concat(F.lit("ep_conv_"), F.substring(F.sha2(name, 256), 1, 12)).alias("id"), name.alias("source"), "type", "title", "summary", "content", "importance", F.lit(at).alias("timestamp"))
    eps = written(eps, "episodes")
    named = extractor(chunked, aliases, ignore)
    s = written(named.withColumn("source", name), "entities")
    after = merge.ingested(s, store.table("nodes"), store.table("edges"), at)
    kinds = F.when(F.col("type") == "person", F.array(F.lit("mentioned"), F.lit("participant"))).otherwise(F.array(F.lit("mentioned")))
    links = s.join(eps.select(F.col("id").alias("episode_id"), "source"), "source").select("episode_id", node_id(F.col("label")).alias("node_id"), F.explode(kinds).alias("role")).distinct()
    marks = new.select(F.concat(F.lit("conversation:"), F.col("conv_id").cast("string")).alias("key"), F.col("content_hash").alias("value"))
    tables = {"nodes": after["nodes"], "edges": after["edges"], "episodes": eps, "episode_entities": links, "meta": marks}
    if embedder:
        tables["embeddings"] = vectors.embed(eps.select("id", F.lit("episode").alias("type"), "content"), embedder, provider)
    return store.upsert(**tables)
