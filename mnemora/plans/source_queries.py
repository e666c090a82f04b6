"""Sources, sinks and the truth layer over whole tables: files are written from the tables, read back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.functions import text
from mnemora.operators import conversations, dynamics, federation, graph, procedures, store_ops, summaries, temporal, truth
from mnemora.plans import truth_layer
from mnemora.plans.catalog import day, query, r
from mnemora.plans.derive import ctes, graph as trade, table
from mnemora.plans.store_queries import PROCS, procs
from mnemora.shared import scratch
from mnemora.sources import captures, files, graph_json, memory_files, notes
from mnemora.store import GraphStore

W = "WITH " + ctes()


def _store(spark, sf_dir) -> GraphStore:
    """A store of the trade graph."""
    g = trade(spark, sf_dir)
    text_of = lambda df, *dates: df.withColumns({c: F.col(c).cast("date").cast("string") for c in dates})
    store = GraphStore(spark, scratch(spark, "store"))
    store.upsert(nodes=text_of(g["nodes"], "first_seen", "last_reinforced"), edges=text_of(g["edges"], "first_formed", "last_reinforced"))
    return store


# notes on disk


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS lot, coalesce(text, '') AS text, lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS dd FROM documents)
SELECT CASE lot WHEN 0 THEN 'front/doc-' || doc_id || '.md' ELSE 'dated/deep/2024-02-' || dd || '-doc-' || doc_id || '.md' END AS file, CASE lot WHEN 0 THEN '2023-05-' || dd ELSE '2024-02-' || dd END AS date,
  sha256(CASE lot WHEN 0 THEN '---' || chr(10) || 'date: 2023-05-' || dd || chr(10) || '---' || chr(10) ELSE '' END || text) AS hash FROM d WHERE lot IN (0, 1)""")
def notes_discovered(spark, sf_dir):
    """Every document as a file: with front matter, with a date in its name, in a folder to be left out, and of another kind."""
    d = table(spark, sf_dir, "documents")
    lot, name, dd = F.col("doc_id") % 4, F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    own = F.coalesce("text", F.lit(""))
    path = F.when(lot == 0, F.concat(F.lit("front/"), name, F.lit(".md"))).when(lot == 1, F.concat(F.lit("dated/deep/2024-02-"), dd, F.lit("-"), name, F.lit(".md"))).when(lot == 2, F.concat(F.lit("skip/"), name, F.lit(".md"))).otherwise(F.concat(name, F.lit(".txt")))
    body = F.when(lot == 0, F.concat(F.lit("---\ndate: 2023-05-"), dd, F.lit("\n---\n"), own)).otherwise(own)
    folder = scratch(spark, "notes")
    truth_layer.write_files(d.select(path.alias("path"), body.alias("text")), folder)
    found = notes.discover(spark, folder, f"{folder}/none", ignore=("skip",))
    base = folder.replace("file://", "")
    return found.select(notes.relative(F.col("path"), base).alias("file"), notes.document_date(F.col("path"), F.col("text"), F.col("modified")).alias("date"), "hash")


@query(r"""WITH d AS (SELECT doc_id, source || ' [[' || lang || ']] Notes: on ' || doc_id || ' and ' || substr(coalesce(text, ''), 1, 70) AS t FROM documents),
s AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(t, '\[\[|\]\]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM d),
c AS (SELECT *, substr(s, 1, 60) AS cut FROM s), l AS (SELECT *, length(cut) - length(string_split(cut, '-')[-1]) - 1 AS last FROM c)
SELECT doc_id, CASE WHEN length(s) > 60 THEN CASE WHEN last > 30 THEN substr(cut, 1, last) ELSE cut END ELSE s END AS slug, CASE WHEN length(t) > 40 THEN substr(t, 1, 39) || '…' ELSE t END AS short,
  array_to_string(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: length(x) >= 3), ' ') AS keywords, 'mem_' || substr(sha256('export|' || t), 1, 12) AS memory_id FROM l""")
def text_forms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.concat("source", F.lit(" [["), "lang", F.lit("]] Notes: on "), F.col("doc_id").cast("string"), F.lit(" and "), F.substring(F.coalesce("text", F.lit("")), 1, 70))
    t = d.select("doc_id", t.alias("t"))
    c = F.col("t")
    return t.select("doc_id", text.slug(c).alias("slug"), text.truncate(c, 40).alias("short"), F.array_join(text.keywords(c), " ").alias("keywords"), text.memory_id(F.lit("export|"), c).alias("memory_id"))


# conversations in other formats


@query("""WITH c AS (SELECT conv_id, turn, role, text, conv_id % 4 AS lot FROM conversations WHERE text IS NOT NULL AND text <> '')
SELECT conv_id, (turn * 1000)::BIGINT AS turn, role, text FROM c WHERE lot = 0 AND turn % 7 <> 0
UNION ALL SELECT conv_id, turn * 1000 + CASE WHEN turn % 7 <> 0 THEN 1 ELSE 0 END, 'tool', 'Called find(' || turn || ')' FROM c WHERE lot = 0 AND turn % 5 = 0
UNION ALL SELECT conv_id, turn * 1000, role, text FROM c WHERE lot = 1 UNION ALL SELECT conv_id, turn * 1000 + 1, 'tool', 'Called find({})' FROM c WHERE lot = 1 AND turn % 3 = 0
UNION ALL SELECT conv_id, turn * 1000 + CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END, 'tool', 'got ' || turn FROM c WHERE lot = 1 AND turn % 2 = 0
UNION ALL SELECT conv_id, turn, role, text FROM c WHERE lot = 2 AND turn % 6 <> 0 UNION ALL SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'user' ELSE role END, text FROM c WHERE lot = 3""")
def conversation_adapters(spark, sf_dir):
    """A fourth of the conversations in each format, with tool calls, missing contents, broken lines and unknown roles."""
    c = table(spark, sf_dir, "conversations").filter("text is not null and text <> ''").select("conv_id", "turn", "role", "text")
    lot, turn = F.col("conv_id") % 4, F.col("turn")
    word = turn.cast("string")
    call = F.when(turn % 5 == 0, F.array(F.struct(F.lit("find").alias("name"), word.alias("arguments"))))
    chat = c.filter(lot == 0).select("conv_id", "turn", "role", F.when(turn % 7 != 0, F.col("text")).alias("content"), call.alias("tool_calls"))
    none = F.lit(None).cast("string")
    block = lambda kind, t=none, name=none, given=none, content=none: F.struct(F.lit(kind).alias("type"), t.alias("text"), name.alias("name"), given.alias("input"), content.alias("content"))
    parts = F.array(block("text", F.col("text")), F.when(turn % 3 == 0, block("tool_use", name=F.lit("find"))), F.when(turn % 2 == 0, block("tool_result", content=F.concat(F.lit("got "), word))), block("image"))
    blocks = c.filter(lot == 1).select("conv_id", "turn", "role", F.array_compact(parts).alias("blocks"))
    line = F.when(turn % 6 == 0, F.lit("{no json")).when(turn % 6 == 1, F.to_json(F.struct("role", F.col("text").alias("message")))).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    lines = c.filter(lot == 2).select("conv_id", "turn", line.alias("line"))
    sessions = c.filter(lot == 3).select("conv_id", "turn", F.when(turn % 4 == 0, "narrator").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    every = [conversations.from_tool_calls(chat), conversations.from_blocks(blocks), conversations.from_json_lines(lines), conversations.from_sessions(sessions)]
    out = [x.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text") for x in every]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'blocks' WHEN 2 THEN 'jsonl' ELSE 'session' END AS format, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_formats(spark, sf_dir):
    """The format of every conversation, found from its file's text."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))  # one conversation
    lot = F.col("conv_id") % 4
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    blocks = F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    raw = (
        F.when(lot == 0, F.to_json(plain)).when(lot == 1, F.to_json(F.struct(blocks.alias("messages")))).when(lot == 2, F.array_join(F.transform(plain, lambda x: F.to_json(x)), "\n"))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), plain.alias("messages"))))
    )
    return c.select("conv_id", conversations.detect_format(raw).alias("format"), F.size("m").cast("long").alias("turns"))


# the spool and canonical files


@query("""WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type FROM events),
i AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'mem_' || lpad(event_id::VARCHAR, 12, '0') ELSE 'ev-' || event_id END AS id FROM e)
SELECT CASE WHEN id IS NULL THEN 'error' WHEN event_id % 9 = 0 THEN 'tombstone' ELSE 'entry' END AS kind, CASE WHEN id IS NULL THEN '' WHEN event_id % 9 = 0 OR event_id % 2 = 0 THEN id ELSE 'mem_' || substr(sha256(id || '|' || ts), 1, 12) END AS id,
  CASE WHEN id IS NULL THEN '' ELSE ts END AS ts FROM i""")
def capture_files(spark, sf_dir):
    """Every event appended to the spool, a folder a day, and read again: entries with sound ids, tombstones, and lines that are neither."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    ident = F.when(n % 13 == 0, F.lit(None)).when(n % 2 == 0, F.concat(F.lit("mem_"), F.lpad(n.cast("string"), 12, "0"))).otherwise(F.concat(F.lit("ev-"), n.cast("string")))
    rows = e.select(F.when(n % 9 == 0, "tombstone").otherwise("memory").alias("kind"), ident.alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("title"))
    folder = scratch(spark, "spool")
    captures.append(rows, folder)
    got = captures.read(spark, folder)
    out = captures.canonical_ids(got["entries"]).select(F.lit("entry").alias("kind"), "id", "ts").unionByName(got["tombstones"].select(F.lit("tombstone").alias("kind"), "id", "ts"))
    return out.unionByName(got["errors"].select(F.lit("error").alias("kind"), F.lit("").alias("id"), F.lit("").alias("ts")))


MEMORY = """f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'global/' WHEN 1 THEN 'projects/p' || doc_id % 7 || '/' ELSE 'agents/a/' END || 'doc-' || doc_id || '.md' AS path, 'mem_' || lpad(doc_id::VARCHAR, 12, '0') AS id,
  CASE doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' WHEN 2 THEN 'lesson' ELSE 'event' END AS type, 'Memory of ' || source || ' ' || doc_id AS title, '2024-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS created,
  'We take [[Topic ' || doc_id % 50 || '|it]] for [[' || source || ']] number ' || doc_id || '.' AS claim, 'text ' || doc_id AS verbatim FROM documents)"""


def memories(spark, sf_dir, faults=True):
    """Every document as a memory file (path, text); some with faults."""
    d = files.dealt(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    n, word = F.col("doc_id"), F.col("doc_id").cast("string")
    place = F.when(n % 3 == 0, "global/").when(n % 3 == 1, F.concat(F.lit("projects/p"), (n % 7).cast("string"), F.lit("/"))).otherwise("agents/a/")
    kind = F.when(n % 4 == 0, "fact").when(n % 4 == 1, "decision").when(n % 4 == 2, "lesson").otherwise("event")
    body = F.concat(F.lit("# head\n\nWe take [[Topic "), (n % 50).cast("string"), F.lit("|it]] for [["), "source", F.lit("]] number "), word, F.lit(".\n\nmore\n\n## Source\ntext "), word, F.lit("\n"))
    rows = d.select(
        F.concat(place, F.lit("doc-"), word, F.lit(".md")).alias("path"), F.concat(F.lit("mem_"), F.lpad(word, 12, "0")).alias("id"), (F.when(n % 10 == 7, "nonsense").otherwise(kind) if faults else kind).alias("type"), F.lit("active").alias("status"),
        F.concat(F.lit("Memory of "), "source", F.lit(" "), word).alias("title"), F.concat(F.lit("2024-03-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("created"), F.lit(None).cast("string").alias("last_reinforced"), (n % 6).cast("long").alias("reinforcement_count"),
        F.lit(0.5).alias("importance"), F.lit(None).cast("string").alias("scope"), F.array(F.lit("t")).alias("tags"), F.array().cast("array<string>").alias("links"), F.lit("test").alias("source"), body.alias("body"),
    )
    return memory_files.serialized(rows)


@query(f"""WITH {MEMORY} SELECT path, CASE WHEN doc_id % 10 = 7 THEN 'unknown type' ELSE '' END AS error, CASE WHEN doc_id % 10 <> 7 THEN id END AS id, CASE WHEN doc_id % 10 <> 7 THEN title END AS title, CASE WHEN doc_id % 10 <> 7 THEN claim END AS claim,
  CASE WHEN doc_id % 10 <> 7 THEN verbatim END AS verbatim, CASE doc_id % 10 WHEN 7 THEN NULL ELSE CASE doc_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'project/p' || doc_id % 7 ELSE 'agent/a' END END AS scope FROM f""")
def memory_files_parsed(spark, sf_dir):
    got = memory_files.with_claims(memory_files.parsed(memories(spark, sf_dir)))
    return got.select("path", F.coalesce("error", F.lit("")).alias("error"), "id", "title", "claim", F.col("source_text").alias("verbatim"), "scope")


@query(f"""WITH {MEMORY}, good AS (SELECT f.*, source FROM f JOIN documents USING (doc_id) WHERE doc_id % 10 <> 7 AND doc_id % 6 <> 0),
l AS (SELECT id, 'Topic ' || doc_id % 50 AS t FROM good UNION SELECT id, source FROM good)
SELECT 'memory' AS kind, id, '' AS target, CASE type WHEN 'fact' THEN 'concept' ELSE type END AS type FROM good
UNION ALL SELECT DISTINCT 'entity', substr(sha256(lower(t)), 1, 16), '', 'concept' FROM l UNION ALL SELECT 'edge', id, substr(sha256(lower(t)), 1, 16), 'explicit' FROM l""")
def memory_graph(spark, sf_dir):
    """What the files compile to where a sixth of the memories is forgotten: memories, what they link to, and the links."""
    files = memory_files.with_claims(memory_files.parsed(memories(spark, sf_dir)))
    gone = table(spark, sf_dir, "documents").filter("doc_id % 6 = 0").select(F.concat(F.lit("mem_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"))
    c = truth_layer.compiled(files, gone)
    n = c["memories"].select(F.lit("memory").alias("kind"), "id", F.lit("").alias("target"), "type").unionByName(c["entities"].select(F.lit("entity").alias("kind"), "id", F.lit("").alias("target"), "type"))
    return n.unionByName(c["edges"].select(F.lit("edge").alias("kind"), F.col("source").alias("id"), "target", "type"))


@query(f"""WITH {MEMORY}, t AS (SELECT DISTINCT substr(sha256(lower('Topic ' || doc_id % 50)), 1, 16) AS id FROM documents UNION SELECT DISTINCT substr(sha256(lower(source)), 1, 16) FROM documents),
c AS (SELECT 'mem_' || lpad((500000000 + event_id % 3000)::VARCHAR, 12, '0') AS id, event_id FROM events WHERE event_id % 9 <> 0), g AS (SELECT DISTINCT 'mem_' || lpad((500000000 + event_id % 3000)::VARCHAR, 12, '0') AS id FROM events WHERE event_id % 9 = 0 AND user_id % 2 = 0)
SELECT id, 'active' AS status FROM f UNION ALL SELECT id, '' FROM t UNION ALL SELECT DISTINCT id, 'candidate' FROM c WHERE id NOT IN (SELECT id FROM g)""")
def truth_rebuilt(spark, sf_dir):
    """A store built anew of a folder: every document's memory file, what they link to, and the captures that no file holds and no tombstone names."""
    folder = scratch(spark, "memory")
    truth_layer.write_files(memories(spark, sf_dir, faults=False), folder)
    e = table(spark, sf_dir, "events").withColumn("id", F.concat(F.lit("mem_"), F.lpad((500_000_000 + F.col("event_id") % 3000).cast("string"), 12, "0")))
    stone = F.col("event_id") % 9 == 0
    rows = e.filter(~stone | (F.col("user_id") % 2 == 0)).select(F.when(stone, "tombstone").otherwise("memory").alias("kind"), "id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("title"))
    captures.append(rows, f"{folder}/{truth_layer.SPOOL}")
    path = scratch(spark, "rebuilt")
    truth_layer.rebuild(spark, folder, path)
    return GraphStore(spark, path).table("nodes").select("id", F.coalesce("status", F.lit("")).alias("status"))


@query("""WITH m AS (SELECT doc_id, 'Note ' || lang || ' ' || doc_id % 97 AS title, CASE doc_id % 2 WHEN 0 THEN 'global' ELSE 'project/x' END AS scope FROM documents),
s AS (SELECT *, scope || '/note-' || lang2 || '-' || doc_id % 97 AS stem FROM (SELECT *, lower(split_part(title, ' ', 2)) AS lang2 FROM m)),
k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY lpad(doc_id::VARCHAR, 12, '0')) + CASE WHEN doc_id % 97 < 10 AND scope = 'global' THEN 1 ELSE 0 END AS k FROM s)
SELECT 'mem_' || lpad(doc_id::VARCHAR, 12, '0') AS id, CASE WHEN k <= 99 THEN stem || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' END AS path FROM k""")
def memory_paths(spark, sf_dir):
    """Files for memories whose titles repeat, beside files that are there."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    new = d.select(F.concat(F.lit("mem_"), F.lpad(n.cast("string"), 12, "0")).alias("id"), F.concat(F.lit("Note "), "lang", F.lit(" "), (n % 97).cast("string")).alias("title"), F.when(n % 2 == 0, "global").otherwise("project/x").alias("scope"))
    taken = d.filter(n % 97 < 10).select(F.concat(F.lit("global/note-"), F.lower("lang"), F.lit("-"), (n % 97).cast("string"), F.lit(".md")).alias("path")).distinct()
    return truth.target_paths(new, taken)


# the store


@query(W + """, gone AS (SELECT id FROM nodes WHERE mention_count % 5 = 0)
SELECT 'node' AS kind, id FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'forgotten', id FROM gone
UNION ALL SELECT 'edge', id FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)""")
def store_forgets(spark, sf_dir):
    """Nodes forgotten everywhere; one commit of the keys that go."""
    s = _store(spark, sf_dir)
    s.forget(s.table("nodes").filter("mention_count % 5 = 0").select("id"), "2001-09-01", "test")
    of = lambda table, kind: s.table(table).select(F.lit(kind).alias("kind"), "id")
    return of("nodes", "node").unionByName(of("edges", "edge")).unionByName(of("forgotten", "forgotten"))


@query(W + """, n AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM nodes WHERE mention_count % 2 = 0) AS half, (SELECT count(*) FROM edges) AS e)
SELECT * FROM (SELECT 's2' AS id, '2001-02-01' AS created_at, half AS node_count, e AS edge_count, half AS stored, false AS pruned FROM n UNION ALL SELECT 's3', '2001-03-01', half, e, half, false FROM n) ORDER BY created_at DESC""")
def snapshots_listed(spark, sf_dir):
    """Three snapshots of a changing store, listed from a date on, with what retention drops and what each holds."""
    s = _store(spark, sf_dir)
    s.create_snapshot("s1", "2001-01-01")
    s.delete("nodes", s.table("nodes").filter("mention_count % 2 <> 0").select("id"))
    s.create_snapshot("s2", "2001-02-01")
    s.create_snapshot("s3", "2001-03-01")
    pruned = temporal.prune_snapshots(s.table("snapshots"), "2001-01-15").select("id", F.lit(True).alias("p"))
    held = s.snapshot("s2")["nodes"].select(F.lit("s2").alias("id")).unionByName(s.snapshot("s3")["nodes"].select(F.lit("s3").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("stored"))
    listed = s.list_snapshots(since="2001-01-15", limit=2)
    return listed.join(held, "id").join(pruned, "id", "left").select("id", "created_at", "node_count", "edge_count", "stored", F.coalesce("p", F.lit(False)).alias("pruned"))


@query(W + "SELECT id, label, type, mention_count::BIGINT AS mention_count FROM nodes WHERE mention_count % 3 = 1")
def store_looked_up(spark, sf_dir):
    """The nodes of given ids, out of the store's files that may hold them."""
    s = _store(spark, sf_dir)
    return s.lookup("nodes", trade(spark, sf_dir)["nodes"].filter("mention_count % 3 = 1").select("id")).select("id", "label", "type", "mention_count")


@query(W + """, k AS (SELECT id, label, row_number() OVER (ORDER BY mention_count DESC, id) AS place FROM nodes WHERE type = 'tool' AND lower(label) LIKE '%re%')
SELECT * FROM k WHERE place BETWEEN 6 AND 25""")
def nodes_paged(spark, sf_dir):
    n = store_ops.list_nodes(trade(spark, sf_dir)["nodes"], kind="tool", label="RE")
    page = store_ops.page(n, 5, 20)
    at = Window.orderBy(F.desc("mention_count"), "id")
    return page.select("id", "label", "mention_count").withColumn("place", (F.row_number().over(at) + 5).cast("long")).drop("mention_count")  # a page


@query(W + ", top AS (SELECT source AS id FROM edges ORDER BY weight DESC, id LIMIT 1) SELECT id, round(weight, 6) AS weight FROM edges WHERE source = (SELECT id FROM top) AND weight >= 0.02")
def edges_listed(spark, sf_dir):
    e = trade(spark, sf_dir)["edges"]
    top = e.orderBy(F.desc("weight"), "id").first()["source"]
    return store_ops.list_edges(e, kind="co-occurrence", source=top, least=0.02).select("id", r("weight", "weight"))


@query(W + """, top AS (SELECT id FROM nodes ORDER BY mention_count DESC, id LIMIT 1), one AS (SELECT neighbor AS id FROM adj WHERE node = (SELECT id FROM top) UNION SELECT id FROM top)
SELECT id FROM edges WHERE source IN (SELECT id FROM one) OR target IN (SELECT id FROM one)""")
def edges_within_two_hops(spark, sf_dir):
    g = trade(spark, sf_dir)
    top = g["nodes"].orderBy(F.desc("mention_count"), "id").first()["id"]
    return graph.touched_edges(g["edges"], top, 2).select("id")


@query(W + """, d AS (SELECT n.id, n.label, n.type, degree, coalesce(max(weight), 0) AS w FROM nodes n JOIN degree USING (id) LEFT JOIN adj ON node = n.id GROUP BY ALL)
SELECT id, label, type, degree, round(w, 6)::DOUBLE AS max_weight FROM d""")
def viz_nodes(spark, sf_dir):
    g = trade(spark, sf_dir)
    return graph.viz_projection(g["nodes"], g["edges"])["nodes"].select("id", "label", "type", "degree", r("max_weight", "max_weight"))


@query(W + "SELECT id, greatest(0, reinforcement_count + CASE mention_count % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)::BIGINT AS reinforcement_count FROM nodes")
def feedback_nodes(spark, sf_dir):
    n = trade(spark, sf_dir)["nodes"]
    m = F.col("mention_count") % 3
    rated = n.select(F.col("id").alias("node_id"), F.when(m == 0, 0.7).when(m == 1, -0.2).otherwise(0.0).alias("rating"))
    return dynamics.feedback_nodes(n, rated).select("id", "reinforcement_count")


@query(W + """SELECT 'node' AS kind, id, label AS name FROM nodes UNION ALL SELECT 'edge', id, source FROM edges""")
def graph_lines(spark, sf_dir):
    """The graph as JSON lines, read back."""
    g = trade(spark, sf_dir)
    folder = scratch(spark, "lines")
    graph_json.documents(g["nodes"], g["edges"]).write.partitionBy("kind").text(folder)
    back = spark.read.text(folder)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return back.select("kind", get("id").alias("id"), F.coalesce(get("label"), get("source")).alias("name"))


@query("""WITH d AS (SELECT doc_id, 'Title ' || doc_id AS title, 'Content ' || lang AS content, CASE WHEN doc_id % 4 > 0 THEN doc_id % 11 / 10.0::DOUBLE END AS importance, ['E' || doc_id % 20, 'F' || doc_id % 3][1:doc_id % 3] AS entities FROM documents),
m AS (SELECT *, 'mem_' || substr(sha256('remember|' || title || '|' || content), 1, 12) AS id FROM d)
SELECT 'node' AS kind, id, ceil(3 * coalesce(importance, 0.5))::BIGINT AS n, '' AS target FROM m UNION ALL SELECT 'edge', id, 0, substr(sha256(lower(e)), 1, 16) FROM (SELECT id, unnest(entities) AS e FROM m)""")
def remembered_items(spark, sf_dir):
    """Every document remembered as an item with entities."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    names = F.slice(F.array(F.concat(F.lit("E"), (n % 20).cast("string")), F.concat(F.lit("F"), (n % 3).cast("string"))), F.lit(1), (n % 3).cast("int"))
    items = d.select(F.concat(F.lit("Title "), n.cast("string")).alias("title"), F.concat(F.lit("Content "), "lang").alias("content"), F.lit(None).cast("string").alias("type"), F.when(n % 4 > 0, n % 11 / 10.0).alias("importance"), names.alias("entities"))
    new = summaries.remembered(items, "2024-01-01")
    nodes = new["nodes"].select(F.lit("node").alias("kind"), "id", F.col("reinforcement_count").alias("n"), F.lit("").alias("target"))
    return nodes.unionByName(new["edges"].select(F.lit("edge").alias("kind"), F.col("source").alias("id"), F.lit(0).cast("long").alias("n"), "target"))


@query(f"WITH {PROCS} SELECT id, confidence FROM procs WHERE confidence >= 0.4 AND NOT flagged AND len(list_filter(kw, lambda k: contains(k, 'tion'))) > 0")
def procedures_listed(spark, sf_dir):
    return procedures.listed(procs(spark, sf_dir), kind="preference", confidence=0.4, flagged=False, keyword="TION").select("id", "confidence")
