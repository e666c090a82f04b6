"""Extraction, resolution, conversation and merging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.functions.text import normalize
from mnemora.operators import conversations, dynamics, extract, increments, merge, pairs, resolve, store_ops, tagger, views
from mnemora.plans.catalog import ORACLES, query, r
from mnemora.plans.derive import cached, table
from mnemora.shared import written

#: Notes over the tables: a file for each customer, a section for each order, its lines named in turn by link, bold and code.
NOTES_SQL = """notes AS (SELECT 'customer-' || o_custkey || '.md' AS file, '## ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderkey AS section, 'Order ' || o_orderkey AS heading, o_orderkey AS line,
  string_agg(CASE l_linenumber % 3 WHEN 1 THEN '[[' || p_name || ']]' WHEN 2 THEN '**' || p_type || '**' ELSE '`' || p_brand || '`' END, ', ' ORDER BY l_linenumber, l_partkey)
    || CASE o_orderstatus WHEN 'F' THEN ' due to stock' ELSE '' END || ' #' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) || CASE WHEN o_orderkey % 5 = 0 THEN ' by Docker' ELSE '' END
    || CASE WHEN o_orderkey % 7 = 0 THEN ' github.com/acme/shop' || o_custkey % 10 ELSE '' END AS content,
  strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority)"""
NORM = "regexp_replace(regexp_replace(trim(lower({x})), '\\s+', ' ', 'g'), '[.,;:!?]+$', '')"


def notes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    k = F.col("l_linenumber") % 3
    named = F.when(k == 1, F.concat(F.lit("[["), "p_name", F.lit("]]"))).when(k == 2, F.concat(F.lit("**"), "p_type", F.lit("**"))).otherwise(F.concat(F.lit("`"), "p_brand", F.lit("`")))
    lines = l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", named.alias("t")))), lambda x: x["t"]), ", ").alias("t"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    day, key, cust = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey"), F.col("o_custkey")
    ends = [F.when(F.col("o_orderstatus") == "F", " due to stock").otherwise(""), F.lit(" #"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")), F.when(key % 5 == 0, " by Docker").otherwise(""), F.when(key % 7 == 0, F.concat(F.lit(" github.com/acme/shop"), (cust % 10).cast("string"))).otherwise("")]
    return o.select(
        F.concat(F.lit("customer-"), cust.cast("string"), F.lit(".md")).alias("file"), F.concat(F.lit("## "), day, F.lit(" "), key.cast("string")).alias("section"), F.concat(F.lit("Order "), key.cast("string")).alias("heading"),
        key.alias("line"), F.concat("t", *ends).alias("content"), day.alias("date"),
    )


def _hits(pattern: str, kind: str, p: float, k: int, prefix: str = "", where: str = "true") -> str:
    """Matches of a kind with their order: of extractors and kinds (k) first, then of places."""
    return f"SELECT file, section, '{prefix}' || trim(x) AS text, '{kind}' AS type, {p}::DOUBLE AS confidence, {k} * 1000000 + i AS ord FROM (SELECT file, section, unnest(m) AS x, unnest(range(len(m))) AS i FROM (SELECT file, section, regexp_extract_all(content, '{pattern}', 1) AS m FROM notes)) WHERE {where}"


_COLUMNS = "SELECT file, section, text, type, confidence FROM"
STRUCTURAL = (
    _hits(r"\[\[([^\]]+)\]\]", "concept", 0.9, 0) + " UNION ALL " + _hits(r"\*\*([^*]+)\*\*", "concept", 0.7, 1, where="length(trim(x)) > 2") + " UNION ALL "
    + _hits("`([^`]+)`", "tool", 0.7, 2, where=r"length(trim(x)) BETWEEN 2 AND 40 AND NOT contains(x, '/') AND NOT regexp_matches(x, '\s-[a-zA-Z]|\s--|^\d+\.\d+\.\d+\.\d+$|172\.17\.|[{}()=<>&|$+^~]')")
    + f" UNION ALL SELECT file, section, heading, 'concept', 0.6::DOUBLE, 3000000 FROM notes WHERE lower(heading) NOT IN ({', '.join(repr(h) for h in extract.GENERIC_HEADINGS)})"
)


@query(f"WITH {NOTES_SQL} {_COLUMNS} ({STRUCTURAL})")
def extract_structural(spark, sf_dir, own=None):
    return extract.structural(notes(spark, sf_dir) if own is None else own).select("file", "section", "text", "type", "confidence")


_TOOLS = " UNION ALL ".join(
    f"SELECT file, section, '{t}' AS text, 'tool' AS type, 0.9::DOUBLE AS confidence, {4_000_000 + i} AS ord FROM notes WHERE regexp_matches(content, '(?i)(^|[^A-Za-z0-9_]){t.replace('.', chr(92) + '.')}([^A-Za-z0-9_]|$)')" for i, t in enumerate(extract.KNOWN_TOOLS)
)
CUSTOM = _TOOLS + " UNION ALL " + _hits(r"github\.com/([a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+)", "project", 0.9, 5) + " UNION ALL " + _hits("#([a-zA-Z][A-Za-z0-9_]+)", "tag", 0.8, 6) + " UNION ALL " + _hits("@([a-z0-9_-]+/[a-z0-9_-]+)", "tool", 0.8, 7, "@")


@query(f"WITH {NOTES_SQL} {_COLUMNS} ({CUSTOM})")
def extract_custom(spark, sf_dir, own=None):
    return extract.custom(notes(spark, sf_dir) if own is None else own).select("file", "section", "text", "type", "confidence")


@query(f"WITH {NOTES_SQL} SELECT file, section FROM notes WHERE regexp_matches(content, '(?i)(led to|because of|resulted in|caused by|due to|which meant|this meant)\\s')")
def causal_sections(spark, sf_dir, own=None):
    return extract.causal(notes(spark, sf_dir) if own is None else own).select("file", "section")


def mentions_of(own):
    return extract.structural(own).unionByName(extract.custom(own))


MENTIONS = f"""WITH {NOTES_SQL}, s AS ({STRUCTURAL}), c AS ({CUSTOM}), every AS (SELECT * FROM s UNION ALL SELECT * FROM c), named AS (SELECT *, {NORM.format(x='text')} AS name FROM every),
best AS (SELECT file, section, name, max(confidence) AS confidence, arg_min(text, (-confidence, ord)) AS text, arg_min(ord, (-confidence, ord)) AS ord FROM named GROUP BY file, section, name)"""


@query(MENTIONS + " SELECT file, section, name, confidence FROM best")
def mention_dedup(spark, sf_dir, own=None):
    return extract.strongest(mentions_of(notes(spark, sf_dir) if own is None else own)).select("file", "section", "name", "confidence")


def sightings(own):
    """Resolved notes: every name its own node. No section comes twice in a file."""
    from pyspark.sql import Window

    from mnemora.functions.text import node_id

    # dealt by file once: places of sections, mentions and the strongest of each name keep to it
    excerpt, place = F.substring("content", 1, 80).alias("excerpt"), F.dense_rank().over(Window.partitionBy("file").orderBy("section")).alias("section_ord")
    about = own.repartition("file").select("file", "section", "heading", "date", "content", excerpt, place)
    m = extract.strongest(extract.structural_and_custom(about, ("date", "excerpt", "section_ord")))
    return m.select("file", "section", "ord", "date", F.col("name"), node_id(F.col("name")).alias("node_id"), F.col("text").alias("label"), "type", "excerpt", (F.col("confidence") == 0.9).alias("is_link"), "section_ord")


def _seen(spark, sf_dir, own):
    """Sightings of the notes; those of the tables are written once."""
    if own is not None:
        return sightings(own)
    return cached(spark, sf_dir, "sightings", lambda write: {"sightings": write(sightings(notes(spark, sf_dir)), "sightings", lean=True)})["sightings"]


NOTE_NODES = MENTIONS + ", m AS (SELECT b.*, date, substr(sha256(name), 1, 16) AS node_id FROM best b JOIN notes USING (file, section))"


@query(NOTE_NODES + """ SELECT node_id AS id, arg_min(text, (file, section, ord)) AS label, count(*) AS mention_count, count(*) - 1 AS reinforcement_count, arg_min(date, (file, section, ord)) AS first_seen,
  arg_max(date, (file, section, ord)) AS last_reinforced, count(DISTINCT file) AS files, least(10, count(*)) AS excerpts FROM m GROUP BY node_id""")
def note_nodes(spark, sf_dir, own=None):
    n = merge.roll_up(_seen(spark, sf_dir, own))
    return n.select("id", "label", "mention_count", "reinforcement_count", "first_seen", "last_reinforced", F.size("source_files").cast("long").alias("files"), F.size("excerpts").cast("long").alias("excerpts"))


@query(NOTE_NODES + """, p AS (SELECT a.file, a.section, a.date, a.node_id AS source, b.node_id AS target FROM m a JOIN m b ON a.file = b.file AND a.section = b.section AND a.node_id < b.node_id),
g AS (SELECT source, target, count(*) AS n, arg_min(date, (file, section)) AS first, arg_max(date, (file, section)) AS last FROM p GROUP BY source, target)
SELECT source || '--' || target || '--co-occurrence' AS id, n - 2 AS reinforcement_count, first AS first_formed, last AS last_reinforced, least(n, 20) AS evidence FROM g WHERE n >= 2""")
def note_cooccurrence(spark, sf_dir, own=None):
    seen = _seen(spark, sf_dir, own)
    e, _ = dynamics.graduate(merge.section_pairs(merge.only(seen, merge.often(seen))))
    return e.select("id", "reinforcement_count", "first_formed", "last_reinforced", F.size("evidence").cast("long").alias("evidence"))


@query(NOTE_NODES + """, l AS (SELECT file, section, node_id FROM m WHERE confidence = 0.9),
p AS (SELECT least(a.node_id, b.node_id) AS source, greatest(a.node_id, b.node_id) AS target FROM l a JOIN m b ON a.file = b.file AND a.section = b.section AND a.node_id <> b.node_id)
SELECT source || '--' || target || '--explicit' AS id, count(*) - 1 AS reinforcement_count FROM p GROUP BY source, target""")
def explicit_edges(spark, sf_dir, own=None):
    return merge.explicit(_seen(spark, sf_dir, own)).select("id", "reinforcement_count")


@query(NOTE_NODES + """, q AS (SELECT file, section, date FROM notes WHERE regexp_matches(content, '(?i)(led to|because of|resulted in|caused by|due to|which meant|this meant)\\s')),
k AS (SELECT m.*, row_number() OVER (PARTITION BY file, section ORDER BY ord, node_id) AS k FROM m SEMI JOIN q ON q.file = m.file AND q.section = m.section),
p AS (SELECT a.node_id AS source, b.node_id AS target FROM k a JOIN k b ON a.file = b.file AND a.section = b.section AND a.k = 1 AND b.k = 2)
SELECT source || '--' || target || '--causal' AS id, count(*) - 1 AS reinforcement_count FROM p GROUP BY source, target""")
def causal_edges(spark, sf_dir, own=None):
    return merge.causal(_seen(spark, sf_dir, own), extract.causal(notes(spark, sf_dir) if own is None else own)).select("id", "reinforcement_count")


@query(NOTE_NODES + """, o AS (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY section) AS si FROM m),
r AS (SELECT *, count(*) OVER (PARTITION BY node_id ORDER BY file, si) AS so_far FROM o),
p AS (SELECT a.file, least(a.node_id, b.node_id) AS source, greatest(a.node_id, b.node_id) AS target, min((a.si, b.si, a.ord, b.ord)) AS at FROM r a JOIN r b ON a.file = b.file AND a.si < b.si AND a.node_id <> b.node_id AND a.so_far >= 2 AND b.so_far >= 2 GROUP BY 1, 2, 3),
cap AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p."at") AS k FROM p)
SELECT source || '--' || target || '--temporal' AS id, count(*) - 1 AS reinforcement_count FROM cap WHERE k <= 50 GROUP BY source, target""".replace("AS at FROM", 'AS "at" FROM'))
def temporal_edges_capped(spark, sf_dir, own=None):
    return merge.temporal(_seen(spark, sf_dir, own)).select("id", "reinforcement_count")


@query(NOTE_NODES + """, x AS (SELECT node_id, list(substr(content, 1, 80) ORDER BY m.file, m.section, ord)[1:10] AS e, arg_min(text, (m.file, m.section, ord)) AS label, arg_min(type, (m.file, m.section, ord)) AS type
  FROM (SELECT b.*, date, substr(sha256(name), 1, 16) AS node_id, n.content, k.type FROM best b JOIN notes n USING (file, section) JOIN (SELECT file, section, name, arg_min(type, (-confidence, ord)) AS type FROM named GROUP BY ALL) k USING (file, section, name)) m GROUP BY node_id)
SELECT node_id AS id, label, type, len(e)::BIGINT AS excerpts, sha256(array_to_string(e, '|')) AS texts FROM x""")
def note_memories(spark, sf_dir, own=None):
    """Nodes of the notes as a client sees them."""
    m = views.memories(merge.roll_up(_seen(spark, sf_dir, own)))
    return m.select("id", "label", "type", F.size("excerpts").cast("long").alias("excerpts"), F.sha2(F.array_join("excerpts", "|"), 256).alias("texts"))


@query(NOTE_NODES + """, e AS (SELECT file, section, substr(sha256(file || ':' || heading || ':' || content), 1, 16) AS id, heading, date FROM notes),
k AS (SELECT file, section, name, arg_min(type, (-confidence, ord)) AS type FROM named GROUP BY ALL)
SELECT e.id, CASE WHEN regexp_matches(lower(heading), 'decision|decided|chose') THEN 'decision' WHEN regexp_matches(lower(heading), 'event|meeting|session') OR regexp_matches(heading, '\\d{4}-\\d{2}-\\d{2}') THEN 'event' ELSE 'observation' END AS type, e.date AS timestamp, heading AS title,
  substr(sha256(k.name), 1, 16) AS node_id, CASE WHEN k.type IN ('concept', 'project', 'tool', 'tag') THEN 'topic' WHEN k.type = 'person' THEN 'participant' ELSE 'mentioned' END AS role
FROM e JOIN k ON k.file = e.file AND k.section = e.section""")
def note_episodes(spark, sf_dir, own=None):
    """An episode a section, and the parts that its nodes play in it."""
    e = extract.episodes(notes(spark, sf_dir) if own is None else own)
    s = _seen(spark, sf_dir, own).select(F.col("file").alias("source"), "section", "node_id", extract.role(F.col("type")).alias("role"))
    return e.join(s, ["source", "section"]).select("id", "type", "timestamp", "title", "node_id", "role")


def _changed(spark, sf_dir, own):
    """Sightings before some files changed, those of the changed files now, and whether a file (file) is one of these: a tenth of the files are new, another tenth had half of their sections."""
    seen = _seen(spark, sf_dir, own)
    lot = F.pmod(F.xxhash64("file"), F.lit(10))
    old = seen.filter((lot != 4) & ((lot != 3) | (F.pmod(F.xxhash64("section"), F.lit(2)) == 0)))
    changed = lot.isin(3, 4)
    return old, seen.filter(changed), changed


@query(ORACLES["note_nodes"])
def note_nodes_after_changes(spark, sf_dir, own=None):
    """Nodes kept up as files change: those that the changed files name are summed anew of their parts, the others stay as they were."""
    old, fresh, changed = _changed(spark, sf_dir, own)
    parts = written(increments.node_parts(old), "parts", lean=True)
    stored = increments.nodes_of(parts)
    ids = fresh.select("node_id").unionByName(old.filter(changed).select("node_id")).distinct()
    now = parts.filter(~changed).join(ids, "node_id", "left_semi").select(parts.columns).unionByName(increments.node_parts(fresh))
    n = stored.join(ids.withColumnRenamed("node_id", "id"), "id", "left_anti").unionByName(increments.nodes_of(now).select(stored.columns))
    return n.select("id", "label", "mention_count", "reinforcement_count", "first_seen", "last_reinforced", F.size("source_files").cast("long").alias("files"), F.size("excerpts").cast("long").alias("excerpts"))


@query(ORACLES["note_cooccurrence"])
def note_cooccurrence_after_changes(spark, sf_dir, own=None):
    """Co-occurrence edges kept up likewise, by the pairs that the changed files name.

    Parts are kept of pairs of nodes seen often enough for an edge. A node that comes to be brings the parts that it has in unchanged files.
    """
    old, fresh, changed = _changed(spark, sf_dir, own)
    none = fresh.select("file", "section").filter("false")
    pair_parts = lambda seen: increments.pair_parts(seen, none).filter("type = 'co-occurrence'")
    before = written(merge.often(old), "before", lean=True)
    parts = written(pair_parts(merge.only(old, before)), "parts", lean=True)
    rest = old.filter(~changed)
    after = written(merge.often(rest.unionByName(fresh)), "after", lean=True)
    risen = written(after.join(before, "node_id", "left_anti"), "risen", lean=True)
    touched = merge.only(rest, risen).select("file", "section").distinct()
    of_risen = lambda p: p.join(risen.withColumnRenamed("node_id", "source").withColumn("_s", F.lit(True)), "source", "left").join(risen.withColumnRenamed("node_id", "target").withColumn("_t", F.lit(True)), "target", "left").filter("_s or _t")
    late = of_risen(pair_parts(merge.only(rest, after).join(touched, ["file", "section"], "left_semi"))).select(parts.columns)
    new = written(pair_parts(merge.only(fresh, after)).unionByName(late), "new-parts", lean=True)
    named = merge.if_few(new.select(*increments.PAIR).unionByName(parts.filter(changed).select(*increments.PAIR)).distinct())
    now = parts.filter(~changed).join(named, increments.PAIR, "left_semi").select(parts.columns).unionByName(new.select(parts.columns))
    pairs = increments.pairs_of(parts.join(named, increments.PAIR, "left_anti").select(parts.columns)).unionByName(increments.pairs_of(now))
    e, _ = increments.edges_of(pairs)
    return e.select("id", "reinforcement_count", "first_formed", "last_reinforced", F.size("evidence").cast("long").alias("evidence"))


#: A note a customer, of blocks of all kinds: a section an order, its heading underlined for odd keys; what stands in code and quotes begins none.
MARKDOWN = """notes AS (SELECT o_custkey, o_orderkey, string_agg(p_name, chr(10) ORDER BY l_linenumber, l_partkey) AS names, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def markdown_notes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    names = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda x: F.concat(F.lit("- **"), x["p_name"], F.lit("**\n")))
    own = l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy("l_orderkey").agg(F.array_join(names, "").alias("items")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("o_orderkey").cast("string")
    head = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("## Order "), key, F.lit("\n"))).otherwise(F.concat(F.lit("Order "), key, F.lit("\n---\n")))
    section = F.concat(head, F.lit("```\n## code\n```\n"), "items", F.lit("\n> ## quoted\n> - by Docker\n\n    ## indented\n\n"))
    notes = own.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", section.alias("s")))), lambda x: x["s"]), "").alias("text"))
    return notes.select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("path"), "text")


@query(f"""WITH {MARKDOWN} SELECT 'customer-' || o_custkey || '.md' AS file, 'Order ' || o_orderkey AS heading, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS section_ord,
  names || chr(10) || 'quoted' || chr(10) || 'by Docker' AS content FROM notes""")
def markdown_sections(spark, sf_dir):
    from mnemora.sources.notes import sections

    return sections(markdown_notes(spark, sf_dir)).select("file", "heading", "section_ord", "content")


@query(f"""WITH {MARKDOWN}, k AS (SELECT o_custkey, o_orderkey, lines, unnest(['heading', 'code', 'list', 'item', 'paragraph', 'quote', 'heading', 'list', 'item', 'paragraph', 'code']) AS kind, unnest([0, 0, 0, 1, 2, 0, 1, 1, 2, 3, 0]) AS depth, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS i FROM notes)
SELECT 'customer-' || o_custkey || '.md' AS path, kind, depth, sum(CASE WHEN i IN (4, 5) THEN lines ELSE 1 END)::BIGINT AS n FROM k GROUP BY ALL""")
def markdown_blocks(spark, sf_dir):
    from mnemora.sources.markdown import blocks

    return blocks(markdown_notes(spark, sf_dir)).groupBy("path", "kind", F.col("depth").cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


FIRST = ("Anna", "Boris", "Clara", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Irene", "Jonas", "Katja", "Luis", "Marta", "Nils", "Olga", "Pavel")
LAST = ("Abelson", "Brandt", "Castro", "Duval", "Engel", "Fischer", "Garcia", "Hansen", "Ivanov", "Jansen", "Keller", "Lindberg", "Moreau", "Novak", "Olsen", "Petrov", "Quint", "Rossi", "Sandoval", "Tanaka")
FIRMS = ("Labs", "Foundation", "Institute", "Corp")


def name_notes(spark, sf_dir):
    """(custkey, text, names): a sentence or three for every customer with planted names of people, places and organisations."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey").cast("int")
    of = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), F.pmod(F.xxhash64("c_custkey", F.lit(i)), F.lit(len(names))).cast("int"))
    person = lambda i: F.concat_ws(" ", of(FIRST, i), of(LAST, i + 1))
    place, firm = F.initcap("n_name"), F.concat_ws(" ", of(LAST, 5), of(FIRMS, 6))
    first, second = person(1), person(3)
    said = [
        F.concat(F.lit("Yesterday "), first, F.lit(" met the team in "), place, F.lit(". The order was late.")), F.concat(firm, F.lit(" asked whether "), first, F.lit(" could call back. We wait.")),
        F.concat(F.lit("The invoice was sent to "), second, F.lit(" by "), first, F.lit(", who works for "), firm, F.lit(".")), F.concat(F.lit("Nobody from "), place, F.lit(" answered. Please write to "), second, F.lit(" again.")),
    ]
    names = [[first, place], [firm, first], [second, first, firm], [place, second]]
    text, own = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for i in range(4):
        text, own = F.when(k % 4 == i, said[i]).otherwise(text), F.when(k % 4 == i, F.array(*names[i])).otherwise(own)
    return c.select("c_custkey", text.alias("text"), F.array_sort(own).alias("names"))


@query()
def names_tagged(spark, sf_dir):
    """Names that a tagger finds in every customer's note. It learns from some of the notes, in which known names are marked."""
    n = name_notes(spark, sf_dir)
    known = {f"{a} {b}": "person" for a in FIRST for b in LAST[:12]} | {f"{b} {f}": "project" for b in LAST[:12] for f in FIRMS} | {r["n"]: "place" for r in table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("n")).collect()}  # the nations
    unknown = F.exists("names", lambda x: ~x.isin(*known))
    model = tagger.fit(tagger.labelled_by(n.filter(~unknown), known), sample=1000)
    found = tagger.tagged_names(n.select("c_custkey", "text"), model)
    return found.select("c_custkey", F.explode("names").alias("x")).select("c_custkey", F.col("x.text").alias("name"), F.col("x.type").alias("type"))


# resolution over part names

NAMES = "names AS (SELECT DISTINCT p_name AS label FROM part), known AS (SELECT label, substr(sha256(label), 1, 16) AS id FROM names WHERE ascii(substr(sha256(label), 1, 1)) % 2 = 0)"


def _known(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct()
    h = F.sha2("label", 256)
    return n, n.filter(F.ascii(F.substring(h, 1, 1)) % 2 == 0).select("label", F.substring(h, 1, 16).alias("id"), F.array().cast("array<string>").alias("aliases"))


@query(f"WITH {NAMES} SELECT n.label AS name, k.id, 'label' AS tier FROM names n JOIN known k USING (label)")
def entity_resolution_exact(spark, sf_dir):
    n, known = _known(spark, sf_dir)
    return resolve.exact(n.select(normalize(F.col("label")).alias("name")), known)


@query(f"""WITH {NAMES}, p AS (SELECT n.label AS name, k.id FROM names n, known k WHERE
  CASE WHEN length(n.label) <= 15 AND length(k.label) <= 15 THEN levenshtein(n.label, k.label) <= 2 ELSE len(list_intersect(string_split(n.label, ' '), string_split(k.label, ' '))) / 2.0 >= 0.5 END)
SELECT name, min(id) AS id FROM p GROUP BY name""")
def entity_resolution_fuzzy(spark, sf_dir):
    n, known = _known(spark, sf_dir)
    return resolve.fuzzy(n.select(normalize(F.col("label")).alias("name")), known)


@query(f"""WITH RECURSIVE names AS (SELECT {NORM.format(x='p_name')} AS name, min(p_partkey) AS ord FROM part GROUP BY 1),
o AS (SELECT name, row_number() OVER (ORDER BY ord) AS k FROM names),
f AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS name, NULL::VARCHAR AS leader, []::VARCHAR[] AS leads UNION ALL
  SELECT k, name, coalesce(hit, name), CASE WHEN hit IS NULL THEN list_append(leads, name) ELSE leads END FROM (SELECT o.k, o.name, leads, list_filter(leads, lambda x:
    CASE WHEN length(o.name) <= 15 AND length(x) <= 15 THEN levenshtein(o.name, x) <= 2
    ELSE len(list_intersect(string_split(o.name, ' '), string_split(x, ' '))) / greatest(len(list_distinct(string_split(o.name, ' '))), len(list_distinct(string_split(x, ' '))))::DOUBLE >= 0.5 END)[1] AS hit
    FROM f JOIN o ON o.k = f.k + 1))
SELECT name, leader FROM f WHERE k > 0""")
def leader_resolution(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy(normalize(F.col("p_name")).alias("name")).agg(F.min("p_partkey").alias("ord"))
    return resolve.leaders(names)


# events, pages and conversations


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE AS new FROM events),
s AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session, count(*) AS events, min(ts)::VARCHAR AS started, round(sum(value), 4) AS value FROM s GROUP BY user_id, session""".replace("min(ts)::VARCHAR", "strftime(min(ts), '%Y-%m-%d %H:%M:%S')"))
def event_sessions(spark, sf_dir):
    s = conversations.sessions(table(spark, sf_dir, "events"), "user_id", "ts", order="event_id")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("started"), r(F.sum("value"), "value", 4))


@query("""WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events)
SELECT a.user_id AS source, b.user_id AS target, count(*) AS n FROM h a JOIN h b ON a.hour = b.hour AND a.user_id < b.user_id GROUP BY 1, 2""")
def event_pairs(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.date_trunc("hour", "ts").alias("group"))
    return pairs.counted(h)


@query("""WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events)
SELECT a.user_id AS source, b.user_id AS target, count(*) AS n FROM h a JOIN h b ON a.hour = b.hour AND a.user_id < b.user_id GROUP BY 1, 2 HAVING count(*) >= 3""")
def event_pairs_often(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.date_trunc("hour", "ts").alias("group"))
    return pairs.counted(h, 3)


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    return p.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, role, length(text) + length(role) + 2 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, 0 AS chunk, 0 AS next, 1 AS n, size AS chars, role FROM m WHERE k = 1 UNION ALL
  SELECT conv_id, turn, k, own, own + answer::INTEGER, CASE WHEN answer THEN 0 WHEN whole THEN 1 ELSE n + 1 END, CASE WHEN answer THEN 0 WHEN whole THEN size ELSE chars + size END, role FROM (
    SELECT *, next + (whole AND NOT answer)::INTEGER AS own FROM (SELECT *, whole AND n > 0 AND role = 'assistant' AND before = 'user' AS answer FROM (
      SELECT m.*, f.next, f.n, f.chars, f.role AS before, f.n >= 3 OR (f.n > 0 AND ceil((f.chars + m.size) / 4.0) > 4000) AS whole FROM f JOIN m ON m.conv_id = f.conv_id AND m.k = f.k + 1))))
SELECT conv_id, turn, chunk FROM f""")
def conversation_chunks(spark, sf_dir):
    return conversations.chunks(messages(spark, sf_dir), max_messages=3).select("conv_id", "turn", "chunk")


@query("""WITH m AS (SELECT *, 0 AS chunk FROM conversations),
g AS (SELECT conv_id, chunk, arg_min(text, turn) FILTER (role = 'user') AS first_user, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS answers,
  string_agg('[' || role || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS content, ceil(sum(length(text) + length(role) + 2) / 4.0)::BIGINT AS tokens, count(*) AS messages FROM m GROUP BY ALL),
t AS (SELECT *, regexp_replace(first_user, '^\\s+|\\s+$', '', 'g') AS t FROM g)
SELECT conv_id, coalesce(CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 77) || '...' END, 'Untitled conversation') AS title,
  'Conversation chunk with ' || concat_ws(', ', CASE WHEN users > 0 THEN users || ' user message' || CASE WHEN users > 1 THEN 's' ELSE '' END END, CASE WHEN answers > 0 THEN answers || ' assistant response' || CASE WHEN answers > 1 THEN 's' ELSE '' END END) AS summary,
  sha256(content) AS content_sha256, tokens, messages FROM t""")
def chunk_episodes(spark, sf_dir):
    e = conversations.chunk_episodes(messages(spark, sf_dir).withColumn("chunk", F.lit(0)))
    return e.select("conv_id", "title", "summary", F.sha2("content", 256).alias("content_sha256"), "tokens", "messages")


@query("""WITH h AS (SELECT conv_id, substr(sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)), 1, 32) AS content_hash FROM conversations GROUP BY conv_id)
SELECT min(conv_id) AS conv_id, content_hash FROM h WHERE conv_id % 7 <> 0 GROUP BY content_hash""")
def ingest_dedup(spark, sf_dir):
    m = messages(spark, sf_dir)
    seen = m.filter(F.col("conv_id") % 7 == 0).select("conv_id").distinct().withColumn("content_hash", F.lit(""))  # every seventh was ingested under another content
    return conversations.new_conversations(m, seen)


#: Conversations that name things: every message names its first two words of four letters or more, as a link and as code.
TALK_SQL = """talk AS (SELECT conv_id, turn, role, text || ' [[' || coalesce(regexp_extract_all(text, '[a-z]{4,}')[1], '') || ']] `' || coalesce(regexp_extract_all(text, '[a-z]{4,}')[2], '') || '`' AS text FROM conversations)"""
_TALK_TOOLS = " UNION ALL ".join(
    f"SELECT conv_id, turn, 0 AS k, {i} AS ord, 'tool' AS type, 0.9::DOUBLE AS confidence, '{t.lower()}' AS name FROM said WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){t.replace('.', chr(92) + '.')}([^A-Za-z0-9_]|$)')" for i, t in enumerate(extract.CHAT_TOOLS)
)
INGEST_SQL = f"""WITH {TALK_SQL}, said AS (SELECT * FROM talk WHERE role <> 'system'),
hit AS ({_TALK_TOOLS} UNION ALL SELECT conv_id, turn, 1, 0, 'concept', 0.9, unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)) FROM said
  UNION ALL SELECT conv_id, turn, 1, 1, 'tool', 0.7, x FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '`([^`]+)`', 1)) AS x FROM said) WHERE length(x) BETWEEN 2 AND 40),
best AS (SELECT conv_id, name, arg_min(type, (-confidence, turn, k, ord)) AS type FROM hit WHERE name NOT IN ({', '.join(repr(x) for x in extract.CHAT_STOPWORDS)}) GROUP BY ALL),
near AS (SELECT b.conv_id, name, least(3, count(*)) AS n FROM best b JOIN talk t ON t.conv_id = b.conv_id AND contains(lower(t.text), name) GROUP BY ALL),
ent AS (SELECT substr(sha256(name), 1, 16) AS id, name, b.conv_id, type, n, CASE WHEN b.conv_id % 2 = 0 THEN '2026-01-01' ELSE '2026-02-01' END AS day,
  row_number() OVER (PARTITION BY name ORDER BY b.conv_id % 2, b.conv_id) AS k FROM best b JOIN near USING (conv_id, name))"""


def talk(spark, sf_dir):
    w = F.regexp_extract_all("text", F.lit("([a-z]{4,})"), F.lit(1))
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    m = messages(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" [["), word(0), F.lit("]] `"), word(1), F.lit("`")))
    return conversations.chat_entities(m.withColumn("chunk", F.lit(0))).withColumn("source", F.col("conv_id").cast("string"))


def ingested_twice(spark, sf_dir):
    """Nodes and edges after the even conversations, then the odd ones."""
    from mnemora.schemas import EDGES, NODES
    from mnemora.shared import written
    from mnemora.store import full

    e = written(talk(spark, sf_dir), "entities")
    now = {"nodes": spark.createDataFrame([], NODES), "edges": spark.createDataFrame([], EDGES)}
    for odd, at in ((0, "2026-01-01"), (1, "2026-02-01")):
        new = merge.ingested(e.filter(F.col("conv_id") % 2 == odd), now["nodes"], now["edges"], at)
        now = {t: written(store_ops.upsert(now[t], full(new[t], t), ["id"]), t) for t in now}
    return now


@query(INGEST_SQL + """ SELECT id, arg_min(type, k) AS type, count(*) AS mention_count, count(*) - 1 AS reinforcement_count, min(day) AS first_seen, max(day) AS last_reinforced,
  least(10, sum(CASE WHEN k = 1 THEN n ELSE 1 END))::BIGINT AS excerpts FROM ent GROUP BY id""")
def ingest_nodes(spark, sf_dir):
    n = ingested_twice(spark, sf_dir)["nodes"]
    return n.select("id", "type", "mention_count", "reinforcement_count", "first_seen", "last_reinforced", F.size("excerpts").cast("long").alias("excerpts"))


@query(INGEST_SQL + """, p AS (SELECT a.id AS source, b.id AS target, a.day FROM ent a JOIN ent b ON a.conv_id = b.conv_id AND a.id < b.id)
SELECT source || '--' || target || '--co-occurrence' AS id, count(*) - 1 AS reinforcement_count, min(day) AS first_formed, max(day) AS last_reinforced, least(20, count(*)) AS evidence,
  round(CASE WHEN count(*) = 1 THEN 1 ELSE 1 + 1.5 * ln(count(*)) END, 6)::DOUBLE AS stability FROM p GROUP BY source, target""")
def ingest_edges(spark, sf_dir):
    e = ingested_twice(spark, sf_dir)["edges"]
    return e.select("id", "reinforcement_count", "first_formed", "last_reinforced", F.size("evidence").cast("long").alias("evidence"), r("stability", "stability"))
