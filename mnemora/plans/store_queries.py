"""Episodes, procedures, feedback, ledger and truth-layer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from mnemora import keyed
from mnemora.functions import dates, weights
from mnemora.operators import dynamics, graph, procedures, store_ops, truth, vectors, views
from mnemora.plans.catalog import day, query, r
from mnemora.plans.derive import ctes, graph as trade, mentions, mock_vectors, now, part_id, table
from mnemora.shared import scratch

W = "WITH " + ctes()
EP = "ep AS (SELECT o_orderkey AS id, o_orderdate AS timestamp, CASE o_orderstatus WHEN 'F' THEN 'decision' WHEN 'O' THEN 'event' ELSE 'observation' END AS type FROM orders)"


def episodes(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "decision").when(F.col("o_orderstatus") == "O", "event").otherwise("observation")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"), kind.alias("type"), F.col("o_orderpriority").alias("source"))


def links(spark, sf_dir):
    return mentions(spark, sf_dir).select(F.col("section").alias("episode_id"), part_id(F.col("l_partkey")).alias("node_id"))


@query(W + f""", {EP}, top AS (SELECT id FROM nodes ORDER BY mention_count DESC, id LIMIT 1)
SELECT DISTINCT ep.id, ep.timestamp::DATE::VARCHAR AS timestamp, type FROM ep JOIN mentions ON section = ep.id
WHERE type = 'event' AND ep.timestamp BETWEEN '1996-01-01' AND '2000-06-30' AND substr(sha256('part:' || part), 1, 16) = (SELECT id FROM top)""")
def episode_filter(spark, sf_dir):
    top = trade(spark, sf_dir)["nodes"].orderBy(F.desc("mention_count"), "id").first()["id"]
    e = store_ops.list_episodes(episodes(spark, sf_dir), links(spark, sf_dir), kind="event", since="1996-01-01", until="2000-06-30", entity=top)
    return e.select("id", day("timestamp"), "type")


@query(W + f""", {EP}, l AS (SELECT section AS episode_id, n.label, CASE WHEN n.type = 'person' THEN 'participant' WHEN n.type IN ('concept', 'project', 'tool', 'tag') THEN 'topic' ELSE 'mentioned' END AS role FROM mentions JOIN nodes n ON n.id = substr(sha256('part:' || part), 1, 16))
SELECT ep.id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (role = 'participant'), '') AS participants, coalesce(string_agg(label, ',' ORDER BY label) FILTER (role = 'topic'), '') AS topics
FROM ep LEFT JOIN l ON l.episode_id = ep.id GROUP BY ep.id""")
def episode_roles(spark, sf_dir):
    from mnemora.operators.extract import role

    n = trade(spark, sf_dir)["nodes"].select(F.col("id").alias("node_id"), "label", role(F.col("type")).alias("role"))
    p = store_ops.episode_roles(episodes(spark, sf_dir), links(spark, sf_dir).join(n, "node_id").withColumnRenamed("label", "name"))
    return p.select("id", F.array_join("participants", ",").alias("participants"), F.array_join("topics", ",").alias("topics"))


#: A procedure a conversation, of its first assistant's turn: its longer words trigger it.
PROCS = """procs AS (SELECT conv_id, 'proc-' || conv_id AS id, text AS statement, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS kw, ['topic' || conv_id % 7, 'ci'][1:1 + conv_id % 2] AS ctx,
  round(0.3 + (conv_id * 7 % 60) / 100.0, 2)::DOUBLE AS confidence, CASE WHEN conv_id % 3 > 0 THEN conv_id * 5 % 400 END AS age, conv_id % 3 AS contradictions, conv_id % 11 = 0 AS flagged
  FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id))"""


def procs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null").groupBy("conv_id").agg(F.min_by("text", "turn").alias("statement"))
    n = F.col("conv_id")
    at = F.date_format(F.date_sub(now().cast("date"), (n * 5 % 400).cast("int")), "yyyy-MM-dd")
    return c.select(
        F.concat(F.lit("proc-"), n.cast("string")).alias("id"), "statement", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("statement"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("trigger_keywords"),
        F.slice(F.array(F.concat(F.lit("topic"), (n % 7).cast("string")), F.lit("ci")), F.lit(1), (1 + n % 2).cast("int")).alias("trigger_contexts"), F.round(0.3 + (n * 7 % 60) / 100, 2).alias("confidence"),
        F.when(n % 3 > 0, at).alias("last_applied"), (n % 3).cast("long").alias("contradictions"), (n % 11 == 0).alias("flagged_for_review"), F.lit(1.0).alias("stability"), F.lit(0).cast("long").alias("applications"), F.lit("preference").alias("type"),
    )


@query(f"""WITH {PROCS}, h AS (SELECT *, len(list_filter(kw, lambda k: contains(k, 'tion') OR contains(k, 'her') OR contains('restoring', k))) AS hits, len(list_filter(ctx, lambda x: x IN ('ci', 'topic3'))) AS met FROM procs),
s AS (SELECT id, statement, (hits / greatest(len(kw), 1)::DOUBLE * 0.7 + met / greatest(len(ctx), 1)::DOUBLE * 0.3) * confidence * CASE WHEN age IS NULL THEN 1 ELSE greatest(0.5, 1 - age / 365.0::DOUBLE) END AS score FROM h)
SELECT id, statement, round(score, 6)::DOUBLE AS score FROM s WHERE score >= 0.05""")
def procedure_match(spark, sf_dir):
    p = procs(spark, sf_dir)
    return procedures.match(p, ["tion", "her", "restoring"], ["CI", "topic3"], now(), limit=None, least=0.05).select("id", "statement", r("score", "score"))


@query(f"""WITH {PROCS}, h AS (SELECT *, len(list_filter(kw, lambda k: contains(k, 'tion'))) AS hits FROM procs), s AS (SELECT id, hits / greatest(len(kw), 1)::DOUBLE * 0.7 * confidence * CASE WHEN age IS NULL THEN 1 ELSE greatest(0.5, 1 - age / 365.0::DOUBLE) END AS score FROM h)
SELECT id, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM s WHERE score > 0 ORDER BY place LIMIT 10""")
def procedure_top(spark, sf_dir):
    from pyspark.sql import Window

    p = procedures.match(procs(spark, sf_dir), ["tion"], [], now(), limit=10, least=1e-12)
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).cast("long")).select("id", r("score", "score"), "place")  # ten rows


@query(f"""WITH RECURSIVE {PROCS}, fb AS (SELECT id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS f, row_number() OVER (PARTITION BY id ORDER BY event_id) AS k FROM events JOIN procs ON conv_id = user_id),
x AS (SELECT id, 0::BIGINT AS k, confidence AS c, 1.0::DOUBLE AS s, 0 AS a, contradictions::INTEGER AS n, flagged FROM procs UNION ALL
  SELECT id, k, c, s, a, n, flagged OR (f < 0 AND n >= 3 AND c < 0.3) FROM (SELECT x.id, fb.k, f, flagged, CASE f WHEN 1 THEN least(0.99, c + 0.1 * (1 - c)) WHEN -1 THEN greatest(0.01, c * 0.8) ELSE c END AS c,
    CASE f WHEN 1 THEN least(2.0, s + 0.1) ELSE s END AS s, CASE f WHEN 1 THEN a + 1 ELSE a END AS a, CASE f WHEN -1 THEN n + 1 ELSE n END AS n FROM x JOIN fb ON fb.id = x.id AND fb.k = x.k + 1))
SELECT id, round(arg_max(c, k), 6)::DOUBLE AS confidence, round(arg_max(s, k), 6)::DOUBLE AS stability, arg_max(a, k)::INTEGER AS applications, arg_max(n, k)::INTEGER AS contradictions, arg_max(flagged, k) AS flagged FROM x GROUP BY id""")
def procedure_feedback_fold(spark, sf_dir):
    """Every event of a user is a verdict on the procedure of the same number: purchases praise, errors blame."""
    kind = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    fb = table(spark, sf_dir, "events").select(F.concat(F.lit("proc-"), F.col("user_id").cast("string")).alias("procedure_id"), F.col("event_id").cast("long").alias("ord"), kind.alias("feedback"), F.col("ts").cast("string").alias("at"))
    p = dynamics.apply_feedback(procs(spark, sf_dir), fb)
    whole = lambda c: F.col(c).cast("int").alias(c)
    return p.select("id", r("confidence", "confidence"), r("stability", "stability"), whole("applications"), whole("contradictions"), F.col("flagged_for_review").alias("flagged"))


@query(W + """, n AS (SELECT id, CASE WHEN mention_count % 3 = 0 THEN 0.5 WHEN mention_count % 3 = 1 THEN -0.5 ELSE 0 END AS rating FROM nodes),
a AS (SELECT e.id, target, x.rating AS ra, y.rating AS rb, e.reinforcement_count AS rc, e.weight AS w, e.stability AS s FROM edges e JOIN n x ON x.id = source JOIN n y ON y.id = target),
b AS (SELECT *, CASE WHEN ra > 0 THEN rc + 1 ELSE rc END AS rc1, CASE WHEN ra < 0 THEN greatest(0.0, w + 0.2 * ra) ELSE w END AS w1, CASE WHEN ra > 0 THEN least(10.0, s * (1 + ra)) WHEN ra < 0 THEN greatest(0.1, s * (1 + 0.5 * ra)) ELSE s END AS s1 FROM a)
SELECT id, CASE WHEN rb > 0 THEN rc1 + 1 ELSE rc1 END AS reinforcement_count, round(CASE WHEN rb < 0 THEN greatest(0.0, w1 + 0.2 * rb) ELSE w1 END, 6)::DOUBLE AS weight,
  round(CASE WHEN rb > 0 THEN least(10.0, s1 * (1 + rb)) WHEN rb < 0 THEN greatest(0.1, s1 * (1 + 0.5 * rb)) ELSE s1 END, 6)::DOUBLE AS stability FROM b""")
def feedback_edges(spark, sf_dir):
    g = trade(spark, sf_dir)
    m = F.col("mention_count") % 3
    ratings = g["nodes"].select(F.col("id").alias("node_id"), F.when(m == 0, 0.5).when(m == 1, -0.5).otherwise(0.0).alias("rating"))
    return dynamics.feedback_edges(g["edges"], ratings).select("id", "reinforcement_count", r("weight", "weight"), r("stability", "stability"))


@query("""WITH now_files AS (SELECT 'doc-' || doc_id || '.md' AS path, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 1),
ledger AS (SELECT 'doc-' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 5 = 2 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> 0)
SELECT f.path, CASE WHEN l.path IS NULL THEN 'new' WHEN l.hash <> f.hash THEN 'changed' ELSE 'unchanged' END AS status FROM now_files f LEFT JOIN ledger l USING (path)""")
def change_detection(spark, sf_dir):
    from mnemora.sources import notes

    d = table(spark, sf_dir, "documents")
    path, five = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")), F.col("doc_id") % 5
    files = d.filter(five != 1).select(path.alias("path"), F.sha2("text", 256).alias("hash"))
    ledger = d.filter(five != 0).select(path.alias("path"), F.sha2(F.when(five == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return notes.changes(files, ledger)


CAP = "captures AS (SELECT 'mem_' || (event_id % 5000) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS title FROM events), gone AS (SELECT 'mem_' || (event_id % 5000) AS id FROM events WHERE event_type = 'error' AND user_id % 2 = 0)"


def captures(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ident = F.concat(F.lit("mem_"), (F.col("event_id") % 5000).cast("string"))
    c = e.select(ident.alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("title"))
    return c, e.filter("event_type = 'error' and user_id % 2 = 0").select(ident.alias("id"))


@query(f"""WITH {CAP}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, title) AS r FROM captures)
SELECT id, ts, title FROM f WHERE r = 1 AND id NOT IN (SELECT id FROM gone) AND substr(id, 5)::INTEGER % 11 <> 0 AND substr(id, 5)::INTEGER % 13 <> 0""")
def tombstone_compile(spark, sf_dir):
    c, gone = captures(spark, sf_dir)
    number = F.substring("id", 5, 10).cast("int")
    files, done = c.filter(number % 11 == 0).select("id"), c.filter(number % 13 == 0).select("id")
    return truth.to_promote(c, truth.forgotten_ids(gone, gone), files, done).select("id", "ts", "title")


@query(W + """, f AS (SELECT id, mention_count % 50 AS rc, first_seen AS lr FROM nodes)
SELECT f.id, greatest(rc, n.reinforcement_count) AS reinforcement_count, greatest(lr, n.last_reinforced)::DATE::VARCHAR AS last_reinforced FROM f JOIN nodes n ON n.id = f.id""")
def salience_merge(spark, sf_dir):
    n = trade(spark, sf_dir)["nodes"]
    files = n.select("id", (F.col("mention_count") % 50).alias("reinforcement_count"), F.col("first_seen").alias("last_reinforced"))
    return truth.salience(files, n).select("id", "reinforcement_count", day("last_reinforced"))


@query(W + """, names AS (SELECT id AS old, 'renamed-' || substr(id, 1, 6) AS new FROM nodes WHERE mention_count % 4 = 0),
e AS (SELECT coalesce(x.new, source) AS s, coalesce(y.new, target) AS t FROM edges LEFT JOIN names x ON x.old = source LEFT JOIN names y ON y.old = target)
SELECT least(s, t) || '--' || greatest(s, t) || '--co-occurrence' AS id, s AS source, t AS target FROM e""")
def rename_nodes(spark, sf_dir):
    g = trade(spark, sf_dir)
    names = g["nodes"].filter(F.col("mention_count") % 4 == 0).select(F.col("id").alias("old"), F.concat(F.lit("renamed-"), F.substring("id", 1, 6)).alias("new"))
    return truth.renamed_edges(g["edges"], names).select("id", "source", "target")


MOCK = f"""WITH RECURSIVE {mock_vectors("SELECT conv_id || '-' || turn AS id, coalesce(text, '') AS text FROM conversations")}
SELECT id, 'episode' AS type, count(*)::INTEGER AS dimensions, round(sqrt(sum(x::DOUBLE * x::DOUBLE)), 6) AS vector_norm, round(max(x) FILTER (i = 1)::DOUBLE, 6) AS first_value, round(max(x) FILTER (i = 64)::DOUBLE, 6) AS last_value FROM mock GROUP BY id"""


@query(MOCK)
def mock_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("episode").alias("type"), F.col("text").alias("content"))
    at = lambda k: r(F.get("vector", F.lit(k)).cast("double"), "first_value" if k == 0 else "last_value")
    return vectors.embed(rows).select("id", "type", "dimensions", r("vector_norm", "vector_norm"), at(0), at(63))


@query("""WITH RECURSIVE e AS (SELECT user_id AS lane, event_id AS id, epoch_us(ts) AS "at" FROM events),
w AS (SELECT *, min("at") OVER (PARTITION BY lane) AS lo, greatest(1, max("at") OVER (PARTITION BY lane) - min("at") OVER (PARTITION BY lane))::DOUBLE AS width, row_number() OVER (PARTITION BY lane ORDER BY "at", id) AS k FROM e),
p AS (SELECT lane, id, k, ("at" - lo)::DOUBLE / width AS position FROM w),
f AS (SELECT lane, id, k, position, position AS anchor, 0 AS stack FROM p WHERE k = 1 UNION ALL
  SELECT p.lane, p.id, p.k, p.position, CASE WHEN p.position - anchor < 0.02 THEN anchor ELSE p.position END, CASE WHEN p.position - anchor < 0.02 THEN stack + 1 ELSE 0 END FROM f JOIN p ON p.lane = f.lane AND p.k = f.k + 1)
SELECT lane, id::VARCHAR AS id, round(position, 6) AS position, stack FROM f""")
def episode_timeline_stack(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lane = e.select(F.col("user_id").alias("lane"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return views.timeline_stack(lane).select("lane", "id", r("position", "position"), "stack")


@query(f"""WITH {CAP}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, title) AS r FROM captures)
SELECT id, title AS label, 'candidate' AS status, ts AS first_seen FROM f WHERE r = 1 AND id NOT IN (SELECT id FROM gone) AND substr(id, 5)::INTEGER % 11 <> 0""")
def capture_replay(spark, sf_dir):
    c, gone = captures(spark, sf_dir)
    return truth.replayed(c, gone, c.filter(F.substring("id", 5, 10).cast("int") % 11 == 0)).select("id", "label", "status", "first_seen")


@query(W + "SELECT type, count(*) AS n, round(count(*) / (SELECT count(*) FROM nodes)::DOUBLE, 6) AS share FROM nodes GROUP BY type")
def type_shares(spark, sf_dir):
    return views.shares(trade(spark, sf_dir)["nodes"], "type").select("type", "n", r("share", "share"))


@query(W + "SELECT type, year(first_seen)::INTEGER AS year, count(*) AS n, sum(mention_count)::BIGINT AS mentions FROM nodes GROUP BY CUBE (type, year(first_seen)::INTEGER)")
def type_cube(spark, sf_dir):
    return views.type_cube(trade(spark, sf_dir)["nodes"])


@query("""WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M') AS start, n, greatest(0, n - 1) AS over FROM w""")
def rate_limits(spark, sf_dir):
    out = views.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", 1, "1 hour")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.col("over").cast("long").alias("over"))


@query("""WITH d AS (SELECT DISTINCT label FROM embeddings), e AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0)
SELECT count(*) AS total, count(*) FILTER (vec_id % 3 <> 0) AS embedded, round(100.0 * count(*) FILTER (vec_id % 3 <> 0) / count(*), 6)::DOUBLE AS percent FROM embeddings""")
def embedding_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"))
    return vectors.coverage(e, e.filter(F.col("id").cast("long") % 3 != 0)).select("total", "embedded", r("percent", "percent"))


@query(f"""WITH {PROCS}, p AS (SELECT id, confidence, flagged, 0 AS k FROM procs WHERE conv_id % 3 > 0 UNION ALL SELECT id, confidence / 2, NOT flagged, 1 FROM procs WHERE conv_id % 2 = 0),
m AS (SELECT id, arg_min(confidence, k) AS confidence, arg_min(flagged, k) AS flagged FROM p GROUP BY id)
SELECT count(*) AS procedures, count(*) FILTER (flagged) AS flagged, round(avg(confidence), 6)::DOUBLE AS average_confidence, count(*) FILTER (confidence < 0.3) AS weak FROM m""")
def procedures_merged(spark, sf_dir):
    """Two stores' procedures: those of the own one hide those of the shared one."""
    p = procs(spark, sf_dir).select("id", "confidence", "flagged_for_review", F.substring("id", 6, 20).cast("long").alias("n"))
    own = p.filter("n % 3 > 0").drop("n")
    hive = p.filter("n % 2 = 0").select("id", (F.col("confidence") / 2).alias("confidence"), (~F.col("flagged_for_review")).alias("flagged_for_review"))
    return procedures.health(procedures.merged(own, hive)).withColumn("average_confidence", F.round("average_confidence", 6))


@query(W + ", d AS (SELECT n.id, mention_count, degree, coalesce(max(weight), 0) AS w FROM nodes n JOIN degree USING (id) LEFT JOIN adj ON node = n.id GROUP BY ALL) SELECT id, round(least(18, 3 + 1.5 * log2(degree + 1) + 0.8 * log2(mention_count + 1)), 6)::DOUBLE AS size, round(0.3 + 0.7 * least(w, 1), 6)::DOUBLE AS opacity FROM d")
def node_look(spark, sf_dir):
    g = trade(spark, sf_dir)
    n = graph.viz_projection(g["nodes"], g["edges"])["nodes"]
    return n.select("id", r(weights.node_size(F.col("degree"), F.col("mention_count")), "size"), r(weights.node_opacity(F.col("max_weight")), "opacity"))


@query(W + "SELECT id, round(0.3 + 2.2 * least(1, weight / base_weight), 6)::DOUBLE AS width FROM edges")
def edge_look(spark, sf_dir):
    return trade(spark, sf_dir)["edges"].select("id", r(weights.edge_width(F.col("weight"), F.col("base_weight")), "width"))


@query(W + """, s AS (SELECT min(first_seen) AS a, max(first_seen) AS b FROM nodes), v AS (SELECT id, a, b, floor((epoch_us(first_seen) - epoch_us(a))::DOUBLE / (epoch_us(b) - epoch_us(a)) * 100 + 0.5)::BIGINT AS value,
  -2.0 * abs(floor((epoch_us(TIMESTAMP '2001-09-01') - epoch_us(first_seen)) / 86400000000.0)) AS depth FROM nodes, s)
SELECT id, value, strftime(make_timestamp(epoch_us(a) + floor(value / 100.0::DOUBLE * (epoch_us(b) - epoch_us(a)) / 1000)::BIGINT * 1000), '%Y-%m-%d %H:%M') AS back, depth::DOUBLE AS depth FROM v""")
def time_axis(spark, sf_dir):
    n = trade(spark, sf_dir)["nodes"]
    span = n.agg(F.min("first_seen").alias("a"), F.max("first_seen").alias("b"))  # one row
    n = n.join(F.broadcast(span), how="cross").withColumn("value", dates.slider_value(F.col("first_seen"), F.col("a"), F.col("b")))
    back = F.date_format(dates.slider_date(F.col("value"), F.col("a"), F.col("b")), "yyyy-MM-dd HH:mm")
    return n.select("id", "value", back.alias("back"), weights.depth(dates.days_floored(now(), F.col("first_seen"))).cast("double").alias("depth"))


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE vec_id % 7 <> 0), c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM p)
SELECT round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, n, (SELECT round(max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) FROM p, c) AS spread FROM c""")
def layout_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = [F.when(F.col("vec_id") % 7 != 0, F.get("embedding", F.lit(k)).cast("double")).alias(c) for k, c in enumerate("xyz")]
    return views.centroid(e.select(*at)).select(*[r(c, c) for c in ("cx", "cy", "cz")], "n", r("spread", "spread"))


@query("SELECT 'l' || label AS type, count(*) AS n FROM embeddings GROUP BY label")
def embedding_types(spark, sf_dir):
    return vectors.counts_by_type(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("type")))


@query(W + ", e AS (SELECT id FROM nodes WHERE mention_count % 3 <> 0) SELECT id, label FROM nodes WHERE id NOT IN (SELECT id FROM e)")
def embedding_missing(spark, sf_dir):
    n = trade(spark, sf_dir)["nodes"]
    return vectors.missing(n, n.filter(F.col("mention_count") % 3 != 0))


@query(W + "SELECT id, sha256(label || ' — ' || concat_ws('. ', alias, type)) AS text_sha256 FROM nodes")
def node_texts(spark, sf_dir):
    n = trade(spark, sf_dir)["nodes"]
    e = lambda c: F.struct(F.lit("f").alias("file"), c.alias("text"), F.lit("d").alias("date"))
    return n.select("id", F.sha2(vectors.node_text(F.col("label"), F.array(e(F.get("aliases", F.lit(0))), e(F.col("type")))), 256).alias("text_sha256"))


DELTAS = """o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 7 AS u, o_orderkey % 11 AS g FROM orders),
kept AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice + CASE WHEN u BETWEEN 1 AND 5 THEN u ELSE 0 END, 2)::DOUBLE AS o_totalprice FROM o
  WHERE CASE WHEN u BETWEEN 1 AND 5 AND g BETWEEN 1 AND 5 THEN u >= g WHEN u BETWEEN 1 AND 5 THEN true WHEN g BETWEEN 1 AND 5 THEN false ELSE o_orderkey % 3 <> 0 END)"""


def order_table(spark, sf_dir) -> tuple[keyed.KeyedTable, keyed.State]:
    """Orders by key: two thirds of them as the base, then five deltas that write some anew and delete others."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    t = keyed.KeyedTable(spark, scratch(spark, "orders"), "orders", StructType.fromDDL("o_orderkey long, o_orderstatus string, o_totalprice double"), ("o_orderkey",))
    state = t.replaced(o.filter("o_orderkey % 3 <> 0"))
    for k in range(1, 6):
        new = o.filter(F.col("o_orderkey") % 7 == k).withColumn("o_totalprice", F.col("o_totalprice") + k)
        state = t.changed(state, new, o.filter(F.col("o_orderkey") % 11 == k))
    return t, state


@query(f"WITH {DELTAS} SELECT * FROM kept")
def orders_in_deltas(spark, sf_dir):
    t, state = order_table(spark, sf_dir)
    return t.rows(state).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"WITH {DELTAS} SELECT * FROM kept")
def orders_in_deltas_compacted(spark, sf_dir):
    t, state = order_table(spark, sf_dir)
    return t.rows(t.compacted(state, all_of_it=True)).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"""WITH {DELTAS} SELECT * FROM kept WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def orders_looked_up(spark, sf_dir):
    t, state = order_table(spark, sf_dir)
    keys = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.lookup(state, keys).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"""WITH {PROCS} SELECT id, statement, 'preference' AS type, len(kw)::BIGINT AS keywords, array_to_string(ctx, ',') AS contexts, confidence, contradictions::BIGINT AS contradictions, flagged FROM procs""")
def procedures_shown(spark, sf_dir):
    p = views.shown_procedures(procs(spark, sf_dir))
    return p.select("id", "statement", "type", F.size("trigger_keywords").cast("long").alias("keywords"), F.array_join("trigger_contexts", ",").alias("contexts"), "confidence", "contradictions", F.col("flagged_for_review").alias("flagged"))


@query(W + "SELECT id, true AS embedded, '' AS warning FROM nodes")
def nodes_embedded(spark, sf_dir):
    """All nodes of the graph put into a new store and embedded there, as their writer is told."""
    from mnemora.plans.embedding import embed_nodes
    from mnemora.store import GraphStore

    n = trade(spark, sf_dir)["nodes"]
    store = GraphStore(spark, scratch(spark, "embedded-store"))
    store.upsert(nodes=n.select("id", "label", "type"))
    return embed_nodes(store, n, vectors.mock_vectors).select("id", "embedded", "warning")


@query(W + "SELECT id FROM nodes WHERE NOT (mention_count % 3 <> 0 AND mention_count % 5 <> 0)")
def embeddings_stale(spark, sf_dir):
    """Nodes that were never embedded, or whose content has changed since."""
    n = trade(spark, sf_dir)["nodes"].select("id", F.lit("node").alias("type"), F.col("label").alias("content"), "mention_count")
    was = n.filter("mention_count % 3 <> 0").withColumn("content", F.when(F.col("mention_count") % 5 == 0, F.concat("content", F.lit(" before"))).otherwise(F.col("content")))
    return vectors.stale(n, vectors.embed(was)).select("id")


@query("""WITH f AS (SELECT doc_id, doc_id % 5 AS k FROM documents)
SELECT doc_id::VARCHAR AS file, 'Topic ' || doc_id AS text, CASE k WHEN 2 THEN 'tool' ELSE 'concept' END AS type, CASE k WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence FROM f WHERE k < 3""")
def model_answers(spark, sf_dir):
    """What a language model answers about every document, as mentions: within other words, without a confidence, of unknown kinds, broken, or out of range."""
    from mnemora.operators import extract

    d = table(spark, sf_dir, "documents")
    k, word = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    row = lambda kind, more: F.concat(F.lit('[{"text": " Topic '), word, F.lit('", "type": "' + kind + '"' + more + "}]"))
    answer = F.when(k == 0, F.concat(F.lit("Here it is:\n"), row("concept", ', "confidence": 0.9'), F.lit("\nDone."))).when(k == 1, row("concept", "")).when(k == 2, row("tool", ', "confidence": 0.6')).when(k == 3, row("mood", "")).otherwise(row("concept", ', "confidence": 7'))
    return extract.parse_model_answer(d.select(word.alias("file"), F.lit("s").alias("section"), answer.alias("answer"))).select("file", "text", "type", "confidence")


@query("""WITH d AS (SELECT doc_id::VARCHAR AS file, source AS heading, coalesce(text, '') AS c FROM documents), p AS (SELECT *, unnest(range(greatest(1, ceil(length(c) / 12000.0)::BIGINT))) AS part FROM d)
SELECT file, part::INTEGER AS part, sha256(chr(10) || chr(10) || '## ' || heading || chr(10) || substr(c, part * 12000 + 1, 12000)) AS body FROM p""")
def model_prompts(spark, sf_dir):
    """What a language model would be asked about every document, in parts that hold all of its text."""
    from mnemora.operators import extract

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit("s").alias("section"), F.col("source").alias("heading"), F.col("text").alias("content"))
    p = extract.model_prompts(d)
    return p.select("file", "part", F.sha2(F.substring(F.col("prompt"), F.locate("\n\n## ", F.col("prompt")), F.length("prompt")), 256).alias("body"))
