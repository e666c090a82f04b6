"""N-gram Jaccard join with token-group matrices (operator 3).

A document's set holds the 64-bit hashes of its distinct word shingles; documents link when
``100 * intersection >= percent * union``, and the join gives the components of the links. No link
between different sets is lost, and copies are never paired: documents of equal sets are one class.

1. Sieve. Every class's tokens below a fixed hash bound (a share of the hash range) are dealt by token.
   A token in one class only cannot be shared; a class with more such tokens than a link leaves
   room for has no link. This needs no order and drops most classes.
2. Groups. The remaining classes are partitioned by the token they share with most others, large groups
   further by hash, to at most some ``GROUP`` classes or ``GROUP_TOKENS`` tokens. Pairs inside a group are compared at once.
3. Matrix. Tokens are ordered by rarity among the remaining classes. Linked classes share ``OVERLAP`` tokens
   (all they need, where that is less) of their prefixes in this order, which are so many tokens longer than what a
   link may leave unmatched. The matrix stores for each group the union of its members' prefixes, by token; a query's
   overlap with the unions is summed over its own prefix, and it is sent only to groups that it overlaps in so many
   tokens. There the group is opened only if the overlap with the union of all its tokens allows a link, and then
   only members of fitting size are compared.
4. Rounds. First the queries are central members of groups, one for each token of the matrix, and the
   components found are contracted. Then every class queries those groups that hold a larger component
   than its own. A family of near copies has few groups and is mostly one component after the
   first round, so it costs some queries a straggler, not all pairs.

Rules for rows: null text, or text without a word, is the empty set, linked with nothing
(component_id is its doc_id); repeated rows belong to one class; null ids are ignored for the smallest id
of a component unless it has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.operators.components import contract

from .common import fingerprint, ship, small_enough, text_of, written

WORDS, PERCENT = 4, 85
GROUP, GROUP_TOKENS = 512, 400_000
#: Queries compared with a group in one task.
QUERIES = 512
#: Prefix tokens that a query must share with a group's union.
OVERLAP = 3
BROADCAST_ROWS = 300_000
#: Characters of text hashed at once.
BATCH_CHARS = 4_000_000
FULL = (1 << 64) - 1


def shingle_sets(texts: list[str], size: int) -> list:
    """For each text the sorted distinct 64-bit hashes of its word shingles; a shorter text is one shingle of all its words."""
    import numpy as np

    from .words import mix, word_hashes

    w, n = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    h = np.full(len(w), size, np.uint64)
    for i in range(size):  # the shingle that starts at each word; those that cross a text's end are not read
        m = max(0, len(w) - i)
        h[:m] = (h[:m] ^ w[len(w) - m :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h = mix(h)
    out, at = [], 0
    for k in n.tolist():
        if k >= size:
            out.append(np.unique(h[at : at + k - size + 1]))
        elif k:
            own = np.uint64(k)
            for x in w[at : at + k]:
                own = mix(np.array([own ^ x]))[0]
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += k
    return out


def _mix(h, k: int):
    import numpy as np

    h = (h ^ (h >> np.uint64(29))) * np.uint64(k)
    return h ^ (h >> np.uint64(32))


def _share(percent: int) -> float:
    """Share of the tokens that the sieve reads: more than a link may leave unmatched, with room for chance."""
    return min(1.0, 1.7 * (100 - percent) / 100)


def _signature(h) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    import numpy as np

    return tuple(int(_mix(h, k).sum(dtype=np.uint64).astype(np.int64)) for k in (0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _slices(batches: Iterator) -> Iterator:
    """Batches of at most some BATCH_CHARS of text, or of one row."""
    import pyarrow.compute as pc

    for batch in batches:
        first, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
            if i > first and size + n > BATCH_CHARS:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n
        if batch.num_rows > first:
            yield batch.slice(first)


def sketches(docs: DataFrame, size: int, percent: int, all_tokens: bool = False) -> DataFrame:
    """(doc_id, th, n, s1, s2, tokens) per row of docs (doc_id, th, text); tokens of the sieve or all, as signed numbers."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bound = int(_share(percent) * FULL)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in _slices(batches):
            n, s1, s2, parts, ends = [], [], [], [], [0]
            for h in shingle_sets(batch.column(2).to_pylist(), size):
                a, b = _signature(h)
                own = h if all_tokens else h[: np.searchsorted(h, np.uint64(bound), "right")]
                n.append(len(h))
                s1.append(a)
                s2.append(b)
                parts.append(own.view(np.int64))
                ends.append(ends[-1] + len(own))
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), tokens]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "s1", "s2", "tokens"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {id_type}, th long, n long, s1 long, s2 long, tokens array<long>")


def _needed(n: Column, percent: int) -> Column:
    """The least intersection of a set of n with any set it links with."""
    return F.ceil(n * percent / F.lit(100.0) - 1e-9).cast("long")


def sieve(marks: DataFrame, percent: int) -> DataFrame:
    """The classes (s1, s2, rep: one of its rows) that may have a link. marks: sketches with sieve tokens."""
    classes = marks.filter("n > 0").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min(F.struct("doc_id", "th")).alias("rep"))
    # node: 64 bits are enough here, for classes that meet by chance only pass more often
    dealt = classes.select(F.col("s1").alias("node"), F.explode("tokens").alias("token"))
    # counts are combined before they are dealt, and a join may be split where a token is hot
    common = dealt.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    shared = dealt.join(common, "token").groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    sizes = marks.filter("n > 0").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first(F.size("tokens")).alias("read"), F.min(F.struct("doc_id", "th")).alias("rep"))
    joined = sizes.join(shared, sizes["s1"] == shared["node"], "left")
    alone = F.col("read") - F.coalesce("m", F.lit(0))
    return joined.filter(alone <= F.col("n") - _needed(F.col("n"), percent)).select("s1", "s2", "rep")


def _pairs(member_sets: list, query_sets: list):
    """Matrix of intersection sizes of two lists of sorted token arrays, in blocks of tokens."""
    import numpy as np

    sides, rows = [*member_sets, *query_sets], len(member_sets)
    flat = np.concatenate(sides) if sides else np.empty(0, np.int64)
    who = np.repeat(np.arange(len(sides)), [len(s) for s in sides])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    edge = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(edge) - 1
    count = np.bincount(col)
    keep = count[col] > 1
    who, col = who[keep], col[keep]
    out = np.zeros((rows, len(query_sets)), np.int64)  # a block's counts are exact as floats, sums of blocks need not be
    if len(col):
        col = np.cumsum(np.concatenate([[0], col[1:] != col[:-1]]))
        width = max(1, 16_000_000 // (4 * len(sides)))
        for c in range(0, int(col[-1]) + 1, width):
            lo, hi = np.searchsorted(col, [c, c + width])
            m = np.zeros((len(sides), min(width, int(col[-1]) + 1 - c)), np.float32)
            m[who[lo:hi], col[lo:hi] - c] = 1
            out += (m[:rows] @ m[rows:].T).astype(np.int64)
    return out


def _within(table, percent: int):
    """Members of one group with their local component (its smallest member) and the most central member marked."""
    import numpy as np
    import pyarrow as pa

    sets = [np.asarray(x.values) for x in table.column("tokens").combine_chunks()]
    n = np.array([len(s) for s in sets])
    inter = _pairs(sets, sets)
    linked = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
    names = list(zip(table.column("s1").to_pylist(), table.column("s2").to_pylist(), strict=True))
    comp = np.arange(len(sets))
    for i in range(len(sets)):
        for j in np.flatnonzero(linked[i, :i]):
            a, b = comp[i], comp[j]
            if a != b:
                comp[comp == a] = b
    first = {}
    for i, c in enumerate(comp):
        first[c] = min(first.get(c, names[i]), names[i])
    central = int(np.argmax((inter / np.maximum(1, n[:, None])).sum(axis=1) - 1e-6 * np.arange(len(sets)))) if len(sets) else 0
    l1, l2 = [first[c][0] for c in comp], [first[c][1] for c in comp]
    out = table.select(["key", "lot", "s1", "s2", "n", "tokens"])
    reach = linked.sum(axis=1).tolist()
    for name, values, kind in (("l1", l1, pa.int64()), ("l2", l2, pa.int64()), ("central", [i == central for i in range(len(sets))], pa.bool_()), ("reach", reach, pa.int64())):
        out = out.append_column(name, pa.array(values, kind))
    return out


def _opened(members, queries, percent: int):
    """Links between the local components of queries and those of a group's members, as pairs of labels."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("a1", pa.int64()), ("a2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64())])
    if not members.num_rows or not queries.num_rows:
        return schema.empty_table()
    own = [np.asarray(x.values) for x in members.column("tokens").combine_chunks()]
    asked = [np.asarray(x.values) for x in queries.column("tokens").combine_chunks()]
    union = np.unique(np.concatenate(own))
    sizes = np.array([len(s) for s in own])
    names = [(members.column("l1")[i].as_py(), members.column("l2")[i].as_py()) for i in range(len(own))]
    labels = [(queries.column("l1")[i].as_py(), queries.column("l2")[i].as_py()) for i in range(len(asked))]
    open_for = []
    for j, q in enumerate(asked):
        hit = np.searchsorted(union, q)
        hit[hit == len(union)] = 0
        if 100 * int((union[hit] == q).sum()) >= percent * len(q) and 100 * sizes.max() >= percent * len(q) and 100 * len(q) >= percent * sizes.min():
            open_for.append(j)
    found = set()
    if open_for:
        inter = _pairs(own, [asked[j] for j in open_for])
        n = np.array([len(asked[j]) for j in open_for])
        for i, j in zip(*np.nonzero(100 * inter >= percent * (sizes[:, None] + n[None, :] - inter)), strict=True):
            a, b = labels[open_for[j]], names[i]
            if a != b:
                found.add((a, b))
    rows = [(*a, *b) for a, b in found]
    return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], schema=schema)


MEMBER = "key long, lot long, s1 long, s2 long, n long, tokens array<long>, l1 long, l2 long, central boolean, reach long"


def _label(a: Column, b: Column) -> Column:
    return F.struct(a.alias("x"), b.alias("y"))


def _asked(members: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Links (a, b: labels) of the wanted (s1, s2; key, lot) pairs of querying members and groups."""
    wanted = written(wanted, "wanted")
    chunks = wanted.groupBy("key", "lot").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks"))
    columns = ["key", "lot", "chunk", "tokens", "l1", "l2"]
    sides = members.join(chunks, ["key", "lot"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(*columns, F.lit(False).alias("asks"))
    sent = wanted.join(chunks, ["key", "lot"]).withColumn("chunk", F.pmod(F.xxhash64("s1", "s2"), F.col("chunks")))
    sent = sent.join(members.select("s1", "s2", "tokens", "l1", "l2"), ["s1", "s2"]).select(*columns, F.lit(True).alias("asks"))

    def compare(table):
        asks = table.column("asks")
        import pyarrow.compute as pc

        return _opened(table.filter(pc.invert(asks)), table.filter(asks), percent)

    links = sides.unionByName(sent).groupBy("key", "lot", "chunk").applyInArrow(compare, "a1 long, a2 long, b1 long, b2 long")
    return links.distinct().select(_label(F.col("a1"), F.col("a2")).alias("a"), _label(F.col("b1"), F.col("b2")).alias("b"))


def _linked(classes: DataFrame, percent: int) -> DataFrame:
    """(s1, s2, root) of the classes (s1, s2, n, tokens: all) that have links; root names the component."""
    # rarity among the classes, and each one's prefix without tokens of its own
    t = classes.select("s1", "s2", F.explode("tokens").alias("token"))
    rare = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = t.join(rare, "token").groupBy("s1", "s2").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    both = classes.join(known, ["s1", "s2"]).filter(F.size("shared") >= _needed(F.col("n"), percent))
    # prefix length less the tokens of its own: of a link's common tokens, the first OVERLAP have all the others after them
    room = F.greatest(F.lit(0), F.size("shared") - _needed(F.col("n"), percent) + F.least(F.lit(OVERLAP), _needed(F.col("n"), percent))).cast("int")
    alive = written(both.select("s1", "s2", "n", "tokens", F.transform(F.slice("shared", 1, room), lambda x: x["token"]).alias("prefix"), F.element_at("shared", -1)["token"].alias("key")), "alive")

    # groups
    count = alive.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / GROUP_TOKENS)).alias("lots")).filter("lots > 1")
    if small_enough(count, BROADCAST_ROWS):
        count = F.broadcast(count)
    dealt = alive.join(count, "key", "left").withColumn("lot", F.pmod(F.xxhash64("s1", "s2"), F.coalesce("lots", F.lit(1).cast("long"))))
    members = dealt.select("key", "lot", "s1", "s2", "n", "tokens").groupBy("key", "lot").applyInArrow(lambda x: _within(x, percent), MEMBER)
    members = written(members, "members")
    overlap = lambda pairs: pairs.groupBy("s1", "s2", "n", "key", "lot").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= F.least(F.lit(OVERLAP), _needed(F.col("n"), percent))).select("s1", "s2", "key", "lot")
    home = members.select("s1", "s2", "n", "key", "lot", _label(F.col("l1"), F.col("l2")).alias("label"), "central", "reach")
    prefixes = written(alive.select("s1", "s2", F.explode("prefix").alias("token")).join(home, ["s1", "s2"]), "prefixes")

    # first round: of the central members that have a token, the one with the most links in its group asks all groups that have it
    ask = prefixes.filter("central").groupBy("token").agg(F.max(F.struct("reach", "s1", "s2", "n", F.col("key").alias("k"), F.col("lot").alias("l"))).alias("q")).select("token", "q.*")
    matrix = written(prefixes.select("token", "key", "lot").distinct(), "matrix")
    wanted = overlap(ask.join(matrix, "token").filter("k <> key or l <> lot"))
    inside = members.filter("l1 <> s1 or l2 <> s2").select(_label(F.col("s1"), F.col("s2")).alias("a"), _label(F.col("l1"), F.col("l2")).alias("b"))
    first = written(inside.unionByName(_asked(members, wanted, percent)), "first")
    roots = contract(first, least=False)

    # second round: whoever is not in the largest component that a group has asks it
    named = home.join(roots, home["label"] == roots["node"], "left").withColumn("root", F.coalesce("root", "label")).drop("node")
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    ranks = written(named.join(sizes, "root").select("s1", "s2", F.struct("size", "root").alias("rank")), "ranks")
    ranked = written(prefixes.select("token", "s1", "s2", "n", "key", "lot").join(ranks, ["s1", "s2"]), "ranked")
    most = ranked.groupBy("token").agg(F.max("rank").alias("most"))
    asks = ranked.join(most, "token").filter("rank < most").select("token", "s1", "s2", "n", "rank", F.col("key").alias("k"), F.col("lot").alias("l"))
    holds = ranked.groupBy("token", "key", "lot").agg(F.max("rank").alias("held"))
    wanted = overlap(asks.join(holds, "token").filter("rank < held and (k <> key or l <> lot)"))
    roots = contract(first.unionByName(_asked(members, wanted, percent)), least=False)
    return members.select("s1", "s2", _label(F.col("s1"), F.col("s2")).alias("node")).join(roots, "node").select("s1", "s2", "root")


def components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, th, n_shingles, component_id, is_first (whether the row is the one of its component with the least (doc_id, th))."""
    own = docs.select("doc_id", text_of(docs).alias("text")).withColumn("th", fingerprint(F.col("text")))
    marks = written(sketches(own, size, percent), "sketches")
    left = written(sieve(marks, percent), "sieved")
    rep = left.select(F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th"))
    few = small_enough(left, BROADCAST_ROWS)
    rep = F.broadcast(rep) if few else rep.hint("shuffle_hash")
    texts = own.join(rep, own["doc_id"].eqNullSafe(rep["_id"]) & (own["th"] == rep["_th"]), "left_semi").dropDuplicates(["doc_id", "th"])
    classes = written(sketches(texts, size, percent, all_tokens=True).select("s1", "s2", "n", "tokens").dropDuplicates(["s1", "s2"]), "classes")
    linked = _linked(classes, percent)
    held = marks.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("rep"))
    held = written(held.join(linked, ["s1", "s2"], "left"), "held")
    linked = held.filter("root is not null")
    tops = written(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.min("rep").alias("top")), "tops")
    # a component may hold a large share of the classes: its one row is broadcast, or joined by a join that may be split
    linked = linked.join(F.broadcast(tops) if small_enough(tops, BROADCAST_ROWS) else tops, "root").select("s1", "s2", "component_id", "top")
    placed = written(linked.unionByName(held.filter("root is null").select("s1", "s2", F.col("least").alias("component_id"), F.col("rep").alias("top"))), "placed")
    base = marks.select("doc_id", "th", F.col("n").alias("n_shingles"), "s1", "s2")
    out = base.join(placed, ["s1", "s2"], "left")
    alone = F.col("n_shingles") == 0
    is_first = alone | F.col("top").eqNullSafe(F.struct("doc_id", "th"))
    return out.select("doc_id", "th", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), is_first.alias("is_first"))


def report(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (the one with the least (doc_id, text fingerprint); repeated rows count once), in the columns of docs."""
    gone = components(docs, size, percent).filter(~F.col("is_first")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    gone = written(gone, "copies").hint("shuffle_hash")
    th = fingerprint(text_of(docs))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (th == gone["_th"]), "left_anti")


SQL = r"""
WITH RECURSIVE j_doc AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
j_pos AS (SELECT rid, w, least(4, len(w)) AS k, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM j_doc WHERE len(w) > 0),
j_set AS (SELECT DISTINCT rid, array_to_string(w[i:i + k - 1], ' ') AS g FROM j_pos),
j_size AS (SELECT rid, count(*) AS n FROM j_set GROUP BY rid),
j_pair AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM j_set a JOIN j_set b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
j_link AS (SELECT x, y FROM j_pair JOIN j_size s ON s.rid = x JOIN j_size t ON t.rid = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
j_both AS (SELECT x, y FROM j_link UNION ALL SELECT y, x FROM j_link),
j_reach AS (SELECT rid AS x, rid AS y FROM j_doc UNION SELECT r.x, b.y FROM j_reach r JOIN j_both b ON b.x = r.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM j_doc d JOIN j_reach r ON r.x = d.rid JOIN j_doc e ON e.rid = r.y LEFT JOIN j_size s ON s.rid = d.rid GROUP BY d.rid, d.doc_id, n
"""
