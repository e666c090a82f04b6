"""Benchmark decontamination by winnowing (operator 10), DataFrame functions only.

A document word is hit when it lies inside an occurrence of a window: 13 consecutive words of a
benchmark item, or the whole item where it has fewer (but some) words.

Winnowing keeps, of every 6 consecutive 8-gram hashes, the smallest. 6 + 8 - 1 = 13, so every window of 13 words has one
fingerprint, the smallest of its 6, and any shared span of 13 words shares it. An item shorter than 13 words has one
fingerprint, the hash of all its words, which is held against the documents' grams of its length (at most 12 lengths, in the same pass).

1. One pass over all documents joins their fingerprints with the items'; the documents that share one are touched.
2. A shared fingerprint is extended to the window around it: the touched documents' windows, each with its fingerprint and the hash of
   all its words, are joined with the items' windows by both. What matches are hits; overlapping ones make the shared spans.

A window meets an item once however often the item repeats it, so the work grows with the words of both, also where texts repeat themselves.
The items' windows (a few numbers each) are broadcast only if a count proves them few (``BROADCAST_ROWS``); beyond that the same joins are
shuffled. Documents' fingerprints are never gathered: they stream through the join and only hits remain. Null texts have no
words; null ids are ordinary values; items of equal words are compared once, item rows that repeat count once; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fingerprint, let, small_enough, text_of, written

WINDOW, GRAM = 13, 8
SPAN = WINDOW - GRAM + 1
#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 500_000
SPLIT_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same with A-Z, for texts that are not lower-cased.
EITHER_RE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column, pattern: str) -> Column:
    """The parts between separators; one at either end leaves an empty string there, and nowhere else, which is cut off."""

    def inner(p: Column) -> Column:
        lead = (F.get(p, F.lit(0)) == "").cast("int")
        n = F.size(p) - lead - (F.element_at(p, -1) == "").cast("int")
        return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.slice(p, lead + 1, F.greatest(n, F.lit(0))))

    return let(F.split(text, pattern), inner)


def tokens(text: Column) -> Column:
    """Words of lower-cased (A-Z) text; an array without empty strings."""
    # of ASCII alone both give the same, and lower is faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return _split(low, SPLIT_RE)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(wh: Column, n: int) -> Column:
    """Hashes of the n-grams of word hashes; none where there are fewer words."""
    return F.when(F.size(wh) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(wh) - n), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(n)]))
    )


def _minima(h: Column, span: int = SPAN) -> Column:
    """The smallest hash of each run of span hashes."""
    return F.when(F.size(h) < span, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - span), lambda i: F.least(*[F.get(h, i + k) for k in range(span)]))
    )


def fingerprints(words: Column, short: list[int] | None = None) -> Column:
    """The distinct winnowed 8-gram hashes of an array of words, and its distinct grams of the short lengths."""

    def own(wh: Column) -> Column:
        every = [let(_grams(wh, GRAM), lambda g: _minima(g)), *(_grams(wh, n) for n in short or [])]
        return F.array_distinct(F.concat(*every) if short else every[0])

    return let(_hashes(words), own)


def _windows(words: Column, long: bool, short: list[int]) -> Column:
    """(fp, wh, i, n): the windows of 13 words of an array of words, and its grams of the short lengths, with fingerprint, hash, place (0-based) and length."""
    one = lambda fp, h, i, n: F.struct(fp.alias("fp"), h.alias("wh"), i.alias("i"), F.lit(n).alias("n"))

    def of(wh: Column) -> Column:
        least = lambda g, i: F.least(*[F.get(g, i + k) for k in range(SPAN)])
        own = [let(_grams(wh, GRAM), lambda g: F.transform(_grams(wh, WINDOW), lambda h, i: one(least(g, i), h, i, WINDOW)))] if long else []
        whole = lambda n: F.transform(_grams(wh, n), lambda h, i: one(h, h, i, n))
        return F.concat(*own, *[whole(n) for n in short])

    return let(_hashes(words), of)


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, cid, v): the words of each item that has any; items of equal words have one cid."""
    w = benchmark.select("item_id", tokens(text_of(benchmark)).alias("v")).filter(F.size("v") > 0)
    return w.withColumn("cid", F.sha2(F.array_join("v", " "), 256)).distinct()


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, th, cid, i, n): the places and lengths of windows of items in documents. docs: doc_id, text, th; items: cid, v, distinct."""
    size = F.size("v")
    short = sorted(r["n"] for r in items.select(size.alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # at most 12 numbers
    own_windows = F.when(size >= WINDOW, _windows(F.col("v"), True, []))
    for n in short:
        own_windows = own_windows.when(size == n, _windows(F.col("v"), False, [n]))
    prints = items.select("cid", F.explode(own_windows).alias("p")).select("cid", "p.fp", "p.wh", "p.n").distinct()
    prints = written(prints, "prints")
    few = small_enough(prints, BROADCAST_ROWS)

    base = docs.select("doc_id", "th", "text")
    own = base.select("doc_id", "th", F.explode(fingerprints(tokens(F.col("text")), short)).alias("fp"))
    touched = written(own.join(_small(prints.select("fp").distinct(), few), "fp", "left_semi").select("doc_id", "th").distinct(), "touched")

    pick = _small(touched, small_enough(touched, BROADCAST_ROWS))
    same = base["doc_id"].eqNullSafe(pick["doc_id"]) & (base["th"] == pick["th"])
    hit = base.join(pick, same, "left_semi").dropDuplicates(["doc_id", "th"])
    windows = hit.select("doc_id", "th", F.explode(_windows(tokens(F.col("text")), True, short)).alias("g")).select("doc_id", "th", "g.*")
    return windows.join(_small(prints, few), ["fp", "wh", "n"]).select("doc_id", "th", "cid", "i", "n")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated."""
    own = docs.select("doc_id", text_of(docs).alias("text")).withColumn("th", fingerprint(F.col("text")))
    named = written(item_words(benchmark), "items")
    hits = written(occurrences(own, named.select("cid", "v").distinct()), "hits")
    places = F.transform(F.collect_set(F.struct("i", "n")), lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1))
    words = hits.groupBy("doc_id", "th").agg(F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_hit"))
    ids = hits.select("doc_id", "th", "cid").distinct().join(named.select("cid", F.col("item_id").cast("string").alias("i")).distinct(), "cid")
    ids = ids.groupBy("doc_id", "th").agg(F.collect_set("i").alias("items"))
    ids = ids.select(F.col("doc_id").alias("_i"), F.col("th").alias("_h"), "items")
    r = words.join(ids, words["doc_id"].eqNullSafe(ids["_i"]) & (words["th"] == ids["_h"])).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_hit", "items")
    counted = own.select("doc_id", "th", F.size(_split(F.col("text"), EITHER_RE)).cast("long").alias("n_words"))
    out = counted.join(r, counted["doc_id"].eqNullSafe(r["_id"]) & (counted["th"] == r["_th"]), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("th")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, in the columns of docs."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    bad = written(bad, "contaminated")
    bad = _small(bad, small_enough(bad, BROADCAST_ROWS))
    th = fingerprint(text_of(docs))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (th == bad["_th"]), "left_anti")


#: Windows and hits of tables {docs} and benchmark; c_doc has a row for each document.
HITS_SQL = r"""
c_item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
c_ipos AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM c_item WHERE len(w) > 0),
c_win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM c_ipos),
c_len AS (SELECT DISTINCT n FROM c_win),
c_doc AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {docs}),
c_pos AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM c_doc, c_len WHERE len(w) >= n),
c_gram AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM c_pos),
c_hit AS (SELECT rid, i, g.n, item_id FROM c_gram g JOIN c_win USING (n, gram)),
c_word AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM c_hit, range(0, 13) t(k) WHERE k < n GROUP BY rid),
c_items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM c_hit GROUP BY rid),
c_all AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM c_doc d LEFT JOIN c_word USING (rid) LEFT JOIN c_items USING (rid))
"""
SQL = "WITH " + HITS_SQL.replace("{docs}", "documents") + "SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM c_all"
