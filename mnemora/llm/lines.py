"""Line dedup with overlapping three-line windows (operator 8), DataFrame functions only.

Windows are made of three consecutive units, in two readings of a text (lower-cased, white space folded to single blanks):

* lines - lines with a word, whatever their length; covered lines are removed whole;
* clauses - the text without regard to its line breaks, cut after each of ``.!?,;:`` that white space follows, so that
  passages within long lines or wrapped in another way are found too. Covered clauses that touch are one run, and a run is cut
  out of its lines where one of its windows has ``LEAST`` characters or more, without the blanks between
  clauses (three short exclamations meet by chance); line feeds stay.

Windows are known by 96 bits of hash over 64 bits of each unit. Windows found more than once anywhere are repeated; an occurrence is the first if
no other of its reading has a smaller (doc_id, text fingerprint, place), nulls before all. The units of every other
occurrence are covered; covered positions of a document are merged and removed. Each removed unit so has an equal
earlier one, and the earliest stays. A document that loses anything also loses its lines without a
word. Texts of fewer than three units of either reading are left as they are; null texts are empty;
rows that repeat a document's id and text are one document.

The units' hashes are computed once, written, and removed once the repeats are. The windows' counts are combined before the shuffle of 64 bits a window;
only rows of repeated windows are shuffled after that, by a join that Spark may split where a window is hot. Texts are
moved only if what is to be removed is too large to be broadcast (``BROADCAST_BYTES``, summed over its rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, drop_path, fingerprint, kept, let, text_of, unboxed, written

#: A clause's length counts up to LONGEST, which is more than LEAST.
SIZE, LEAST, LONGEST = 3, 80, 127
#: Bytes of removals that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: A clause with the white space after it; nothing is tried twice.
CLAUSE = r"[^.!?,;:]*+(?:[.!?,;:](?![\x20\x09-\x0D])[^.!?,;:]*+)*+(?:[.!?,;:][\x20\x09-\x0D]++)?"
#: Added to the places of lines, which so come before those of clauses.
LINES = -(1 << 30)


def _folded(text: Column) -> Column:
    """The text with its white space, but for line feeds, as single blanks; most texts are so already, which is cheaper to see than to make."""
    odd = text.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | text.contains(c)
    return F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")).otherwise(text)


def _lines(folded: Column) -> Column:
    """The lines with a word, lower-cased. folded: text whose white space other than line feeds is single blanks. Lines are lower-cased one by one, for those of ASCII alone take Spark's short way."""
    return F.filter(F.transform(F.split(folded, "\n"), lambda x: F.trim(F.lower(x))), lambda x: x != "")


def _clauses(lines: Column) -> Column:
    """The clauses of lines, which white space no longer doubles. Blanks are looked for first: most characters then cost one comparison."""
    return F.split(F.array_join(lines, " "), " (?<=[.!?,;:] )")


def _hashed(lines: Column, clauses: bool) -> Column:
    """(a, b): of each line a hash; of each clause 57 bits of hash, and in the low bits its length, or LONGEST where it is longer."""
    clause = lambda x: F.xxhash64(x).bitwiseAND(~LONGEST).bitwiseOR(F.least(F.length(x), F.lit(LONGEST)).cast("long"))
    b = F.transform(_clauses(lines), clause) if clauses else F.array().cast("array<bigint>")
    return F.struct(F.transform(lines, lambda x: F.xxhash64(x)).alias("a"), b.alias("b"))


def _windows(own: DataFrame, units: str, reading: int, first: int, long: Column) -> DataFrame:
    """(doc_id, th, at, h, g, l): the windows of an array of units, made of it and of itself shifted; hashes are computed on rows, not within arrays."""
    n = F.greatest(F.size(units) - (SIZE - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(units, i + 1, n).alias(f"u{i}") for i in range(SIZE)])
    names = [f"w.{f.name}" for f in own.select(zipped.alias("w")).schema["w"].dataType.elementType]
    rows = own.filter(F.size(units) >= SIZE).select("doc_id", "th", F.posexplode(zipped).alias("at", "w")).select("doc_id", "th", "at", *[F.col(c).alias(f"u{i}") for i, c in enumerate(names)])
    three = [F.lit(reading), *(F.col(f"u{i}") for i in range(SIZE))]
    return rows.select("doc_id", "th", (F.col("at") + first).alias("at"), F.xxhash64(*three).alias("h"), F.hash(*three).alias("g"), long.alias("l"))


def removals(docs: DataFrame, clauses: bool = True) -> DataFrame:
    """(doc_id, th, lines, clauses): places of the covered windows of each document that has any, among its lines with a word and its clauses. docs: doc_id, text, th."""
    both = let(let(let(F.col("text"), _folded), _lines), lambda x: _hashed(x, clauses))
    own, places = kept(docs.select("doc_id", "th", both.alias("w")).select("doc_id", "th", "w.a", "w.b"), "units")
    length = sum((F.col(f"u{i}").bitwiseAND(LONGEST) for i in range(1, SIZE)), F.col("u0").bitwiseAND(LONGEST))
    every = _windows(own, "a", 0, LINES, F.lit(True)).unionByName(_windows(own, "b", 1, 0, length >= LEAST))
    repeated = written(every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "repeated")
    # both sides of either join come from tables, so that Spark may split what a hot window holds
    rows = written(every.join(repeated, "h"), "occurrences")
    drop_path(docs.sparkSession, places)
    place = F.struct("doc_id", "th", "at")
    first = rows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "g", "first")
    later = rows.join(written(first, "first"), ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("at", "l"))).alias("w"))
    lines = F.transform(F.filter("w", lambda x: x["at"] < 0), lambda x: x["at"] - LINES)
    runs = F.transform(let(F.filter("w", lambda x: x["at"] >= 0), _long_runs), lambda x: x["at"])
    return gone.select("doc_id", "th", lines.alias("lines"), runs.alias("clauses")).filter((F.size("lines") > 0) | (F.size("clauses") > 0))


def _long_runs(w: Column) -> Column:
    """Of the windows (at, l) in order those whose run of touching windows has a long one."""
    first = lambda j: (j == 0) | (F.get(w, j)["at"] - F.get(w, j - 1)["at"] > SIZE)
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), first)

    def runs(s: Column) -> Column:
        each = F.transform(s, lambda j, t: F.slice(w, j + 1, F.coalesce(F.get(s, t + 1), F.size(w)) - j))
        return F.flatten(F.filter(each, lambda r: F.exists(r, lambda x: x["l"])))

    return F.when(F.size(w) == 0, w).otherwise(let(starts, runs))


def _full(line: Column) -> Column:
    """Whether a line has a word: a search that ends at the first."""
    return line.rlike(r"[^\x20\x09-\x0D]")


def _units(windows: Column) -> Column:
    """The merged places of windows' units."""
    return F.array_distinct(F.flatten(F.transform(windows, lambda k: F.sequence(k, k + SIZE - 1))))


def dedup(docs: DataFrame, text_col: str = "text", clauses: bool = True) -> DataFrame:
    """docs with struct ``d``: text (cleaned), n_lines (with a word), n_removed (lines), n_cut (clauses). clauses: whether the second reading is used."""
    text, th = text_of(docs, text_col), fingerprint(text_of(docs, text_col))
    own = docs.select("doc_id", text.alias("text")).withColumn("th", fingerprint(F.col("text")))
    gone = removals(own, clauses).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.struct(_units(F.col("lines")).alias("l"), _units(F.col("clauses")).alias("c")).alias("_drop"))
    gone = written(gone, "removals")
    moved = gone.agg(F.coalesce(F.sum(40 + 4 * (F.size("_drop.l") + F.size("_drop.c"))), F.lit(0))).first()[0]
    out = docs.join(F.broadcast(gone) if moved <= BROADCAST_BYTES else gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["_id"]) & (th == gone["_th"]), "left")
    lines = F.split(text, "\n")

    def cut(pieces: Column) -> Column:
        """The text with covered clauses left out, their line feeds kept."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("_drop.c"))
        every = F.concat(F.transform(stay, lambda i: F.struct(i.alias("i"), F.get(pieces, i).alias("p"))), F.transform("_drop.c", lambda i: F.struct(i.alias("i"), F.regexp_replace(F.get(pieces, i), "[^\n]+", "").alias("p"))))
        return F.array_join(F.transform(F.sort_array(every), lambda x: x["p"]), "")

    def cleaned(own: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: _full(F.get(own, i)))
        stay = let(full, lambda f: F.array_except(f, F.transform("_drop.l", lambda i: F.get(f, i))))
        rest = F.when(F.size("_drop.c") == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0)), cut))
        return let(F.split(rest, "\n"), lambda r: F.array_join(F.filter(F.transform(stay, lambda i: F.get(r, i)), _full), "\n"))

    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    d = F.struct(
        F.when(F.col("_drop").isNull(), text).otherwise(let(lines, cleaned)).alias("text"),
        F.size(F.filter(lines, _full)).cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), F.lit(0).cast("long")).otherwise(size("_drop.l")).alias("n_removed"),
        F.when(F.col("_drop").isNull(), F.lit(0).cast("long")).otherwise(size("_drop.c")).alias("n_cut"),
    )
    return out.withColumn("d", d).drop("_id", "_th", "_drop")


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "d.n_lines", "d.n_removed", "d.n_cut", "d.text")


def without_repeats(docs: DataFrame, clauses: bool = True) -> DataFrame:
    """docs in their own columns with repeated lines, and clauses if asked for, removed."""
    return unboxed(dedup(boxed(docs), clauses=clauses), docs.columns, F.col("d.text"))


#: The lines and clauses of table {docs} and what goes; l_all has a row for each document.
DEDUP_SQL = r"""
l_doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {docs}),
l_split AS (SELECT rid, doc_id, string_split(text, chr(10)) AS l FROM l_doc),
l_line AS (SELECT rid, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM l_split),
l_full AS (SELECT *, regexp_replace(trim(lower(line), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM l_line),
l_near AS (SELECT rid, doc_id, i, t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2
    FROM l_full WHERE t <> '' WINDOW w AS (PARTITION BY rid ORDER BY i)),
l_rank AS (SELECT rid, i, i1, i2, row_number() OVER (PARTITION BY t, t1, t2 ORDER BY doc_id, i) AS rn FROM l_near WHERE t2 IS NOT NULL),
l_gone AS (SELECT DISTINCT rid, unnest([i, i1, i2]) AS i FROM l_rank WHERE rn > 1),
l_cut AS (SELECT rid, doc_id, list_filter(regexp_extract_all(text, '(?s).*?(?:[.!?,;:][\x20\x09-\x0D]+|\z)'), lambda x: x <> '') AS c FROM l_doc),
l_piece AS (SELECT rid, doc_id, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS piece FROM l_cut),
l_clause AS (SELECT *, regexp_replace(trim(lower(piece), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM l_piece),
l_close AS (SELECT rid, doc_id, i, t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM l_clause WINDOW w AS (PARTITION BY rid ORDER BY i)),
l_order AS (SELECT rid, i, length(t) + length(t1) + length(t2) >= 80 AS long, row_number() OVER (PARTITION BY t, t1, t2 ORDER BY doc_id, i) AS rn FROM l_close WHERE t2 IS NOT NULL),
l_start AS (SELECT rid, i, long, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 3 THEN 0 ELSE 1 END AS start FROM l_order WHERE rn > 1),
l_run AS (SELECT rid, i, long, sum(start) OVER (PARTITION BY rid ORDER BY i) AS run FROM l_start),
l_long AS (SELECT rid, run FROM l_run GROUP BY rid, run HAVING bool_or(long)),
l_over AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS i FROM l_run JOIN l_long USING (rid, run)),
l_rest AS (SELECT p.rid, count(o.i) AS n_cut, string_split(string_agg(CASE WHEN o.i IS NULL THEN piece ELSE regexp_replace(piece, '[^\n]+', '', 'g') END, '' ORDER BY p.i), chr(10)) AS l
    FROM l_piece p LEFT JOIN l_over o ON p.rid = o.rid AND p.i = o.i GROUP BY p.rid),
l_left AS (SELECT f.rid, count(*) AS n_lines, count(g.i) AS n_removed, any_value(n_cut) AS n_cut,
    coalesce(string_agg(r.l[f.i], chr(10) ORDER BY f.i) FILTER (g.i IS NULL AND regexp_matches(r.l[f.i], '[^\x20\x09-\x0D]')), '') AS clean
    FROM l_full f JOIN l_rest r ON r.rid = f.rid LEFT JOIN l_gone g ON f.rid = g.rid AND f.i = g.i WHERE t <> '' GROUP BY f.rid),
l_all AS (SELECT d.rid, doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_cut, 0)::BIGINT AS n_cut,
    CASE WHEN coalesce(n_removed, 0) + coalesce(n_cut, 0) = 0 THEN text ELSE clean END AS clean FROM l_doc d LEFT JOIN l_left USING (rid))
"""
SQL = "WITH " + DEDUP_SQL.replace("{docs}", "documents") + "SELECT doc_id, n_lines, n_removed, n_cut, clean AS text FROM l_all"
