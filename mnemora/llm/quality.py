"""Line-first quality rules (operator 2), DataFrame functions only.

Every line with a word is held against three rules; a line that breaks one is removed, and a
document that loses more than half of the characters of its words is rejected:

* punctuation - a line of fewer than 20 words does not end in closing punctuation (a longer one may be
  prose that was cut), or a line has a symbol of ``#*$%&|<>`` or an exclamation mark for every
  other word or more;
* navigation - four or more separators ``| » › • · →`` between its words;
* boilerplate - at most 30 words, among them a phrase of the list below.

All is computed within the row: no shuffle, no Python. Three-word windows are compared by
64-bit hashes within one document. Null text counts as empty: no words, ``base_failed``, not kept.
Repeated rows give repeated results; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, boxed, let, text_of, unboxed, words_of

#: Phrases of page furniture.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript",
    "subscribe to", "sign up", "click here", "read more", "log in", "skip to content",
)
BOILERPLATE_RE = "(?i)(" + "|".join(BOILERPLATE) + ")"
CLOSING = ".!?:;,\"')]…”»。！？"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·→"
SHORT = 20


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, WHITE, ""))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line with words breaks a rule."""
    n = F.size(words)
    closing = F.instr(F.lit(CLOSING), F.right(F.element_at(words, -1), F.lit(1))) > 0
    noisy = 2 * count_chars(line, SYMBOLS + "!") >= n
    nav = count_chars(line, SEPARATORS) >= 4
    return (~closing & (n < SHORT)) | noisy | nav | ((n <= 30) & line.rlike(BOILERPLATE_RE))


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more in the array."""

    def marked(h: Column) -> Column:
        # sorted by (hash, place): equal windows stand side by side
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            n = F.size(s)
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            dup = F.filter(s, lambda x, j: F.coalesce((j > 0) & same(j - 1, j), F.lit(False)) | F.coalesce((j < n - 1) & same(j, j + 1), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(dup, lambda x: F.sequence(x["i"], x["i"] + (size - 1))))))

        return let(pairs, covered)

    def windows(wh: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(wh) - size), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(size)]))

    def count(wh: Column) -> Column:
        return let(windows(wh), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))

    return F.when(F.size(words) < size, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), count))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df and a struct ``q``: counts, base_failed, kept, the cleaned text and the characters it lost."""
    text = text_of(df, text_col)

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_window_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        """Of lines with their words, which are split once: the counts of all words, and the judged lines."""
        full = F.transform(F.filter(lines, lambda x: F.size(x["w"]) > 0), lambda x: x["line"])
        judged = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.when(F.size(x["w"]) == 0, F.lit(False)).otherwise(line_fails(x["line"], x["w"])).alias("bad")))
        return F.struct(
            let(F.flatten(F.transform(lines, lambda x: x["w"])), of_words).alias("words"),
            let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            let(judged, lambda j: F.struct(
                F.aggregate(F.filter(j, lambda x: x["bad"]), F.lit(0).cast("long"), lambda a, x: a + word_chars(x["line"])).alias("lost"),
                F.array_join(F.transform(F.filter(j, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("text"),
            )).alias("c"),
        )

    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("w")))
    out = df.withColumn("_l", let(lines, of_lines))
    n, chars = F.col("_l.words.n_words"), word_chars(text).cast("long")
    failed = (n < 50) | (100 * F.col("_l.words.n_repeat_words") > 50 * n)
    q = F.struct(
        n.alias("n_words"), chars.alias("word_chars"), count_chars(text, SYMBOLS).cast("long").alias("n_symbols"), F.col("_l.n_dup_lines").alias("n_dup_lines"),
        F.col("_l.words.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"), F.col("_l.c.lost").alias("lost_chars"), F.col("_l.c.text").alias("text"),
    )
    out = out.withColumn("q", q).drop("_l")
    return out.withColumn("q", F.col("q").withField("kept", ~F.col("q.base_failed") & (2 * F.col("q.lost_chars") <= F.col("q.word_chars"))))


def verdicts(docs: DataFrame) -> DataFrame:
    q = measure(docs.select("doc_id", "text"))
    return q.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of docs."""
    kept = F.when(F.col("q.kept"), F.array(F.struct("row", F.col("q.text").alias("text"))))
    # a generator drops the rejected rows; a filter would be pushed down and compute the rules twice
    return unboxed(measure(boxed(docs)).select(F.explode(kept).alias("x")).select("x.row", "x.text"), docs.columns, F.col("text"))


_PHRASES = "|".join(BOILERPLATE)
_CLOSING_SQL = CLOSING.replace("'", "''")
#: Shared by the query's SQL and the pipeline's: the judged lines of table {docs}, then per-document counts.
MEASURE_SQL = r"""
q_text AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {docs}),
q_words AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM q_text),
q_pos AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM q_words WHERE len(w) >= 3),
q_win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM q_pos),
q_rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM q_win, range(0, 3) t(k) WHERE c > 1 GROUP BY rid),
q_split AS (SELECT rid, string_split(text, chr(10)) AS l FROM q_text),
q_line AS (SELECT rid, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM q_split),
q_full AS (SELECT rid, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM q_line),
q_judged AS (SELECT *, n > 0 AND ((n < 20 AND strpos('{closing}', right(t, 1)) = 0)
    OR 2 * (length(line) - length(translate(line, '#*$%&|<>!', ''))) >= n
    OR length(line) - length(translate(line, '|»›•·→', '')) >= 4
    OR (n <= 30 AND regexp_matches(line, '(?i)({phrases})'))) AS bad FROM q_full),
q_lines AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
    coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (bad), 0)::BIGINT AS lost_chars,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') AS clean FROM q_judged GROUP BY rid),
q_counts AS (SELECT t.rid, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, lost_chars, clean
    FROM q_text t JOIN q_words USING (rid) JOIN q_lines USING (rid) LEFT JOIN q_rep r USING (rid)),
q_base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q_counts),
q_all AS (SELECT *, NOT base_failed AND 2 * lost_chars <= word_chars AS kept FROM q_base)
""".replace("{closing}", _CLOSING_SQL).replace("{phrases}", _PHRASES)
SQL = "WITH " + MEASURE_SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars FROM q_all
"""
