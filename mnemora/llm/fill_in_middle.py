"""Fill-in-the-middle transformation by rank and select over code point boundaries (operator 11).

The UTF-8 bytes of a slice of texts carry one bit each, set where a code point begins, packed into
words with a directory of counts. The difference of two ranks is a text's number of code points n;
selecting the rank of its first byte plus a cut gives the byte to cut at, for all texts of the slice
at once. Nothing is decoded, shuffled or kept between slices: memory is one Arrow batch and one slice.

Where to cut and which form to take are drawn from the SHA-256 of ``seed:doc_id``, so they are the
same on any worker and when a task is repeated.

Defined cases: a null text is empty; an empty text, or one with any of the sentinels, stays plain;
a null id draws as if it were the empty string; rows that repeat give repeated results; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, ship, text_of

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of texts transformed, and of those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SLICE_BYTES = 8 << 20


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four unsigned numbers of 32 bits for each document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _slices(offsets, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes, or of one row."""
    import numpy as np

    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def transform(docs: DataFrame, seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null where plain) and output, the text as it is trained on."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", text_of(docs).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(docs["doc_id"], seed))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from mnemora.llm.succinct import BitVector

        p, s, m = (x.encode() for x in sentinels)
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            text = batch.column(1)
            width = np.int64 if pa.types.is_large_string(text.type) else np.int32
            places = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for a, b in _slices(places, slice_bytes):
                first, at = places[a], places[a : b + 1] - places[a]
                raw = data[first : places[b]]
                bits = BitVector((raw & 0xC0) != 0x80)
                ranks = bits.rank(at)
                n = ranks[1:] - ranks[:-1]
                part = batch.slice(a, b - a)
                h = [part.column(2 + i).to_numpy() for i in range(4)]
                x, y = h[0] % (n + 1), h[1] % (n + 1)
                low, high = np.minimum(x, y), np.maximum(x, y)
                # the end of a text is the start of the next one, or of nothing
                cut_1, cut_2 = bits.select(ranks[:-1] + low), bits.select(ranks[:-1] + high)
                marked = np.zeros(b - a, bool)
                for one in sentinels:
                    marked |= pc.match_substring(part.column(1), one).to_numpy(zero_copy_only=False)
                plain = (n == 0) | marked | (h[2] % 100 >= rate)
                spm = h[3] % 100 < suffix_first
                view, out = memoryview(raw), []
                for k in range(b - a):
                    start, end = at[k], at[k + 1]
                    if plain[k]:
                        out.append(bytes(view[start:end]))
                        continue
                    prefix, middle, suffix = view[start : cut_1[k]], view[cut_1[k] : cut_2[k]], view[cut_2[k] : end]
                    out.append(b"".join((s, suffix, p, prefix, m, middle) if spm[k] else (p, prefix, s, suffix, m, middle)))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                columns = [part.column(0), pa.array(n), pa.array(form, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return own.mapInArrow(run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text that an output was made of. A sentinel neither begins nor ends within another, and no part of the text holds one, so the first of each is the one set."""
    p, s, m = sentinels

    def pieces(first: str, second: str, back: bool) -> Column:
        def cut(out: Column) -> Column:
            i, j = F.locate(second, out), F.locate(m, out)
            one = F.substr(out, F.lit(len(first) + 1), i - len(first) - 1)
            two = F.substr(out, i + len(second), j - i - len(second))
            return F.concat(two if back else one, F.substr(out, j + len(m)), one if back else two)

        return let(output, cut)

    return F.when(form == "plain", output).when(form == "psm", pieces(p, s, False)).otherwise(pieces(s, p, True))


def report(docs: DataFrame) -> DataFrame:
    """A row for each document: n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    out = transform(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (
  SELECT doc_id, text, length(text) AS n,
         ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2, ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4
  FROM d),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""
