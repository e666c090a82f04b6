"""Helpers shared by the training-data operators.

Null texts count as empty. Rows are told apart by ``(doc_id, text fingerprint)``; rows that
repeat both are the same document and get equal results, one result row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.shared import drop_path, hadoop, kept, scratch, shared_dir, ship, small_enough, written

__all__ = ["drop_path", "hadoop", "kept", "scratch", "shared_dir", "ship", "small_enough", "written"]

#: ASCII white space: the blank and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: Catalyst does not inline what a lambda binds."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array."""
    t = F.btrim(text, F.lit(WHITE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE_RE))


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a struct of all columns: what an operator adds meets no column of the same name."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def unboxed(df: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``row`` with a new text, and n_chars to match where there is one."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns])
