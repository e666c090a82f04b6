"""Learned procedures: listing and matching to a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.dates import days_between, instant


def listed(procedures: DataFrame, kind: str | None = None, confidence: float | None = None, flagged: bool | None = None, keyword: str | None = None, context: str | None = None) -> DataFrame:
    """Procedures by filters, the most confident first; a keyword (part of a trigger) takes the place of a context (equal to one)."""
    p = procedures
    if kind:
        p = p.filter(F.col("type") == kind)
    if confidence is not None:
        p = p.filter(F.col("confidence") >= confidence)
    if flagged is not None:
        p = p.filter(F.col("flagged_for_review") == flagged)
    if keyword:
        p = p.filter(F.exists("trigger_keywords", lambda k: F.lower(k).contains(keyword.lower())))
    elif context:
        p = p.filter(F.exists("trigger_contexts", lambda c: F.lower(c) == context.lower()))
    return p.orderBy(F.desc("confidence"), "id")


def merged(own: DataFrame, hive: DataFrame) -> DataFrame:
    """Procedures of both by id; a private one hides a shared one."""
    return own.unionByName(hive.join(own.select("id"), "id", "left_anti").select(own.columns))


def health(procedures: DataFrame) -> DataFrame:
    """One row: procedures, flagged ones, average confidence, and those under 0.3."""
    return procedures.agg(
        F.count(F.lit(1)).alias("procedures"), F.count_if(F.col("flagged_for_review")).alias("flagged"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"), F.count_if(F.col("confidence") < 0.3).alias("weak"),
    )


def match(procedures: DataFrame, terms: list[str], contexts: list[str], now: Column, limit: int | None = 5, least: float = 0.3) -> DataFrame:
    """(id, statement, score, matched_keywords): share of triggers met, by confidence and how lately the procedure was applied; the best ones first, or all where there is no limit."""
    t = F.array(*[F.lit(x) for x in terms]).cast("array<string>")
    c = F.array(*[F.lit(x.lower()) for x in contexts]).cast("array<string>")
    hits = F.filter("trigger_keywords", lambda k: F.exists(t, lambda q: k.contains(q) | q.contains(k)))
    met = F.filter("trigger_contexts", lambda x: F.array_contains(c, F.lower(x)))
    score = (F.size(hits) / F.greatest(F.size("trigger_keywords"), F.lit(1)) * 0.7 + F.size(met) / F.greatest(F.size("trigger_contexts"), F.lit(1)) * 0.3) * F.col("confidence")
    late = F.greatest(F.lit(0.5), 1 - days_between(instant(F.col("last_applied")), now) / 365)
    p = procedures.select("id", "statement", (score * F.when(F.col("last_applied").isNotNull(), late).otherwise(F.lit(1.0))).alias("score"), F.array_join(hits, ",").alias("matched_keywords"))
    p = p.filter(F.col("score") >= least)
    return p if limit is None else p.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
