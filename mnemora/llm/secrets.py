"""Secret scans with an incremental blob ledger (operator 6), DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text (null: empty). A ledger keeps,
for each blob and rule version scanned, the findings; a scan takes from the given versions the
blobs that the ledger lacks for the rules' version, one text a blob, and appends a part to the
ledger. Findings are joined back to all paths of a blob, so copies and later runs cost no scan.

Places of matches are sums of the lengths of the gaps (``split``) and matches
(``regexp_extract_all``) before them, in code points. A ledger part is an immutable Parquet folder
under its path and counts only once its ``_SUCCESS`` file is there; parts that name a blob
twice (two writers) agree, and one is taken.

Defined cases: empty tables give no rows; null ids are values; rows that repeat give repeated results.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hadoop, let, scratch, text_of


@dataclass(frozen=True)
class Rule:
    """pattern: without look-around; group: the group whose length counts; needs: one of these (lower case) is in each text that matches."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    base: bool = False


#: The base rules first; their order settles ties.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "key"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",), True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, (), True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 1, ("eyj",)),
)
BASE = tuple(r.kind for r in RULES if r.base)


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


FOUND = "array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>"


def _matches(text: Column, lowered: Column, rule: Rule) -> Column:
    """All matches of a rule in order, with the length of the gap before each."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"), F.split(text, rule.pattern, -1).alias("g"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("x"),
    )
    rows = let(parts, lambda p: F.transform(p["m"], lambda v, i: F.struct(
        F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(F.get(p["g"], i)).alias("gap"), F.length(v).alias("len"), (F.length(F.get(p["x"], i)) >= rule.least).alias("ok"),
    )))
    may = text.rlike(rule.pattern)
    if rule.needs:
        any_of = lowered.contains(rule.needs[0])
        for n in rule.needs[1:]:
            any_of = any_of | lowered.contains(n)
        may = any_of & may
    return F.when(may, rows.cast(FOUND)).otherwise(F.array().cast(FOUND))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, found) of one row a blob (sha, text); found: array of struct<start, ord, kind, end> by start, then rule."""
    text, lowered = F.col("text"), F.lower("text")
    hits = blobs.select("sha", F.explode_outer(F.concat(*[_matches(text, lowered, r) for r in rules])).alias("f")).select("sha", "f.*")
    before = Window.partitionBy("sha", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    one = F.struct((F.col("end") - F.col("len")).alias("start"), order[F.col("kind")].alias("ord"), "kind", "end")
    return placed.groupBy("sha").agg(F.sort_array(F.collect_list(F.when(F.col("ok"), one))).alias("found"))


class BlobLedger:
    """A folder of immutable ledger parts: sha, rule_version, found."""

    SCHEMA = "sha string, rule_version string, found array<struct<start:bigint,ord:int,kind:string,end:bigint>>"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules, self.version = spark, path.rstrip("/"), rules, rules_version(rules)

    def parts(self) -> list[str]:
        fs, p = hadoop(self.spark, self.path)
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(x.toString() for x in found if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def entries(self) -> DataFrame | None:
        """What has been scanned with this version of the rules."""
        parts = self.parts()
        return self.spark.read.schema(self.SCHEMA).parquet(*parts).filter(F.col("rule_version") == self.version) if parts else None

    def scan(self, versions: DataFrame) -> str:
        """Scans the blobs of versions (text) that are new to the ledger; the path of the part added."""
        blobs = versions.select(text_of(versions).alias("text")).select(F.sha2("text", 256).alias("sha"), "text")
        seen = self.entries()
        if seen is not None:
            blobs = blobs.join(seen.select("sha"), "sha", "left_anti")
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        scan_blobs(blobs.dropDuplicates(["sha"]), self.rules).withColumn("rule_version", F.lit(self.version)).select("sha", "rule_version", "found").write.parquet(part)
        return part

    def findings(self, versions: DataFrame) -> DataFrame:
        """versions with the findings of their blobs: every path of a blob has them. Scan first."""
        own = versions.withColumn("sha", F.sha2(text_of(versions), 256))
        one_each = self.entries()
        if len(self.parts()) > 1:
            one_each = one_each.dropDuplicates(["sha"])
        return own.join(one_each.select("sha", "found"), "sha", "left")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans. A path makes the ledger last."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, ledger_path or scratch(spark, "ledger"))
    docs = docs.select("doc_id", "text")
    ledger.scan(docs)
    out = ledger.findings(docs)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS ord, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS v, unnest(g[1:len(m)]) AS gap, unnest(x) AS x, {r.least} AS least FROM "
            f"(SELECT rid, regexp_extract_all(text, '{p}', 0) AS m, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}', {r.group}) AS x FROM s_doc WHERE regexp_matches(text, '{p}'))"
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH s_doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s_raw AS ({" UNION ALL ".join(parts)}),
s_end AS (SELECT *, sum(length(gap) + length(v)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM s_raw),
s_hit AS (SELECT rid, ord, kind, e - length(v) AS s, e FROM s_end WHERE length(x) >= least),
s_agg AS (SELECT rid, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (kind IN ({base})) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM s_hit GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM s_doc LEFT JOIN s_agg USING (rid)
"""


SQL = _sql()
