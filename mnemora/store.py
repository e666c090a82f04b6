"""A store of the graph's tables: immutable runs by key and one pointer to the last version.

A commit writes runs (whole tables, or the rows and keys that change) and then a new pointer file, which names
the runs of every table; readers see one version or the other. Runs of an older schema are brought to
the present one as they are read.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemora import keyed
from mnemora.operators import truth, vectors
from mnemora.schemas import DEALT_BY, EDGES, NODES, SCHEMA_VERSION, SNAPSHOTS, TABLES, upgraded
from mnemora.shared import hadoop

#: Tables of one commit that are written at the same time.
AT_ONCE = 8


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # versions

    def version(self, n: int | None = None) -> dict:
        """The last version, or the n-th."""
        if n is not None:
            return json.loads(self.spark.read.text(f"{self.path}/versions/v{n:020d}.json", wholetext=True).first()[0]) if n else {"n": 0, "tables": {}}
        fs, p = hadoop(self.spark, f"{self.path}/versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v")) if fs.exists(p) else []
        if not names:
            return {"n": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{names[-1]}", wholetext=True).first()[0])

    def commit(self, tables: dict[str, DataFrame] | None = None, changes: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None) -> int:
        """Puts whole tables in place of others, and changes others by (rows to upsert, keys to delete), in one new version; raises if another commit came first.

        A change writes its own rows only; now and then the rows of earlier changes are folded in.
        """
        now = self.version()
        states = {t: self._state(t, now) for t in now["tables"]}
        jobs = {name: (lambda t, df=df: t.replaced(df)) for name, df in (tables or {}).items()}
        jobs |= {name: (lambda t, c=c, name=name: t.compacted(t.changed(self._state(name, now), *c))) for name, c in (changes or {}).items()}
        with ThreadPoolExecutor(AT_ONCE) as pool:  # many tables change little: their jobs share the cluster
            states |= dict(zip(jobs, pool.map(lambda name: jobs[name](self._keyed(name)), jobs), strict=True))
        self._point(now["n"], states)
        return now["n"] + 1

    def _point(self, n: int, states: dict) -> None:
        """Makes the version after n; fails if there is one."""
        fs, final = hadoop(self.spark, f"{self.path}/versions/v{n + 1:020d}.json")
        fs.mkdirs(final.getParent())
        jvm = self.spark.sparkContext._jvm
        draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"n": n + 1, "schema": SCHEMA_VERSION, "tables": states}).encode()))
        out.close()
        refuse = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, refuse)

    def _keyed(self, name: str) -> keyed.KeyedTable:
        ddl, keys = TABLES[name]
        return keyed.KeyedTable(self.spark, f"{self.path}/tables", name, StructType.fromDDL(ddl), keys, SCHEMA_VERSION, lambda rows, version: upgraded(rows, name, version), DEALT_BY.get(name, ()))

    def _state(self, name: str, version: dict | None = None) -> keyed.State:
        """A table's runs. Stores of before had one path a table, and the version of the schema for all."""
        v = version or self.version()
        state = v["tables"].get(name, keyed.EMPTY)
        return {"base": {"path": state, "parts": 1, "bytes": 0, "schema": v.get("schema", SCHEMA_VERSION)}, "deltas": []} if isinstance(state, str) else state

    def table(self, name: str) -> DataFrame:
        return self._keyed(name).rows(self._state(name))

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys (for some tables, of a part of the key: DEALT_BY), out of the files that may hold them."""
        return self._keyed(table).lookup(self._state(table), keys)

    def get(self, table: str, *key: str) -> dict | None:
        """The row of one key."""
        names = TABLES[table][1]
        one = self.spark.createDataFrame([key], ", ".join(f"{k} string" for k in names))
        row = self.lookup(table, one).join(one, list(names), "left_semi").first()
        return row.asDict(recursive=True) if row else None

    def compact(self, *names: str) -> int:
        """Folds all changes of some tables (or of all) into their bases."""
        now = self.version()
        states = {t: self._state(t, now) for t in now["tables"]}
        for t in names or states:
            states[t] = self._keyed(t).compacted(states[t], all_of_it=True)
        self._point(now["n"], states)
        return now["n"] + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the last versions do not name, and the pointers before them; readers of older versions fail then. How many runs went."""
        last = self.version()["n"]
        kept = [v for v in (self.version(n) for n in range(max(1, last - keep + 1), last + 1)) if v["n"]]
        states = [self._state(t, v) for v in kept for t in v["tables"]]
        for n in range(last - keep, 0, -1):
            fs, p = hadoop(self.spark, f"{self.path}/versions/v{n:020d}.json")
            if not fs.delete(p, False):
                break
        return keyed.vacuum(self.spark, f"{self.path}/tables", states)

    def changes_since(self, n: int, table: str) -> tuple[DataFrame, DataFrame] | None:
        """What came after version n: (rows written, keys deleted), read from the later deltas alone; None where the table was rewritten or folded since, so that it is to be read anew."""
        then, now = self._state(table, self.version(n)), self._state(table)
        old, new = [r["path"] for r in then["deltas"]], [r["path"] for r in now["deltas"]]
        if then["base"] != now["base"] or new[: len(old)] != old:
            return None
        return self._keyed(table).changes(now["deltas"][len(old) :])

    # writes

    def upsert(self, **deltas: DataFrame) -> int:
        """Rows by key; the last row of a key that comes in is not defined, so give each once."""
        return self.commit(changes={t: (full(d, t), None) for t, d in deltas.items()})

    def replace(self, **tables: DataFrame) -> int:
        return self.commit({t: full(d, t) for t, d in tables.items()})

    def delete(self, table: str, ids: DataFrame) -> int:
        """Removes the rows whose first key column is among the ids."""
        return self.commit(changes={table: (None, self._at(table, TABLES[table][1][0], ids))})

    def _at(self, table: str, column: str, ids: DataFrame) -> DataFrame:
        """Keys of the rows that name ids in a column."""
        keys = TABLES[table][1]
        named = ids.select(F.col("id").alias(column)).distinct()
        return named if keys == (column,) else self.table(table).join(named, column, "left_semi").select(*keys)

    def forget(self, ids: DataFrame, at: str, reason: str = "") -> int:
        """Removes nodes everywhere and records that they are forgotten; only keys and records are written."""
        record = ids.select("id", F.lit(at).alias("ts"), F.lit("store").alias("origin"), F.lit(reason).alias("reason"))
        edges = self._at("edges", "source", ids).unionByName(self._at("edges", "target", ids))
        gone = {"nodes": self._at("nodes", "id", ids), "edges": edges, "embeddings": self._at("embeddings", "id", ids), "episode_entities": self._at("episode_entities", "node_id", ids)}
        return self.commit(changes={t: (None, d) for t, d in gone.items()} | {"forgotten": (record.dropDuplicates(["id"]), None)})

    def rename(self, names: DataFrame) -> int:
        """Gives nodes (old, new) new ids in all tables that name them."""
        out = {
            "nodes": truth.renamed_ids(self.table("nodes"), "id", names), "edges": truth.renamed_edges(self.table("edges"), names),
            "embeddings": truth.renamed_ids(self.table("embeddings"), "id", names), "episode_entities": truth.renamed_ids(self.table("episode_entities"), "node_id", names),
        }
        return self.commit({t: full(d, t) for t, d in out.items()})

    # embeddings

    def clear_embeddings(self) -> int:
        """Drops all vectors and the stamp of their encoder; how many there were."""
        n = self.table("embeddings").count()
        self.commit({"embeddings": self.table("embeddings").filter("false"), "meta": self.table("meta").filter(~F.col("key").startswith("embedding_"))})
        return n

    def set_provider(self, provider: str, dimensions: int) -> int:
        """Stamps the encoder that the index is for; another one than before clears the index. The number of vectors cleared."""
        stamp = {r["key"]: r["value"] for r in self.table("meta").filter(F.col("key").startswith("embedding_")).collect()}  # two rows at most
        new = {"embedding_provider": provider, "embedding_dimensions": str(dimensions)}
        cleared = self.clear_embeddings() if stamp and stamp != new else 0
        self.upsert(meta=self.spark.createDataFrame(list(new.items()), "key string, value string"))
        return cleared

    def put_embeddings(self, rows: DataFrame) -> int:
        """Adds vectors; raises where they are of another encoder than the index."""
        have, new = vectors.fingerprint(self.table("embeddings")), vectors.fingerprint(rows)
        if have and new and have != new:
            raise vectors.EncoderMismatch(f"the index holds {have}, not {new}")
        return self.upsert(embeddings=rows)

    def unlink(self, links: DataFrame) -> int:
        """Removes links (episode_id, node_id) in all roles."""
        gone = self.table("episode_entities").join(links.select("episode_id", "node_id"), ["episode_id", "node_id"], "left_semi").select(*TABLES["episode_entities"][1])
        return self.commit(changes={"episode_entities": (None, gone)})

    def list_snapshots(self, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
        s = self.table("snapshots")
        s = s if since is None else s.filter(F.col("created_at") >= since)
        s = (s if until is None else s.filter(F.col("created_at") <= until)).orderBy(F.desc("created_at"), "id")
        return s if limit is None else s.limit(limit)

    # snapshots: full copies, by partition

    def create_snapshot(self, snapshot_id: str, at: str, trigger: str = "manual") -> int:
        nodes, edges = self.table("nodes"), self.table("edges")
        for name, df in (("nodes", nodes), ("edges", edges)):
            df.write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}/snapshot_id={snapshot_id}")
        row = [(snapshot_id, at, trigger, nodes.count(), edges.count(), self.table("episodes").count(), None)]
        return self.upsert(snapshots=self.spark.createDataFrame(row, SNAPSHOTS))

    def snapshot(self, snapshot_id: str) -> dict[str, DataFrame]:
        read = lambda name, ddl: self.spark.read.schema(ddl).parquet(f"{self.path}/snapshots/{name}/snapshot_id={snapshot_id}")
        return {"nodes": read("nodes", NODES), "edges": read("edges", EDGES)}

    def drop_snapshots(self, ids: list[str]) -> int:
        for i in ids:
            for name in ("nodes", "edges"):
                fs, p = hadoop(self.spark, f"{self.path}/snapshots/{name}/snapshot_id={i}")
                fs.delete(p, True)
        return self.delete("snapshots", self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def views(self) -> None:
        """Registers the tables as temporary views for SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)


def full(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, those not given as nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[table][0])])
