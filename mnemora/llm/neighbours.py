"""Approximate nearest neighbours by cosine over a small-world graph for each shard (operator 13).

Rows of equal vectors form a class, which keeps its least ``copies`` ids: no more of them can be among the
nearest, for ties go to the smaller id. Classes are dealt to shards by the hash of the vector, each of
bounded bytes, and each shard becomes a hierarchical graph of flat neighbour arrays, written in pieces to
the shared folder (or to a path of the caller's). A search packs the queries into blocks, sends every block
to all shards of its dimension, and merges what they find. A search task holds one graph and streams
its blocks; where there are more queries than ``CHUNK``, several tasks share a shard, each with its own
part of the queries. Scores are computed in double precision on the original vectors.

Defined cases: vectors that are null, zero or empty, or hold null or non-finite entries, and rows of null
id, take no part. Vectors of different lengths are not compared. Rows that repeat id and vector count
once; an id with several vectors is several queries and several candidates, none of them a candidate of its
own id. Fewer candidates than asked for: all of them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, ship, written

#: Links of a vector above level 0 (twice as many there); candidates kept while building and, for a shard of ``WIDE_FROM`` vectors or less, while searching.
LINKS, BUILD_WIDTH, SEARCH_WIDTH, WIDE_FROM = 16, 100, 128, 16384
#: Most bytes of a shard's vectors and links; vectors that are worth a shard while tasks are free.
SHARD_BYTES, LEAST = 128 << 20, 4096
PIECE_BYTES = 4 << 20
#: Queries of a block, and most queries of a search task.
BLOCK, CHUNK = 256, 65536


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Distinct (id, v, dim, key) of the rows that take part."""
    v = F.col("v")
    kind = vectors.schema[col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # floats move as floats
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[col].cast("array<float>" if single else "array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)
    return own.distinct().select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("key"))


def _lists(column) -> tuple:
    """Values and lengths of a list column."""
    import numpy as np

    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _unit(v):
    """Rows scaled by powers of two to a largest entry below one, their norms, and the unit rows."""
    import numpy as np

    v = v.astype(float)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v, norm, v / norm[:, None]


@dataclass(frozen=True)
class Index:
    """Graphs in pieces (shard, part, data) under a path. shards: (dim, first, count) for each length of vectors, first counting over all."""

    spark: SparkSession
    path: str
    shards: tuple[tuple[int, int, int], ...]
    copies: int

    def search(self, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest found to each row of queries, rows of its own id left out."""
        if k >= self.copies:
            raise ValueError(f"this index keeps {self.copies} ids of equal vectors, so k may be {self.copies - 1} at most")
        ship(self.spark)
        blocks = written(usable(queries, id_col, col).mapInArrow(_blocks, "dim int, block long, n long, data binary"), "query-blocks")
        asked = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        chunks = max(1, -(-asked // CHUNK))
        total = max([1, *(first + count for _, first, count in self.shards)])
        dims = self.spark.createDataFrame(list(self.shards), "dim int, first int, count int")
        chunk = F.pmod(F.xxhash64("block"), F.lit(chunks))
        sent = blocks.join(dims, "dim").select(F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("shard"), chunk.alias("chunk"), F.lit(1).alias("kind"), F.col("block").alias("part"), "data")
        pieces = self.spark.read.schema("shard int, part long, data binary").parquet(self.path)
        pieces = pieces.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(0).alias("kind"), "part", "data")
        dealt = pieces.unionByName(sent).withColumn("task", (F.col("shard") * chunks + F.col("chunk")).cast("int"))
        dealt = dealt.repartitionById(total * chunks, F.col("task")).sortWithinPartitions("kind", "part").select("kind", "data")

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            graph, pieces = None, []
            for batch in batches:
                for kind, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if not kind:
                        pieces.append(data.as_py())
                        continue
                    if not pieces and graph is None:
                        continue  # no shard: an empty index
                    if graph is None:
                        graph, pieces = _Graph(b"".join(pieces)), []
                    columns = graph.nearest(data.as_py(), k, width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["query_id", "key", "vec_id", "score"])

        found = dealt.mapInArrow(run, "query_id long, key long, vec_id long, score double")
        best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Graph:
    """One shard in memory."""

    def __init__(self, data: bytes):
        import numpy as np

        from mnemora.llm.succinct import unpack

        a = unpack(data)
        counts = a["counts"]
        self.v, self.norm, self.x = _unit(a["v"].reshape(counts[0], -1))
        self.ids, self.starts = a["ids"], np.concatenate([[0], np.cumsum(a["sizes"])])
        self.links = [a[f"l{i}"].reshape(counts[i], -1) for i in range(len(counts))]

    def nearest(self, block: bytes, k: int, width: int) -> list:
        """Ids and keys of the block's queries with the ids and scores of their k nearest here."""
        import numpy as np

        from mnemora.llm import small_world
        from mnemora.llm.succinct import unpack

        q = unpack(block)
        v, norm, x = _unit(q["v"].reshape(len(q["id"]), -1))
        width = max(k + 1, int(width * max(1.0, len(self.x) / WIDE_FROM) ** 0.5))
        rows, _ = small_world.search(self.x, self.links, x, min(width, len(self.x)))
        line, column = np.nonzero(rows >= 0)
        row = rows[line, column]
        score = np.concatenate([np.einsum("ij,ij->i", v[line[a : a + 8192]], self.v[row[a : a + 8192]]) for a in range(0, len(row), 8192)] or [np.zeros(0)]) / (norm[line] * self.norm[row])
        # classes become their rows
        size = self.starts[row + 1] - self.starts[row]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[row], size)
        line, score, ids = np.repeat(line, size), np.repeat(score, size), self.ids[at]
        other = ids != q["id"][line]
        line, score, ids = line[other], score[other], ids[other]
        order = np.lexsort((ids, -score, line))
        line, score, ids = line[order], score[order], ids[order]
        first = np.searchsorted(line, line)
        best = np.arange(len(line)) - first < k
        return [q["id"][line[best]], q["key"][line[best]], ids[best], score[best]]


def _blocks(batches: Iterator) -> Iterator:
    """Rows (id, v, dim, key) as packed blocks of one length each."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from mnemora.llm.succinct import pack

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            for a in range(0, len(own), BLOCK):
                part = batch.take(pa.array(own[a : a + BLOCK]))
                data = pack({"id": part.column(0).to_numpy(), "key": part.column(3).to_numpy(), "v": _lists(part.column(1))[0]})
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([part.num_rows], pa.int64()), pa.array([data], pa.binary())], names=["dim", "block", "n", "data"])
                number += 1


def _graphs(batches: Iterator) -> Iterator:
    """The rows (shard, key, ids, v) of one shard as the pieces of its graph."""
    import numpy as np
    import pyarrow as pa

    from mnemora.llm import small_world
    from mnemora.llm.succinct import pack

    shard, parts = None, []
    for batch in batches:
        if batch.num_rows:
            shard = batch.column(0)[0].as_py()
            parts.append((batch.column(1).to_numpy(), *_lists(batch.column(2)), _lists(batch.column(3))[0].reshape(batch.num_rows, -1)))
    if shard is None:
        return
    keys, ids, sizes, v = (np.concatenate(p) for p in zip(*parts, strict=True))
    parts.clear()
    order, counts = small_world.level_counts(keys.view(np.uint64), LINKS)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order]) + np.repeat(starts[order], sizes[order])
    v = v[order]
    links = small_world.build(_unit(v)[2], counts, LINKS, BUILD_WIDTH)
    data = pack({"counts": np.array(counts, np.int64), "v": v.ravel(), "ids": ids[at], "sizes": sizes[order].astype(np.int64)} | {f"l{i}": g.ravel() for i, g in enumerate(links)})
    for i, a in enumerate(range(0, len(data), PIECE_BYTES)):
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([i], pa.int64()), pa.array([data[a : a + PIECE_BYTES]], pa.binary())], names=["shard", "part", "data"])


def build(vectors: DataFrame, k: int, path: str | None = None, id_col: str = "vec_id", col: str = "embedding") -> Index:
    """Indexes all vectors for searches of up to k neighbours."""
    spark = vectors.sparkSession
    ship(spark)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))  # limited in each task before the shuffle, so copies of one vector move k + 1 ids a task
    classes = usable(vectors, id_col, col).withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("v", "dim", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = written(classes, "vector-classes")
    free = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, first = [], 0
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):  # a row for each length of vectors
        most = max(1, SHARD_BYTES // (8 * dim + 4 * 2 * LINKS + 8 * (k + 1)))
        count = max(-(-n // most), min(free, -(-n // LEAST)))
        shards.append((dim, first, count))
        first += count
    dims = spark.createDataFrame(shards, "dim int, first int, count int")
    shard = (F.col("first") + F.pmod(F.xxhash64("key"), "count")).cast("int")
    dealt = classes.join(dims, "dim").select(shard.alias("shard"), "key", "ids", "v").repartitionById(max(1, first), F.col("shard"))
    path = path or scratch(spark, "graphs")
    dealt.mapInArrow(_graphs, "shard int, part long, data binary").write.parquet(path)
    return Index(spark, path, tuple(shards), k + 1)


def report(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest rows found to each row whose id is divisible by ``every``."""
    return build(embeddings, k).search(embeddings.filter(embeddings["vec_id"] % every == 0), k)
