"""Embedding whitening by a compensated covariance (operator 12).

Vectors lie on a grid of integers x, so sums are exact and n*x - S is an exact integer. Outer products of
the centred vectors are accumulated as pairs of doubles, high and low, with error-free sums and products;
each task gives its pairs in tiles of the matrix, and tiles are merged pair by pair in rounds. One task a
length of vectors solves for eigenvalues: LAPACK's divide and conquer on the tridiagonal form (``eigh`` of numpy,
which calls ``syevd``). Rows are read once for the sums, the products, the check of the result and the
result itself, and are never shuffled; what moves or reaches the driver depends on the dimension alone.

Defined cases: rows of null vectors, of vectors without entries and of vectors with null or non-finite entries
are dropped. Vectors of each length are a list of their own. Entries beyond the range of the grid count
as its ends, 2**62. A deviation that is no 64-bit number is null. A component without variance (an eigenvalue of
at most dimension * 2**-52 of the largest one, as when there are fewer rows than dimensions) has null ``whitened`` and
is left out of ``identity_error``; ``explained`` is null where there is no variance at all. Rows that repeat count as often as they come;
null ids pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Entries of a matrix in a tile, entries worked on at once, partial results merged by one task.
TILE, AT_ONCE, FAN = 1 << 17, 1 << 16, 64
EDGE = float(1 << 62)


def two_sum(a, b):
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b and its rounding error, exactly (barring overflow)."""

    def halves(v):
        c = 134217729.0 * v  # 2**27 + 1
        high = c - (c - v)
        return high, v - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(high, low, other_high, other_low):
    """The sum of two pairs, as a pair."""
    s, t = two_sum(high, other_high)
    t = t + (low + other_low)
    total = s + t
    return total, t - (total - s)


class Products:
    """Sum of the outer products of rows with themselves, as pairs of doubles."""

    def __init__(self, dim: int):
        import numpy as np

        self.dim, self.high, self.low = dim, np.zeros((dim, dim)), np.zeros((dim, dim))

    def add(self, high, low) -> None:
        """Rows given as pairs."""
        lines = max(1, min(self.dim, AT_ONCE // self.dim))
        rows = max(1, AT_ONCE // (lines * self.dim))
        for a in range(0, len(high), rows):
            h, l = high[a : a + rows], low[a : a + rows]
            for i in range(0, self.dim, lines):
                one, one_low = h[:, i : i + lines, None], l[:, i : i + lines, None]
                p, e = two_product(one, h[:, None, :])
                e = e + (one * l[:, None, :] + one_low * h[:, None, :])
                while len(p) > 1:
                    half = len(p) // 2
                    q, f = added(p[:half], e[:half], p[half : 2 * half], e[half : 2 * half])
                    if len(p) % 2:
                        q[:1], f[:1] = added(q[:1], f[:1], p[-1:], e[-1:])
                    p, e = q, f
                own = slice(i, i + lines)
                self.high[own], self.low[own] = added(self.high[own], self.low[own], p[0], e[0])


def on_grid(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """(id, dim, x) of the rows that remain."""
    v = F.col("v")
    fine = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = vectors.select(vectors[id_col].alias("id"), vectors[col].cast("array<double>").alias("v")).filter(v.isNotNull() & fine)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * float(grid), F.lit(EDGE)), F.lit(-EDGE))).cast("long") + F.lit(offset).cast("long"))
    return own.select("id", F.size(v).alias("dim"), x.alias("x"))


def _matrices(batch, dim: int, x: int) -> Iterator:
    """(row numbers, matrix) for each length of vectors in a batch whose columns dim and x are given by number."""
    import numpy as np
    import pyarrow as pa

    dims = batch.column(dim).to_numpy()
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        values = batch.column(x) if len(rows) == len(dims) else batch.column(x).take(pa.array(rows))
        yield int(d), rows, values.flatten().to_numpy().reshape(len(rows), d)


def deviations(x, n: int, sums: list[int]):
    """n * x - S, exactly: 64-bit numbers, or Python's where they might not do."""
    import numpy as np

    if n * max(int(x.max(initial=0)), -int(x.min(initial=0))) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(dev, n: int):
    """dev / n as pairs of doubles."""
    import numpy as np

    if dev.dtype == object:
        from fractions import Fraction

        high = (dev / n).astype(float)
        rest = [float(Fraction(a, n) - Fraction(b)) for a, b in zip(dev.ravel().tolist(), high.ravel().tolist(), strict=True)]
        return high, np.array(rest).reshape(high.shape)
    whole = dev.astype(float)
    below = (dev - whole.astype(np.int64)).astype(float)  # beyond 2**53 a double leaves some over
    high = whole / n
    p, e = two_product(high, float(n))
    return high, ((whole - p) - e + below) / n


@dataclass(frozen=True)
class Fit:
    """Parameters for vectors of one length. axes: a column for each component; scale: square roots of eigenvalues, nan without variance."""

    n: int
    sums: list[int]
    axes: object
    scale: object
    explained: list
    identity_error: float | None = None

    def whitened(self, dev):
        high, low = centred(dev, self.n)
        return ((high @ self.axes) + (low @ self.axes)) / self.scale


def _partials(batches: Iterator, rows_of) -> Iterator:
    """Tiles of the sums of outer products of what rows_of(dim, matrix) gives as pairs."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, sums = TaskContext.get().partitionId(), {}
    for batch in batches:
        for dim, _, x in _matrices(batch, 0, 1):
            high, low = rows_of(dim, x)
            if dim not in sums:
                sums[dim] = Products(high.shape[1])
            sums[dim].add(high, low)
    for dim, s in sums.items():
        high, low = s.high.ravel(), s.low.ravel()
        for tile, a in enumerate(range(0, len(high), TILE)):
            columns = [pa.array([dim], pa.int32()), pa.array([tile], pa.int32()), pa.array([part], pa.int32()), *[pa.array([v[a : a + TILE].tobytes()], pa.binary()) for v in (high, low)]]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "tile", "part", "high", "low"])


PARTIAL = "dim int, tile int, part int, high binary, low binary"


def _merge(key, table):
    """One tile for many; in the order of the parts, so that a repeated task gives equal bits."""
    import numpy as np
    import pyarrow as pa

    high = low = None
    for one in sorted(table.to_pylist(), key=lambda r: r["part"]):
        h, l = np.frombuffer(one["high"]), np.frombuffer(one["low"])
        high, low = (h, l) if high is None else added(high, low, h, l)
    columns = [pa.array([k.as_py()], pa.int32()) for k in key]
    return pa.table([*columns, pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], names=["dim", "tile", "part", "high", "low"])


def _products(own: DataFrame, rows_of) -> DataFrame:
    """A row for each (dim, tile): the merged sums of outer products."""
    parts = written(own.select("dim", "x").mapInArrow(lambda batches: _partials(batches, rows_of), PARTIAL), "products")
    left = parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    while left > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("dim", "tile", "part").applyInArrow(_merge, PARTIAL)
        left = -(-left // FAN)
    return parts


def _square(rows: list, dim: int):
    """(high, low) matrices of tiles."""
    import numpy as np

    tiles = sorted(rows, key=lambda r: r["tile"])
    return [np.concatenate([np.frombuffer(r[c]) for r in tiles]).reshape(dim, dim) for c in ("high", "low")]


def _solver(ns: dict[int, int], components: int):
    def solve(key, table):
        import numpy as np
        import pyarrow as pa

        dim = key[0].as_py()
        high, low = _square(table.to_pylist(), dim)
        v = (high + low) / ns[dim]
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        k = len(values)
        return pa.table({"dim": pa.array([dim] * k, pa.int32()), "component": pa.array(range(1, k + 1), pa.int32()), "value": values, "trace": [float(np.trace(v))] * k, "axis": [vectors[:, i].tolist() for i in range(k)]})

    return solve


@dataclass(frozen=True)
class Whitener:
    """Fitted parameters by the length of vectors."""

    fits: dict[int, Fit]
    grid: int
    offset: int

    def transform(self, vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
        """id, n, deviation, whitened (an array, an entry for each component), explained (likewise) and identity_error for each row that remains; rows of a length that was not fitted are dropped."""
        spark, fits = vectors.sparkSession, self.fits
        ship(spark)
        own = on_grid(vectors, id_col, col, self.grid, self.offset)
        kind = own.schema["id"].dataType.simpleString()

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for dim, rows, x in _matrices(batch, 1, 2):
                    if dim not in fits:
                        continue
                    fit = fits[dim]
                    dev = deviations(x, fit.n, fit.sums)
                    top = float(np.abs(dev).max())
                    squares = (dev * dev).sum(axis=1) if dev.dtype != object and top * top * dim < 2.0**62 else (dev.astype(object) ** 2).sum(axis=1)
                    squares = [s if s < 1 << 63 else None for s in squares.tolist()]
                    w = fit.whitened(dev)
                    k = w.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(w) + 1, k), pa.int32()), pa.array(w.ravel(), mask=np.isnan(w.ravel())))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([dim] * len(w), pa.int32()), pa.array(squares, pa.int64()), lists], names=["id", "dim", "deviation", "whitened"])

        out = own.mapInArrow(run, f"id {kind}, dim int, deviation long, whitened array<double>")
        about = spark.createDataFrame([(d, f.n, f.explained, f.identity_error) for d, f in fits.items()], "dim int, n long, explained array<double>, identity_error double")
        return out.join(about, "dim").select(F.col("id").alias(id_col), "n", "deviation", "whitened", "explained", "identity_error")


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", col: str = "embedding", grid: int = GRID, offset: int = OFFSET) -> Whitener:
    """Means, components and the check of the whitened covariance, from all rows that remain."""
    import numpy as np

    ship(vectors.sparkSession)
    own = on_grid(vectors, id_col, col, grid, offset)
    at = F.posexplode("s")
    sums = own.select("dim", "x").mapInArrow(_sums, "dim int, n long, s array<decimal(38,0)>").select("dim", "n", at).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    means: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("dim", "pos").collect():  # as many rows as vectors have entries
        means.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    solved = _products(own, lambda dim, x: centred(deviations(x, *means[dim]), means[dim][0]))
    solved = solved.groupBy("dim").applyInArrow(_solver({d: n for d, (n, _) in means.items()}, components), "dim int, component int, value double, trace double, axis array<double>")
    fits = {}
    found = solved.orderBy("dim", "component").collect()  # so many components of each length
    for dim, (n, s) in means.items():
        rows = [r for r in found if r["dim"] == dim]
        values = np.array([r["value"] for r in rows])
        scale = np.sqrt(np.where((values > 0) & (values > dim * 2.0**-52 * values[0]), values, np.nan))
        explained = [r["value"] / r["trace"] if r["trace"] > 0 else None for r in rows]
        fits[dim] = Fit(n, s, np.array([r["axis"] for r in rows]).T, scale, explained)

    def result(dim: int, x):
        w = fits[dim].whitened(deviations(x, *means[dim]))
        return np.nan_to_num(w), np.zeros(w.shape)

    check = _products(own, result).collect()  # components squared for each length
    for dim, f in fits.items():
        k = len(f.scale)
        cov = sum(_square([r for r in check if r["dim"] == dim], k)) / f.n
        has = ~np.isnan(f.scale)
        error = float(np.abs(cov - np.eye(k))[has][:, has].max()) if has.any() else None
        fits[dim] = Fit(f.n, f.sums, f.axes, f.scale, f.explained, error)
    return Whitener(fits, grid, offset)


def _sums(batches: Iterator) -> Iterator:
    """A task's number of rows and exact sums for each length of vectors."""
    import numpy as np
    import pyarrow as pa

    totals: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for dim, _, x in _matrices(batch, 0, 1):
            n, s = totals.get(dim, (0, [0] * dim))
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            totals[dim] = n + len(x), [a + (int(h) << 32) + int(l) for a, h, l in zip(s, high, low, strict=True)]
    for dim, (n, s) in totals.items():
        from decimal import Decimal

        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([[Decimal(a) for a in s]], pa.list_(pa.decimal128(38, 0)))], names=["dim", "n", "s"])


def report(embeddings: DataFrame) -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = fit(embeddings).transform(embeddings)
    one = F.posexplode(F.arrays_zip("whitened", "explained"))
    return rows.select("vec_id", "n", "deviation", "identity_error", one).select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error")
