"""Whitening of embeddings by a two-pass covariance.

Entries become integers, x = floor(64 c) + 1000000. The fit list holds each distinct x vector once, so a vector that a
third of all rows repeat weighs one. Pass one adds integers exactly, in numpy where a bound shows that they fit 64 bits and
as Python integers else; the mean S / n stays a fraction. Pass two subtracts the mean (whole part first, so nothing is lost
to the offset of a million) and adds the outer products of a batch by one matrix product. Partial sums are merged by
treeAggregate, so the driver receives a few d x d matrices whatever the number of partitions. LAPACK's symmetric solver
gives the components, which travel to the tasks as one broadcast of d x (components + 1) numbers, and a third pass
measures the covariance of what comes out. Memory of a worker: one Arrow batch and one d x d matrix; nothing depends on
the number of rows. The distinct vectors are written once, so a lost executor costs a read of its part.

Defined cases: rows whose vector is null, empty, or holds a null or a non-finite entry go; so do rows whose length is not
the most frequent one among the distinct vectors (the greatest such on ties). Entries beyond 2**55 are held at that. A
component without variance (eigenvalue at most 1e-12 of the trace) can't be whitened and is left out, so equal vectors, a
single one or an empty table give no rows. A deviation beyond 64 bits is null. Rows that repeat a vector or an id each
give their own rows; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoleaf.llm.common import bound_batches, written

SCALE, SHIFT = 64, 1_000_000
#: Entries are held within this, far beyond the vectors of any model, so that x is a long.
LARGEST = float(2**55)
#: Components with a smaller share of the trace have no variance but rounding.
FLAT = 1e-12
COMPONENTS = 16


def integers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """_key and x (array of long) of the rows whose vector is complete and finite."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.coalesce((F.size("_c") > 0) & ~F.exists("_c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    x = F.transform("_c", lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v * SCALE))).cast("long") + SHIFT)
    return vectors.select(F.col(key).alias("_key"), c.alias("_c")).filter(fine).select("_key", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def add_exactly(x: np.ndarray) -> list[int]:
    """Sums of the columns as Python integers."""
    if len(x) * float(max(1, abs(int(x.min())), abs(int(x.max())))) < 2**62:
        return x.sum(axis=0).tolist()
    return [sum(c) for c in x.T.tolist()]


def centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - part


def tree_sum(parts: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Adds rows (m: bytes of d x d doubles, n) of all partitions in a tree."""

    def row(acc, r):
        m = np.frombuffer(r.m, dtype=np.float64)
        return (m.copy(), r.n) if acc is None else (acc[0] + m, acc[1] + r.n)

    def both(a, b):
        return a if b is None else b if a is None else (a[0] + b[0], a[1] + b[1])

    got = parts.rdd.treeAggregate(None, row, both, depth=2)
    return (np.zeros((d, d)), 0) if got is None else (got[0].reshape(d, d), got[1])


def outer_products(fit: DataFrame, project) -> DataFrame:
    """One row a partition: the sum of z'z for z = project(x), as bytes, and the number of rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if len(b):
                z = project(matrix(b.column(0)))
                total, n = z.T @ z if total is None else total + z.T @ z, n + len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary()), pa.array([n])], names=["m", "n"])

    return fit.mapInArrow(add, "m binary, n long")


class Fit:
    """What the passes found: n, the integer sums, components (columns), their eigenvalues, trace and identity error."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float, error: float):
        self.n, self.sums, self.components, self.values, self.trace, self.error = n, sums, components, values, trace, error

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole parts and fractions of S / n."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, dtype=np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])


def distinct_vectors(x: DataFrame) -> DataFrame:
    """The fit list, one row for each distinct vector of the most frequent length; copies meet before the shuffle."""
    fit = written(x.select("x").distinct().withColumn("d", F.size("x")), "fit-list")
    top = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return fit.filter(F.col("d") == (top[0].d if top else 0)).select("x", "d")


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Both passes and the decomposition; None for an empty fit list."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if len(b):
                s = add_exactly(matrix(b.column(0)))
                total, n = s if total is None else [p + q for p, q in zip(total, s, strict=True)], n + len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in total]]), pa.array([n])], names=["s", "n"])

    def row(acc, r):
        s = [int(v) for v in r.s]
        return (s, r.n) if acc is None else ([p + q for p, q in zip(acc[0], s, strict=True)], acc[1] + r.n)

    def both(a, b):
        return a if b is None else b if a is None else ([p + q for p, q in zip(a[0], b[0], strict=True)], a[1] + b[1])

    fit = fit.select("x")
    got = fit.mapInArrow(sums, "s array<string>, n long").rdd.treeAggregate(None, row, both, depth=2)
    if got is None:
        return None
    out = Fit(got[1], got[0], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    d, (whole, part) = len(out.sums), out.mean
    products, _ = tree_sum(outer_products(fit, lambda x: centred(x, whole, part)), d)
    cov = products / out.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    out.trace = float(np.trace(cov))
    take = int(np.count_nonzero(values[:components] > FLAT * max(out.trace, 0.0)))
    out.values, out.components = values[:take], np.ascontiguousarray(vectors[:, :take])
    if take:
        scaled = out.components / np.sqrt(out.values)
        again, _ = tree_sum(outer_products(fit, lambda x: centred(x, whole, part) @ scaled), take)
        out.error = float(np.abs(again / out.n - np.eye(take)).max())
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error for each kept row and component."""
    spark = vectors.sparkSession
    bound_batches(spark)
    x = integers(vectors, key, vector)
    fit = distinct_vectors(x)
    found = fit_whitening(fit, components)
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    sums, n, d, error = found.sums, found.n, len(found.sums), found.error
    (whole, part), share = found.mean, found.values / found.trace
    model = spark.sparkContext.broadcast((whole, part, found.components / np.sqrt(found.values)))

    def deviations(x: np.ndarray, whole: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)**2, exact: n (x - whole) - (S - n whole) is small where x is near the mean."""
        rest = np.array([s - n * int(w) for s, w in zip(sums, whole, strict=True)], dtype=object)
        y = x - whole
        most = float(np.abs(y).max()) * n + n
        if most * most * d < 2**62:
            z = y * n - rest.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = ((y.astype(object) * n - rest) ** 2).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part, scaled = model.value
        k = scaled.shape[1]
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1))
            at = np.repeat(np.arange(len(b)), k)
            columns = [
                b.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))),
                pa.array(np.full(len(at), n, dtype=np.int64)),
                pa.array(deviations(x, whole), pa.int64()).take(pa.array(at)),
                pa.array((centred(x, whole, part) @ scaled).ravel()),
                pa.array(np.tile(share, len(b))),
                pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.filter(F.size("x") == d).mapInArrow(project, schema)
