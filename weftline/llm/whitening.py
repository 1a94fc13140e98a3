"""Embedding whitening by a tall-skinny QR factorisation.

Entries become whole numbers, ``x = floor(scale * c) + shift``, so that counts
and per-dimension sums ``S`` are exact. Rows are centred with these,
``(n * x - S) / n``, every partition reduces its own to the triangular factor
of a QR factorisation, and factors are merged in a tree of ``FAN`` until one
is left. Its singular values and right vectors are those of all centred rows:
eigenvalues of the covariance are ``s ** 2 / n``, and a row times a vector,
over the root of its eigenvalue, is a whitened component. No covariance of the
input is ever formed.

What a task holds is an Arrow batch and ``FAN`` factors of dimension squared;
the driver sees the sums and the last factor.

Defined cases: a row is dropped if its vector is null or empty, holds null,
NaN or infinite entries or one beyond 2 ** 61 / ``scale``, or has another
length than most vectors have (of equally common lengths the greatest); a null
id stays null; repeated rows count and come back as often as they occur; an
empty table, or one without valid rows, gives an empty result. A component
without variance has null for ``whitened`` and 0 for ``explained``, both null
if no component has any; so is ``identity_error`` then. A ``deviation`` beyond
a long is null. Further columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import col, forget, materialise, table

SCALE, SHIFT = 1024, 100_000
#: Factors merged by one task.
FAN = 64
#: Rows that are factored at once.
BLOCK = 4096
SAFE = float(1 << 62)
SCHEMA = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


def entries(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each valid vector in the flat array of its batch, as whole numbers; length 0 marks the others."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * flat)
        bad = ~(np.abs(x) < SAFE / 2)
    ends = np.cumsum(size)
    start = ends - size
    seen = np.concatenate(([0], np.cumsum(bad)))
    size = np.where(seen[ends] > seen[start], 0, size)
    return start, size, np.where(bad, 0, x).astype(np.int64) + SHIFT


def vectors(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a valid vector of ``dim`` entries, and these as a matrix of whole numbers."""
    start, size, x = entries(column)
    at = np.flatnonzero(size == dim)
    return at, x[start[at, None] + np.arange(dim)]


@dataclass(frozen=True)
class Fit:
    """Number of rows and exact sums of their entries."""

    n: int
    sums: tuple[int, ...]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def off(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: as longs, or Python's whole numbers where these could overflow."""
        mean = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n for s in self.sums])
        far = x - mean
        if self.n * (float(np.abs(far).max(initial=0)) + 1) < SAFE:
            return self.n * far - rest
        return self.n * far.astype(object) - rest.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.off(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = self.off(x)
        if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * self.dim >= SAFE:
            return [v if v < 1 << 63 else None for v in (d.astype(object) ** 2).sum(axis=1).tolist()]
        return (d * d).sum(axis=1).tolist()


def exact_sums(rows: DataFrame) -> Fit | None:
    """Counts and sums of the vectors of the commonest length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            start, size, x = entries(b.column(1))
            for d in np.unique(size[size > 0]).tolist():
                v = x[start[size == d, None] + np.arange(d)]
                # Halves of 31 bits and the rest, so that no sum of a batch overflows.
                high, low = (v >> 31).sum(axis=0).tolist(), (v & 0x7FFFFFFF).sum(axis=0).tolist()
                n, s = total.get(d, (0, [0] * d))
                total[d] = n + len(v), [a + (h << 31) + w for a, h, w in zip(s, high, low, strict=True)]
        out = [(d, k, n, str(v)) for d, (n, s) in total.items() for k, v in enumerate(s)]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dim", "k", "n", "s"])

    sums = rows.mapInArrow(add, "dim int, k int, n long, s string").groupBy("dim", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = materialise(sums)
    most = sums.orderBy(F.desc("n"), F.desc("dim")).first()
    # A row for each dimension.
    got = sums.where(F.col("dim") == most["dim"]).orderBy("k").collect() if most else []
    forget(sums)
    return Fit(most["n"], tuple(int(r["s"]) for r in got)) if most else None


def factor(rows: DataFrame, fit: Fit) -> np.ndarray:
    """Triangular factor of the centred rows."""
    dim = fit.dim

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.empty((0, dim))
        for b in batches:
            _, x = vectors(b.column(1), dim)
            for at in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack((r, fit.centred(x[at : at + BLOCK]))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merge(some: pa.Table) -> pa.Table:
        r = np.vstack([np.frombuffer(x, float).reshape(-1, dim) for _, x in sorted(zip(some["part"].to_pylist(), some["r"].to_pylist(), strict=True))])
        return pa.table({"part": pa.array([some["part"][0].as_py() // FAN], pa.int64()), "r": pa.array([np.linalg.qr(r, mode="r").tobytes()], pa.binary())})

    level = materialise(rows.mapInArrow(reduce, "part long, r binary"))
    while level.count() > 1:
        above = materialise(level.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merge, "part long, r binary"))
        forget(level)
        level = above
    r = np.frombuffer(bytes(level.first()["r"]), float).reshape(-1, dim)
    forget(level)
    return r


@dataclass(frozen=True)
class Whitening:
    fit: Fit
    #: Right vectors of the components as columns, roots of their eigenvalues (0: none) and shares of the variance.
    basis: np.ndarray
    roots: np.ndarray
    explained: tuple[float | None, ...]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components; NaN for those without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.roots > 0, self.fit.centred(x) @ self.basis / self.roots, np.nan)


def learnt(rows: DataFrame, components: int) -> Whitening | None:
    fit = exact_sums(rows)
    if fit is None:
        return None
    r = factor(rows, fit)
    _, s, vt = np.linalg.svd(np.vstack((r, np.zeros((max(0, fit.dim - len(r)), fit.dim)))))
    k = min(components, fit.dim)
    basis = vt[:k].T
    # The greatest entry of each vector is positive, so that reruns agree.
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    some = s[:k] > s[0] * fit.dim * np.finfo(float).eps
    total = float((s**2).sum())
    return Whitening(fit, basis, np.where(some, s[:k] / np.sqrt(fit.n), 0.0), tuple(float(v**2) / total if on else 0.0 for v, on in zip(s[:k], some, strict=True)) if total else (None,) * k)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; the rows are centred as they are."""
    on = np.flatnonzero(model.roots > 0)
    if not len(on):
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((len(on), len(on)))
        for b in batches:
            w = model.apply(vectors(b.column(1), model.fit.dim)[1])[:, on]
            g += w.T @ w
        i, j = np.indices(g.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(g.ravel())], ["i", "j", "v"])

    got = rows.mapInArrow(products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max(abs(r["v"] / model.fit.n - (r["i"] == r["j"])) for r in got)


def whiten(docs: DataFrame, components: int = 8, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n, deviation, whitened, explained, identity_error)`` for every row with a valid vector.

    ``whitened`` and ``explained`` hold the first ``components`` by falling eigenvalue.
    """
    rows = docs.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    model = learnt(rows, components)
    if model is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.roots)
        for b in batches:
            at, x = vectors(b.column(1), model.fit.dim)
            m = len(at)
            ends = pa.array(np.arange(0, (m + 1) * k, k), pa.int32())
            w = model.apply(x).ravel()
            lists = [pa.ListArray.from_arrays(ends, pa.array(w, pa.float64(), mask=np.isnan(w))), pa.ListArray.from_arrays(ends, pa.array(model.explained * m, pa.float64()))]
            cols = [b.column(0).take(pa.array(at)), pa.array([model.fit.n] * m, pa.int64()), pa.array(model.fit.deviation(x), pa.int64()), *lists, pa.array([error] * m, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, SCHEMA)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = whiten(table(spark, sf_dir, "embeddings")).select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error",
    )
