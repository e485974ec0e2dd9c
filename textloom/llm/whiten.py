"""Whitening of embeddings by shifted Cholesky QR.

The method: the centred rows A are never gathered. Each pass over them sums a Gram matrix of d x d numbers on the executors, the driver
factors it, and the next pass solves its rows against the factors so far by triangular solves: A = Q1 R1 with a shift that keeps the first
factorisation possible however the columns depend on one another, then Q1 = Q2 R2 and so on until Q is orthogonal to rounding.
The product R of the factors has the singular values and right singular vectors of A, without the squared condition number
that a plain Gram matrix would have. Only matrices of the vectors' own dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, stash

#: Steps per unit of an entry, components that are returned at most, passes at most, and the distance from orthogonality that ends them.
SCALE, COMPONENTS, PASSES, ENOUGH = 256, 4, 6, 1e-13
#: Directions with less than this share of the largest singular value hold rounding only.
RANK = 1e-12
#: Entries beyond this do not fit the exact arithmetic.
WIDEST = 1 << 52
POINT = "vec_id long, dim int, x array<bigint>"
ROW = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("part", pa.int64()), ("values", pa.list_(pa.float64()))])


def points(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, dim, x of the rows that take part: x are the entries in whole steps, rounded down."""
    v = F.transform(vectors[vector_col], lambda c: c.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(sound)
    steps = F.transform("v", lambda c: F.floor(c * scale))
    return rows.select("vec_id", F.size("v").alias("dim"), steps.alias("x"))


def summed(fit: DataFrame, part: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """By dimension, the sum over all rows of ``part(dim, x)``, a matrix for a batch of rows x.

    A task adds up its batches and emits one matrix row by row; rows of equal number are added up on the executors, in the order
    of their tasks. What comes to the driver is one matrix for each dimension.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        total: dict[int, np.ndarray] = {}
        for dim, _, x in by_dimension(batches):
            m = part(dim, x)
            total[dim] = total[dim] + m if dim in total else m
        for dim, m in sorted(total.items()):
            for start in range(0, len(m), 256):
                rows = m[start : start + 256]
                ids = np.arange(start, start + len(rows), dtype=np.int32)
                values = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * m.shape[1], rows.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array(ids), pa.array(np.full(len(rows), at, np.int64)), values], schema=ROW)

    rows = fit.select("dim", "x").mapInArrow(work, "dim int, i int, part long, values array<double>")
    several = F.sort_array(F.collect_list(F.struct("part", "values")))
    zero = F.transform(several[0]["values"], lambda v: F.lit(0.0))
    total = F.aggregate(several, zero, lambda acc, r: F.zip_with(acc, r["values"], lambda a, b: a + b))
    out: dict[int, dict[int, list[float]]] = {}
    for r in rows.groupBy("dim", "i").agg(total.alias("values")).toLocalIterator():
        out.setdefault(r["dim"], {})[r["i"]] = r["values"]
    return {dim: np.array([m[i] for i in sorted(m)]) for dim, m in out.items()}


def by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions in the batch, rows as a matrix of whole numbers) for the vectors of each batch."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        x = b.column("x")
        flat, offsets = x.values.to_numpy(), x.offsets.to_numpy()
        if len(flat) and max(-int(flat.min()), int(flat.max())) > WIDEST:
            raise OverflowError(f"entries beyond {WIDEST // SCALE} cannot be whitened exactly")
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            yield dim, at, flat[offsets[at][:, None] + np.arange(dim)]


@dataclass
class Whitening:
    """What a dimension's fit list says: its size, sums, components in rows by falling variance, variances and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n * x - sum) ** 2."""
        widest = max(abs(int(x.min())), abs(int(x.max())), 1) * self.n + max(map(abs, self.sums))
        kind = np.int64 if widest * widest * x.shape[1] < 1 << 63 else object
        d = x.astype(kind) * self.n - np.array(self.sums, kind)
        out = (d * d).sum(axis=1).tolist()
        if max(out) >= 1 << 63:
            raise OverflowError("a deviation does not fit in 64 bits")
        return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, from whole numbers as far as they are exact."""
    whole, rest = zip(*[divmod(s, n) for s in sums], strict=True)
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array(rest, np.float64) / n


def solved(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """a R1^-1 R2^-1 ... for upper triangular factors, column by column."""
    q = a.T.copy()
    for r in factors:
        for j in range(len(r)):
            q[j] = (q[j] - r[:j, j] @ q[:j]) / r[j, j]
    return q.T


def factor(gram: np.ndarray, rows: int, first: bool) -> np.ndarray:
    """The upper triangular Cholesky factor of ``gram``; shifted at first, and whenever it would break down."""
    d = len(gram)
    u = np.finfo(float).eps
    shift = 11 * (rows * d + d * (d + 1)) * u * np.linalg.norm(gram, 2)
    # The bound of the theory; with very many rows a far smaller shift does, and keeps the passes few.
    shift = max(min(shift, 1e-8 * np.linalg.norm(gram, 2)), np.finfo(float).tiny)
    if not first:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each dimension of ``vectors`` (dim, x): every distinct x once."""
    spark = vectors.sparkSession
    small_batches(spark)
    distinct = stash(vectors.select("dim", "x").distinct(), "distinct")
    counts = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    totals: dict[int, dict[int, int]] = {}
    for r in distinct.select("dim", F.posexplode("x").alias("i", "v")).groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).toLocalIterator():
        totals.setdefault(r["dim"], {})[r["i"]] = int(r["s"])
    sums = {dim: [s[i] for i in range(dim)] for dim, s in totals.items()}
    # A dimension with one distinct vector has no variance and no components.
    open_dims = {dim for dim, n in counts.items() if n > 1}
    factors: dict[int, list[np.ndarray]] = {dim: [] for dim in open_dims}
    last: dict[int, np.ndarray] = {}
    for k in range(PASSES):
        if not open_dims:
            break
        grams = summed(distinct.where(F.col("dim").isin(*open_dims)), gram_of(counts, sums, factors))
        for dim, g in grams.items():
            last[dim] = g
            scale = np.abs(g).max() if k == 0 else 1.0
            if scale == 0 or k > 1 and np.abs(g - np.eye(dim)).max() <= ENOUGH * dim or k == PASSES - 1:
                open_dims.discard(dim)
            else:
                factors[dim].append(factor(g, counts[dim], k == 0))
    models = {}
    for dim, g in last.items():
        # A = Q R and G = Q'Q, the identity but for rounding and for directions in which A has no extent: R is corrected by its root.
        r = np.eye(dim)
        for f in factors[dim]:
            r = f @ r
        w, e = np.linalg.eigh(g)
        _, s, vt = np.linalg.svd(np.sqrt(np.maximum(w, 0))[:, None] * (e.T @ r))
        top = min(components, int((s > RANK * s[0]).sum()) if s[0] > 0 else 0)
        v = vt[:top]
        v = v * np.sign(v[np.arange(top), np.abs(v).argmax(axis=1)])[:, None] if top else v
        n = counts[dim]
        models[dim] = Whitening(n, sums[dim], v, s[:top] ** 2 / n, float((s**2).sum() / n))
    fitted = {dim: m for dim, m in models.items() if len(m.variances)}
    if fitted:
        for dim, g in summed(distinct.where(F.col("dim").isin(*fitted)), identity_of(fitted)).items():
            m = fitted[dim]
            m.identity_error = float(np.abs(g[:-1] / m.n - np.outer(g[-1], g[-1]) / m.n**2 - np.eye(len(m.variances))).max())
    return fitted


def gram_of(counts: dict[int, int], sums: dict[int, list[int]], factors: dict[int, list[np.ndarray]]) -> Callable[[int, np.ndarray], np.ndarray]:
    known = {dim: list(f) for dim, f in factors.items()}

    def part(dim: int, x: np.ndarray) -> np.ndarray:
        q = solved(centred(x, counts[dim], sums[dim]), known[dim])
        return q.T @ q

    return part


def identity_of(models: dict[int, Whitening]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Products of the whitened components, and their sums as a last row."""

    def part(dim: int, x: np.ndarray) -> np.ndarray:
        w = models[dim].whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    return part


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries take no part. The model is fitted on each distinct vector of whole
    steps once, vectors of another length for themselves. There are as many components as asked for, or as the fit list has directions
    with variance, if fewer: equal vectors alone give no rows, as does an empty table. Components of equal variance come in either order.
    Rows with null or equal ids stay rows; other columns are ignored. A deviation beyond 64 bits is an error.
    """
    rows = stash(points(vectors, id_col, vector_col, scale), "points")
    models = fit(rows, components)
    if not models:
        return rows.where("false").selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    # One matrix of ``components`` rows for each length of a vector, however many vectors there are.
    known = vectors.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, x in by_dimension([b]):
                m = known.value.get(dim)
                if m is None:
                    continue
                top = len(m.variances)
                ids = b.column("vec_id").take(pa.array(np.repeat(at, top)))
                each = lambda values: pa.array(np.tile(values, len(at)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        each(np.arange(1, top + 1, dtype=np.int32)),
                        each(np.full(top, m.n, np.int64)),
                        pa.array(np.repeat(np.array(m.deviations(x), np.int64), top)),
                        pa.array(m.whitened(x).ravel()),
                        each(m.variances / m.trace),
                        each(np.full(top, m.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(work, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
