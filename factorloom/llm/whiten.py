"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The fit list holds each distinct vector once, as integers. A step multiplies the centred rows by a direction and
the result by their transpose, in one pass over the fit list: every task gives a vector as wide as the embedding, so nothing
grows with the rows. A left vector u = Xt is held by its small image t; its products with the earlier left vectors
follow from the vectors X'u at hand, so both sides are reorthogonalised against all earlier vectors, twice, without a
further pass. The triangle of all coefficients, bidiagonal but for rounding and for fresh starts, has as its singular values
and vectors the deviations and components. A direction that leads nowhere, and the first convergence before all
dimensions are spanned, give a fresh start from a vector orthogonal to all others: so equal eigenvalues are found as
often as they occur.

Rows: a vector that is null, empty or has a null or non-finite component takes no part; vectors of each length are a
table of their own; repeated vectors count once in the fit and each give their rows; a direction whose variance is under
1e-12 of the largest is no component, so one distinct vector, and an empty table, give no rows; a null id stays
null. Only vec_id and embedding are read. floor(64 c) must fit in 40 bits; a deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from factorloom.llm import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Residual of a component, as a share of the largest singular value, at which it has converged.
CONVERGED = 1e-14
#: Singular values under this share of the largest are none.
NOTHING = 1e-6

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """n, the sums of the fit list, components as columns, deviations (roots of the eigenvalues), shares of the trace."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    spread: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return x * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n) @ self.axes / self.spread


def rows_of(vectors: DataFrame) -> DataFrame:
    """Usable rows as integers: vec_id, x."""
    c = F.col("embedding")
    usable = (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda e: F.floor(F.lit(SCALE) * e.cast("double")).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(fit: DataFrame, width: int, out: int, part: object, kind: str = "double") -> np.ndarray:
    """The sum over all rows of what `part` makes of a block of them, `out` numbers wide; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(out, np.int64 if kind == "long" else float)
        for batch in batches:
            total += part(matrix(batch.column("x"), width))
        yield pa.record_batch([pa.array(np.arange(out, dtype=np.int32)), pa.array(total)], ["i", "v"])

    got = fit.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(out, np.int64 if kind == "long" else float)
    total[got["i"].to_numpy()] = got["v"].to_numpy()
    return total


def fresh(rng: np.random.Generator, basis: np.ndarray) -> np.ndarray:
    """A random unit vector orthogonal to the columns."""
    v = rng.standard_normal(len(basis))
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
        v /= np.linalg.norm(v)
    return v


def fitted(fit: DataFrame, n: int, width: int, components: int = COMPONENTS) -> Whitening:
    """Components of the fit list of `n` distinct vectors (column x) of one length."""
    sums = summed(fit, width, width, lambda x: x.sum(axis=0), "long")
    centred = lambda x: (x * n - sums) / n
    trace = float(summed(fit, width, 1, lambda x: np.square(centred(x)).sum(keepdims=True).ravel())[0])
    none = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    if trace <= 0:
        return none

    def products(t: np.ndarray) -> tuple[float, np.ndarray]:
        """Length of Xt, and X'Xt over it."""

        def block(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            u = c @ t
            return np.append(u @ c, u @ u)

        got = summed(fit, width, width + 1, block)
        length = float(np.sqrt(got[-1]))
        return length, got[:-1] / length if length > 0 else got[:-1]

    rng = np.random.default_rng(5)
    v, t_all, z = (np.zeros((width, 0)) for _ in range(3))  # right vectors, images of the left ones, X' times the left ones
    r = np.zeros((0, 0))
    tiny = 1e-13 * np.sqrt(trace)
    known: np.ndarray | None = None
    ahead = fresh(rng, v)
    while True:
        t, c = ahead, np.zeros(v.shape[1])
        for _ in range(2):  # the left vector Xt against all earlier ones
            d = z.T @ t
            t, c = t - t_all @ d, c + d
        length, back = products(t)
        grown = np.zeros((len(r) + 1, len(r) + 1))
        grown[:-1, :-1], grown[:-1, -1] = r, c
        if length > tiny:
            grown[-1, -1] = length
        else:
            t, back = np.zeros(width), np.zeros(width)
        r, v = grown, np.column_stack([v, ahead])
        t_all, z = np.column_stack([t_all, t / length if length > tiny else t]), np.column_stack([z, back])
        if v.shape[1] == width:
            break
        left, values, _ = np.linalg.svd(r)
        rest = z - v @ (v.T @ z)
        open_ends = np.linalg.norm(rest @ left[:, :components], axis=0)
        beta = np.linalg.norm(rest[:, -1])
        if len(values) >= components and (open_ends <= CONVERGED * values[0]).all():
            if known is not None and np.allclose(known, values[:components], rtol=1e-12, atol=1e-12 * values[0]):
                break
            known, ahead = values[:components], fresh(rng, v)
        elif beta <= tiny:
            ahead = fresh(rng, v)
        else:
            ahead = rest[:, -1] / beta
            ahead = ahead - v @ (v.T @ ahead)
            ahead /= np.linalg.norm(ahead)
    _, values, right = np.linalg.svd(r)
    own = values[:components] > NOTHING * values[0]
    axes = v @ right[:components].T[:, own]
    axes /= np.linalg.norm(axes, axis=0)
    model = Whitening(n, sums, axes, values[:components][own] / np.sqrt(n), np.square(values[:components][own]) / trace)
    k = axes.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        y = model.whitened(x)
        return np.append((y.T @ y).ravel(), y.sum(axis=0))

    got = summed(fit, width, k * k + k, moments) / n
    mean = got[k * k :]
    model.identity_error = float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    return model


def squares(dev: np.ndarray) -> pa.Array:
    """Sum of squares of each row as a long, null beyond it."""
    if dev.size == 0 or float(np.abs(dev).max()) ** 2 * dev.shape[1] < 2**63:
        return pa.array((dev * dev).sum(axis=1), pa.int64())
    exact = (dev.astype(object) ** 2).sum(axis=1)
    return pa.array([int(e) if e < 2**63 else None for e in exact], pa.int64())


def scored(rows: DataFrame, model: Whitening, width: int) -> DataFrame:
    """A row for each vector and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.spread)
        for batch in batches:
            if not k:
                continue
            x = matrix(batch.column("x"), width)
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            flat = [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), squares(model.deviations(x)).take(at)]
            flat += [pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))]
            yield pa.record_batch(flat, RESULT.replace(",", "").split()[::2])

    return rows.mapInArrow(run, RESULT)


def whiten(vectors: DataFrame, folder: str, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    The number of vector lengths is small; each has a fit of its own.
    """
    rows = rows_of(vectors)
    common.bounded(rows.sparkSession)
    distinct = common.written(rows.groupBy("x").agg(F.size("x").alias("width")).select("x", "width"), f"{folder}/fit")
    sizes: list[Row] = distinct.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect()
    out = rows.sparkSession.createDataFrame([], RESULT)
    for k, (width, n) in enumerate(sizes):
        one = scored(rows.where(F.size("x") == width), fitted(distinct.where(F.col("width") == width), n, width, components), width)
        out = one if not k else out.unionByName(one)
    return out
