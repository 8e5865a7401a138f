"""Embedding whitening by TSQR: no covariance matrix of the input is formed.

1.  Sums of the entries, as whole numbers x = floor(scale * c) + shift, are exact: 64-bit within a batch, decimal beyond.
2.  Rows are centred by those sums: (n * x - S) / n, whose numerator is exact.  Each partition folds its rows into a
    triangular factor R by QR, a bounded block of rows at a time.
3.  R factors are stacked and factored again, ``FAN`` at a time, until one is left: a tree of its logarithm's depth.
4.  The SVD of that R gives the principal directions (right vectors) and eigenvalues (squared singular values / n).

What a task or the driver holds are matrices of dims x dims, whatever the number of rows.

Rows whose vector is null or has null or non-finite entries are left out, and so are entries of 2^48 / scale and more,
and vectors of another length than most have (of equally many: the longer).  Directions whose eigenvalue is zero to working precision can't be whitened and
are left out.  ``deviation`` beyond a 64-bit number is null.  Repeated and null ids return their rows each; an empty table,
or one of equal vectors, gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, stored

SCALE, SHIFT = 64, 1_000_000
#: Bound of scaled entries, so that a batch's sums stay within 64 bits.
LARGEST = float(1 << 48)
COMPONENTS = 32
#: R factors merged in a task; rows folded into R at a time.
FAN, ROWS = 16, 4096
_LONG = 2**63 - 1


@dataclass
class Whitener:
    """n, exact sums S per dimension, directions (dims x k), and eigenvalues (k) with the trace of the covariance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """(n * x - S) / n for rows of whole numbers."""
        return numerators(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.directions) / np.sqrt(self.values)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: in 64 bits where these hold it, else as Python's numbers."""
    if int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0) < _LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 of each row."""
    d = numerators(x, n, sums)
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 2**62:
        return (d * d).sum(1).tolist()
    return [v if v <= _LONG else None for v in (sum(int(v) ** 2 for v in row) for row in d)]


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is complete and finite."""
    c = F.col(vector_col)
    entry = lambda v: v.cast("double")
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(entry(v)) & (F.abs(entry(v)) * scale < LARGEST))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(entry(v) * scale).cast("long") + shift).alias("x"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def fit(x: DataFrame, components: int = COMPONENTS, fan: int = FAN) -> Whitener | None:
    """The whitener of a table with a column x of whole numbers, all of one length; None where nothing varies."""

    def totals(batches):
        for b in batches:
            if b.num_rows:
                yield batch_of(pa.schema([("n", pa.int64()), ("s", pa.list_(pa.int64()))]), [b.num_rows], [_matrix(b.column(0)).sum(0)])

    parts = x.select("x").mapInArrow(totals, "n long, s array<long>").select("n", F.posexplode("s").alias("d", "s"))
    sums = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()  # a row per dimension
    if not sums:
        return None
    n, s = int(sums[0].n), [int(r.s) for r in sums]
    dims = len(s)
    base = Whitener(n, s, np.zeros((dims, 0)), np.zeros(0), 0.0)
    schema = pa.schema([("part", pa.int64()), ("r", pa.binary())])

    def fold(batches):
        r = np.zeros((0, dims))
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                r = np.linalg.qr(np.concatenate([r, base.centred(_matrix(b.column(0).slice(at, ROWS)))]), mode="r")
        if len(r):
            yield batch_of(schema, [TaskContext.get().partitionId()], [r.tobytes()])

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.concatenate([np.frombuffer(r).reshape(-1, dims) for r in pdf.sort_values("part").r])
        return pd.DataFrame({"part": [int(key[0])], "r": [np.linalg.qr(stack, mode="r").tobytes()]})

    factors = stored(x.select("x").mapInArrow(fold, "part long, r binary"), "whitening-r")
    last = factors.agg(F.max("part")).first()[0]
    while last > 0:
        last //= fan
        factors = factors.groupBy(F.floor(F.col("part") / fan).alias("up")).applyInPandas(merge, "part long, r binary")
    final = np.frombuffer(factors.first().r).reshape(-1, dims)
    _, singular, right = np.linalg.svd(final, full_matrices=False)
    values = singular**2 / n
    k = int(min(components, (singular > singular[:1].max(initial=0) * np.finfo(float).eps * max(dims, 1)).sum()))
    return Whitener(n, s, right[:k].T.copy(), values[:k], float(values.sum())) if k else None


def identity_error(x: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from sums per partition."""
    k = len(model.values)
    schema = pa.schema([("s", pa.list_(pa.float64()))])

    def sums(batches):
        total = np.zeros(k + k * k)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                w = model.whitened(_matrix(b.column(0).slice(at, ROWS)))
                total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield batch_of(schema, [total])

    rows = x.select("x").mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # k + k * k numbers
    total = np.array([r.s for r in rows]) / model.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, fan: int = FAN) -> DataFrame:
    """A row per remaining vector and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = whole_numbers(rows, id_col, vector_col, scale, shift)
    lengths = x.groupBy(F.size("x").alias("dims")).count().agg(F.max(F.struct("count", "dims")).alias("m")).first().m
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = None
    if lengths is not None:
        x = x.where(F.size("x") == lengths.dims)
        model = fit(x, components, fan)
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    error, k = identity_error(x, model), len(model.values)
    explained = model.values / model.trace
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                m, own = part.num_rows, _matrix(part.column(1))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                far = pa.array(deviations(own, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield batch_of(schema, ids, np.tile(np.arange(1, k + 1), m), np.full(m * k, model.n), far, model.whitened(own).ravel(), np.tile(explained, m), np.full(m * k, error))

    return x.select("vec_id", "x").mapInArrow(project, out)
